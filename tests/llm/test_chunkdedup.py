import random
import re
from collections import defaultdict

import numpy as np
import pytest

from quarrygraph.llm import chunkdedup
from tests.llm.conftest import odd_rows

N = chunkdedup.MIN_WORDS


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows):
    """Words of each document that lie in a window of N words which another document has too."""
    rows = list({(i, t) for i, t in rows if i is not None})
    where = defaultdict(set)
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - N + 1):
            where[tuple(w[k : k + N])].add(i)
    out = defaultdict(set)
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - N + 1):
            if len(where[tuple(w[k : k + N])]) > 1:
                out[i].update(range(k, k + N))
    return dict(out)


def spans(df):
    out = defaultdict(set)
    for r in df.collect():
        out[r.doc_id].update(range(r.start_word, r.start_word + r.n_words))
    return dict(out)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(i, text(rng.randrange(10, 300))) for i in range(60)]
    for n in (49, 50, 51, 52, 60, 75, 120):
        passage = text(n)
        for _ in range(3):
            rows.append((len(rows), f"{text(rng.randrange(0, 60))} {passage}\n{text(rng.randrange(0, 60))}"))
    rows += [(1000 + i, rows[1][1]) for i in range(5)]  # exact copies
    base = text(200).split()
    for i in range(12):  # near copies
        w = list(base)
        for _ in range(3):
            w[rng.randrange(200)] = "edited"
        rows.append((2000 + i, " ".join(w)))
    line = text(30)
    rows += [(3000 + i, f"{text(40)} {line} {text(40)}") for i in range(20)]  # too short to count
    inside = text(60)
    rows.append((4000, f"{inside} {inside}"))  # repeated within itself only
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(docs_of, seed):
    rows = corpus(seed)
    assert spans(chunkdedup.repeated_passages(docs_of(rows))) == brute(rows)


def test_insertions_move_no_distant_cut():
    rng = np.random.default_rng(5)
    w = rng.integers(0, 1 << 62, 600).astype(np.uint64)
    cut = set(chunkdedup.cuts(w, np.array([600])).tolist())
    longer = np.concatenate([w[:300], w[:5], w[300:]])
    moved = {c if c < 300 else c - 5 for c in chunkdedup.cuts(longer, np.array([605])).tolist() if not 260 < c < 345}
    assert moved == {c for c in cut if not 260 < c < 340} and max(np.diff(sorted(cut))) <= chunkdedup.SPREAD


def test_cuts_by_definition():
    rng = np.random.default_rng(6)
    for n in (0, 3, 10, 24, 60, 200):
        w = rng.integers(0, 40, n).astype(np.uint64)
        h = chunkdedup.gear(w) if n else w
        expected = set()
        for s in range(chunkdedup.MEMORY - 1, n - chunkdedup.SPREAD + 1):
            run = h[s : s + chunkdedup.SPREAD]
            expected |= {s + k for k in np.flatnonzero(run == run.min())}
        assert set(chunkdedup.cuts(w, np.array([n])).tolist()) == expected


def test_odd_rows(odd, docs_of, clashing):
    assert spans(chunkdedup.repeated_passages(odd)) == brute(odd_rows())
    assert chunkdedup.repeated_passages(docs_of([])).count() == 0 and chunkdedup.repeated_passages(clashing).count() == 0
