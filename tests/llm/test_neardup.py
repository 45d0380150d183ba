import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quarrygraph.llm import components, neardup
from quarrygraph.llm.common import text_slices
from tests.llm.conftest import odd_rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingle_set(text, size):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, size, percent):
    """component of each id; a set for each id."""
    sets = {i: shingle_set(t, size) for i, t in rows if i is not None}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        k = rng.randrange(len(w))
        w[k] = rng.choice(["zap", "zip", "zop"]) + str(rng.randrange(99))
    return " ".join(w)


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(i, text(rng.randrange(1, 120))) for i in range(120)]
    base = text(90)
    rows += [(200 + i, edited(rng, base, rng.randrange(6))) for i in range(90)]  # around the threshold, most pairs unlinked
    passage = text(60)
    rows += [(300 + i, text(20) + " " + passage + " " + text(20)) for i in range(40)]  # a common passage
    rows += [(400 + i, rows[3][1].upper()) for i in range(30)]  # copies in other case
    return rows


@pytest.mark.parametrize("size", [4, 5])
def test_against_brute_force(docs_of, size):
    rows = corpus()
    component, n = brute(rows, size, 80)
    got = neardup.near_duplicates(docs_of(rows), size, 80).collect()
    assert {r.doc_id: r.component_id for r in got} == component
    assert {r.doc_id: r.n_shingles for r in got} == n
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_small_blocks_give_the_same(docs_of, monkeypatch):
    rows = corpus(2)
    for name, value in {"BLOCK": 7, "BLOCK_SIGNATURES": 7, "PASSING": 5, "COLUMNS": 16, "SLOT": 5}.items():
        monkeypatch.setattr(neardup, name, value)
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs_of(rows), 4, 80).collect()} == brute(rows, 4, 80)[0]


def test_what_neighbourhoods_miss_is_compared_across(docs_of, monkeypatch):
    rows = corpus(3)
    # no neighbourhood forms, so every link must come from the comparison across
    monkeypatch.setattr(neardup, "_near", lambda pairs, classes: pairs.filter("a < 0").withColumn("apart", neardup.F.col("a")))
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs_of(rows), 4, 80).collect()} == brute(rows, 4, 80)[0]


def test_what_hubs_miss_is_compared_within(docs_of, monkeypatch):
    rows = corpus(4)
    # no class is linked to its hub, so every link must come from the blocks of its neighbourhood
    confirm = neardup._confirm
    calls = []

    def none_at_first(pairs, *rest):
        calls.append(1)
        return confirm(pairs.filter("a < 0") if len(calls) == 1 else pairs, *rest)

    monkeypatch.setattr(neardup, "_confirm", none_at_first)
    monkeypatch.setattr(neardup, "BLOCK", 9)
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs_of(rows), 4, 80).collect()} == brute(rows, 4, 80)[0]
    assert len(calls) == 2


def test_sizes_of_intersections():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40))).astype(np.uint64) for _ in range(20)]
    got = neardup._shared(sets[:12], sets[12:])
    assert got.tolist() == [[len(np.intersect1d(x, y)) for y in sets[12:]] for x in sets[:12]]
    assert neardup._shared([np.zeros(0, np.uint64)], [np.ones(3, np.uint64)]).tolist() == [[0]]


def test_rows_of_one_id_count_by_the_least_digest(docs_of):
    rng = random.Random(12)
    text = lambda: " ".join(f"q{rng.randrange(500)}" for _ in range(60))
    a, b = text(), text()
    rows = [(1, a), (2, a + " x"), (3, b + " y"), (9, a), (9, b)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs_of(rows), 4, 80).collect()}
    digest = {r.text: (r.d1, r.d2) for r in neardup.profile(docs_of([(9, a), (9, b)]), 4, text=True).collect()}
    assert got == ({1: 1, 2: 1, 3: 3, 9: 1} if digest[a] < digest[b] else {1: 1, 2: 1, 3: 3, 9: 3})


def test_odd_rows(odd):
    got = {r.doc_id: r for r in neardup.near_duplicates(odd, 4, 80).collect()}
    assert {i: r.component_id for i, r in got.items()} == {None: None, **brute(odd_rows(), 4, 80)[0]}
    assert got[None].kept and got[1].n_shingles == got[2].n_shingles == got[3].n_shingles == 0 and got[4].n_shingles == 1 and not got[6].kept


@pytest.mark.parametrize("most", [10**6, 0])
def test_keep_one(docs_of, odd, clashing, monkeypatch, most):
    monkeypatch.setattr(neardup, "BROADCAST_IDS", most)
    kept = neardup.keep_one(odd, 4)
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 9] and kept.columns == odd.columns
    assert neardup.keep_one(clashing).columns == clashing.columns and neardup.keep_one(clashing).count() == 2
    assert neardup.keep_one(docs_of([])).count() == 0 and neardup.near_duplicates(docs_of([])).count() == 0


def test_pigeonhole():
    """Signatures that differ in up to 2 * CHUNKS - 1 symbols share a key."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = rng.integers(0, 65536, neardup.SYMBOLS).astype(np.uint16)
        b = a.copy()
        at = rng.choice(neardup.SYMBOLS, 2 * neardup.CHUNKS - 1, replace=False)
        b[at] = b[at] + 1
        assert (neardup.keys(a[None])[0] == neardup.keys(b[None])[0]).any()


def test_shingles_of_rows():
    texts = ["a b c d e", "", "A  B\tc d E", "a b", "a b c d a b c d"]
    column = pa.array(texts)
    (_, _, data, at), *rest = list(text_slices(column))
    assert not rest
    h, n = neardup.shingles(data, at, 4)
    assert n.tolist() == [2, 0, 2, 1, 4] and (h[:2] == h[2:4]).all()


@pytest.mark.parametrize("most", [10**6, 0])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(components, "TASK_EDGES", most)
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 80)] + [(7, 7)]
    up = {}

    def root(i):
        up.setdefault(i, i)
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        if a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: root(i) for i in up}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
