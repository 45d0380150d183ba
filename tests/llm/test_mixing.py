import math
import random
from collections import Counter

import pytest

from quarrygraph.llm import mixing
from tests.llm.conftest import odd_rows


def corpus(docs_of, seed=3, n=1200):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = "hot" if rng.random() < 0.4 else f"s{rng.randrange(6)}"
        text = "w " * rng.randrange(1, 30 if source != "s0" else 8)
        rows.append((i, text, "en", source, len(text)))
    return rows, docs_of(rows)


def shares(rows):
    t = Counter()
    for _, text, _, source, _ in rows:
        t[source] += len(text.split())
    return t


@pytest.mark.parametrize("limit", [1.0, 1.5, 2.0, 50.0])
def test_repetition_limit(docs_of, limit):
    rows, docs = corpus(docs_of)
    t = shares(rows)
    got = mixing.mix(docs, limit).collect()
    taken, tokens = Counter(r.doc_id for r in got), Counter()
    for r in got:
        tokens[r.source] += r.n_tokens
    epochs = {s: tokens[s] / t[s] for s in t}
    assert set(taken) == {r[0] for r in rows}  # every document at least once
    assert max(epochs.values()) <= limit + 0.02 * limit + 30 / min(t.values()) and min(epochs.values()) >= 1
    spread = max(t.values()) / min(t.values())
    a = max(0.0, 1 - math.log(limit) / math.log(spread))
    for s in t:  # weights are the shares to the power a
        assert abs(epochs[s] - (max(t.values()) / t[s]) ** (1 - a)) < 0.01 + 30 / t[s]
    # whole epochs take each row once, the last, partial one takes some
    for s in t:
        count = [taken[r[0]] for r in rows if r[3] == s]
        assert max(count) - min(count) <= 1


def test_target_entropy(docs_of):
    rows, docs = corpus(docs_of)
    t = shares(rows)
    p = [x / sum(t.values()) for x in t.values()]
    own, top = -sum(x * math.log(x) for x in p), math.log(len(p))
    spark = docs.sparkSession
    sources = spark.createDataFrame(list(t.items()), "source string, n_tokens long")
    target = (own + top) / 2
    a = mixing.exponent(sources, target_entropy=target)
    w = [x**a for x in p]
    w = [x / sum(w) for x in w]
    assert abs(-sum(x * math.log(x) for x in w) - target) < 1e-6
    assert mixing.exponent(sources, target_entropy=top + 1) == 0.0 and mixing.exponent(sources, target_entropy=own / 2) == 1.0


def test_budget(docs_of):
    rows, docs = corpus(docs_of)
    total = sum(shares(rows).values())
    for budget in (total // 3, total, 3 * total):
        got = sum(r.n_tokens for r in mixing.mix(docs, 2.0, budget=budget).collect())
        assert abs(got - budget) <= 30 * 7


def order(r):
    return r.epoch, r.turn, r.block, r.place


def test_epochs_are_different_permutations_of_blocks(docs_of, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 8)
    rows, docs = corpus(docs_of)
    got = sorted(mixing.mix(docs, 2.0, budget=5 * sum(shares(rows).values())).filter("source = 's1'").collect(), key=order)
    each = {e: [r.doc_id for r in got if r.epoch == e] for e in (1, 2)}
    blocks = {e: list(dict.fromkeys(r.block for r in got if r.epoch == e)) for e in (1, 2)}
    assert sorted(each[1]) == sorted(each[2]) and each[1] != each[2]
    assert sorted(blocks[1]) == sorted(blocks[2]) and blocks[1] != blocks[2] and len(blocks[1]) > 5
    assert all(len({r.block for r in got if r.doc_id == i}) == 1 for i in each[1])  # a row's block is the same in every epoch


@pytest.mark.parametrize(("size", "group"), [(1024, 1024), (8, 4), (3, 2)])
def test_taken_rows_against_brute_force(docs_of, monkeypatch, size, group):
    """Rows of the partial epoch are the head of that epoch's whole order, up to the first row that spends the budget."""
    monkeypatch.setattr(mixing, "BLOCK_ROWS", size)
    monkeypatch.setattr(mixing, "GROUP", group)
    rows, docs = corpus(docs_of)
    t = shares(rows)
    got = mixing.mix(docs, 2.0).collect()
    whole = mixing.mix(docs, 2.0, budget=9 * sum(t.values())).collect()
    spread = max(t.values()) / min(t.values())
    a = max(0.0, 1 - math.log(2) / math.log(spread))
    expected = Counter()
    for s in t:
        epochs = (max(t.values()) / t[s]) ** (1 - a)
        full = math.floor(epochs + 1e-6)
        left = max(0.0, (epochs - full) * t[s])
        for e in range(1, full + 2):
            for r in sorted((r for r in whole if r.source == s and r.epoch == e), key=order):
                if e <= full or left > 0.5:
                    expected[r.doc_id, e] += 1
                if e > full:
                    left -= r.n_tokens
    assert Counter((r.doc_id, r.epoch) for r in got) == expected


def test_odd_rows(odd, docs_of, clashing):
    got = mixing.mix(odd, 2.0)
    assert {r.doc_id for r in got.collect()} == {i for i, _ in odd_rows()}
    assert mixing.mixture(odd, 2.0).columns == odd.columns and mixing.mixture(odd, 2.0).count() == got.count()
    assert mixing.mixture(clashing).columns == clashing.columns and mixing.mixture(clashing).count() >= 2
    assert mixing.mix(docs_of([])).count() == 0 and mixing.mixture(docs_of([])).count() == 0
    blank = docs_of([(1, None, "en", None, 0), (2, " ", "en", None, 0), (3, "a b", "en", None, 3)])
    assert sorted(r.doc_id for r in mixing.mix(blank).collect()) == [1, 2, 3]
    assert sorted(r.doc_id for r in mixing.mix(docs_of([(1, None), (2, "")])).collect()) == [1, 2]
