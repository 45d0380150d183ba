import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrygraph.llm import divergence, oracles
from tests.llm.conftest import odd_rows


def brute(rows, least=30, most=50):
    """rows: (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    docs, n, group = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        docs[lang].update(set(terms))
        n[lang].update(terms)
        group[lang, source].update(terms)
    out = set()
    for lang in {r[1] for r in rows}:
        kept = [t for t, k in docs[lang].items() if k >= least]
        sources = [s for x, s in group if x == lang]
        total = {s: sum(group[lang, s][t] for t in kept) for s in sources}
        p = lambda k, of: 1 + 10**9 * (k + 5) // (of + 5 * len(kept))  # noqa: B023, E731
        share = {s: [p(group[lang, s][t], total[s]) for t in kept] for s in sources}
        base = [p(n[lang][t], sum(n[lang][u] for u in kept)) for t in kept]
        for s in sources:
            far = sorted((-sum(abs(a - b) for a, b in zip(share[s], share[o], strict=True)), o.encode(), o) for o in sources if o != s)
            out |= {(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(far, 1)}
            high = sorted((b - a, t.encode(), t) for t, a, b in zip(kept, share[s], base, strict=True) if group[lang, s][t] and a > b)
            out |= {(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(high[:most], 1)}
    return out


def found(df):
    got = df.collect()
    out = {(r.lang, r.source, r.part, r.item, r.value, r.rank) for r in got}
    assert len(out) == len(got)
    return out


def sample(n=400, seed=2):
    rng = random.Random(seed)
    words = [f"w{a}{b}" for a in "abcdefghijklmnopqrstuvwxyz" for b in ("x", "yé", "ÉY", "z漢")] + ["Tie" + c * k for c in "abcdefghijklmno" for k in (1, 2, 3)]
    out = []
    for _ in range(n):
        source = rng.choice(["hot", "hot", "hot", "s1", "s2", None, ""])
        pool = words if source == "hot" else words[:: 2 if source == "s1" else 1]
        text = rng.choice([" ", "-", "7", "\n"]).join(rng.choice(pool) for _ in range(rng.randrange(0, 90)))
        out.append((rng.choice([text, text, text.upper(), None]), rng.choice(["en", "en", "en", "fr", None]), source))
    return [*out, ("one alone", "xx", "only"), (None, "yy", "a"), ("", "yy", "b")]


@pytest.fixture(scope="module")
def case(docs_of):
    rows = sample()
    return rows, docs_of([(i, t, lang, s, 0) for i, (t, lang, s) in enumerate(rows)])


def test_against_brute_force(case):
    rows, docs = case
    want = brute(rows)
    assert found(divergence.audit(docs)) == want and {w[2] for w in want} == {"pair", "term"} and max(w[5] for w in want if w[2] == "term") == 50
    assert ("yy", "a", "pair", "b", 0, 1) in want and not any(w[0] == "xx" for w in want)


def test_sql_agrees(case):
    rows, docs = case
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (text VARCHAR, lang VARCHAR, source VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    got = duck.execute(oracles.DIVERGENCE)
    names = [x[0] for x in got.description]
    at = [names.index(x) for x in ("lang", "source", "part", "item", "value", "rank")]
    assert {tuple(r[i] for i in at) for r in got.fetchall()} == found(divergence.audit(docs))


@pytest.mark.parametrize("bound", ["BUCKET_TERMS", "BROADCAST_ROWS"])
def test_small_buckets_and_no_broadcast(case, monkeypatch, bound):
    rows, docs = case
    monkeypatch.setattr(divergence, bound, 3)
    assert found(divergence.audit(docs)) == brute(rows)


def test_ties_go_by_bytes(spark):
    """More ties than are needed at the kth value, told apart by their third and later bytes only."""
    rng = random.Random(4)
    rows = [("l", f"s{g}", "same" * (g + 1) + "".join(rng.choice("abé漢") for _ in range(6)) + str(i), rng.choice([5, 5, 5, 2**30 - 1, 1 << 20, 1 << 10]) if g else 7) for g in range(4) for i in range(90 if g else 60)]
    rows += [("l", "few", x, 1) for x in ("a", "ab", "b")] + [("l", "exact", f"x{i:02}", 3) for i in range(50)]
    table = spark.createDataFrame(rows, "lang string, source string, item string, value long").repartition(5)
    got = defaultdict(set)
    for r in divergence.top(table).collect():
        got[r.source].add(r.item)
    for s in {r[1] for r in rows}:
        own = sorted((-v, x.encode(), x) for _, g, x, v in rows if g == s)
        assert got[s] == {x for *_, x in own[:50]}, s


def test_shares_stay_exact(spark):
    cases = [(0, 0, 1), (10**12, 10**14, 10**6), (2 * 10**14, 2 * 10**14, 10**7), (7, 99, 13), (3, 3, 1)]
    got = spark.createDataFrame(cases, "n long, total long, terms long").select("n", "total", "terms", divergence.share(*(divergence.F.col(c) for c in ("n", "total", "terms"))).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.n + 5) // (r.total + 5 * r.terms) for r in got)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcdefg"), st.sampled_from("pqrs"), st.integers(1, 10**9)), unique_by=lambda c: c[:2], max_size=28), st.lists(st.integers(1, 1000), min_size=4, max_size=4))
def test_pair_sums(cells, base):
    terms = sorted({c[0] for c in cells})
    dense = np.array([[dict(((t, s), p) for t, s, p in cells).get((t, s), base[k]) for k, s in enumerate("pqrs")] for t in terms], np.int64).reshape(len(terms), 4)
    want = np.abs(dense[:, :, None] - dense[:, None, :]).sum(0)
    got = divergence.pair_sums([c[0] for c in cells], [c[1] for c in cells], np.array([c[2] for c in cells], np.int64), list("pqrs"), np.array(base, np.int64))
    assert (got == want).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZé漢-[`{@A 1\x00\x7f😀"), max_size=12), max_size=8))
def test_terms(texts):
    raw = [t.encode() for t in texts]
    data, at = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    terms, owner = divergence.term_array(data, at)
    want = [(i, re.sub("[A-Z]", lambda m: m[0].lower(), x)) for i, t in enumerate(texts) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)]
    assert list(zip(owner.tolist(), terms.to_pylist(), strict=True)) == want


def test_odd_rows(odd, monkeypatch):
    monkeypatch.setattr(divergence, "LEAST_DOCS", 2)
    rows = [(t, "en", f"s{(i or 0) % 3}") for i, t, *_ in odd_rows()]
    assert found(divergence.audit(odd)) == brute(rows, 2)


def test_empty_and_clashing(docs_of, clashing, monkeypatch):
    assert divergence.audit(docs_of([(1, "a")]).limit(0)).count() == 0
    monkeypatch.setattr(divergence, "LEAST_DOCS", 1)
    assert found(divergence.audit(clashing)) == brute([("some words stand here", "en", "a"), ("other words stand there", "en", "b")], 1)
