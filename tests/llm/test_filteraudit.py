import random
import re
from collections import defaultdict
from itertools import permutations

import duckdb
import pytest

from quarrygraph.llm import filteraudit, oracles
from tests.llm.conftest import odd_rows

LABELS = "doc_id long, quality int, toxic int"
NAMES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(docs, labels):
    """Every order is run over every document."""
    docs = [(i, t or "", s or "") for i, t, s in docs]
    fails = []
    for i, t, _ in docs:
        w = [x for x in re.split("[ \t\n\x0b\x0c\r]+", t) if x]
        f = "A" if len(w) < 200 else ""
        f += "B" if 100 * len(set(w)) < 50 * len(w) else ""
        f += "C" if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else ""
        f += "D" if set("#$%&*|") & set(t) else ""
        f += "E" if i is not None and any(j is not None and j < i and u == t for j, u, _ in docs) else ""
        fails.append(f)
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    out = {}
    for part in {s for *_, s in docs}:
        own = [(i, f) for (i, _, s), f in zip(docs, fails, strict=True) if s == part]
        total = defaultdict(int)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                total[x] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(x in f for _, f in own) - len(gone), sum(f == x for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


def found(df):
    return {(r.part, r.filter_order, r.step): [r[n] for n in NAMES] for r in df.collect()}


def sample(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.choice([0, 5, 199, 200, 230]))] + ["same"] * rng.choice([0, 0, 150, 240])
        text = " ".join(words) + rng.choice(["", "", " #", " ABCDEFGHIJKLMNOPQRSTUVWXYZ", "\n|"])
        out.append((i, rng.choice([text, "a copy", None]), rng.choice(["hot", "hot", "hot", None, "", "s1"])))
    return out


@pytest.fixture(scope="module")
def case(docs_of, spark):
    rows = sample(60)
    labels = [(i, i % 3 == 0, i % 4 == 0) for i in range(0, 60, 2)] + [(2, 1, 0), (2, 0, 1), (None, 1, 1), (4, None, None), (999, 1, 1)]
    labels = [(i, None if q is None else int(q), None if x is None else int(x)) for i, q, x in labels]
    return rows, labels, docs_of([(i, t, "en", s, 0) for i, t, s in rows]), spark.createDataFrame(labels, LABELS)


def test_every_order_against_brute_force(case):
    rows, labels, docs, said = case
    got = found(filteraudit.audit(docs, said))
    assert got == brute(rows, labels) and len(got) == 600 * 3
    for part in ("hot", "", "s1"):
        n = sum((s or "") == part for *_, s in rows)
        by_filter = {order[step - 1]: v[-1] for (p, order, step), v in got.items() if p == part}
        assert sum(by_filter.values()) == 120 * (n - got[part, "ABCDE", 5][0])  # the worths share out all that any order removes


def test_sql_agrees(case):
    rows, labels, docs, said = case
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    duck.execute("CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    duck.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
    assert {tuple(r[:3]): list(r[3:]) for r in duck.execute(oracles.AUDIT).fetchall()} == found(filteraudit.audit(docs, said))


def test_odd_rows(odd, spark):
    rows = [(i, t, f"s{(i or 0) % 3}") for i, t, *_ in odd_rows()]
    assert found(filteraudit.audit(odd, spark.createDataFrame([], LABELS))) == brute(rows, [])


def test_null_and_repeated_ids(docs_of, spark):
    rows = [(None, "x y", "a"), (None, "x y", "a"), (3, "x y", "a"), (3, "x y", "b"), (4, "x y", "b"), (5, None, "b"), (6, "", "b")]
    docs = docs_of([(i, t, "en", s, 0) for i, t, s in rows])
    got = found(filteraudit.audit(docs, spark.createDataFrame([(3, 1, 0)], LABELS)))
    assert got == brute(rows, [(3, 1, 0)]) and got["b", "EABCD", 1][:2] == [2, 2]


def test_edges_of_the_filters(docs_of, spark):
    """A, B and C are strict: 200 words, half of them distinct and 2 % capitals pass."""
    half = " ".join(f"w{i % 100}" for i in range(200))
    two = "AA" + "b" * 98
    rows = [(1, half, "h"), (2, half + " w1", "h"), (3, two, "c"), (4, two[:-1], "c")]
    counts = {(r.part, r.mask): r.n for r in filteraudit.masks(docs_of([(i, t, "en", s, 0) for i, t, s in rows])).groupBy("part", "mask").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    assert counts == {("h", 0): 1, ("h", 2): 1, ("c", 1): 1, ("c", 5): 1}


def test_empty_and_clashing(docs_of, clashing, spark):
    none = spark.createDataFrame([], LABELS)
    assert filteraudit.audit(docs_of([(1, "a")]).limit(0), none).count() == 0
    got = found(filteraudit.audit(clashing, none.selectExpr("*", "1 AS part", "2 AS good", "3 AS mask")))
    assert len(got) == 1200 and got["a", "ABCDE", 1] == [0, 1, 0, 1, 0, 0, 120]
