"""Queries without SQL that run on whole tables, against brute force on the smallest ones."""

import os
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quarrygraph.plans import adapters as A
from quarrygraph.plans import queries
from quarrygraph.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def rows(spark, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{DATA}/{name}.parquet").select(*columns).collect()]


def test_edges_come_from_every_order(spark):
    path = {r.k: r.path for r in A.nodes(spark, DATA).filter("k is not null").collect()}
    brand, home, buyer = dict(rows(spark, "part", "p_partkey", "p_brand")), dict(rows(spark, "supplier", "s_suppkey", "s_nationkey")), dict(rows(spark, "customer", "c_custkey", "c_nationkey"))
    orders = defaultdict(list)
    for o, n, s, p in rows(spark, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"):
        orders[o].append((n, s, brand[p]))
    customer = {o: buyer[c] for o, c in rows(spark, "orders", "o_orderkey", "o_custkey")}
    want = {(path[a], path[b]) for o, lines in orders.items() for (m, a, x) in lines for (n, b, y) in lines if m < n and a != b and x == y and home[b] == customer[o]}
    got = {(r.source, r.target) for r in A.imports(spark, DATA).collect() if not r.target.startswith("external:")}
    assert got == want and want
    found = {r.path: r.in_degree for r in QUERIES["g14_degrees"](spark, DATA).collect()}
    degree = Counter(r.target for r in A.edges(spark, DATA).collect())
    assert all(found[p] == degree[p] for p in found)


def ranks(names, pairs, rounds=1000):
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)
    r = dict.fromkeys(names, 1 / len(names))
    for _ in range(rounds):
        lost = sum(v for k, v in r.items() if not out[k])
        new = dict.fromkeys(names, (0.85 * lost + 0.15) / len(names))
        for a, v in r.items():
            for b in out[a]:
                new[b] += 0.85 * v / len(out[a])
        r = new
    return r


def test_pagerank_is_converged(spark):
    edges = [(r.source, r.target) for r in A.edges(spark, DATA).collect()]
    names = [r.path for r in A.nodes(spark, DATA).collect()]
    got = {r.path: r.pagerank for r in QUERIES["g1_pagerank"](spark, DATA).collect()}
    want = ranks(names, edges)
    # production stops at a change of 1e-6 * n
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 2e-5 for k, v in want.items())
    groups = defaultdict(list)
    for r in A.members(spark, DATA).collect():
        groups[r.community_id].append(r.path)
    local = {(r.community_id, r.path): r.pagerank for r in QUERIES["g6_community_pagerank"](spark, DATA).collect()}
    for c, paths in groups.items():
        want = ranks(paths, [(a, b) for a, b in edges if a in paths and b in paths])
        assert all(abs(local[c, k] - v) < 2e-5 for k, v in want.items())
    assert "g1_pagerank" not in ORACLE_SQL and "g6_community_pagerank" not in ORACLE_SQL


def test_renames_of_all_lines(spark):
    want = set()
    for r in spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_linenumber", "l_suppkey", "l_partkey").collect():
        s, p = r.l_suppkey, r.l_partkey
        want.add([(f"src/{{old => new}}/f{s}.py", f"src/new/f{s}.py"), (f"a{p}.py => b/c{p}.py", f"b/c{p}.py"), ("src/{ => sub}/g.py", "src/sub/g.py"), (f"plain/p{s}.go", f"plain/p{s}.go")][r.l_linenumber % 4])
    got = [(r.p, r.new_path) for r in QUERIES["h9_rename_paths"](spark, DATA).collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("name", ["p3_imports", "p5_exports", "p1_symbols"])
def test_generated_files_are_dealt_to_tasks(spark, tmp_path, monkeypatch, name):
    """A Parquet file of keys is one task's; the files made of them are many tasks'."""
    monkeypatch.setattr(queries, "FILES_A_TASK", 40, raising=False)
    spark.range(1, 401).withColumnRenamed("id", "p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = queries.QUERIES[name](spark, str(tmp_path)).select("path", F.spark_partition_id().alias("task"))
    assert got.select("path").distinct().count() == 400 and got.select("task").distinct().count() == 10
