"""Traversals with sets as bitmaps, and co-change in a grid of blocks, against brute force."""

import math
import os
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarrygraph.operators import flows, graph, history, impact
from quarrygraph.operators.tables import numbered
from quarrygraph.plans import adapters as A
from quarrygraph.plans.queries import EDGE_QUERIES, ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
EDGES = "source string, target string, imported_names array<string>, edge_type string"


def walk(out, seed, most=None):
    found, frontier, depth = {seed: 0}, [seed], 0
    while frontier and (most is None or depth < most):
        depth += 1
        frontier = sorted({y for x in frontier for y in out[x]} - set(found))
        found |= dict.fromkeys(frontier, depth)
    return found


@pytest.mark.parametrize(("n", "m", "most"), [(150, 260, None), (150, 260, 3), (90, 2500, 15), (5, 0, None)])
def test_reach_sets(spark, n, m, most):
    """More than two words of seeds, cycles and loops, seeds without edges, repeated seeds."""
    rng = random.Random(n + m)
    pairs = {(f"v{rng.randrange(n)}", f"v{rng.randrange(n)}") for _ in range(m)}
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)
    seeds = [f"v{i}" for i in range(n)] + ["alone", "v0"]
    edges = spark.createDataFrame([(a, b, [], "x") for a, b in pairs for _ in range(2)], EDGES)
    got = graph.reach_sets(edges, spark.createDataFrame([(s,) for s in seeds], "path string").repartition(3), most).collect()
    want = {(s, v, d) for s in seeds for v, d in walk(out, s, most).items()}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert graph.reach_sets(edges, spark.createDataFrame([], "path string"), most).count() == 0


def test_flow_members_of_many_entries(spark):
    """Entry points of more than one word on a dense graph."""
    rng = random.Random(5)
    names = [f"d{i % 7}/m{i}.py" for i in range(140)]
    pairs = {(rng.choice(names), rng.choice(names[70:])) for _ in range(900)}
    nodes = spark.createDataFrame([(x, i % 2 == 0, i % 9 == 0) for i, x in enumerate(names)], "path string, is_entry_point boolean, is_test boolean")
    edges = spark.createDataFrame([(a, b, [], "IMPORTS_FROM") for a, b in pairs], EDGES)
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)
    starts = [r.path for r in flows.entry_points(nodes, edges).collect()]
    assert len(starts) > 64
    got = {tuple(r) for r in flows.members(nodes, edges, 4).collect()}
    assert got == {(s, v, d) for s in starts for v, d in walk(out, s, 4).items()}


def test_reachable_and_directions(spark):
    rng = random.Random(11)
    pairs = {(f"v{rng.randrange(60)}", f"v{rng.randrange(60)}") for _ in range(75)}
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)
    edges = spark.createDataFrame([(a, b, [], "x") for a, b in pairs], EDGES)
    wanted = [(f"v{rng.randrange(62)}", f"v{rng.randrange(62)}") for _ in range(300)]
    got = {(r.source, r.target): r.reached for r in graph.reachable(edges, spark.createDataFrame(wanted, "source string, target string")).collect()}
    assert got == {(a, b): b in walk(out, a) for a, b in wanted} and len(set(got.values())) == 2
    seeds, files = ["v3", "v20", "v41"], [f"v{i}" for i in range(61)]
    want = {}
    for f in files:
        want[f] = "unknown"
        for s in sorted(seeds):
            if s == f:
                continue
            if s in out[f]:
                want[f] = "dependency"
            elif f in out[s]:
                want[f] = "dependent"
            elif s in walk(out, f):
                want[f] = "upstream"
            if want[f] != "unknown":
                break
    frame = lambda x: spark.createDataFrame([(y,) for y in x], "path string")
    assert {r.path: r.direction for r in impact.directions(edges, frame(files), frame(seeds)).collect()} == want and len(set(want.values())) == 4


def test_numbered_has_no_gaps(spark):
    df = spark.range(1000).selectExpr("id % 37 AS x").repartition(7).filter("x <> 5")
    got = numbered(df).collect()
    assert sorted(r.n for r in got) == list(range(len(got))) and Counter(r.x for r in got) == Counter(r.x for r in df.collect())
    assert numbered(df.limit(0)).count() == 0


NOW = datetime(2026, 1, 1)
COMMITS = "sha string, file_path string, author string, email string, ts timestamp, is_merge boolean, subject string, added long, deleted long"


def commit(sha, files, days, merge=False):
    return [(sha, f, "a", "e", NOW - timedelta(days=days), merge, "s", 1, 1) for f in files]


def brute_pairs(rows, least, widest=None):
    touched = {(r[0], r[1]): r[4] for r in rows if not r[5]}
    by = defaultdict(list)
    for (sha, f), ts in touched.items():
        by[sha].append((f, ts))
    score, last = defaultdict(float), {}
    for files in by.values():
        if widest is None or len(files) <= widest:
            for a, ts in files:
                for b, _ in files:
                    if a < b:
                        score[a, b] += math.exp(-max(0, (NOW - ts).total_seconds() / 86400) / 180)
                        last[a, b] = max(last.get((a, b), ts), ts)
    return {(a, b, round(s, 6), last[a, b]) for (a, b), s in score.items() if s >= least}


@pytest.mark.parametrize(("block", "least", "widest"), [(4, 1.0, None), (16, 0.5, None), (16, 2.0, 30), (256, 0.0, None)])
def test_co_changes_in_blocks(spark, monkeypatch, block, least, widest):
    monkeypatch.setattr(history, "BLOCK_FILES", block)
    rng = random.Random(block)
    rows = []
    for k in range(60):
        rows += commit(f"c{k}", {f"f{rng.randrange(40)}" for _ in range(rng.choice([1, 2, 5, 9, 35]))}, rng.randrange(-3, 300), k % 11 == 0)
    rows += commit("wide", [f"f{i}" for i in range(90)], 10) + rows[:20]
    got = {(r.file_a, r.file_b, round(r.score, 6), r.last_ts) for r in history.co_changes(spark.createDataFrame(rows, COMMITS), NOW, least, widest).collect()}
    want = brute_pairs(rows, least, widest)
    assert got == want and want


def test_a_commit_of_20000_files(spark):
    """Files of one commit only can't reach the least score: they make no pairs. Pairs of other commits keep its weight."""
    rows = commit("wide", [f"f{i:05}" for i in range(20_000)], 1)
    for k in range(4):
        rows += commit(f"c{k}", ["f00001", "f00002", "f19999"], 2 + k)
    df = spark.createDataFrame(rows, COMMITS)
    got = {(r.file_a, r.file_b, round(r.score, 6)) for r in history.co_changes(df, NOW, 3.0).collect()}
    score = round(sum(math.exp(-d / 180) for d in (1, 2, 3, 4, 5)), 6)
    assert got == {("f00001", "f00002", score), ("f00001", "f19999", score), ("f00002", "f19999", score)}


def test_no_task_gets_a_wide_commit_whole(spark, monkeypatch):
    """Rows of one cell of the grid are those of two blocks, however wide the commit."""
    monkeypatch.setattr(history, "BLOCK_FILES", 50)
    rows = commit("wide", [f"f{i}" for i in range(1000)], 1)
    seen = []
    real = type(spark.range(1)).join

    def join(self, other, on=None, how=None):
        if on == ["sha", "i", "j"]:
            seen.append(max(r["count"] for r in self.groupBy("sha", "i", "j").count().collect()))
        return real(self, other, on, how)

    monkeypatch.setattr(type(spark.range(1)), "join", join)
    assert history.co_changes(spark.createDataFrame(rows, COMMITS), NOW, 0.5).count() == 1000 * 999 // 2
    assert seen and max(seen) <= 110


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_every_pair_is_an_edge(spark):
    path = {r.k: r.path for r in A.nodes(spark, DATA).filter("k is not null").collect()}
    orders = defaultdict(list)
    for r in spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_suppkey").collect():
        orders[r.l_orderkey].append((r.l_linenumber, r.l_suppkey))
    want = {(path[a], path[b]) for lines in orders.values() for m, a in lines for n, b in lines if m < n and a != b}
    with A.all_pairs():
        edges = [(r.source, r.target) for r in A.edges(spark, DATA).collect()]
        imports = {(r.source, r.target) for r in A.imports(spark, DATA).collect() if not r.target.startswith("external:")}
    by_rule = {(r.source, r.target) for r in A.imports(spark, DATA).collect() if not r.target.startswith("external:")}
    assert imports == want and by_rule < want
    got = {r.path: r.in_degree for r in QUERIES["g14_degrees_all_pairs"](spark, DATA).collect()}
    assert got == {p: n for p in got for n in [Counter(b for _, b in edges)[p]]}
    assert all(f"{n}_all_pairs" in QUERIES for n in EDGE_QUERIES) and sum(f"{n}_all_pairs" in ORACLE_SQL for n in EDGE_QUERIES) >= 18


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_shortest_path_over_every_pair(spark):
    with A.all_pairs():
        pairs = {(r.source, r.target) for r in A.edges(spark, DATA).collect()}
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)
    row = QUERIES["g10_shortest_path_all_pairs"](spark, DATA).first()
    trail = row.trail.split(" > ") if " > " in row.trail else row.trail.split(",")
    assert walk(out, trail[0])[trail[-1]] == row.hops == len(trail) - 1 and all(e in pairs for e in zip(trail, trail[1:], strict=False))


def test_joins_with_edges_leave_the_edges_where_they_are(spark, monkeypatch):
    """Rounds, and counts of edges, bring the few rows of nodes to the edges: no plan shuffles an edge before it is aggregated."""
    edges = graph.pinned(spark.createDataFrame([(f"a{i}", f"a{i * 7 % 50}") for i in range(50)], "source string, target string").withColumn("edge_type", F.lit("IMPORTS_FROM")))
    seeds = graph.pinned(spark.createDataFrame([("s", "a1")], "seed string, node string"))
    plans = []
    monkeypatch.setattr(graph, "pinned", lambda df, f=graph.pinned: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or f(df))
    found = {(r.node, r.depth) for r in graph.reach(edges, seeds).collect()}
    at, want = 1, {}
    while f"a{at}" not in want:
        want[f"a{at}"] = len(want)
        at = at * 7 % 50
    assert found == set(want.items()) and sum("rightHint=(strategy=broadcast)" in p for p in plans) == len(want)
    assert {r.path for r in graph.dependents(edges, spark.createDataFrame([("a7",)], "path string"), 2).collect()} == {"a1", "a43"}
    monkeypatch.setattr("quarrygraph.operators.tables.BROADCAST_ROWS", 0)
    assert {(r.node, r.depth) for r in graph.reach(edges, seeds).collect()} == found


def test_pairs_of_two_sets_are_not_shuffled(spark):
    """All pairs of 150 sources and 100 targets, some of them nodes of no edge, as a brute force gives them; no exchange stands above what makes the pairs."""
    r = random.Random(5)
    steps = {(f"n{r.randrange(200)}", f"n{r.randrange(200)}") for _ in range(260)}
    sources, targets = [f"n{i}" for i in range(0, 300, 2)], [f"n{i}" for i in range(0, 300, 3)]
    path = lambda names: spark.createDataFrame([(n,) for n in names], "path string")
    got = graph.reachable_between(spark.createDataFrame(sorted(steps), "source string, target string"), path(sources), path(targets))
    want = set()
    for s in sources:
        seen, work = {s}, [s]
        while work:
            at = work.pop()
            for a, b in steps:
                if a == at and b not in seen:
                    seen.add(b)
                    work.append(b)
        want |= {(s, t, t in seen) for t in targets}
    rows = [tuple(x) for x in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "Exchange" not in plan[: plan.index("Generate posexplode")] and "Join" not in plan[: plan.index("Generate posexplode")]
    assert graph.reachable_between(spark.createDataFrame(sorted(steps), "source string, target string"), path([]), path(targets)).count() == 0


def test_parts_are_followed_one_by_one(spark, monkeypatch):
    """Forty parts with more seeds than a word has bits: no round of joins over all edges is made, but of a part too large for a task."""
    rng = random.Random(11)
    pairs = {(f"p{k}/v{rng.randrange(9)}", f"p{k}/v{rng.randrange(9)}") for k in range(40) for _ in range(14)}
    pairs |= {(f"big/v{i}", f"big/v{(i + 1) % 50}") for i in range(50)}
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)
    seeds = [f"p{k}/v{i}" for k in range(40) for i in range(4)] + ["big/v1", "big/v2"]
    edges = spark.createDataFrame([(a, b, [], "IMPORTS_FROM") for a, b in sorted(pairs)], EDGES)
    start = spark.createDataFrame([(s,) for s in seeds], "path string")
    want = {(s, v, d) for s in seeds for v, d in walk(out, s, 15).items()}
    by_joins = []
    monkeypatch.setattr(graph, "_bits", lambda steps, starts, most, f=graph._bits: by_joins.append(starts.count()) or f(steps, starts, most))
    assert {tuple(r) for r in graph.reach_sets(edges, start, 15).collect()} == want and not by_joins
    monkeypatch.setattr(graph, "TASK_EDGES", 30)
    assert {tuple(r) for r in graph.reach_sets(edges, start, 15).collect()} == want and by_joins == [2]


def test_components_and_cycles_of_parts(spark, monkeypatch):
    """A graph beyond TASK_EDGES whose parts are not: each part is one task's search, and the colours are left to larger parts."""
    pairs = [(f"p{k}/{a}", f"p{k}/{b}") for k in range(12) for a, b in ("ab", "bc", "ca", "cd", "de", "ed")]
    long = [(f"q{i:02}", f"q{(i + 1) % 20:02}") for i in range(20)]
    names = sorted({x for p in [*pairs, *long] for x in p}) + ["alone"]
    nodes = spark.createDataFrame([(x,) for x in names], "path string")
    edges = lambda rows: spark.createDataFrame([(a, b, [], "IMPORTS_FROM") for a, b in rows for _ in range(2)], EDGES)
    want = {x: x for x in names} | {f"p{k}/{x}": f"p{k}/{y}" for k in range(12) for x, y in ("aa", "ba", "ca", "dd", "ed")}
    monkeypatch.setattr(graph, "TASK_EDGES", 15)
    rounds = []
    monkeypatch.setattr(graph, "_strong_rounds", lambda left, e, f=graph._strong_rounds: rounds.append(left.count()) or f(left, e))
    assert {r.path: r.component for r in graph.strong_components(nodes, edges(pairs)).collect()} == want and not rounds
    got = {r.component: (r.size, r.cycle_path) for r in graph.cycles(nodes, edges([*pairs, *long])).collect()}
    assert rounds == [20] and got == {f"p{k}/{x}": (n, [f"p{k}/{y}" for y in ring]) for k in range(12) for x, n, ring in (("a", 3, "abca"), ("d", 2, "ded"))} | {"q00": (20, [f"q{i % 20:02}" for i in range(21)])}


def test_seeds_of_a_large_part_are_dealt_to_tasks(spark, monkeypatch):
    """One part whose seeds reach more rows than a task may hold: no round of joins is made, and what is held or read in pieces, with repeated edges, is what a brute force gives."""
    rng = random.Random(3)
    names = [f"v{i:03}" for i in range(260)]
    pairs = {(a, rng.choice(names)) for a in names for _ in range(2)} | {("small/a", "small/b")}
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)
    seeds = names[::2] + ["small/a", "alone"]
    edges = spark.createDataFrame([(a, b, [], "x") for a, b in sorted(pairs) for _ in range(2)], EDGES).repartition(3)
    path = lambda names: spark.createDataFrame([(s,) for s in names], "path string")
    monkeypatch.setattr(graph, "TASK_CELLS", 200)
    monkeypatch.setattr(graph, "_bits", lambda *_: pytest.fail("joins over all edges"))
    ends = names[::3] + ["small/b", "nowhere"]
    for held, cells in ((graph.HELD_EDGES, graph.PIECE_CELLS), (0, 300)):
        monkeypatch.setattr(graph, "HELD_EDGES", held)
        monkeypatch.setattr(graph, "PIECE_CELLS", cells)
        for most in (2, None):
            got = [tuple(r) for r in graph.reach_sets(edges, path(seeds), most).collect()]
            want = {(s, v, d) for s in seeds for v, d in walk(out, s, most).items()}
            assert len(got) == len(want) and set(got) == want
        pairs_of_sets = [tuple(r) for r in graph.reachable_between(edges, path(seeds), path(ends), path(names)).collect()]
        assert len(pairs_of_sets) == len(seeds) * len(ends) and set(pairs_of_sets) == {(s, t, t in walk(out, s)) for s in seeds for t in ends}


def test_pieces_hold_every_edge(monkeypatch):
    """Edges in any order come as pieces by target; edges picked from a piece are a piece."""
    monkeypatch.setattr(graph, "PIECE_EDGES", 7)
    rng = random.Random(1)
    pairs = [(rng.randrange(20), rng.randrange(20)) for _ in range(100)]
    batches = [graph.pa.record_batch([graph.pa.array(x) for x in zip(*pairs[i : i + 10], strict=True)], ["a", "b"]) for i in range(0, 100, 10)]
    told = lambda nodes, starts, others: [(a, v) for v, x in zip(nodes, graph.np.split(others, starts[1:]), strict=True) for a in x]
    pieces = [tuple(graph.np.frombuffer(c[0].as_py(), "int32") for c in p.columns) for p in graph._pieces_by_target(iter(batches))]
    assert len(pieces) >= 100 / 7 and Counter(x for p in pieces for x in told(*p)) == Counter(pairs)
    at = graph.np.array([1, 2, 5])
    assert told(*graph._some_edges(*pieces[0], at)) == [told(*pieces[0])[i] for i in at]
    joined = next(graph._joined_nodes(iter(batches[:1])))
    label = dict(zip(*(c.to_pylist() for c in joined.columns), strict=True))
    assert all(label.get(a, a) == label.get(b, b) for a, b in pairs[:10]) and all(v < k for k, v in label.items())


def test_flows_are_traced_in_numbers(spark, monkeypatch):
    """What entry points reach is dealt to several tasks, however few edges there are, and members and scores are those of a brute force: with a path that is no node, repeated nodes and equal depths."""
    rng = random.Random(9)
    names = [f"d{i % 5}/m{i}.py" for i in range(120)]
    pairs = {(rng.choice(names), rng.choice(names[60:])) for _ in range(300)} | {(names[0], "gone/auth.py"), ("gone/auth.py", names[70])}
    outside = {(rng.choice(names), f"external:{rng.randrange(4)}") for _ in range(60)}
    tested = {(b, a) for a, b in sorted(pairs)[:40]}
    nodes = spark.createDataFrame([(x, i % 2 == 0, i % 9 == 0) for i, x in enumerate(names)] + [(names[4], True, False)], "path string, is_entry_point boolean, is_test boolean")
    edges = spark.createDataFrame([(a, b, [], "IMPORTS_FROM") for a, b in sorted(pairs | outside)] + [(a, b, [], "TESTED_BY") for a, b in sorted(tested)], EDGES)
    dealt = []
    monkeypatch.setattr(graph, "_followed", lambda *x, f=graph._followed: dealt.append(f(*x)) or dealt[-1])
    found, rows = flows.trace(nodes, edges, 4)
    assert dealt[0][0].rdd.getNumPartitions() >= 8
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)
    entries = {r.path for r in flows.entry_points(nodes, edges).collect()}
    reached = {s: walk(out, s, 4) for s in entries}
    ids = {r.entry_point: r.flow_id for r in found.collect()}
    # a node that comes twice counts twice
    size = {s: sum(2 if p == names[4] else 1 for p in reached[s]) for s in entries}
    assert {r.entry_point: r.node_count for r in found.collect()} == {s: n for s, n in size.items() if n >= 2}
    assert {r.entry_point: r.file_spread for r in found.collect()} == {s: len({p.rsplit("/", 1)[0] for p in reached[s]}) for s in ids}
    covers = {a for a, _ in tested} & set(names)
    assert {r.entry_point for r in found.collect() if r.has_test_coverage} == {s for s in ids if covers & set(reached[s])}
    want = {(ids[s], p, d, i) for s in ids for i, (d, p) in enumerate(sorted((d, p) for p, d in reached[s].items()))}
    assert {tuple(r) for r in rows.collect()} == want


def test_pairs_of_orders_on_own_tables(spark, tmp_path, monkeypatch):
    """Both edge relations on rows with repeated and null keys against a brute force; lists of an order's lines are made after the lines are dealt, and the rule makes none."""
    rng = random.Random(2)
    suppliers = [(k, rng.randrange(3)) for k in range(1, 31)] + [(7, 1), (8, None), (3, 0)]
    customers, parts = [(c, c % 3) for c in range(9)] + [(4, 2)], [(p, f"b{p % 3}") for p in range(12)] + [(5, "b0")]
    orders = [(o, rng.randrange(10)) for o in range(60)] + [(5, 2)]
    lines = [(rng.choice([*range(60), None]), n, rng.choice([*range(1, 32), None]), rng.randrange(13)) for n in range(6) for _ in range(60)]
    tables = {
        "supplier": (suppliers, "s_suppkey long, s_nationkey int"), "customer": (customers, "c_custkey long, c_nationkey int"), "part": (parts, "p_partkey long, p_brand string"),
        "orders": (orders, "o_orderkey long, o_custkey long"), "lineitem": (lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    of = lambda rows, key: [v for k, v in rows if k == key and k is not None]
    every, ruled = set(), set()
    for o, x, s, p in lines:
        for o2, y, d, q in lines:
            if o == o2 and x < y and s != d:
                for sn in of(suppliers, s):
                    for dn in of(suppliers, d):
                        every.add((s, sn, d, dn))
                        if dn is not None and dn in {n for c in of(orders, o) for n in of(customers, c)} and set(of(parts, p)) & set(of(parts, q)):
                            ruled.add((s, sn, d, dn))
    keys = {r.i: (r.k, r.nk) for r in A._keys(spark, str(tmp_path)).collect()}
    for f, want in ((A._joined_of_all, every), (A._joined_by_rule, ruled)):
        got = set()
        for r in f.__wrapped__(spark, str(tmp_path)).collect():
            a, b = keys[r.ab >> 32], keys[r.ab & (1 << 32) - 1]
            got |= {(*a, *b)} if r.way & 1 else set()
            got |= {(*b, *a)} if r.way & 2 else set()
        assert got == want and want
    assert "collect_list" not in A._joined_by_rule.__wrapped__(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
