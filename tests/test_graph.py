import random

import pytest
from pyspark.sql import functions as F

from quarrygraph.operators import communities, graph


def edges_of(spark, pairs, kind="IMPORTS_FROM"):
    return spark.createDataFrame([(a, b, [], kind) for a, b in pairs], "source string, target string, imported_names array<string>, edge_type string")


def nodes_of(spark, names):
    return spark.createDataFrame([(n, False, False) for n in names], "path string, is_entry_point boolean, is_test boolean")


@pytest.fixture(scope="module")
def wild(spark):
    rng = random.Random(5)
    names = [f"d{i % 3}/f{i}" for i in range(24)]
    pairs = sorted({(a, b) for a, b in ((rng.choice(names), rng.choice(names)) for _ in range(50)) if a != b})
    return names, pairs, nodes_of(spark, names).persist(), edges_of(spark, pairs).persist()


def distances(pairs, start):
    seen, front = {start: 0}, [start]
    for u in front:
        for a, b in pairs:
            if a == u and b not in seen:
                seen[b] = seen[u] + 1
                front.append(b)
    return seen


def test_reach_and_hops(spark, wild):
    names, pairs, _, e = wild
    got = {(r.seed, r.node): r.depth for r in graph.reach(e, spark.createDataFrame([(n, n) for n in names[:3]], "seed string, node string")).collect()}
    assert got == {(s, n): d for s in names[:3] for n, d in distances(pairs, s).items()}
    seeds = spark.createDataFrame([(names[0],), (names[1],)], "path string")
    forward = [distances(pairs, s) for s in names[:2]]
    backward = [distances([(b, a) for a, b in pairs], s) for s in names[:2]]
    expected = {}
    for d in forward + backward:
        for n, k in d.items():
            if k <= 2 and n not in names[:2]:
                expected[n] = min(k, expected.get(n, 9))
    assert {r.path: r.depth for r in graph.k_hops(e, seeds, 2).collect()} == expected


def test_shortest_path(spark, wild):
    names, pairs, _, e = wild
    d = distances(pairs, names[0])
    far = max(d, key=lambda n: (d[n], n))
    r = graph.shortest_path(e, names[0], far).first()
    assert r.hops == d[far] and r.path[0] == names[0] and r.path[-1] == far and all(p in pairs for p in zip(r.path, r.path[1:], strict=False))
    assert graph.shortest_path(e, names[0], "nowhere").count() == 0
    assert graph.shortest_path(e, names[0], names[0]).first().hops == 0


@pytest.mark.parametrize("most", [10**6, 0])
def test_pagerank(spark, wild, monkeypatch, most):
    monkeypatch.setattr(graph, "TASK_EDGES", most)  # in one task, and as joins
    names, pairs, n, e = wild
    got = {r.path: r.pagerank for r in graph.pagerank(n, e).collect()}
    size = len(names)
    rank = dict.fromkeys(names, 1 / size)
    out = {u: [b for a, b in pairs if a == u] for u in names}
    for _ in range(200):
        lost = sum(rank[u] for u in names if not out[u])
        rank = {v: 0.15 / size + 0.85 * (lost / size + sum(rank[u] / len(out[u]) for u in names if v in out[u])) for v in names}
    assert abs(sum(got.values()) - 1) < 1e-6 and all(abs(got[u] - rank[u]) < 1e-4 for u in names)
    assert graph.pagerank(nodes_of(spark, []), e).count() == 0


def test_betweenness(spark, wild, monkeypatch):
    names, pairs, n, e = wild
    # by counting shortest paths through each node
    d = {s: distances(pairs, s) for s in names}
    sigma = {}
    for s in names:
        count = {s: 1}
        for v in sorted(d[s], key=d[s].get):
            if v != s:
                count[v] = sum(count[a] for a, b in pairs if b == v and a in d[s] and d[s][a] == d[s][v] - 1)
        sigma[s] = count
    expected = dict.fromkeys(names, 0.0)
    for s in names:
        for t in d[s]:
            for v in names:
                if v not in (s, t) and v in d[s] and t in d[v] and d[s][v] + d[v][t] == d[s][t]:
                    expected[v] += sigma[s][v] * sigma[v][t] / sigma[s][t]
    k = (len(names) - 1) * (len(names) - 2)
    got = {r.path: r.betweenness for r in graph.betweenness(n, e).collect()}
    assert all(abs(got[v] - expected[v] / k) < 1e-9 for v in names)
    monkeypatch.setattr(graph, "SOURCE_CELLS", 1)  # one source at a time
    got = {r.path: r.betweenness for r in graph.betweenness(n, e).collect()}
    assert all(abs(got[v] - expected[v] / k) < 1e-9 for v in names)
    monkeypatch.setattr(graph, "BETWEENNESS_EDGES", 0)  # the joins that larger graphs take
    got = {r.path: r.betweenness for r in graph.betweenness(n, e).collect()}
    assert all(abs(got[v] - expected[v] / k) < 1e-9 for v in names)


def test_betweenness_in_pieces(spark, wild, monkeypatch):
    """Edges beyond the bound are read in pieces, nodes' edges apart from one another, a few sources at once; the same sums."""
    _, _, n, e = wild
    want = {r.path: r.betweenness for r in graph.betweenness(n, e).collect()}
    monkeypatch.setattr(graph, "BETWEENNESS_EDGES", 0)
    for name, value in (("PIECE_EDGES", 2), ("FILE_PIECES", 8), ("PIECE_CELLS", 3 * len(want))):
        monkeypatch.setattr(graph, name, value)
    got = {r.path: r.betweenness for r in graph.betweenness(n, e.unionByName(e)).collect()}
    assert set(got) == set(want) and any(want.values()) and all(abs(got[p] - want[p]) < 1e-12 for p in want)


@pytest.mark.parametrize("most", [10**6, 0])
def test_strong_components_and_cycles(spark, wild, monkeypatch, most):
    monkeypatch.setattr(graph, "TASK_EDGES", most)
    names, pairs, n, e = wild
    d = {s: distances(pairs, s) for s in names}
    expected = {u: min(v for v in names if v in d[u] and u in d[v]) for u in names}
    assert {r.path: r.component for r in graph.strong_components(n, e).collect()} == expected
    sizes = {c: sum(x == c for x in expected.values()) for c in expected.values()}
    got = graph.cycles(n, e, 2).collect()
    assert {r.component: r.size for r in got} == {c: k for c, k in sizes.items() if k > 1}
    for r in got:
        assert r.cycle_path[0] == r.cycle_path[-1] == r.component and all(p in pairs for p in zip(r.cycle_path, r.cycle_path[1:], strict=False))
    two = graph.cycles(nodes_of(spark, "abc"), edges_of(spark, [("a", "b"), ("b", "a"), ("b", "c")])).collect()
    assert [(r.size, r.members, r.cycle_path) for r in two] == [(2, ["a", "b"], ["a", "b", "a"])]
    assert graph.cycles(nodes_of(spark, "ab"), edges_of(spark, [("a", "b")])).count() == 0


def test_degrees(spark, wild):
    names, pairs, n, e = wild
    assert {r.path: (r.in_degree, r.out_degree) for r in graph.degrees(n, e).collect()} == {u: (sum(b == u for _, b in pairs), sum(a == u for a, _ in pairs)) for u in names}


@pytest.mark.parametrize("small", [100_000, 0])
def test_louvain(spark, monkeypatch, small):
    monkeypatch.setattr(communities, "SMALL_EDGES", small)
    clique = lambda p: [(f"{p}{i}", f"{p}{j}") for i in range(5) for j in range(i)]
    pairs = clique("a/x") + clique("b/y") + [("a/x0", "b/y0")]
    names = sorted({x for p in pairs for x in p}) + ["lone"]
    n, e = nodes_of(spark, names), edges_of(spark, pairs)
    got = communities.detect(n, e).persist()
    by = {r.path: r.community_id for r in got.collect()}
    assert set(by) == set(names) and len({by[x] for x in names if x.startswith("a/")}) == 1 and by["a/x0"] != by["b/y0"] and len(set(by.values())) == 3
    assert communities.modularity(got, e).first().modularity > 0.4
    s = {r.community_id: r for r in communities.summary(got, e).collect()}
    assert s[by["a/x0"]].name == "a" and s[by["a/x0"]].member_count == 5 and s[by["lone"]].cohesion == 0 and len(s[by["a/x0"]].top_files) == 5


def test_louvain_after_distributed_moves(spark, monkeypatch):
    monkeypatch.setattr(communities, "TASK_EDGES", 3)
    clique = lambda p: [(f"{p}{i}", f"{p}{j}") for i in range(6) for j in range(i)]
    pairs = clique("a") + clique("b") + [("a0", "b0")]
    n, e = nodes_of(spark, sorted({x for p in pairs for x in p})), edges_of(spark, pairs)
    got = communities.detect(n, e).persist()
    assert got.count() == 12 and communities.modularity(got, e).first().modularity > 0.3


def test_moves_by_arrays_and_by_joins(spark, monkeypatch):
    """Moves of a graph beyond one task: as by the definition, on numbers, and the same by joins."""
    rng = random.Random(5)
    groups = {f"{'cab'[g]}{i}": g for g in range(3) for i in range(9)}
    names = sorted(groups)
    pairs = {(a, b) for a in names for b in names if a != b and rng.random() < (0.5 if groups[a] == groups[b] else 0.05)}
    n, e = nodes_of(spark, [*names, "lone"]), edges_of(spark, [*pairs, *list(pairs)[:9]])
    monkeypatch.setattr(communities, "TASK_EDGES", 3)
    held = communities.detect(n, e, 3).collect()
    with monkeypatch.context() as m:
        m.setattr(communities, "MOVE_NODES", 0)
        assert sorted(held) == sorted(communities.detect(n, e, 3).collect())
    ids = communities.numbered(n.orderBy("path"), "id").select("path", "id")
    near = communities._adjacent(e, ids)
    total = near.selectExpr("sum(size(near)) / 2 n").first().n
    got = {r.id: r.part for r in communities._moved(near, ids, ids.count(), total, 4).collect()}
    at = {r.path: r.id for r in ids.collect()}
    turn = {r.id: r.t for r in ids.selectExpr("id", "transform(sequence(0, 3), k -> pmod(xxhash64(path, k), 2) = 0) t").collect()}
    edge = {u: {at[b] for a, b in pairs if at[a] == u} | {at[a] for a, b in pairs if at[b] == u} for u in got}
    label = {u: u for u in got}
    for k in range(4):
        weight = {c: sum(len(edge[u]) for u in got if label[u] == c) for c in got}
        best = {}
        for u in got:
            gains = [(sum(label[v] == c for v in edge[u]) - (weight[c] - (len(edge[u]) if c == label[u] else 0)) * len(edge[u]) / (2 * total), c == label[u], c) for c in {label[v] for v in edge[u]}]
            best[u] = max(gains)[2] if gains and turn[u][k] else label[u]
        label = best
    assert got == label and len(set(label.values())) < len(label)


def test_community_pagerank_both_ways(spark, wild, monkeypatch):
    names, pairs, _, e = wild
    m = spark.createDataFrame([(n, int(n[1])) for n in names], "path string, community_id int")
    inner = e.filter(F.substring("source", 1, 2) == F.substring("target", 1, 2)).select("source", "target")
    one = {r.path: r.pagerank for r in communities.pagerank_by(m, inner, rounds=5, tolerance=None).collect()}
    monkeypatch.setattr(graph, "TASK_EDGES", 0)
    two = {r.path: r.pagerank for r in communities.pagerank_by(m, inner, rounds=5, tolerance=None).collect()}
    assert set(one) == set(names) and all(abs(one[n] - two[n]) < 1e-12 for n in names) and abs(sum(one.values()) - 3) < 1e-9


def test_cohesion_half(spark):
    m = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1)], "path string, community_id int")
    got = {r.community_id: r.cohesion for r in communities.cohesion(m, edges_of(spark, [("a", "b"), ("b", "c")])).collect()}
    assert got == {0: 0.5, 1: 0.0}


def test_node_link(spark, sample):
    assert '"links"' in graph.node_link(*sample).first().json


def test_dependents(spark, sample):
    got = {r.path for r in graph.dependents(sample[1], spark.createDataFrame([("src/config.py",)], "path string"), 2).collect()}
    assert got == {"src/db.py", "src/api.py"}
    assert sample[0].filter(F.col("path") == "src/orphan.py").count() == 1
