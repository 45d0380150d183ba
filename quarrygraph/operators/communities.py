"""Communities: detection, names, cohesion, coupling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrygraph import params as P
from quarrygraph.functions import paths
from quarrygraph.operators import graph
from quarrygraph.operators.tables import beside_edges, numbered, pinned, swept

RESOLUTION, GAIN = 1.0, 1e-7
#: Edges of a component up to which Louvain runs in one task; larger components are coarsened by distributed moves first.
TASK_EDGES = 2_000_000
#: Edges of a whole graph up to which its components aren't told apart.
SMALL_EDGES = 100_000
#: Nodes whose communities distributed moves broadcast, as arrays; beyond that the moves go by joins.
MOVE_NODES = 1_000_000


def undirected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, w), a < b: one edge of weight 1 for each pair that any edge joins."""
    pairs = edges.filter("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    return pairs.withColumn("w", F.lit(1.0))


def louvain(neighbours: list[dict[int, float]], loops: np.ndarray, total: float, resolution: float = RESOLUTION, threshold: float = GAIN) -> np.ndarray:
    """Community of each node of a weighted graph. Nodes are visited in their order until no move gains; then communities become nodes.

    neighbours: weight to each other node, both ways; loops: weight of self-loops; total: sum of all edge weights of the whole graph (m).
    """
    n = len(neighbours)
    label = np.arange(n)
    if total <= 0:
        return label
    adjacency, own = neighbours, loops.astype(float)
    while True:
        size = len(adjacency)
        degree = np.array([sum(x.values()) for x in adjacency]) + 2 * own
        community, weight = np.arange(size), degree.copy()
        moved_any, moved = False, True
        while moved:
            moved = False
            for u in range(size):
                to: dict[int, float] = {}
                for v, w in adjacency[u].items():
                    to[community[v]] = to.get(community[v], 0.0) + w
                here = community[u]
                weight[here] -= degree[u]
                best, gain = here, to.get(here, 0.0) - resolution * weight[here] * degree[u] / (2 * total)
                for c in sorted(to):
                    g = to[c] - resolution * weight[c] * degree[u] / (2 * total)
                    if g > gain + threshold:
                        best, gain = c, g
                weight[best] += degree[u]
                if best != here:
                    community[u] = best
                    moved = moved_any = True
        if not moved_any:
            return label
        names, community = np.unique(community, return_inverse=True)
        label = community[label]
        merged: list[dict[int, float]] = [{} for _ in names]
        loop = np.zeros(len(names))
        for u in range(size):
            cu = community[u]
            loop[cu] += own[u]
            for v, w in adjacency[u].items():
                cv = community[v]
                if cv == cu:
                    loop[cu] += w / 2
                else:
                    merged[cu][cv] = merged[cu].get(cv, 0.0) + w
        adjacency, own = merged, loop


def _adjacent(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """u, near: each node's neighbours in the undirected graph, sorted, without repeats and itself; pinned. Names go to the edges, and one shuffle of numbers, gathered by node in each task first, makes the lists."""
    a, b = F.col("a").cast("int"), F.col("b").cast("int")
    one = graph.between(edges, ids).filter("a <> b").select(F.explode(F.array(F.struct(a.alias("u"), b.alias("v")), F.struct(b.alias("u"), a.alias("v")))).alias("x")).select("x.*")
    return pinned(one.groupBy("u").agg(F.array_sort(F.collect_set("v")).alias("near")))


def _forward(adjacent: DataFrame) -> DataFrame:
    """a, b, a < b: each pair of neighbours once."""
    return adjacent.select(F.col("u").cast("long").alias("a"), F.explode(F.filter("near", lambda v: v > F.col("u")).cast("array<long>")).alias("b"))


def _flat(lists: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The elements of all lists one after another, and their offsets."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)])


def _moved(adjacent: DataFrame, inside: DataFrame, n: int, total: float, rounds: int) -> DataFrame:
    """id, part: distributed Louvain moves. Each round a hash lets half of the nodes move to the neighbouring community with the best gain (of several, its own, then the last).

    inside: the nodes (id, path) that take part, of n. The lists stay where they are: a round brings every node's community and every community's weight to them as arrays, and only those that move come back.
    """
    context = adjacent.sparkSession.sparkContext
    turn = sum((F.when(F.pmod(F.xxhash64("path", F.lit(k)), F.lit(2)) == 0, F.lit(1 << k)).otherwise(0) for k in range(rounds)), F.lit(0))
    some = inside.join(adjacent.select(F.col("u").cast("long").alias("id"), F.size("near").alias("d")), "id", "left").select("id", F.coalesce("d", F.lit(0)).alias("d"), turn.alias("turn")).toPandas()
    label, degree, turns = np.arange(n), np.zeros(n), np.zeros(n, np.int64)
    degree[some["id"]], turns[some["id"]] = some["d"], some["turn"]
    for k in range(rounds):
        weight = np.bincount(label, weights=degree, minlength=n)
        held = context.broadcast((label, weight, degree, (turns >> k & 1) == 1))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            label, weight, degree, moves = held.value
            for batch in batches:
                us = batch.column(0).to_numpy()
                flat, at = _flat(batch.column(1))
                moved, to = [], []
                for i in np.flatnonzero(moves[us]):
                    u = us[i]
                    here, d = label[u], degree[u]
                    part, w = np.unique(label[flat[at[i] : at[i + 1]]], return_counts=True)
                    gain = w - RESOLUTION * (weight[part] - np.where(part == here, d, 0.0)) * d / (2 * total)
                    best = part[gain == gain.max()]
                    if here not in best:
                        moved.append(u)
                        to.append(best[-1])
                yield pa.record_batch([pa.array(moved, pa.int64()), pa.array(to, pa.int64())], ["id", "part"])

        found = adjacent.mapInArrow(run, "id long, part long").toPandas()
        held.unpersist()
        label = label.copy()
        label[found["id"]] = found["part"]
    kept = context.broadcast(label)

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(kept.value[batch.column(0).to_numpy()], pa.int64())], ["id", "part"])

    return inside.select("id").mapInArrow(labelled, "id long, part long")


def _coarsened(adjacent: DataFrame, inside: DataFrame, total: float, rounds: int) -> DataFrame:
    """id, part: the same moves by joins, where the nodes are too many for arrays."""
    both = pinned(adjacent.select(F.col("u").cast("long").alias("u"), F.explode(F.col("near").cast("array<long>")).alias("v")))
    label = pinned(inside.join(adjacent.select(F.col("u").cast("long").alias("id"), F.size("near").cast("double").alias("d")), "id", "left").select("id", "path", F.col("id").alias("part"), F.coalesce("d", F.lit(0.0)).alias("d")))
    for k in range(rounds):
        weight = label.groupBy("part").agg(F.sum("d").alias("sum"))
        to = both.join(label.select(F.col("id").alias("v"), "part"), "v").groupBy(F.col("u").alias("id"), "part").agg(F.count("*").cast("double").alias("w"))
        own = label.select("id", F.col("part").alias("here"), "d")
        scored = to.join(own, "id").join(weight, "part")
        others = F.col("sum") - F.when(F.col("part") == F.col("here"), F.col("d")).otherwise(0.0)
        scored = scored.withColumn("gain", F.col("w") - RESOLUTION * others * F.col("d") / (2 * total))
        best = scored.groupBy("id").agg(F.max(F.struct("gain", (F.col("part") == F.col("here")).alias("stay"), "part")).alias("b"))
        turn = F.pmod(F.xxhash64("path", F.lit(k)), F.lit(2)) == 0
        label = pinned(label.join(best, "id", "left").select("id", "path", F.when(turn & F.col("b").isNotNull(), F.col("b.part")).otherwise(F.col("part")).alias("part"), "d"))
    return label.select("id", "part")


def detect(nodes: DataFrame, edges: DataFrame, rounds: int = 8) -> DataFrame:
    """path, community_id: Louvain communities of the undirected graph of all nodes and the edges among them; ids count communities by size, then least path.

    Nodes are numbers in the order of their paths, edges lists of neighbours that stay where they are. Components are independent but for the total weight, so each is one group of a
    task; a component of more than TASK_EDGES edges is coarsened by so many rounds of distributed moves first, and its communities take the place of its nodes.
    """
    swept(nodes)  # what the edges' own shuffles left
    ids = numbered(nodes.select("path").distinct().orderBy("path"), "id")
    n = ids.count()
    adjacent = _adjacent(edges, ids)
    swept(nodes)
    total = (adjacent.agg(F.sum(F.size("near").cast("long"))).first()[0] or 0) / 2
    # few edges: all components in one task, with the same result
    part = ids.select("id", F.lit(0).cast("long").alias("part")) if total <= min(SMALL_EDGES, TASK_EDGES) else graph.parts(ids.select("id"), _forward(adjacent))
    lists = adjacent.join(beside_edges(part.withColumnRenamed("id", "u")), "u")
    large = lists.groupBy("part").agg((F.sum(F.size("near").cast("long")) / 2).alias("n")).filter(F.col("n") > TASK_EDGES).select("part")
    large = pinned(large)
    alone = lists.join(F.broadcast(large), "part", "left_anti").select("part", F.col("u").cast("long").alias("x"), F.filter("near", lambda v: v > F.col("u")).cast("array<long>").alias("y"), F.lit(None).cast("array<double>").alias("w"))
    name = part.select("id", "part", F.col("id").alias("super"))
    if not large.isEmpty():
        inside = ids.join(part.join(F.broadcast(large), "part", "left_semi"), "id").select("id", "path")
        near = lists.join(F.broadcast(large), "part", "left_semi").select("u", "near")
        merged = pinned(_moved(near, inside, n, total, rounds) if n <= MOVE_NODES else _coarsened(near, inside, total, rounds))
        name = pinned(name.select("id", "part").join(merged.withColumnRenamed("part", "super"), "id", "left").select("id", "part", F.coalesce("super", "id").alias("super")))
        of = lambda end, to: beside_edges(name).select(F.col("id").alias(end), F.col("super").alias(to))
        joined = _forward(near).join(of("a", "x"), "a").join(of("b", "y"), "b")
        weights = joined.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.count("*").cast("double").alias("w"))
        held = weights.join(name.select(F.col("id").alias("x"), "part"), "x").select("part", "x", F.array("y").alias("y"), F.array("w").alias("w"))
        alone = alone.unionByName(held)
    rows = alone.unionByName(name.select("part", F.col("super").alias("x"), F.array().cast("array<long>").alias("y"), F.lit(None).cast("array<double>").alias("w")).distinct())

    def run(table: pa.Table) -> pa.Table:
        each = table.column("x").to_numpy()
        y, at = _flat(table.column("y"))
        x = np.repeat(each, np.diff(at))
        names = np.unique(np.concatenate([each, y]))
        weight = np.ones(len(y))
        given = np.repeat(table.column("w").is_valid().to_numpy(), np.diff(at))
        weight[given] = _flat(table.column("w"))[0]
        neighbours: list[dict[int, float]] = [{} for _ in names]
        loops = np.zeros(len(names))
        for i, j, w in zip(np.searchsorted(names, x).tolist(), np.searchsorted(names, y).tolist(), weight.tolist(), strict=True):
            if i == j:
                loops[i] += w
            else:
                neighbours[i][j] = neighbours[i].get(j, 0.0) + w
                neighbours[j][i] = neighbours[j].get(i, 0.0) + w
        _, first, label = np.unique(louvain(neighbours, loops, total), return_index=True, return_inverse=True)
        return pa.table({"super": names, "community": names[first[label]]})

    found = pinned(rows.groupBy("part").applyInArrow(run, "super long, community long"))
    member = name.join(found, "super").join(ids, "id").select("path", "community")
    order = member.groupBy("community").agg(F.count("*").alias("n"), F.min("path").alias("least"))
    numbers = order.withColumn("community_id", F.row_number().over(Window.orderBy(F.col("n").desc(), "least")) - 1)
    return member.join(numbers.select("community", "community_id"), "community").select("path", "community_id")


def modularity(members: DataFrame, edges: DataFrame) -> DataFrame:
    """One row, modularity: of the undirected graph, by members (path, community_id)."""
    pairs = undirected(members, edges).join(members.select(F.col("path").alias("a"), F.col("community_id").alias("ca")), "a").join(members.select(F.col("path").alias("b"), F.col("community_id").alias("cb")), "b")
    pairs = pinned(pairs)
    ends = pairs.select(F.col("ca").alias("c")).union(pairs.select(F.col("cb").alias("c"))).groupBy("c").agg(F.count("*").cast("double").alias("degree"))
    m = float(pairs.count()) or 1.0
    inside = pairs.filter("ca = cb").groupBy(F.col("ca").alias("c")).agg(F.count("*").cast("double").alias("inside"))
    terms = ends.join(inside, "c", "left").select((F.coalesce("inside", F.lit(0.0)) / m - F.pow(F.col("degree") / (2 * m), F.lit(2))).alias("q"))
    return terms.agg(F.coalesce(F.sum("q"), F.lit(0.0)).alias("modularity"))


def cohesion(members: DataFrame, edges: DataFrame) -> DataFrame:
    """community_id, internal_edges, external_edges, cohesion: internal / (internal + external), 0 without edges. One pass for all communities.

    An edge counts once for each community that holds an end of it.
    """
    held = beside_edges(members)
    m1, m2 = held.select(F.col("path").alias("source"), F.col("community_id").alias("c1")), held.select(F.col("path").alias("target"), F.col("community_id").alias("c2"))
    ends = edges.select("source", "target").join(m1, "source", "left").join(m2, "target", "left")
    touched = ends.select(F.explode(F.array_distinct(F.array("c1", "c2"))).alias("community_id"), F.coalesce(F.col("c1") == F.col("c2"), F.lit(False)).alias("internal")).filter("community_id is not null")
    sums = touched.groupBy("community_id").agg(F.count_if("internal").alias("internal_edges"), F.count_if(~F.col("internal")).alias("external_edges"))
    all_ids = members.select("community_id").distinct().join(sums, "community_id", "left").fillna(0, ["internal_edges", "external_edges"])
    both = F.col("internal_edges") + F.col("external_edges")
    return all_ids.withColumn("cohesion", F.when(both > 0, F.col("internal_edges") / both).otherwise(0.0))


def names(members: DataFrame) -> DataFrame:
    """community_id, name: the directory that holds more than 60 % of the members (the second level, if one such holds more than half), else the two most common."""
    total = members.groupBy("community_id").agg(F.count("*").alias("n"))
    deep = paths.depth(F.col("path")) >= 2

    def ranked(directory: DataFrame) -> DataFrame:
        counts = directory.groupBy("community_id", "dir").agg(F.count("*").alias("c"))
        return counts.withColumn("k", F.row_number().over(Window.partitionBy("community_id").orderBy(F.col("c").desc(), "dir")))

    first = ranked(members.select("community_id", F.when(deep, paths.top(F.col("path"))).otherwise(F.lit(".")).alias("dir")))
    second = ranked(members.filter(deep).select("community_id", F.substring_index("path", "/", 2).alias("dir"))).filter("k = 1").select("community_id", F.col("dir").alias("second"), F.col("c").alias("second_count"))
    best = first.filter("k <= 2").groupBy("community_id").agg(F.max(F.when(F.col("k") == 1, F.col("dir"))).alias("d1"), F.max(F.when(F.col("k") == 1, F.col("c"))).alias("c1"), F.max(F.when(F.col("k") == 2, F.col("dir"))).alias("d2"))
    joined = best.join(total, "community_id").join(second, "community_id", "left")
    narrow = F.when(F.col("second_count") / F.col("n") > 0.5, F.col("second")).otherwise(F.col("d1"))
    return joined.select("community_id", F.when(F.col("c1") / F.col("n") > 0.6, narrow).otherwise(F.concat_ws(" + ", "d1", "d2")).alias("name"))


def top_files(members: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """community_id, top_files: the k files with the highest PageRank inside their community's own subgraph; ties by path.

    The subgraphs don't meet, so one PageRank over their union, with shares taken per community, ranks all of them at once.
    """
    held = beside_edges(members)
    inner = edges.join(held.select(F.col("path").alias("source"), F.col("community_id").alias("c1")), "source").join(held.select(F.col("path").alias("target"), F.col("community_id").alias("c2")), "target").filter("c1 = c2")
    rank = pagerank_by(members, inner.select("source", "target"))
    order = Window.partitionBy("community_id").orderBy(F.col("pagerank").desc(), "path")
    best = rank.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= k)
    return best.groupBy("community_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "path"))), lambda x: x["path"]).alias("top_files"))


def pagerank_by(members: DataFrame, edges: DataFrame, alpha: float = P.PAGERANK_ALPHA, rounds: int = P.PAGERANK_ROUNDS, tolerance: float | None = P.PAGERANK_TOLERANCE) -> DataFrame:
    """path, community_id, pagerank: PageRank of each community's own subgraph, all at once; teleport and dangling mass stay in the community.

    Nodes are numbers, and edges lists of the sources of each target, made by one shuffle. Communities of at most TASK_EDGES edges and nodes are a group of a task each; larger ones take
    their rounds together: a round brings the nodes' shares to the lists and adds up where they stand.
    """
    ids = numbered(members.select("path").distinct().orderBy("path"), "id")
    a, b = F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b")
    lists = pinned(graph.between(edges, ids).select(a, b).groupBy("b").agg(F.array_sort(F.collect_set("a")).alias("from")))
    swept(members)
    own = members.join(ids, "path").select("path", "id", "community_id")
    size = own.groupBy("community_id").agg(F.count("*").alias("n"))
    into = lists.select(F.col("b").cast("long").alias("id"), "from").join(beside_edges(own.select("id", "community_id")), "id")
    most = into.groupBy("community_id").agg(F.sum(F.size("from").cast("long")).alias("n")).unionByName(size).groupBy("community_id").agg(F.max("n").alias("n"))
    large = [row.community_id for row in most.filter(F.col("n") > graph.TASK_EDGES).collect()]
    small = lambda df: df.filter(~F.col("community_id").isin(large))
    rows = small(own).select("community_id", "id", F.lit(None).cast("array<int>").alias("from")).unionByName(small(into).select("community_id", "id", "from"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        names = np.unique(table.column("id").to_numpy())
        source, at = _flat(table.column("from"))
        target = np.repeat(table.column("id").to_numpy(), np.diff(at))
        here = np.isin(source, names)
        pairs = np.stack([np.searchsorted(names, source[here]), np.searchsorted(names, target[here])], axis=1)
        pairs = pairs[np.lexsort((pairs[:, 0], pairs[:, 1]))]
        rank = graph.pagerank_kernel(names, pairs, alpha, rounds, tolerance)
        return pa.table({"id": names, "pagerank": rank})

    named = lambda df: own.join(df, "id").select("path", "community_id", "pagerank")
    done = named(rows.groupBy("community_id").applyInArrow(run, "id long, pagerank double"))
    if not large:
        return done
    some = F.col("community_id").isin(large)
    pairs = into.filter(some).select(F.col("id").alias("b"), F.explode(F.col("from").cast("array<long>")).alias("a"))
    out = pairs.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("out"))
    rank = pinned(own.filter(some).join(size, "community_id").join(out, "id", "left").select("id", "community_id", "n", F.coalesce("out", F.lit(0)).alias("out"), (1.0 / F.col("n")).alias("pagerank")))
    for _ in range(rounds):
        lost = rank.filter("out = 0").groupBy("community_id").agg(F.sum("pagerank").alias("lost"))
        shares = rank.filter("out > 0").select(F.col("id").alias("a"), (F.col("pagerank") / F.col("out")).alias("share"))
        sent = pairs.join(beside_edges(shares), "a").groupBy(F.col("b").alias("id")).agg(F.sum("share").alias("got"))
        fresh = alpha * (F.coalesce("got", F.lit(0.0)) + F.coalesce("lost", F.lit(0.0)) / F.col("n")) + (1 - alpha) / F.col("n")
        step = pinned(rank.join(sent, "id", "left").join(lost, "community_id", "left").select("id", "community_id", "n", "out", fresh.alias("pagerank"), F.abs(fresh - F.col("pagerank")).alias("change")))
        rank = step.drop("change")
        if tolerance is None:
            continue
        moving = step.groupBy("community_id", "n").agg(F.sum("change").alias("change")).filter(F.col("change") >= F.col("n") * tolerance)
        if moving.isEmpty():
            break
    return done.unionByName(named(rank.select("id", "pagerank")))


def summary(members: DataFrame, edges: DataFrame) -> DataFrame:
    """The relation communities: id, name, member_count, cohesion (3 digits), top_files."""
    count = members.groupBy("community_id").agg(F.count("*").alias("member_count"))
    tops = top_files(members, edges)
    return count.join(names(members), "community_id").join(cohesion(members, edges), "community_id").join(tops, "community_id", "left").select("community_id", "name", "member_count", F.round("cohesion", 3).alias("cohesion"), F.coalesce("top_files", F.array().cast("array<string>")).alias("top_files"))


def coupling(members: DataFrame, edges: DataFrame, least: int = P.COUPLING_LEAST) -> DataFrame:
    """community_a, community_b, cross_edges, warning_level of the pairs with at least so many edges between them."""
    c1, c2 = members.select(F.col("path").alias("source"), F.col("community_id").alias("c1")), members.select(F.col("path").alias("target"), F.col("community_id").alias("c2"))
    crossing = edges.select("source", "target").join(c1, "source").join(c2, "target").filter("c1 <> c2")
    pairs = crossing.groupBy(F.least("c1", "c2").alias("community_a"), F.greatest("c1", "c2").alias("community_b")).agg(F.count("*").alias("cross_edges")).filter(F.col("cross_edges") >= least)
    level = F.when(F.col("cross_edges") > P.COUPLING_HIGH, "high").when(F.col("cross_edges") > P.COUPLING_MODERATE, "moderate").otherwise("low")
    return pairs.withColumn("warning_level", level)


