"""Execution flows: what each entry point reaches through imports, and how critical it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrygraph import params as P
from quarrygraph.functions import paths
from quarrygraph.operators import graph
from quarrygraph.operators.impact import security_sensitive
from quarrygraph.operators.tables import beside_edges, pinned


def entry_points(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """path of marked entry points, of files other than tests that nothing imports, and of files with conventional names."""
    return _entries(nodes, edges.filter(F.col("edge_type") == P.IMPORTS).select(F.col("target").alias("path")).distinct())


def _entries(nodes: DataFrame, imported: DataFrame) -> DataFrame:
    """entry_points of nodes, given what is imported (path, each once)."""
    files = nodes.filter(~F.col("path").startswith(P.EXTERNAL)).select("path", "is_entry_point", "is_test")
    j = files.join(imported.withColumn("imported", F.lit(True)), "path", "left")
    root = ~F.col("is_test") & F.col("imported").isNull()
    return j.filter(F.col("is_entry_point") | root | F.lower(paths.stem(F.col("path"))).isin(P.CONVENTIONAL_STEMS)).select("path")


def _numbers(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ids (path, id), and every edge once as numbers (a, b), with what flows ask of its names and type."""
    kind = F.col("edge_type")
    return graph.keyed_whole(nodes, edges, F.coalesce(kind == P.IMPORTS, F.lit(False)).alias("imports"), (kind == P.TESTED_BY).alias("tested"), F.coalesce(F.col("target").startswith(P.EXTERNAL), F.lit(False)).alias("outside"))


def _members(nodes: DataFrame, ids: DataFrame, rows: DataFrame, max_depth: int) -> DataFrame:
    """members in numbers: seed, node, depth, pinned. All entry points are one traversal, with bitmaps of entry points at the nodes."""
    imported = rows.filter("imports AND b is not null").select(F.col("b").alias("id")).distinct().join(ids, "id").select("path")
    starts = _entries(nodes, imported).distinct().join(ids, "path").select("id")
    steps = rows.filter("imports AND NOT outside AND a is not null AND b is not null").select("a", "b")
    return graph.reach_numbers(ids, steps, starts, max_depth)


def members(nodes: DataFrame, edges: DataFrame, max_depth: int = P.FLOW_DEPTH) -> DataFrame:
    """entry_point, path, depth: what each entry point reaches through imports among files, itself at 0."""
    ids, rows = _numbers(nodes, edges)
    held = beside_edges(ids)
    named = lambda c, to: held.select(F.col("id").alias(c), F.col("path").alias(to))
    return _members(nodes, ids, rows, max_depth).join(named("seed", "entry_point"), "seed").join(named("node", "path"), "node").select("entry_point", "path", "depth")


def _score(reached: DataFrame, nodes: DataFrame, ids: DataFrame, rows: DataFrame) -> DataFrame:
    """The relation flows, pinned, with seed (the entry point's number), for reached (seed, node, depth); flows of one file are left out. flow_id: 8 digits of the entry point's SHA-256.

    Criticality: 0.30 directories, 0.20 external calls, 0.25 sensitive names, 0.15 untested files, 0.10 size. What a path says is read once for each file; the rows of reached, many times as many, bring numbers together.
    """
    own = rows.filter("a is not null").groupBy(F.col("a").alias("id")).agg(F.nullif(F.count_if("outside"), F.lit(0)).alias("calls"), F.bool_or("tested").alias("tested"))
    known = nodes.select("path", "is_test").join(ids, "path").join(own, "id", "left").select("id", "is_test", "calls", "tested")
    folders = pinned(ids.select("id", paths.parent(F.col("path")).alias("dir"), security_sensitive(F.col("path")).alias("sensitive")))
    folders = folders.join(folders.groupBy("dir").agg(F.min("id").alias("folder")), "dir").select("id", "folder", "sensitive")
    of = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    per_file = pinned(folders.join(known, "id", "left").select(F.col("id").alias("node"), "folder", "sensitive", of("is_test"), "calls", of("tested")))
    g = reached.join(beside_edges(per_file), "node").groupBy("seed").agg(
        F.count("*").alias("n"), F.countDistinct("folder").alias("dirs"), F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"), F.count_if("sensitive").alias("hits"),
        F.count_if(~F.col("is_test")).alias("plain"), F.count_if(~F.col("is_test") & F.col("tested")).alias("covered"), F.bool_or("tested").alias("has_test_coverage"),
    ).filter("n >= 2")
    one = F.lit(1.0)
    criticality = (
        0.30 * F.least((F.col("dirs") - 1) / 4.0, one) + 0.20 * F.least(F.col("calls") / 5.0, one) + 0.25 * F.least(F.col("hits") / F.col("n"), one)
        + 0.15 * (one - F.col("covered") / F.greatest("plain", F.lit(1))) + 0.10 * F.least(F.col("n") / 10.0, one)
    )
    named = g.join(ids.select(F.col("id").alias("seed"), F.col("path").alias("entry_point")), "seed")
    return pinned(named.select("seed", F.substring(F.sha2("entry_point", 256), 1, 8).alias("flow_id"), "entry_point", F.col("n").alias("node_count"), F.col("dirs").alias("file_spread"), F.least(criticality, one).alias("criticality"), "has_test_coverage"))


def trace(nodes: DataFrame, edges: DataFrame, max_depth: int = P.FLOW_DEPTH) -> tuple[DataFrame, DataFrame]:
    """(flows, flow_members). Members keep their depth and their place in breadth-first order (ties by path). Files are numbers, in the order of paths, until the end."""
    ids, rows = _numbers(nodes, edges)
    reached = _members(nodes, ids, rows, max_depth)
    found = _score(reached, nodes, ids, rows)
    order = Window.partitionBy("flow_id").orderBy("depth", "node")
    placed = reached.join(beside_edges(found.select("flow_id", "seed")), "seed").select("flow_id", "node", "depth").withColumn("ord", F.row_number().over(order) - 1)
    return found.drop("seed"), placed.join(beside_edges(ids.select(F.col("id").alias("node"), "path")), "node").select("flow_id", "path", "depth", "ord")


def find(flows: DataFrame, query: str) -> DataFrame:
    """The flow that a query means: its id's beginning or its entry point, else a part of the entry point; of several the most critical."""
    exact = F.col("flow_id").startswith(query) | (F.col("entry_point") == query)
    rank = F.when(exact, 0).when(F.col("entry_point").contains(query), 1)
    return flows.withColumn("rank", rank).filter("rank is not null").orderBy("rank", F.col("criticality").desc(), "entry_point").limit(1).drop("rank")
