"""What a change reaches, and how risky each file is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrygraph import params as P
from quarrygraph.operators.graph import k_hops, reach_sets, reversed_edges
from quarrygraph.operators.tables import beside_edges, pinned


def security_sensitive(path: Column) -> Column:
    return F.lower(path).rlike("|".join(P.SECURITY_KEYWORDS))


def risk_level(score: Column) -> Column:
    """Level by the unrounded score."""
    return F.when(score >= 0.7, "CRITICAL").when(score >= 0.5, "HIGH").when(score >= 0.3, "MEDIUM").otherwise("LOW")


def risk_scores(nodes: DataFrame, edges: DataFrame, git: DataFrame, members: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """path, is_test, has_tests, community_id, risk: seven added factors, at most 1. only (path): the files wanted."""
    files = nodes if only is None else nodes.join(only.select("path"), "path", "left_semi")
    files = files.select("path", "is_test", F.coalesce("pagerank", F.lit(0.0)).alias("pagerank"))
    # of few files, only their edges are counted
    near = None if only is None else beside_edges(only.select("path"))
    at = lambda end: edges if near is None else edges.join(near.withColumnRenamed("path", end), end, "left_semi")
    tested = at("source").filter(F.col("edge_type") == P.TESTED_BY).select(F.col("source").alias("path")).distinct().withColumn("tested", F.lit(True))
    own = beside_edges(members.select("path", "community_id"))
    of = lambda end, name: own.select(F.col("path").alias(end), F.col("community_id").alias(name))
    # both counts are sums over one pass of the edges, which stay where they are
    into = at("target").select("source", "target").join(of("source", "from_community"), "source", "left").join(of("target", "own"), "target", "left")
    incoming = into.groupBy(F.col("target").alias("path")).agg(F.count("*").alias("in_degree"), F.count_if(F.col("from_community") != F.col("own")).alias("crossing"))
    churn = git.select(F.col("file_path").alias("path"), "is_hotspot", "hotspot_score", "bus_factor")
    j = files.join(incoming, "path", "left").join(tested, "path", "left").join(churn, "path", "left").join(members.select("path", "community_id"), "path", "left")
    has_tests = F.coalesce("tested", F.lit(False))
    zero = lambda c: F.coalesce(c, F.lit(0))
    hot = F.coalesce("is_hotspot", F.lit(False)) | (F.coalesce("hotspot_score", F.lit(0.0)) > 0.5)
    add = lambda test, value: F.when(test, value).otherwise(0.0)
    score = (
        F.least(zero("in_degree") / 20.0, F.lit(0.10)) + add(~has_tests & ~F.col("is_test"), 0.30) + F.least(zero("crossing") * 0.05, F.lit(0.15)) + add(hot, 0.15)
        + add((zero("bus_factor") <= 1) & ~F.col("is_test"), 0.10) + add(F.col("pagerank") > 0.005, 0.10) + add(security_sensitive(F.col("path")), 0.10)
    )
    return j.select("path", "is_test", has_tests.alias("has_tests"), "community_id", F.least(score, F.lit(1.0)).alias("risk"))


def impact(nodes: DataFrame, edges: DataFrame, git: DataFrame, members: DataFrame, seeds: DataFrame, max_depth: int = P.IMPACT_DEPTH) -> DataFrame:
    """path, depth, risk_score, risk_level, has_tests, is_test, community_id of every file within max_depth of the seeds (path), in either direction."""
    hit = pinned(k_hops(edges, seeds, max_depth))
    scored = risk_scores(nodes, edges, git, members, hit)
    return hit.join(scored, "path").select("path", "depth", F.col("risk").alias("risk_score"), risk_level(F.col("risk")).alias("risk_level"), "has_tests", "is_test", "community_id")


def directions(edges: DataFrame, impacted: DataFrame, seeds: DataFrame) -> DataFrame:
    """path, direction of impacted files (path), by the first seed in the order of paths that tells: dependency (the file has an edge to the seed), dependent (the seed has one to the file),
    upstream (edges lead from the file to the seed over others), else unknown.
    """
    near = seeds.select("path").distinct()
    files = impacted.select("path").distinct()
    steps = edges.select("source", "target").distinct()
    # what leads to a seed: a traversal of the reversed edges, all seeds at once
    above = reach_sets(reversed_edges(steps), near).select(F.col("node").alias("path"), F.col("seed"), F.lit(2).alias("kind"))
    to = steps.join(near.withColumnRenamed("path", "target"), "target").select(F.col("source").alias("path"), F.col("target").alias("seed"), F.lit(0).alias("kind"))
    of = steps.join(near.withColumnRenamed("path", "source"), "source").select(F.col("target").alias("path"), F.col("source").alias("seed"), F.lit(1).alias("kind"))
    told = to.unionByName(of).unionByName(above).filter("path <> seed").join(files, "path", "left_semi").groupBy("path").agg(F.min(F.struct("seed", "kind")).alias("told"))
    names = F.array(*(F.lit(x) for x in ("dependency", "dependent", "upstream")))
    return files.join(told, "path", "left").select("path", F.coalesce(F.get(names, F.col("told.kind")), F.lit("unknown")).alias("direction"))


def summary(impacted: DataFrame) -> DataFrame:
    """One row: total_impacted, max_risk, risk_level, tested_files (tests among the impacted, sorted)."""
    worst = F.coalesce(F.max("risk_score"), F.lit(0.0))
    return impacted.agg(F.count("*").alias("total_impacted"), worst.alias("max_risk"), F.array_sort(F.collect_list(F.when(F.col("is_test"), F.col("path")))).alias("tested_files")).select("total_impacted", "max_risk", risk_level(F.col("max_risk")).alias("risk_level"), "tested_files")


def file_report(nodes: DataFrame, edges: DataFrame, git: DataFrame, path: str) -> DataFrame:
    """One row on one file: what imports it, what it imports, its tests, its history, its ten closest co-change partners. No row for an unknown file."""
    imports = edges.filter(F.col("edge_type") == P.IMPORTS)
    node = nodes.filter(F.col("path") == path)

    def listed(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.agg(F.array_sort(F.collect_list(column)).alias(name)).withColumn("path", F.lit(path))

    importers = listed(imports.filter(F.col("target") == path), "source", "importers")
    needed = listed(imports.filter(F.col("source") == path), "target", "dependents")
    tests = listed(edges.filter((F.col("source") == path) & (F.col("edge_type") == P.TESTED_BY)), "target", "tested_by")
    past = git.filter(F.col("file_path") == path).select(
        F.col("file_path").alias("path"), F.struct("commit_count", "commit_count_90d", "last_commit_at", "is_hotspot", "hotspot_score", "primary_owner", "bus_factor").alias("git"), F.slice("co_change_partners", 1, 10).alias("co_changes")
    )
    out = node.join(importers, "path").join(needed, "path").join(tests, "path").join(past, "path", "left")
    return out.select(
        F.col("path").alias("file"), "language", F.col("symbol_count").alias("symbols"), "is_entry_point", "is_test", "pagerank", "betweenness", F.size("importers").alias("importer_count"), "importers",
        F.size("dependents").alias("dependent_count"), "dependents", "git", "co_changes", "tested_by",
    )
