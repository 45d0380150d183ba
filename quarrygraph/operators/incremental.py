"""What changed between two snapshots of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrygraph.operators.graph import dependents


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change_type (added, modified, deleted) for snapshots (path, content_hash); an empty or null stored hash counts as no file."""
    a = old.filter(F.length("content_hash") > 0).select("path", F.col("content_hash").alias("before"))
    b = new.select("path", F.col("content_hash").alias("after"))
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "deleted").when(F.col("before") != F.col("after"), "modified")
    return a.join(b, "path", "full_outer").select("path", kind.alias("change_type")).filter("change_type is not null")


def near(edges: DataFrame, changed: DataFrame, present: DataFrame, hops: int = 2) -> DataFrame:
    """path, change_type (dependent) of the present files (path) that lead to a changed one within so many hops."""
    found = dependents(edges, changed, hops).join(present.select("path"), "path", "left_semi").join(changed.select("path"), "path", "left_anti")
    return found.select("path", F.lit("dependent").alias("change_type"))


def changes(old: DataFrame, new: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """diff, and the present files that lead to a changed one within so many hops, as dependent."""
    changed = diff(old, new)
    return changed.unionByName(near(edges, changed, new, hops))


def latest_wins(table: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """table with the rows of fresh in place of those with the same keys."""
    return table.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def without(nodes: DataFrame, edges: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without the removed paths and every edge at them."""
    gone = removed.select("path")
    kept = edges.join(gone.withColumnRenamed("path", "source"), "source", "left_anti").join(gone.withColumnRenamed("path", "target"), "target", "left_anti")
    return nodes.join(gone, "path", "left_anti"), kept.select(*edges.columns)


def with_hashes(nodes: DataFrame, hashes: DataFrame) -> DataFrame:
    """nodes with the content hashes of (path, content_hash) where there are some."""
    names = nodes.columns
    return nodes.withColumnRenamed("content_hash", "_old").join(hashes.select("path", "content_hash"), "path", "left").withColumn("content_hash", F.coalesce("content_hash", "_old")).select(*names)
