"""Refactoring aids: rename previews, moves, large functions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrygraph import params as P
from quarrygraph.operators.deadcode import callers_by_community


def move_suggestions(edges: DataFrame, members: DataFrame) -> DataFrame:
    """file_path, current_community, suggested_community, caller_count, reason of files whose callers all sit in one other community."""
    moved = callers_by_community(edges, members).filter("c1 = c2 and c1 <> current_community")
    reason = F.format_string("All %d caller(s) are in community %d, but this file is in community %d", "callers", "c1", "current_community")
    return moved.select(F.col("path").alias("file_path"), "current_community", F.col("c1").alias("suggested_community"), F.col("callers").alias("caller_count"), reason.alias("reason"))


def large_functions(symbols: DataFrame, threshold: int = P.LARGE_FUNCTION_LINES) -> DataFrame:
    """file_path, name, kind, start_line, end_line, line_count of functions and methods with so many lines or more."""
    lines = F.col("end_line") - F.col("start_line") + 1
    return symbols.filter(F.col("kind").isin(P.FUNCTION_KINDS) & (lines >= threshold)).select(F.col("path").alias("file_path"), F.coalesce("qualified_name", "name").alias("name"), "kind", "start_line", "end_line", lines.alias("line_count"))


def rename_edits(nodes: DataFrame, edges: DataFrame, target: str, new_name: str) -> DataFrame:
    """file, kind, old_text, new_text, source_file, imported_names of each edit.

    A path: files that import it, and its tests. Any other name: edges that import the name.
    """
    target = target.replace("\\", "/")
    is_file = nodes.filter(F.col("path") == target).limit(1).select(F.lit(True).alias("is_file"))
    texts = [F.lit(target).alias("old_text"), F.lit(new_name).alias("new_text")]
    none = F.lit(None).cast("string").alias("source_file")
    importers = edges.filter((F.col("target") == target) & ~F.col("source").startswith(P.EXTERNAL)).select(F.col("source").alias("file"), F.lit("import_path").alias("kind"), *texts, none, "imported_names")
    tests = edges.filter((F.col("source") == target) & (F.col("edge_type") == P.TESTED_BY)).select(F.col("target").alias("file"), F.lit("test_import").alias("kind"), *texts, none, "imported_names")
    named = edges.filter(F.array_contains("imported_names", target)).select(F.col("source").alias("file"), F.lit("symbol_reference").alias("kind"), *texts, F.col("target").alias("source_file"), "imported_names")
    known = F.broadcast(is_file)
    return importers.unionByName(tests).join(known, F.lit(True), "left_semi").unionByName(named.join(known, F.lit(True), "left_anti"))


def preview(nodes: DataFrame, edges: DataFrame, target: str, new_name: str, created_at: datetime | str) -> DataFrame:
    """One row of refactor_previews. The id is made from target, name and time."""
    edits = rename_edits(nodes, edges, target, new_name)
    item = F.struct("file", "kind", "old_text", "new_text", "source_file")
    when = F.lit(created_at).cast("timestamp")
    listed = edits.agg(F.array_sort(F.collect_list(item)).alias("edits"))
    key = F.sha2(F.concat_ws("|", F.lit(target), F.lit(new_name), F.date_format(when, "yyyy-MM-dd HH:mm:ss.SSSSSS")), 256)
    return listed.select(F.substring(key, 1, 8).alias("preview_id"), when.alias("created_at"), F.lit(target).alias("target_name"), F.lit(new_name).alias("new_name"), F.lit("rename").alias("kind"), "edits")


def live(previews: DataFrame, now: datetime | str, minutes: int = P.PREVIEW_MINUTES) -> DataFrame:
    """Previews that haven't run out."""
    return previews.filter(F.col("created_at") >= F.lit(now).cast("timestamp") - F.make_dt_interval(mins=F.lit(minutes)))
