"""Findings: unreachable files, packages that nothing imports, files that sit in the wrong community."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrygraph import params as P
from quarrygraph.functions import globs, paths
from quarrygraph.schemas import schema

UNREACHABLE, ZOMBIE, MISPLACED = "unreachable_file", "zombie_package", "misplaced_file"


def is_code(language: Column) -> Column:
    return ~F.coalesce(language, F.lit("unknown")).isin(P.NON_CODE_LANGUAGES)


def is_fixture(path: Column) -> Column:
    return F.lower(path).rlike("(?:^|/)(?:" + "|".join(P.FIXTURE_SEGMENTS) + ")/")


def never_flagged(path: Column, whitelist: list[str] | tuple[str, ...] = ()) -> Column:
    fits = globs.any_match(path, [globs.path_match(p) for p in P.NEVER_FLAG])
    return fits | path.isin(list(whitelist)) if whitelist else fits


def is_dynamic(path: Column, patterns: list[str] = P.DYNAMIC_NAMES) -> Column:
    return globs.any_match(paths.stem(path), [globs.name_match(p) for p in patterns])


def _files(nodes: DataFrame) -> DataFrame:
    return nodes.filter(~F.col("path").startswith(P.EXTERNAL))


def _finding(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema("dead_code")))


def unreachable(nodes: DataFrame, edges: DataFrame, git: DataFrame, as_of: datetime | str, whitelist: list[str] | tuple[str, ...] = (), dynamic: list[str] = P.DYNAMIC_NAMES) -> DataFrame:
    """Code files that no edge leads to, entry points, tests, fixtures and never-flagged names left out.

    Confidence: 1.0 without a commit in 90 days and the last one older than 180, 0.7 without one in 90 days, else 0.4. Safe to delete from 0.7, unless the
    name suggests dynamic use.
    """
    path = F.col("path")
    suspects = _files(nodes).filter(is_code(F.col("language")) & ~F.col("is_entry_point") & ~F.col("is_test") & ~is_fixture(path) & ~never_flagged(path, whitelist))
    alone = suspects.join(edges.select(F.col("target").alias("path")), "path", "left_anti").select(F.col("path").alias("file_path"))
    known = alone.join(git.select("file_path", "commit_count_90d", "last_commit_at", "primary_owner", "age_days"), "file_path", "left")
    quiet = F.coalesce("commit_count_90d", F.lit(0)) == 0
    age = F.floor((F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(F.col("last_commit_at").cast("timestamp"))) / 86400)
    confidence = F.when(quiet & (age > P.OLD_DAYS), 1.0).when(quiet, 0.7).otherwise(0.4)
    out = known.select(
        "file_path", F.lit(UNREACHABLE).alias("kind"), confidence.alias("confidence"), F.lit("File has no importers (in_degree=0)").alias("reason"),
        ((confidence >= 0.7) & ~is_dynamic(F.col("file_path"), dynamic)).alias("safe_to_delete"), F.lit(0).alias("importers"), "last_commit_at", F.coalesce("commit_count_90d", F.lit(0)).alias("commit_count_90d"), "primary_owner", "age_days",
    )
    return _finding(out)


def zombie_packages(nodes: DataFrame, edges: DataFrame, whitelist: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Top directories with a package marker right below, of two or more, that no file of another directory imports."""
    files = _files(nodes).filter(paths.depth(F.col("path")) > 1).select("path", paths.top(F.col("path")).alias("package"))
    marked = files.filter((paths.depth(F.col("path")) == 2) & paths.name(F.col("path")).isin(P.PACKAGE_MARKERS)).select("package").distinct()
    enough = marked.agg((F.count("*") >= 2).alias("enough")).filter("enough")
    outside = edges.filter(~F.col("source").startswith(P.EXTERNAL)).select(paths.top(F.col("source")).alias("from"), F.col("target").alias("path")).join(files, "path").filter("`from` <> package").select("package").distinct()
    alone = marked.join(outside, "package", "left_anti").join(F.broadcast(enough), F.lit(True), "left_semi")
    if whitelist:
        alone = alone.filter(~F.col("package").isin(list(whitelist)))
    reason = F.concat(F.lit("Package '"), "package", F.lit("' has no importers from other packages"))
    return _finding(alone.select(F.col("package").alias("file_path"), F.lit(ZOMBIE).alias("kind"), F.lit(0.5).alias("confidence"), reason.alias("reason"), F.lit(False).alias("safe_to_delete"), F.lit(0).alias("importers"), F.lit(0).alias("commit_count_90d")))


def callers_by_community(edges: DataFrame, members: DataFrame) -> DataFrame:
    """path, callers (importing files), own community, least and greatest community among the callers that have one."""
    own = members.select(F.col("path").alias("target"), F.col("community_id").alias("current_community"))
    of = members.select(F.col("path").alias("source"), F.col("community_id").alias("caller_community"))
    imports = edges.filter((F.col("edge_type") == P.IMPORTS) & ~F.col("source").startswith(P.EXTERNAL)).select("source", "target")
    joined = imports.join(own, "target").join(of, "source", "left")
    return joined.groupBy(F.col("target").alias("path"), "current_community").agg(F.count("*").alias("callers"), F.min("caller_community").alias("c1"), F.max("caller_community").alias("c2"))


def misplaced(nodes: DataFrame, edges: DataFrame, members: DataFrame, git: DataFrame | None = None) -> DataFrame:
    """Files with one or two importers that all sit in one other community."""
    files = _files(nodes).filter(is_code(F.col("language")) & ~F.col("is_test") & ~F.col("is_entry_point")).select("path")
    moved = callers_by_community(edges, members).filter("callers between 1 and 2 and c1 = c2 and c1 <> current_community").join(files, "path", "left_semi")
    reason = F.format_string("All %d importer(s) are in community %d, but file is in community %d. Consider moving.", "callers", "c1", "current_community")
    out = moved.select(F.col("path").alias("file_path"), F.lit(MISPLACED).alias("kind"), F.lit(0.3).alias("confidence"), reason.alias("reason"), F.lit(False).alias("safe_to_delete"), F.col("callers").alias("importers"))
    if git is not None:
        out = out.join(git.select("file_path", "last_commit_at", F.coalesce("commit_count_90d", F.lit(0)).alias("commit_count_90d"), "primary_owner", "age_days"), "file_path", "left")
    return _finding(out)


def analyze(nodes: DataFrame, edges: DataFrame, git: DataFrame, as_of: datetime | str, config: dict | None = None) -> DataFrame:
    """All findings from min_confidence on. config: detect_unreachable_files, detect_zombie_packages, whitelist, dynamic_patterns, min_confidence."""
    c = config or {}
    whitelist = tuple(c.get("whitelist", ()))
    out = unreachable(nodes, edges, git, as_of, whitelist, list(c.get("dynamic_patterns", P.DYNAMIC_NAMES)))
    if not c.get("detect_unreachable_files", True):
        out = out.limit(0)
    if c.get("detect_zombie_packages", True):
        out = out.unionByName(zombie_packages(nodes, edges, whitelist))
    return out.filter(F.col("confidence") >= c.get("min_confidence", P.MIN_CONFIDENCE))


def report(findings: DataFrame, moves: DataFrame | None = None, min_confidence: float = P.MIN_CONFIDENCE) -> DataFrame:
    """Findings from min_confidence on, most confident first; move suggestions, if given, are listed whatever their confidence."""
    kept = findings.filter(F.col("confidence") >= min_confidence)
    return (kept if moves is None else kept.unionByName(moves)).orderBy(F.col("confidence").desc(), "kind", "file_path")
