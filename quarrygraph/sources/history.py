"""Commits of a repository as a relation (grain: commit and file), and what git says about the working tree."""

from __future__ import annotations

import subprocess
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph import params as P
from quarrygraph.sources import tree


class GitLog:
    """A repository's history, read by tasks in ranges of commits."""

    def __init__(self, spark: SparkSession, repo: str):
        self.spark, self.repo = spark, repo

    @cached_property
    def head(self) -> str:
        """The commit that HEAD is; empty in a repository without commits."""
        found = _lines(self.repo, "rev-parse", "--verify", "-q", "HEAD")
        return found[0] if found else ""

    def reaches(self, sha: str) -> bool:
        """Whether HEAD has the commit among its ancestors (it has not after a rewrite)."""
        return bool(sha and self.head) and _lines(self.repo, "merge-base", "--is-ancestor", sha, self.head) is not None

    def _read(self, **options: str) -> DataFrame:
        tree.register(self.spark)
        return self.spark.read.format("repository_log").option("path", self.repo).options(**options).load()

    def commits(self, since: str | None = None) -> DataFrame:
        """The relation commits, of HEAD without what `since` reaches."""
        if not self.head:
            return parse_log(self.spark.createDataFrame([], "value string"))
        return parse_log(self._read(head=self.head, **({"since": since} if since else {})))

    def tracked(self) -> DataFrame:
        """path of every tracked file. What git can't tell raises an error; nothing is left out."""
        return self._read(tracked="true").select(F.col("value").alias("path"))


def new_path(path: Column) -> Column:
    """The new path of a renamed one: 'a/{b => c}/d' and 'a => b'."""
    inside = F.regexp_replace(path, r"\{(.*?) => (.*?)\}", "$2")
    return F.regexp_replace(F.regexp_replace(inside, r"^.* => ", ""), "//", "/")


def old_path(path: Column) -> Column:
    inside = F.regexp_replace(path, r"\{(.*?) => (.*?)\}", "$1")
    return F.regexp_replace(F.regexp_replace(inside, r" => .*$", ""), "//", "/")


def parse_log(records: DataFrame) -> DataFrame:
    """commits from records (value) of LOG_FORMAT without the NUL. Binary files count no lines; a merge has more than one parent."""
    lines = records.filter(F.length(F.trim("value")) > 0).select(F.split("value", "\n").alias("l"))
    head = F.split(F.get("l", 0), "\x1f")
    rows = lines.select(head.alias("h"), F.explode_outer(F.filter(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0))), lambda x: F.length(F.trim(x)) > 0)).alias("line")).filter(F.size("h") >= 6)
    stat = F.split("line", "\t")
    number = lambda c: F.coalesce(F.expr(f"try_cast({c} as bigint)"), F.lit(0))
    out = rows.select("h", F.get(stat, 0).alias("a"), F.get(stat, 1).alias("d"), F.get(stat, 2).alias("p"))
    return out.select(
        F.get("h", 0).alias("sha"), new_path(F.col("p")).alias("file_path"), F.when(F.get("h", 1) == "", "unknown").otherwise(F.get("h", 1)).alias("author"), F.get("h", 2).alias("email"),
        F.timestamp_seconds(F.expr("try_cast(h[3] as bigint)")).alias("ts"), (F.size(F.filter(F.split(F.get("h", 4), " "), lambda x: x != "")) > 1).alias("is_merge"), F.get("h", 5).alias("subject"),
        number("a").alias("added"), number("d").alias("deleted"),
    ).filter("file_path is not null")


def code_files(commits: DataFrame) -> DataFrame:
    """Commits of files whose history is indexed, by extension."""
    from quarrygraph.functions import paths

    return commits.filter(paths.suffix(F.col("file_path")).isin(P.HISTORY_EXTENSIONS))


def newest(commits: DataFrame, limit: int = P.COMMIT_LIMIT, per_file: bool = True) -> DataFrame:
    """The newest commits: of each file, or of the whole repository without merges."""
    from pyspark.sql import Window

    if per_file:
        order = Window.partitionBy("file_path").orderBy(F.col("ts").desc(), "sha")
        return commits.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= limit).drop("k")
    shas = commits.filter(~F.col("is_merge")).select("sha", "ts").distinct().orderBy(F.col("ts").desc(), "sha").limit(limit).select("sha")
    return commits.join(F.broadcast(shas), "sha", "left_semi")


def _lines(repo: str, *args: str) -> list[str] | None:
    try:
        done = subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True, timeout=60)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return [x.strip().replace("\\", "/") for x in done.stdout.splitlines() if x.strip()] if done.returncode == 0 else None


def changed(repo: str) -> list[str]:
    """Paths that differ from HEAD, else those that are staged."""
    return _lines(repo, "diff", "--name-only", "HEAD") or _lines(repo, "diff", "--name-only", "--cached") or []


def top_level(path: str) -> str | None:
    found = _lines(path, "rev-parse", "--show-toplevel")
    return found[0] if found else None


def repository_name(repo: str) -> str:
    """Last segment of the remote's URL without '.git', else of the path."""
    url = _lines(repo, "remote", "get-url", "origin")
    name = (url[0] if url else repo).rstrip("/").replace(":", "/").rsplit("/", 1)[-1]
    return name.removesuffix(".git") or "repository"
