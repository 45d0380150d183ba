"""Source files of a repository, or of any table of (path, content, length, modificationTime)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrygraph import params as P
from quarrygraph.functions import globs, paths
from quarrygraph.schemas import DDL
from quarrygraph.sources.tree import file_system
from quarrygraph.sources.tree import files as list_tree

FILES = DDL["files"]
RAW = "path string, abs_path string, length long, modificationTime timestamp, content binary"
#: Bytes of one reading task, about.
TASK_BYTES = 32 << 20


def tree(spark: SparkSession, root: str, max_bytes: int = P.MAX_FILE_BYTES) -> DataFrame:
    """path, abs_path, length, modificationTime of every file under root that is small enough, listed by tasks. root: a path that the executors see too, or a URI."""
    return list_tree(spark, root).filter(F.col("length") <= max_bytes)


def read_content(listed: DataFrame, root: str) -> DataFrame:
    """Raw files of listed ones. Tasks read files of about TASK_BYTES together (small files weigh TASK_BYTES / 1000)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(root)
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                content = []
                for path in part.column(1).to_pylist():
                    with fs.open_input_stream(path) as f:
                        content.append(f.read())
                yield pa.record_batch([*part.columns, pa.array(content, pa.binary())], schema.names)

    schema = T._parse_datatype_string(RAW)
    names = listed.select("path", "abs_path", "length", "modificationTime")
    size = names.agg(F.sum(F.greatest("length", F.lit(TASK_BYTES // 1000)))).first()[0] or 0
    return names.repartition(max(1, -(-size // TASK_BYTES))).mapInArrow(run, schema)


def read_raw(spark: SparkSession, root: str, max_bytes: int = P.MAX_FILE_BYTES) -> DataFrame:
    """Every file under root that is small enough, with its content."""
    return read_content(tree(spark, root, max_bytes), root)


def language_of(path: Column) -> Column:
    """Language by special name, then by extension; null if neither tells."""
    table, special = (F.expr("map(" + ", ".join(f"'{x}'" for kv in known.items() for x in kv) + ")") for known in (P.EXTENSION_LANGUAGE, P.SPECIAL_NAMES))
    return F.coalesce(F.get(F.transform(F.array(paths.name(path)), lambda n: special[n]), 0), F.get(F.transform(F.array(paths.suffix(path)), lambda s: table[s]), 0))


def shebang_language(text: Column) -> Column:
    """Language that the first line's interpreter names; null without one."""
    line = F.substring(F.substring_index(text, "\n", 1), 1, 200)
    found = F.when(line.contains("python"), "python").when(line.contains("node"), "javascript").when(line.contains("bash") | line.contains(" sh"), "shell").when(line.contains("ruby"), "ruby")
    return F.when(line.startswith("#!"), found)


def is_binary(content: Column) -> Column:
    """A NUL among the first 8192 bytes."""
    return F.hex(F.substring(content, 1, 8192)).rlike("^(?:..)*?00")


def is_generated(path: Column, text: Column) -> Column:
    """A generator's file name, or its marker in the first 512 characters."""
    header = F.upper(F.substring(text, 1, 512))
    marked = globs.any_match(header, [re.escape(m.upper()) for m in P.GENERATED_MARKERS])
    return globs.any_match(paths.name(path), [re.escape(s) + "$" for s in P.GENERATED_SUFFIXES]) | marked


def is_test(path: Column) -> Column:
    stem = F.lower(paths.stem(path))
    return stem.rlike("^(?:test|spec)_|_(?:test|spec)$") | F.lower(path).rlike("/(?:test|tests|spec)/")


def is_config(language: Column) -> Column:
    return language.isin(P.CONFIG_LANGUAGES)


def is_entry_point(path: Column) -> Column:
    return paths.name(path).isin(P.ENTRY_NAMES) | F.lower(paths.stem(path)).isin(P.ENTRY_STEMS)


def in_skipped_directory(path: Column, ignore: list[tuple[bool, str]] = [], extra: list[tuple[bool, str]] = []) -> Column:  # noqa: B006
    """Whether a directory above the path is blocked or ignored (what is below it can't be taken back by a later rule)."""
    blocked = F.arrays_overlap(F.slice(F.split(path, "/"), 1, F.greatest(paths.depth(path) - 1, F.lit(0))), F.array(*(F.lit(d) for d in P.BLOCKED_DIRS)))
    above = F.lit(False)
    if ignore or extra:
        above = F.exists(F.filter(paths.ancestors(path), lambda a: a != ""), lambda a: globs.ignored(F.concat(a, F.lit("/")), ignore) | globs.ignored(F.concat(a, F.lit("/")), extra))
    return blocked | above


def worth_reading(listed: DataFrame, ignore_lines: list[str] | None = None, extra_excludes: list[str] | None = None) -> DataFrame:
    """Of listed files those that no rule on paths leaves out: their content isn't looked at."""
    ignore, extra = globs.ignore_rules(ignore_lines or []), globs.ignore_rules(extra_excludes or [])
    path = F.col("path")
    kept = listed.filter(~F.coalesce(paths.suffix(path).isin(P.BLOCKED_EXTENSIONS), F.lit(False))).filter(~in_skipped_directory(path, ignore, extra))
    return kept.filter(~globs.ignored(path, ignore) & ~globs.ignored(path, extra) & ~globs.ignored(path, globs.ignore_rules(P.BLOCKED_NAMES)))


def classify(raw: DataFrame, ignore_lines: list[str] | None = None, extra_excludes: list[str] | None = None, max_bytes: int = P.MAX_FILE_BYTES) -> DataFrame:
    """Of raw files (path, content and, if there, abs_path, length, modificationTime) those worth indexing, as the relation files, with text.

    Cheap tests on path and size come first; only files that pass have their content looked at.
    """
    path = F.col("path")
    length = F.col("length") if "length" in raw.columns else F.length("content").cast("long")
    modified = F.col("modificationTime") if "modificationTime" in raw.columns else F.lit(None).cast("timestamp")
    where = F.col("abs_path") if "abs_path" in raw.columns else path
    kept = worth_reading(raw.filter(length <= max_bytes), ignore_lines, extra_excludes)
    typed = kept.select(path, where.alias("abs_path"), length.alias("size_bytes"), modified.alias("last_modified"), "content", F.decode("content", "UTF-8").alias("text"), language_of(path).alias("known"))
    typed = typed.withColumn("language", F.coalesce("known", F.when(~is_binary(F.col("content")), shebang_language(F.col("text"))))).filter("language is not null")
    typed = typed.filter(F.col("language").isin(P.NO_GENERATED_CHECK) | ~is_generated(path, F.col("text")))
    return typed.select(
        "path", "abs_path", "language", "size_bytes", "last_modified", is_test(path).alias("is_test"), is_config(F.col("language")).alias("is_config"), is_entry_point(path).alias("is_entry_point"),
        F.sha2("content", 256).alias("content_hash"), "text",
    )


def scan(spark: SparkSession, root: str, extra_excludes: list[str] | None = None, max_kb: int = 500) -> DataFrame:
    """Files of a repository, by its root .gitignore."""
    raw = read_raw(spark, root, max_kb * 1024)
    return classify(raw, ignore_file(spark, root), extra_excludes, max_kb * 1024)


def ignore_file(spark: SparkSession, root: str) -> list[str]:
    """Lines of the root .gitignore (none if it isn't there)."""
    return read_small(spark, f"{root.rstrip('/')}/.gitignore").splitlines()


def read_small(spark: SparkSession, path: str) -> str:
    """Text of one small configuration file; empty if it isn't there."""
    folder, _, name = path.rpartition("/")
    fs, base = file_system(folder)
    if fs.get_file_info(f"{base}/{name}").type != pafs.FileType.File:
        return ""
    with fs.open_input_stream(f"{base}/{name}") as f:
        return f.read().decode("utf-8", "replace")
