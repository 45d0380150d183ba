"""Parts of POSIX paths as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Last extension with its dot, in lower case; empty for names such as '.rc' and 'x.'."""
    return F.lower(F.regexp_extract(name(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    """Name without its last extension."""
    return F.regexp_extract(name(path), r"^(.+?)(\.[^.]+)?$", 1)


def parent(path: Column) -> Column:
    """Directory of a path; '.' at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit("."))


def top(path: Column) -> Column:
    """First segment."""
    return F.substring_index(path, "/", 1)


def depth(path: Column) -> Column:
    """Number of segments."""
    return F.size(F.split(path, "/"))


def ancestors(path: Column) -> Column:
    """Directories above a path, nearest first, '' being the root."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def normalized(path: Column) -> Column:
    """'.' and '..' segments resolved, as far as the path goes up."""
    def step(acc: Column, part: Column) -> Column:
        last = F.when(F.size(acc) > 0, F.element_at(acc, -1))
        up = (part == "..") & (F.size(acc) > 0) & (last != "..")
        return F.when((part == ".") | (part == ""), acc).when(up, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def short_label(path: Column) -> Column:
    """Last two segments after '.../' where there are more."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) <= 2, path).otherwise(F.concat(F.lit(".../"), F.array_join(F.slice(parts, -2, 2), "/")))


def slug(text: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", F.lit("unknown")).otherwise(s)
