"""From imports to edges. Each import becomes ranked candidates, an equi-join finds those that exist, and the best rank wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrygraph import params as P
from quarrygraph.functions import paths


def _array(*items: Column) -> Column:
    return F.array(*items)


def _join_path(base: Column, rest: Column) -> Column:
    return F.when((base == ".") | (base == ""), rest).otherwise(F.concat(base, F.lit("/"), rest))


def candidates(imports: DataFrame) -> DataFrame:
    """imports with candidate paths in the order they are tried, and the stem to fall back to (null: none).

    Python: relative by leading dots, else the dotted path, then the last part's stem. Scripts: relative paths only (aliases come on their own).
    C and C++: the importer's directory, then the stem. Go: the last part's stem. Everything else: the stem.
    """
    here, module, language = paths.parent(F.col("path")), F.col("module_path"), F.col("language")
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    rest = F.regexp_replace(F.regexp_replace(module, r"^\.+", ""), r"\.", "/")
    parts = F.when(here == ".", F.array().cast("array<string>")).otherwise(F.split(here, "/"))
    base = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - F.greatest(dots - 1, F.lit(0)), F.lit(0))), "/")
    inside = _join_path(base, rest)
    none = F.array().cast("array<string>")
    relative = F.when(rest == "", none).otherwise(_array(F.concat(F.regexp_replace(inside, r"(?<=[^/])\.[^./]*$", ""), F.lit(".py")), F.concat(inside, F.lit("/__init__.py"))))
    dotted = F.regexp_replace(module, r"\.", "/")
    python = F.when(dots > 0, relative).otherwise(_array(F.concat(dotted, F.lit(".py")), F.concat(dotted, F.lit("/__init__.py"))))
    normal = paths.normalized(_join_path(here, module))
    script = F.when(dots > 0, _array(*(F.concat(normal, F.lit(e)) for e in (*P.SCRIPT_EXTENSIONS, *P.SCRIPT_INDEXES)), normal)).otherwise(none)
    included = _array(paths.normalized(_join_path(here, F.regexp_replace(module, '[<>"]', ""))))
    is_script, is_c = language.isin("typescript", "javascript"), language.isin("c", "cpp")
    found = F.when(language == "python", python).when(is_script, script).when(is_c, included).otherwise(none)
    last = F.when(language == "python", F.when(dots > 0, F.lit(None)).otherwise(F.element_at(F.split(module, r"\."), -1))).when(language == "go", paths.name(module)).when(~is_script, paths.stem(F.regexp_replace(module, '[<>"]', "")))
    return imports.filter(F.length("module_path") > 0).select("path", "language", "module_path", "imported_names", found.alias("candidates"), F.lower(last).alias("stem"))


#: Imports whose side of a join may be broadcast.
FEW = 10_000


def _first_existing(tried: DataFrame, files: DataFrame, few: bool = False) -> DataFrame:
    """(path, module_path, language) -> resolved: the existing candidate of least rank."""
    ranked = _maybe(tried.select("path", "module_path", "language", F.posexplode("candidates").alias("rank", "candidate")), few)
    hit = ranked.join(files.select(F.col("path").alias("candidate")), "candidate")
    return hit.groupBy("path", "module_path", "language").agg(F.min_by("candidate", "rank").alias("resolved"))


def _maybe(df: DataFrame, few: bool) -> DataFrame:
    """df, to be broadcast if it is known to come from FEW imports."""
    return F.broadcast(df) if few else df


def _by_stem(wanted: DataFrame, files: DataFrame, few: bool = False) -> DataFrame:
    """(path, stem) -> resolved: of the files with that stem the one that shares most path parts, place by place, with the importer; then the least path."""
    stems = files.select(F.col("path").alias("candidate"), F.lower(paths.stem(F.col("path"))).alias("stem"))
    same = F.size(F.filter(F.zip_with(F.split("path", "/"), F.split("candidate", "/"), lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x))
    scored = _maybe(wanted, few).join(stems, "stem").select("path", "stem", "candidate", same.alias("shared"))
    return scored.groupBy("path", "stem").agg(F.min_by("candidate", F.struct(-F.col("shared"), "candidate")).alias("resolved"))


def _by_alias(wanted: DataFrame, aliases: DataFrame, files: DataFrame) -> DataFrame:
    """(path, module_path, language) -> resolved by the aliases of the nearest directory above that has some, longest prefix first.

    The nearest directory is an equi-join on the exploded ancestors; an alias must begin the module, an equi-join on its prefixes.
    """
    dirs = aliases.select("dir").distinct()
    above = wanted.select("path").distinct().select("path", F.posexplode(paths.ancestors(F.col("path"))).alias("up", "dir"))
    nearest = above.join(dirs, "dir").groupBy("path").agg(F.min_by("dir", "up").alias("dir"))
    module = F.col("module_path")
    prefixes = F.transform(F.sequence(F.lit(1), F.length(module)), lambda n: F.substring(module, 1, n))
    spread = wanted.select("path", "module_path", "language").distinct().join(nearest, "path").select("path", "module_path", "language", "dir", F.explode(prefixes).alias("prefix"))
    fits = spread.join(aliases, ["dir", "prefix"])
    base = F.concat("target", F.expr("substring(module_path, length(prefix) + 1)"))
    tried = fits.select("path", "module_path", "language", F.length("prefix").alias("n"), F.posexplode(_array(*(F.concat(base, F.lit(e)) for e in ("", *P.SCRIPT_EXTENSIONS, *P.SCRIPT_INDEXES)))).alias("rank", "candidate"))
    hit = tried.join(files.select(F.col("path").alias("candidate")), "candidate")
    return hit.groupBy("path", "module_path", "language").agg(F.min_by("candidate", F.struct(-F.col("n"), "rank", "candidate")).alias("resolved"))


def resolve(imports: DataFrame, files: DataFrame, aliases: DataFrame | None = None, few: bool = False) -> DataFrame:
    """imports -> path, module_path, imported_names, resolved: a file, 'external:<module>' for other packages of scripts, or null.

    few: the caller has counted at most FEW imports, so that they, and not the files, go to every task.
    """
    tried = candidates(imports)
    keys = ["path", "module_path", "language"]
    out = tried.join(_maybe(_first_existing(tried, files, few), few), keys, "left")
    open_script = F.col("language").isin("typescript", "javascript") & ~F.col("module_path").startswith(".")
    if aliases is not None:
        found = _by_alias(tried.filter(open_script), aliases, files).withColumnRenamed("resolved", "aliased")
        out = out.join(_maybe(found, few), keys, "left")
    else:
        out = out.withColumn("aliased", F.lit(None).cast("string"))
    # only what is still open is looked up by stem: 'index' or 'utils' may name very many files
    open_stems = out.filter("resolved IS NULL AND aliased IS NULL AND stem IS NOT NULL").select("path", "stem").distinct()
    stems = _by_stem(open_stems, files, few).withColumnRenamed("resolved", "by_stem")
    out = out.join(_maybe(stems, few), ["path", "stem"], "left")
    external = F.when(open_script, F.concat(F.lit(P.EXTERNAL), "module_path"))
    return out.select("path", "module_path", "imported_names", F.coalesce("resolved", "aliased", "by_stem", external).alias("resolved"))


def edges(resolved: DataFrame) -> DataFrame:
    """One edge for each pair of different files, with the union of the imported names."""
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("imported_names", F.array().cast("array<string>"))))))
    real = resolved.filter(F.col("resolved").isNotNull() & (F.col("resolved") != F.col("path")))
    return real.groupBy(F.col("path").alias("source"), F.col("resolved").alias("target")).agg(names.alias("imported_names")).withColumn("edge_type", F.lit(P.IMPORTS))


def with_tested_by(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges, and for each import of a file by a test the reverse edge TESTED_BY, unless an edge stands there already."""
    kind = nodes.select("path", "is_test")
    tests = edges.filter(F.col("edge_type") == P.IMPORTS).join(kind.filter("is_test").select(F.col("path").alias("source")), "source", "left_semi")
    tested = tests.join(kind.filter("not is_test").select(F.col("path").alias("target")), "target", "left_semi")
    back = tested.select(F.col("target").alias("source"), F.col("source").alias("target"), "imported_names", F.lit(P.TESTED_BY).alias("edge_type"))
    fresh = back.join(edges.select("source", "target"), ["source", "target"], "left_anti")
    return edges.select("source", "target", "imported_names", "edge_type").unionByName(fresh)


def external_nodes(edges: DataFrame) -> DataFrame:
    """A node for each external package that an edge leads to."""
    outside = edges.filter(F.col("target").startswith(P.EXTERNAL)).select(F.col("target").alias("path")).distinct()
    return outside.select("path", F.lit("external").alias("node_kind"), F.lit("external").alias("language"), F.lit(False).alias("is_entry_point"), F.lit(False).alias("is_test"), F.lit("").alias("content_hash"), F.lit(0).alias("symbol_count"), F.lit(False).alias("has_error"))


def internal(edges: DataFrame) -> DataFrame:
    """Edges between files."""
    return edges.filter(~F.col("source").startswith(P.EXTERNAL) & ~F.col("target").startswith(P.EXTERNAL))


