"""Project configuration: path aliases of script projects, and frameworks with their entry files."""

from __future__ import annotations

import json
import posixpath
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph import params as P
from quarrygraph.functions import globs, paths

_COMMENT = re.compile(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?(?:\*/|\Z)', re.DOTALL)
_ALIASES = "dir string, prefix string, target string"


def relaxed_json(text: str) -> dict:
    """JSON with comments and trailing commas; {} if it can't be read as an object."""
    plain = re.sub(r",\s*([}\]])", r"\1", _COMMENT.sub(lambda m: m[1] or "", text))
    try:
        found = json.loads(plain)
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def extended(path: str, config: dict) -> list[str]:
    """Paths of the files that a configuration extends; '.json' is added to names without an extension."""
    above = config.get("extends") or []
    found = [posixpath.normpath(posixpath.join(posixpath.dirname(path), x)) for x in ([above] if isinstance(above, str) else above) if isinstance(x, str)]
    return [x if posixpath.splitext(x)[1] else x + ".json" for x in found]


def _options(path: str, configs: dict[str, dict], depth: int = 0) -> tuple[dict, str]:
    """Compiler options that define paths, along the chain of extended files (five at most), and the directory they count from."""
    here = posixpath.dirname(path)
    if depth > 5 or path not in configs:
        return {}, here
    own = configs[path].get("compilerOptions") or {}
    if "paths" in own:
        return own, here
    for at in extended(path, configs[path]):
        options, where = _options(at, configs, depth + 1)
        if "paths" in options:
            return ({**options, "baseUrl": own["baseUrl"]}, here) if "baseUrl" in own else (options, where)
    return own, here


def aliases_of(path: str, configs: dict[str, dict]) -> list[tuple[str, str]]:
    """(prefix, target directory) of one configuration; of several targets the first counts."""
    options, where = _options(path, configs)
    base = posixpath.normpath(posixpath.join(where, options.get("baseUrl") or "."))
    base = "" if base == "." or base.startswith("..") else base
    out = []
    for pattern, targets in (options.get("paths") or {}).items():
        if isinstance(targets, list) and targets:
            target = targets[0][:-1] if targets[0].endswith("/*") else targets[0]
            at = posixpath.normpath(posixpath.join(base, target)) if base else re.sub(r"^(?:\./)+", "", target)
            at = "" if at == "." else at
            out.append((pattern[:-1] if pattern.endswith("/*") else pattern, at + "/" if at and not at.endswith("/") else at))
    return out


def aliases(spark: SparkSession, raw: DataFrame, override: str | None = None) -> DataFrame:
    """(dir, prefix, target) of every script configuration among raw files (path, content). A tsconfig beats a jsconfig beside it; an override counts for all.

    Configurations are a few small files, read on the driver; the result joins as a table.
    """
    skipped = F.arrays_overlap(F.split(paths.parent(F.col("path")), "/"), F.array(*(F.lit(d) for d in P.TSCONFIG_SKIP_DIRS)))
    own = F.col("path") == override if override is not None else paths.name(F.col("path")).isin("tsconfig.json", "jsconfig.json") & ~skipped
    configs: dict[str, dict] = {}
    wanted = raw.filter(own)
    for _ in range(7):  # a chain of extended files is five long at most
        fresh = {r["path"]: relaxed_json(bytes(r["content"]).decode("utf-8", "replace")) for r in wanted.select("path", "content").collect()}
        configs.update(fresh)
        above = {x for path, c in fresh.items() for x in extended(path, c)} - set(configs)
        if not above:
            break
        wanted = raw.filter(F.col("path").isin(sorted(above)))
    rows: list[tuple[str, str, str]] = []
    if override is not None:
        rows = [("", a, t) for a, t in aliases_of(override, configs)]
    else:
        taken = set()
        for name in ("tsconfig.json", "jsconfig.json"):
            for path in sorted(p for p in configs if posixpath.basename(p) == name):
                here = posixpath.dirname(path)
                if here not in taken and (found := aliases_of(path, configs)):
                    taken.add(here)
                    rows += [(here, a, t) for a, t in found]
    return spark.createDataFrame(rows, _ALIASES)


def framework_of(package_json: str, pyproject: str) -> dict:
    """framework, version and entry_patterns, from a project's two manifest texts."""
    manifest = relaxed_json(package_json) if package_json else {}
    needed = {**(manifest.get("dependencies") or {}), **(manifest.get("devDependencies") or {})}
    for framework, names, patterns in P.SCRIPT_FRAMEWORKS:
        if any(n in needed for n in names):
            return {"framework": framework, "version": needed.get("next") if framework == "nextjs" else None, "entry_patterns": list(patterns)}
    for framework, patterns in P.PYTHON_FRAMEWORKS:
        if framework in pyproject.lower():
            return {"framework": framework, "version": None, "entry_patterns": list(patterns)}
    return {"framework": None, "version": None, "entry_patterns": []}


def entry_files(files: DataFrame, patterns: list[str]) -> DataFrame:
    """path of the files that a framework's globs find."""
    return files.filter(globs.any_match(F.col("path"), [globs.directory_glob(p) for p in patterns])).select("path")


def mark_entries(nodes: DataFrame, patterns: list[str]) -> DataFrame:
    """nodes with framework entry files marked as entry points."""
    if not patterns:
        return nodes
    return nodes.withColumn("is_entry_point", F.col("is_entry_point") | globs.any_match(F.col("path"), [globs.directory_glob(p) for p in patterns]))
