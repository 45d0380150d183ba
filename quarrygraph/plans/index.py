"""The index of a repository: a full build, and updates that carry changes on from stage to stage.

An update lists the tree, reads only files whose size or time differs from the stored ones, and parses those whose hash has changed. Their symbols, imports and postings take the place
of the old ones, in the buckets that they touch. Edges are resolved again for changed files (for all, if a path came or went). Only if an edge came or went are ranks, communities and
flows computed again, PageRank from the stored one on; only if HEAD, the present files or the day have changed is history, to which only commits after the stored HEAD are added;
findings follow either. What no change reaches is not read or written.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph import params as P
from quarrygraph.operators import communities, deadcode, flows, graph, history, incremental, resolve, search
from quarrygraph.operators.tables import pinned
from quarrygraph.runtime import ship, together
from quarrygraph.schemas import VERSION
from quarrygraph.schemas import schema as source_schema
from quarrygraph.sources import files as source_files
from quarrygraph.sources import parser, projects
from quarrygraph.sources.history import GitLog, code_files, newest
from quarrygraph.sources.store import BUCKET_FILES, Store

#: A file that was written so shortly before it was read may have changed again with the same time: it is read again.
RACY = timedelta(seconds=2)
CONFIGS = ("tsconfig.json", "jsconfig.json")


@dataclass
class Scan:
    """files: the relation of that name; fresh: of those the ones that were read, with text; listed: all paths of the tree that rules let through. All three are checkpointed."""

    files: DataFrame
    fresh: DataFrame
    listed: DataFrame


def scan(spark: SparkSession, root: str, stored: DataFrame | None, read_at: datetime | None, excludes: list[str] | None, ignore: list[str]) -> Scan:
    """The tree against the stored files (none: everything is read). read_at: when those were read."""
    tree = source_files.worth_reading(source_files.tree(spark, root), ignore, excludes)
    if stored is None or read_at is None:
        listed = pinned(tree.withColumn("same", F.lit(False)))
        same = None
    else:
        was = stored.select("path", F.col("size_bytes").alias("was_size"), F.col("last_modified").alias("was_at"))
        alike = (F.col("was_size") == F.col("length")) & (F.col("was_at") == F.col("modificationTime")) & (F.col("modificationTime") < F.lit(read_at - RACY))
        listed = pinned(tree.join(was, "path", "left").withColumn("same", F.coalesce(alike, F.lit(False))).drop("was_size", "was_at"))
        same = stored.join(listed.filter("same").select("path"), "path", "left_semi")
    raw = source_files.read_content(listed.filter("not same").drop("same"), root)
    fresh = pinned(source_files.classify(raw, ignore, excludes))
    files = fresh.drop("text")
    return Scan(files if same is None else pinned(same.unionByName(files.select(*same.columns))), fresh, listed)


def _aliases(spark: SparkSession, root: str, listed: DataFrame, tsconfig: str | None) -> DataFrame | None:
    """Path aliases of the tree's script configurations; None without any."""
    named = F.element_at(F.split("path", "/"), -1)
    if tsconfig is None and listed.filter(named.isin(*CONFIGS)).isEmpty():
        return None
    return projects.aliases(spark, source_files.read_content(listed.filter(F.col("path").endswith(".json")).drop("same"), root), tsconfig)


def _nodes(files: DataFrame, counts: DataFrame, entry_patterns: list[str]) -> DataFrame:
    rows = files.select("path", F.lit("file").alias("node_kind"), "language", "is_entry_point", "is_test", "content_hash").join(counts, "path", "left")
    return projects.mark_entries(rows.fillna({"symbol_count": 0, "has_error": False}), entry_patterns)


def _counts(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.size("symbols").alias("symbol_count"), (F.size("errors") > 0).alias("has_error"))


def _ranked(nodes: DataFrame, edges: DataFrame, before: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes with pagerank, betweenness and community, members). before (path, pagerank): ranks to start from."""
    rank, between, members = together(
        lambda: pinned(graph.pagerank(nodes, edges, start=before)), lambda: pinned(graph.betweenness(nodes, edges)), lambda: pinned(communities.detect(nodes, edges))
    )
    ranks = rank.join(between, "path")
    kept = nodes.drop("pagerank", "betweenness", "community_id")
    return pinned(kept.join(ranks, "path", "left").join(members, "path", "left")), members


def _is_file(path: str = "path") -> F.Column:
    return ~F.col(path).startswith(P.EXTERNAL)


def _write_graph(store: Store, nodes: DataFrame, edges: DataFrame, members: DataFrame) -> None:
    def follow() -> None:
        traced, traced_members = flows.trace(nodes, edges)
        together(lambda: store.write("flows", traced), lambda: store.write("flow_members", traced_members))

    together(
        lambda: store.write("nodes", nodes), lambda: store.write("edges", edges), lambda: store.write("communities", communities.summary(members, edges)), lambda: store.write("community_members", members.filter(_is_file())), follow
    )


def _history(commits: DataFrame, files: DataFrame, tracked: DataFrame | None, as_of: datetime) -> DataFrame:
    partners = files.select("path") if tracked is None else tracked
    return pinned(history.metadata(history_of(commits, files), as_of, tracked=partners, together=newest(commits, per_file=False)))


def _write_findings(store: Store, as_of: datetime) -> None:
    nodes, edges, members, git = (store.read(n) for n in ("nodes", "edges", "community_members", "git_metadata"))
    found = deadcode.analyze(nodes, edges, git, as_of).unionByName(deadcode.misplaced(nodes, edges, members, git))
    store.write("dead_code", found.dropDuplicates(["file_path", "kind"]))


def _frameworks(spark: SparkSession, root: str) -> dict:
    top = root.rstrip("/")
    return projects.framework_of(source_files.read_small(spark, f"{top}/package.json"), source_files.read_small(spark, f"{top}/pyproject.toml"))


def _settings(*parts: object) -> str:
    """Digest of what decides, besides contents, which files are taken and how they are read."""
    return hashlib.sha256(repr(parts).encode()).hexdigest()


def _totals(store: Store) -> dict[str, int]:
    """Counts of the tables but for findings, in one job."""
    n = lambda name, test="true": store.read(name).filter(test).select(F.lit(name + test).alias("what"))
    wanted = {"file_count": ("nodes", "node_kind = 'file'"), "symbol_count": ("symbols", "true"), "hotspot_count": ("git_metadata", "is_hotspot"), "flow_count": ("flows", "true")}
    rows = resolve.internal(store.read("edges")).select(F.lit("edges").alias("what"))
    for name, test in wanted.values():
        rows = rows.unionByName(n(name, test))
    got = {r["what"]: r["count"] for r in rows.groupBy("what").count().collect()}
    return {"edge_count": got.get("edges", 0), **{k: got.get(name + test, 0) for k, (name, test) in wanted.items()}}


def _finding_count(store: Store) -> dict[str, int]:
    return {"dead_code_count": store.read("dead_code").filter("confidence >= 0.4").count()}


def build(
    spark: SparkSession, root: str, store: Store, commits: DataFrame | None = None, as_of: datetime | None = None, name: str = "repository", excludes: list[str] | None = None, tsconfig: str | None = None, full: bool = False,
    tracked: DataFrame | None = None, log: GitLog | None = None,
) -> dict[str, str]:
    """Index the files under root into store, whole or by an update of what is there; returns the stored meta values. full: whole in any case.

    log: the repository's history, of which an update reads only what is new; or commits: the relation itself; without either, no history.
    tracked (path): the files that may be co-change partners (by default the log's, else those that were found). Co-change counts the newest commits of the whole repository.
    """
    ship(spark)
    began, as_of = datetime.now(UTC).replace(tzinfo=None), (as_of or datetime.now(UTC))
    as_of = as_of.replace(tzinfo=None)
    ignore, plan = source_files.ignore_file(spark, root), _frameworks(spark, root)
    settings = _settings(ignore, excludes, tsconfig, plan, name)
    store.migrate()
    meta = {} if full or not store.exists("nodes") else store.meta()
    tracked = log.tracked() if tracked is None and log is not None else tracked
    head = log.head if log is not None else ""
    values = {"schema_version": VERSION, "repo_name": name, "framework": plan["framework"] or "", "settings": settings, "head": head, "scanned_at": began.isoformat()}
    if meta.get("settings") == settings and "scanned_at" in meta:
        return _update(spark, root, store, meta, values, ignore, excludes, tsconfig, plan, commits, tracked, log, began, as_of)

    found = scan(spark, root, None, None, excludes, ignore)
    files = found.files
    store.buckets = max(1, -(-files.count() // BUCKET_FILES))
    parsed = pinned(parser.parse(found.fresh))
    symbols, imports = parser.symbols(parsed), parser.imports(parsed)
    resolved = pinned(resolve.edges(resolve.resolve(imports, files.select("path"), _aliases(spark, root, found.listed, tsconfig))))
    nodes = _nodes(files, _counts(parsed), plan["entry_patterns"]).unionByName(resolve.external_nodes(resolved))
    edges = pinned(resolve.with_tested_by(resolved, nodes))
    nodes = pinned(nodes.withColumn("indexed_file_at", F.lit(began)))

    def ranks() -> None:
        ranked, members = _ranked(nodes, edges)
        _write_graph(store, ranked, edges, members)

    def past() -> None:
        known = commits
        if log is not None:
            store.write("commits", log.commits())
            known = store.read("commits")
        store.write("git_metadata", _history(known, files, tracked, as_of) if known is not None else spark.createDataFrame([], source_schema("git_metadata")))

    writes = {"files": files, "symbols": symbols, "imports": imports, "postings": search.indexed(symbols)}
    together(ranks, past, *(lambda n=n, df=df: store.write(n, df) for n, df in writes.items()))
    _, totals, words = together(lambda: _write_findings(store, as_of), lambda: _totals(store), lambda: search.statistics(store.read("postings"), store.read("symbols")))
    return store.put_meta(**values, **totals, **words, **_finding_count(store), indexed_at=began.isoformat(), history_as_of=as_of.isoformat())


def _update(
    spark: SparkSession, root: str, store: Store, meta: dict[str, str], values: dict, ignore: list[str], excludes: list[str] | None, tsconfig: str | None, plan: dict, commits: DataFrame | None, tracked: DataFrame | None,
    log: GitLog | None, began: datetime, as_of: datetime,
) -> dict[str, str]:
    found = scan(spark, root, store.read("files"), datetime.fromisoformat(meta["scanned_at"]), excludes, ignore)
    changed = pinned(incremental.diff(store.hashes(), found.files.select("path", "content_hash")))
    counts = {r["change_type"]: r["count"] for r in changed.groupBy("change_type").count().collect()}
    new_head = log is not None and log.head != meta.get("head", "")
    if not counts and not new_head:
        return meta
    moved_paths = bool(counts.get("added") or counts.get("deleted"))
    edges_moved = False
    if counts:
        few = sum(counts.values()) <= resolve.FEW
        edges_moved, near = _carry_contents(spark, root, store, found, F.broadcast(changed) if few else changed, moved_paths, tsconfig, plan, began)
        counts |= {"dependent": near} if near else {}
    values["last_change"] = ", ".join(f"{k}={v}" for k, v in sorted(counts.items()))
    stale = as_of - datetime.fromisoformat(meta["history_as_of"]) >= timedelta(days=1)
    history_moved = (log is not None or commits is not None) and (new_head or moved_paths or stale or log is None)
    if history_moved:
        if log is not None:
            known = log.reaches(meta.get("head", ""))
            if known and new_head:
                store.append("commits", log.commits(since=meta["head"]))
            elif not known:
                store.write("commits", log.commits())
            commits = store.read("commits")
        store.write("git_metadata", _history(commits, store.read("files"), tracked, as_of))
        values["history_as_of"] = as_of.isoformat()
    if edges_moved or history_moved or moved_paths:
        _write_findings(store, as_of)
        values |= _finding_count(store)
    totals, words = together(lambda: _totals(store), lambda: search.statistics(store.read("postings"), store.read("symbols")))
    return store.put_meta(meta, **values, **totals, **words, indexed_at=began.isoformat())


def _carry_contents(spark: SparkSession, root: str, store: Store, found: Scan, changed: DataFrame, moved_paths: bool, tsconfig: str | None, plan: dict, began: datetime) -> tuple[bool, int]:
    """Bring changed files into files, symbols, imports, postings, edges and nodes, and what hangs on edges where one came or went; says whether one did, and how many files depend on the
    changed ones by the edges before."""
    paths, files = changed.select("path"), found.files
    parsed = pinned(parser.parse(found.fresh.join(paths, "path", "left_semi")))
    symbols, imports = parser.symbols(parsed), parser.imports(parsed)
    aliases = _aliases(spark, root, found.listed, tsconfig)
    configured = aliases is not None and not paths.filter(F.col("path").endswith(".json")).isEmpty()
    again = imports
    if moved_paths or configured:
        # a new path may be what an import of any file means, and one that is gone no longer is
        again = store.read("imports").join(paths, "path", "left_anti").unionByName(imports)
    again = pinned(again)
    # of files that are the same but for their times the row is written too: they would be read again and again
    read = found.fresh.select("path").unionByName(paths).distinct()
    fresh_docs = search.indexed(symbols)
    terms = [0]
    if (store.manifest("postings") or {"buckets": 1})["buckets"] > 1:
        terms = store.touched("postings", search.indexed(store.read("symbols").join(paths, "path", "left_semi")).select("term").unionByName(fresh_docs.select("term")))
    old_edges = store.read("edges")
    few = again.limit(resolve.FEW + 1).count() <= resolve.FEW
    resolved, near, *_ = together(
        lambda: pinned(resolve.edges(resolve.resolve(again, files.select("path"), aliases, few))), lambda: incremental.near(old_edges, changed, files).count(), lambda: store.replace("postings", paths, fresh_docs, terms),
        lambda: store.replace("symbols", paths, symbols), lambda: store.replace("imports", paths, imports), lambda: store.replace("files", read, files.join(read, "path", "left_semi")),
    )
    of_kind = old_edges.filter(F.col("edge_type") == P.IMPORTS)
    # sources whose edges are as resolved now: the changed ones, or all
    old = of_kind if moved_paths or configured else of_kind.join(paths.withColumnRenamed("path", "source"), "source", "left_semi")
    names = F.col("imported_names")
    both = old.select("source", "target", names.alias("a")).join(resolved.select("source", "target", names.alias("b")), ["source", "target"], "full_outer")
    delta = both.agg(F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("structure"), F.count_if(F.col("a") != F.col("b")).alias("names")).first()
    edges_moved = delta["structure"] > 0
    file_rows = files.join(paths, "path", "left_semi")
    nodes = store.read("nodes")
    kept = nodes.filter(_is_file()).join(paths, "path", "left_anti")
    now = _nodes(file_rows, _counts(parsed), plan["entry_patterns"]).join(nodes.select("path", "pagerank", "betweenness", "community_id"), "path", "left").withColumn("indexed_file_at", F.lit(began))
    if edges_moved or moved_paths:
        imported = pinned(resolved if moved_paths or configured else of_kind.join(paths.withColumnRenamed("path", "source"), "source", "left_anti").unionByName(resolved, allowMissingColumns=True))
        outside = resolve.external_nodes(imported).join(nodes.select("path", "indexed_file_at"), "path", "left").withColumn("indexed_file_at", F.coalesce("indexed_file_at", F.lit(began)))
        rows = pinned(kept.unionByName(now.select(*kept.columns)).unionByName(outside, allowMissingColumns=True))
        edges = pinned(resolve.with_tested_by(imported, rows))
        ranked, members = _ranked(rows, edges, nodes.select("path", "pagerank"))
        _write_graph(store, ranked, edges, members)
    else:
        if delta["names"]:
            nodes_now = pinned(nodes.select("path", "is_test"))
            edges = pinned(resolve.with_tested_by(of_kind.join(resolved.select("source", "target"), ["source", "target"], "left_anti").unionByName(resolved, allowMissingColumns=True), nodes_now))
            store.write("edges", edges)
        store.replace("nodes", paths, now)
    return edges_moved, near


def history_of(commits: DataFrame, found: DataFrame) -> DataFrame:
    """The newest commits of each present code file."""
    return newest(code_files(commits).join(found.select(F.col("path").alias("file_path")), "file_path", "left_semi"))
