"""Command line: the index build and the questions it answers. `--json` prints rows as JSON lines."""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph import params as P
from quarrygraph import render
from quarrygraph.operators import communities, deadcode, flows, graph, impact, refactor, search
from quarrygraph.plans import index
from quarrygraph.sources import history
from quarrygraph.sources.store import Store


def session() -> SparkSession:
    made = SparkSession.builder.appName("quarrygraph").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    return made.config("spark.ui.showConsoleProgress", "false").getOrCreate()


def show(df: DataFrame, as_json: bool, limit: int = 50) -> None:
    """Print rows: all of them as JSON lines, or the first ones as a table."""
    if as_json:
        for line in df.toJSON().toLocalIterator():
            print(line)
    else:
        df.show(limit, truncate=False)


def warehouse(root: str, given: str | None) -> str:
    """Folder of a repository's tables: outside the repository unless one is given."""
    return given or os.path.join(os.path.expanduser("~"), ".quarrygraph", history.repository_name(root) + "-" + format(abs(hash_of(root)), "x"))


def hash_of(text: str) -> int:
    import hashlib

    return int(hashlib.sha256(text.encode()).hexdigest()[:8], 16)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarrygraph", description=__doc__)
    p.add_argument("--repo", default=".", help="repository")
    p.add_argument("--warehouse", help="folder of the index")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, help: str, json_flag: bool = True) -> argparse.ArgumentParser:  # noqa: A002
        c = sub.add_parser(name, help=help)
        if json_flag:
            c.add_argument("--json", action="store_true")
        return c

    c = command("init", "index the repository")
    c.add_argument("--exclude", action="append", default=[])
    c.add_argument("--tsconfig")
    c.add_argument("--full", action="store_true")
    c = command("dead-code", "unreachable files and unused packages")
    c.add_argument("--min-confidence", type=float, default=P.MIN_CONFIDENCE)
    c.add_argument("--include-moves", action="store_true")
    c = command("risk", "one file's blast radius")
    c.add_argument("file")
    c = command("deps", "shortest dependency path")
    c.add_argument("source")
    c.add_argument("target")
    c = command("diagram", "dependency diagram")
    c.add_argument("--format", choices=["html", "mermaid"], default="html")
    c.add_argument("--max-nodes", type=int, default=500)
    c.add_argument("--output")
    command("status", "what the index holds")
    c = command("communities", "detected communities")
    c.add_argument("--coupling", action="store_true")
    c = command("cycles", "circular dependencies")
    c.add_argument("--min-size", type=int, default=2)
    command("flows", "execution flows")
    c = command("flow", "one flow's members")
    c.add_argument("query")
    c = command("wiki", "markdown pages")
    c.add_argument("--output")
    c = command("impact", "what changed files reach")
    c.add_argument("files", nargs="*")
    c.add_argument("--changed", action="store_true")
    c.add_argument("--depth", type=int, default=P.IMPACT_DEPTH)
    c = command("search", "ranked symbol search")
    c.add_argument("query")
    c.add_argument("--limit", type=int, default=20)
    c.add_argument("--kind")
    r = command("refactor", "refactoring aids", json_flag=False).add_subparsers(dest="aid", required=True)
    c = r.add_parser("large")
    c.add_argument("--threshold", type=int, default=P.LARGE_FUNCTION_LINES)
    c.add_argument("--json", action="store_true")
    r.add_parser("moves").add_argument("--json", action="store_true")
    c = r.add_parser("rename")
    c.add_argument("target")
    c.add_argument("new_name")
    c.add_argument("--json", action="store_true")
    return p


def init(spark: SparkSession, store: Store, root: str, a: argparse.Namespace) -> dict[str, str]:
    log = history.GitLog(spark, root) if history.top_level(root) else None
    return index.build(spark, root, store, log=log, name=history.repository_name(root), excludes=a.exclude, tsconfig=a.tsconfig, full=a.full)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    root = os.path.abspath(history.top_level(a.repo) or a.repo)
    spark = session()
    store = Store(spark, warehouse(root, a.warehouse))
    if a.command == "init":
        meta = init(spark, store, root, a)
        print(json.dumps(meta, indent=2) if a.json else "\n".join(f"{k}: {v}" for k, v in sorted(meta.items())))
        return 0
    if not store.exists("nodes"):
        print("No index here. Run 'init' first.", file=sys.stderr)
        return 1
    read, as_json = store.read, getattr(a, "json", False)
    nodes, edges = read("nodes"), read("edges")
    if a.command == "dead-code":
        found = read("dead_code")
        moves = found.filter(F.col("kind") == deadcode.MISPLACED)
        show(deadcode.report(found.filter(F.col("kind") != deadcode.MISPLACED), moves if a.include_moves else None, a.min_confidence), as_json)
    elif a.command == "risk":
        report = impact.file_report(nodes, edges, read("git_metadata"), a.file.replace("\\", "/"))
        if report.isEmpty():
            print(f"file not found in index: {a.file}", file=sys.stderr)
            return 1
        show(report, as_json)
    elif a.command == "deps":
        show(graph.shortest_path(edges, a.source, a.target), as_json)
    elif a.command == "diagram":
        if a.format == "mermaid":
            print(render.mermaid(nodes, edges, min(a.max_nodes, 50)))
        else:
            data = render.graph_data(nodes.drop("community_id"), edges, read("communities"), read("community_members"), store.meta().get("repo_name", ""), a.max_nodes)
            if as_json:
                print(json.dumps(data))
            else:
                out = a.output or "diagram.html"
                render.write_pages({os.path.basename(out): render.html_page(data)}, os.path.dirname(os.path.abspath(out)))
                print(out)
    elif a.command == "status":
        meta = {**store.meta(), "size_bytes": store.size_bytes()}
        print(json.dumps(meta) if as_json else "\n".join(f"{k}: {v}" for k, v in sorted(meta.items())))
    elif a.command == "communities":
        show(communities.coupling(read("community_members"), edges).orderBy(F.col("cross_edges").desc(), "community_a", "community_b") if a.coupling else read("communities").orderBy("community_id"), as_json)
    elif a.command == "cycles":
        show(graph.cycles(nodes, edges, a.min_size).orderBy(F.col("size").desc(), "component"), as_json)
    elif a.command == "flows":
        show(read("flows").orderBy(F.col("criticality").desc(), "entry_point"), as_json)
    elif a.command == "flow":
        one = flows.find(read("flows"), a.query)
        show(read("flow_members").join(F.broadcast(one.select("flow_id", "entry_point")), "flow_id").orderBy("ord"), as_json)
    elif a.command == "wiki":
        pages = render.wiki(read("communities"), read("community_members"), read("flows"), store.meta())
        written = render.write_pages(pages, a.output or "wiki")
        print(json.dumps(written) if as_json else "\n".join(written))
    elif a.command == "impact":
        seeds = [f.replace("\\", "/") for f in a.files] or history.changed(root)
        out = impact.impact(nodes, edges, read("git_metadata"), read("community_members"), spark.createDataFrame([(s,) for s in seeds], "path string"), a.depth).persist()
        show(out.orderBy(F.col("risk_score").desc(), "path"), as_json)
        show(impact.summary(out), as_json)
    elif a.command == "search":
        show(search.search(read("symbols"), a.query, a.limit, a.kind, store), as_json)
    elif a.aid == "large":
        show(refactor.large_functions(read("symbols"), a.threshold).orderBy(F.col("line_count").desc(), "file_path", "start_line"), as_json)
    elif a.aid == "moves":
        show(refactor.move_suggestions(edges, read("community_members")).orderBy(F.col("caller_count").desc(), "file_path"), as_json)
    else:
        made = refactor.preview(nodes, edges, a.target, a.new_name, datetime.now(UTC))
        store.write("refactor_previews", refactor.live(store.read("refactor_previews"), datetime.now(UTC)).unionByName(made))
        show(made, as_json)
    return 0


if __name__ == "__main__":
    sys.exit(main())
