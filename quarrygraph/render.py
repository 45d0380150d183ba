"""Outputs for people: diagrams and a wiki. What is drawn is bounded by a parameter before it reaches the driver."""

from __future__ import annotations

import html
import json
import os
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrygraph.functions import paths


def top_nodes(nodes: DataFrame, members: DataFrame, max_nodes: int = 500) -> DataFrame:
    """The max_nodes nodes with the highest PageRank, with label, type, radius and community.

    A hotspot's betweenness is at or above the one that stands at three quarters of the sorted positive ones.
    """
    top = nodes.orderBy(F.col("pagerank").desc(), "path").limit(max_nodes).join(members.select("path", F.col("community_id").alias("community")), "path", "left")
    positive = top.filter("betweenness > 0")
    k = positive.agg(F.floor(F.count("*") * 0.75).cast("int").alias("k"), F.count("*").cast("int").alias("n"))
    ranked = positive.select("betweenness").withColumn("r", F.row_number().over(Window.orderBy("betweenness")) - 1)
    threshold = ranked.join(F.broadcast(k), F.col("r") == F.least("k", F.col("n") - 1)).select(F.col("betweenness").alias("threshold"))
    most = top.agg(F.max("pagerank").alias("most"))
    joined = top.join(F.broadcast(threshold), F.lit(True), "left").join(F.broadcast(most), F.lit(True), "left")
    kind = F.when(F.col("betweenness") >= F.col("threshold"), "hotspot").when(F.col("is_entry_point"), "entry").when(F.col("is_test"), "test").otherwise("regular")
    radius = 5 + F.col("pagerank") / F.when(F.col("most") > 0, F.col("most")).otherwise(1.0) * 20
    return joined.select("path", paths.short_label(F.col("path")).alias("label"), "language", "pagerank", "betweenness", "symbol_count", kind.alias("type"), radius.alias("radius"), "community", "is_entry_point", "is_test")


def induced(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges with both ends among the kept nodes."""
    ends = kept.select("path")
    return edges.join(ends.withColumnRenamed("path", "source"), "source", "left_semi").join(ends.withColumnRenamed("path", "target"), "target", "left_semi").select("source", "target", "edge_type")


def graph_data(nodes: DataFrame, edges: DataFrame, communities: DataFrame, members: DataFrame, name: str, max_nodes: int = 500) -> dict:
    """nodes, links, communities and repoName of the drawn part."""
    kept = top_nodes(nodes, members, max_nodes).persist()
    names = {r.community_id: r for r in communities.collect()} if max_nodes else {}
    rows = kept.orderBy(F.col("pagerank").desc(), "path").collect()
    links = induced(edges, kept).orderBy("source", "target").collect()
    kept.unpersist()
    return {
        "nodes": [
            {
                "id": r.path, "label": r.label, "language": r.language or "", "pagerank": round(r.pagerank or 0, 6), "betweenness": round(r.betweenness or 0, 6), "symbols": r.symbol_count or 0, "type": r.type, "radius": round(r.radius or 5, 1),
                "community": r.community, "communityName": names[r.community].name if r.community in names else "", "isEntry": bool(r.is_entry_point), "isTest": bool(r.is_test),
            }
            for r in rows
        ],
        "links": [{"source": e.source, "target": e.target, "type": e.edge_type} for e in links],
        "communities": [{"id": c.community_id, "name": c.name, "count": c.member_count, "cohesion": round(c.cohesion, 3)} for c in sorted(names.values(), key=lambda c: c.community_id)],
        "repoName": name,
    }


_PAGE = """<!DOCTYPE html>
<html lang="en"><head><meta charset="utf-8"><title>%(title)s</title>
<style>body{margin:0;font:13px sans-serif;background:#fff;color:#222}svg{width:100vw;height:100vh;display:block}
#side{position:fixed;top:8px;left:8px;background:#fffd;padding:8px 12px;border:1px solid #ccc;max-width:280px}line{stroke:#bbb}line.t{stroke-dasharray:3 3}text{font-size:9px;pointer-events:none}</style></head>
<body><div id="side"><b>%(title)s</b><div id="info"></div></div><svg></svg>
<script type="application/json" id="data">%(data)s</script>
<script>
const data = JSON.parse(document.getElementById("data").textContent), svg = document.querySelector("svg"), ns = "http://www.w3.org/2000/svg";
const fill = {hotspot: "#c0392b", entry: "#2980b9", test: "#7f8c8d", regular: "#27ae60"}, at = new Map();
const W = innerWidth, H = innerHeight;
data.nodes.forEach((n, i) => { const a = i * 2.399963, r = 18 * Math.sqrt(i + 1); n.x = W / 2 + r * Math.cos(a); n.y = H / 2 + r * Math.sin(a); at.set(n.id, n); });
const links = data.links.map(l => ({s: at.get(l.source), t: at.get(l.target), type: l.type}));
for (let k = 0; k < 120; k++) {
  const cool = 1 - k / 120;
  for (const l of links) { const dx = l.t.x - l.s.x, dy = l.t.y - l.s.y, d = Math.hypot(dx, dy) || 1, f = (d - 70) / d * 0.05 * cool; l.s.x += dx * f; l.s.y += dy * f; l.t.x -= dx * f; l.t.y -= dy * f; }
  for (let i = 0; i < data.nodes.length; i++) for (let j = i + 1; j < data.nodes.length; j++) {
    const a = data.nodes[i], b = data.nodes[j], dx = b.x - a.x, dy = b.y - a.y, d2 = dx * dx + dy * dy || 1;
    if (d2 < 10000) { const f = 120 / d2 * cool; a.x -= dx * f; a.y -= dy * f; b.x += dx * f; b.y += dy * f; }
  }
}
const add = (name, attributes, to = svg) => { const e = document.createElementNS(ns, name); for (const k in attributes) e.setAttribute(k, attributes[k]); to.appendChild(e); return e; };
for (const l of links) add("line", {x1: l.s.x, y1: l.s.y, x2: l.t.x, y2: l.t.y, class: l.type === "TESTED_BY" ? "t" : ""});
for (const n of data.nodes) {
  const c = add("circle", {cx: n.x, cy: n.y, r: n.radius, fill: fill[n.type]});
  c.addEventListener("click", () => { document.getElementById("info").textContent = [n.id, n.language, n.symbols + " symbols", n.communityName].filter(Boolean).join(" | "); });
  add("text", {x: n.x + n.radius + 2, y: n.y + 3}).textContent = n.label;
}
</script></body></html>
"""


def html_page(data: dict) -> str:
    """A page that draws graph_data by itself. Data can't end its script element."""
    return _PAGE % {"title": html.escape(f"{data['repoName']} - dependency graph"), "data": json.dumps(data).replace("<", "\\u003c")}


def mermaid(nodes: DataFrame, edges: DataFrame, max_nodes: int = 50) -> str:
    """A flowchart of the max_nodes nodes with the highest PageRank, numbered by it; labels of more than 40 characters keep their last 37."""
    kept = nodes.orderBy(F.col("pagerank").desc(), "path").limit(max_nodes).select("path", "pagerank")
    ids = {r.path: f"n{i}" for i, r in enumerate(kept.orderBy(F.col("pagerank").desc(), "path").collect())}
    lines = ["flowchart LR"] + [f'    {i}["{p if len(p) <= 40 else "..." + p[-37:]}"]' for p, i in ids.items()]
    lines += [f"    {ids[e.source]} --> {ids[e.target]}" for e in induced(edges, kept).orderBy("source", "target").collect()]
    return "\n".join(lines)


def slug(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", name.lower()).strip("-") or "unknown"


def _table(head: list[str], rows: list[list[object]]) -> list[str]:
    return ["| " + " | ".join(head) + " |", "|" + "|".join("-" * (len(h) + 2) for h in head) + "|", *("| " + " | ".join(str(x) for x in r) + " |" for r in rows)]


def wiki(communities: DataFrame, members: DataFrame, flows: DataFrame, stats: dict) -> dict[str, str]:
    """Pages by file name: index, one for each community, flows."""
    cs = communities.orderBy(F.col("member_count").desc(), "community_id").collect()
    listed = {r.community_id: r.members for r in members.groupBy("community_id").agg(F.array_sort(F.collect_list("path")).alias("members")).collect()}
    # communities whose names have one slug get pages of their own
    page: dict[int, str] = {}
    for c in cs:
        name = f"community-{slug(c.name)}.md"
        page[c.community_id] = name if name not in page.values() else f"community-{slug(c.name)}-{c.community_id}.md"
    counts = [["Files", "file_count"], ["Internal Edges", "edge_count"], ["Hotspots", "hotspot_count"], ["Dead Code Findings", "dead_code_count"], ["Execution Flows", "flow_count"]]
    pages = {
        "index.md": "\n".join([
            f"# {stats.get('repo_name', 'Project')} - Architecture Wiki", "", "## Overview", "", *_table(["Metric", "Value"], [[a, stats.get(k, "N/A")] for a, k in counts] + [["Communities", len(cs)]]), "", "## Communities", "",
            *_table(["ID", "Name", "Members", "Cohesion"], [[c.community_id, f"[{c.name}]({page[c.community_id]})", c.member_count, f"{c.cohesion:.3f}"] for c in cs]), "", "## Flows", "", "See [flows.md](flows.md) for execution flow details.", "",
        ])
    }
    for c in cs:
        own = listed.get(c.community_id, [])
        lines = [f"# Community: {c.name}", "", f"**ID:** {c.community_id}  ", f"**Members:** {len(own)}  ", f"**Cohesion:** {c.cohesion:.3f}  ", ""]
        lines += ["## Key Files", "", *(f"- `{f}`" for f in c.top_files), ""] if c.top_files else []
        lines += ["## All Members", "", *(f"- `{m}`" for m in own), ""] if own else []
        pages[page[c.community_id]] = "\n".join([*lines, "[Back to index](index.md)", ""])
    fs = flows.orderBy(F.col("criticality").desc(), "entry_point").collect()
    if fs:
        rows = [[f.flow_id[:8], f"`{f.entry_point}`", f.node_count, f.file_spread, f"{f.criticality:.3f}", "Yes" if f.has_test_coverage else "No"] for f in fs]
        pages["flows.md"] = "\n".join(["# Execution Flows", "", f"Total flows: {len(fs)}", "", *_table(["Flow ID", "Entry Point", "Nodes", "Spread", "Criticality", "Tests"], rows), "", "[Back to index](index.md)", ""])
    return pages


def write_pages(pages: dict[str, str], folder: str) -> list[str]:
    os.makedirs(folder, exist_ok=True)
    out = []
    for name, text in pages.items():
        path = os.path.join(folder, name)
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
        out.append(path)
    return out


