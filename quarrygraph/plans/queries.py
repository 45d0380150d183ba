"""Registered queries: each operator on the canonical relations, and the same in SQL. Values that sums of doubles make are rounded to six digits in both."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph import params as P
from quarrygraph import render
from quarrygraph.functions import globs, paths
from quarrygraph.operators import communities, deadcode, flows, graph, history, impact, incremental, refactor, resolve, search
from quarrygraph.plans import adapters as A
from quarrygraph.runtime import once, shipped
from quarrygraph.sources import documents, files, parser, projects
from quarrygraph.sources import history as git_log

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name. sql: CTEs and a SELECT that go after those of the adapters."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = shipped(f)
        if sql is not None:
            ORACLE_SQL[f.__name__] = f"WITH RECURSIVE {A.CTES.strip()}{sql}"
        return f

    return register


def _six(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


@once
def _git(spark: SparkSession, d: str) -> DataFrame:
    """Of each file's history all but its co-change partners, which only the report on one file shows."""
    return history.facts(A.commits(spark, d), A.AS_OF)


def _seed(spark: SparkSession, d: str) -> DataFrame:
    """The file of the smallest supplier key 1, 2 and 3."""
    return A.nodes(spark, d).filter("k in (1, 2, 3)").select("path")


def _regex(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns).replace("'", "''")


SEED_SQL = "SELECT path FROM nodes WHERE k IN (1, 2, 3)"
SECURITY_SQL = "regexp_matches(lower({0}), '" + "|".join(P.SECURITY_KEYWORDS) + "')"
#: Written for the names that these tables have: markers, and what the lists of names and patterns say of them.
NEVER_SQL = "(ends_with({0}, '__init__.py') OR contains({0}, 'schema') OR contains({0}, 'seed') OR starts_with({0}, 'scripts/'))"
DYNAMIC_SQL = "(ends_with({0}, 'Plugin') OR starts_with({0}, 'register_') OR starts_with({0}, 'on_'))"
PARENT_SQL = "CASE WHEN instr({0}, '/') > 0 THEN regexp_replace({0}, '/[^/]*$', '') ELSE '.' END"
STEM_SQL = r"regexp_extract(regexp_extract({0}, '[^/]*$'), '^(.+?)(\.[^.]+)?$', 1)"

# ---- edges and degrees


@query(", x AS (SELECT source, target, array_to_string(imported_names, ',') AS names, edge_type FROM edges) SELECT * FROM x")
def r10_tested_by(spark: SparkSession, d: str) -> DataFrame:
    return A.edges(spark, d).select("source", "target", F.array_join("imported_names", ",").alias("names"), "edge_type")


@query("""
, raw AS (SELECT source AS path, target, imported_names FROM import_edges UNION ALL SELECT source, target, ['sym0', 'zz'] FROM import_edges WHERE length(source) % 2 = 0)
SELECT path AS source, target, array_to_string(list_sort(list_distinct(flatten(list(imported_names)))), ',') AS names FROM raw GROUP BY 1, 2""")
def r9_edge_merge(spark: SparkSession, d: str) -> DataFrame:
    e = A.imports(spark, d)
    twice = e.select(F.col("source").alias("path"), F.col("target").alias("resolved"), "imported_names").unionByName(e.filter(F.length("source") % 2 == 0).select(F.col("source").alias("path"), F.col("target").alias("resolved"), F.array(F.lit("sym0"), F.lit("zz")).alias("imported_names")))
    return resolve.edges(twice).select("source", "target", F.array_join("imported_names", ",").alias("names"))


@query(r"""
, wanted AS (SELECT e.source AS path, CASE WHEN length(e.target) % 3 = 0 THEN regexp_extract(e.target, '([^/]+)\.py$', 1) WHEN length(e.target) % 3 = 1 THEN 'missing.mod' ELSE replace(regexp_replace(e.target, '\.py$', ''), '/', '.') END AS module_path
  FROM import_edges e JOIN nodes n ON n.path = e.target AND n.node_kind = 'file'),
tried AS (SELECT DISTINCT path, module_path, replace(module_path, '.', '/') || '.py' AS c0, replace(module_path, '.', '/') || '/__init__.py' AS c1, lower(regexp_extract(module_path, '[^.]*$')) AS stem FROM wanted),
stems AS (SELECT path AS candidate, lower(regexp_extract(path, '([^/]+?)(\.[^./]+)?$', 1)) AS stem FROM nodes WHERE node_kind = 'file'),
scored AS (SELECT t.path, t.stem, s.candidate, len(list_filter(list_zip(string_split(t.path, '/'), string_split(s.candidate, '/')), lambda p: coalesce(p[1] = p[2], false))) AS shared FROM (SELECT DISTINCT path, stem FROM tried) t JOIN stems s USING (stem)),
best AS (SELECT path, stem, candidate FROM (SELECT *, row_number() OVER (PARTITION BY path, stem ORDER BY shared DESC, candidate) AS r FROM scored) WHERE r = 1)
SELECT t.path, t.module_path, coalesce(a.path, b.path, best.candidate) AS resolved FROM tried t LEFT JOIN nodes a ON a.path = t.c0 LEFT JOIN nodes b ON b.path = t.c1 LEFT JOIN best ON best.path = t.path AND best.stem = t.stem""")
def r2_resolve_python(spark: SparkSession, d: str) -> DataFrame:
    e = A.imports(spark, d).join(A.nodes(spark, d).filter("node_kind = 'file'").select(F.col("path").alias("target")), "target", "left_semi")
    module = F.when(F.length("target") % 3 == 0, F.regexp_extract("target", r"([^/]+)\.py$", 1)).when(F.length("target") % 3 == 1, "missing.mod").otherwise(F.regexp_replace(F.regexp_replace("target", r"\.py$", ""), "/", "."))
    wanted = e.select(F.col("source").alias("path"), F.lit("python").alias("language"), module.alias("module_path"), "imported_names")
    found = resolve.resolve(wanted, A.nodes(spark, d).filter("node_kind = 'file'").select("path"))
    return found.select("path", "module_path", "resolved").distinct()


@query("""
SELECT n.path, (SELECT count(*) FROM edges e WHERE e.target = n.path) AS in_degree, (SELECT count(*) FROM edges e WHERE e.source = n.path) AS out_degree FROM nodes n""")
def g14_degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(A.nodes(spark, d), A.edges(spark, d))


# ---- traversals

_HOPS = """
, fwd(path, depth) AS (SELECT path, 0 FROM ({seed}) UNION SELECT e.target, f.depth + 1 FROM fwd f JOIN edges e ON e.source = f.path WHERE f.depth < {n}),
bwd(path, depth) AS (SELECT path, 0 FROM ({seed}) UNION SELECT e.source, f.depth + 1 FROM bwd f JOIN edges e ON e.target = f.path WHERE f.depth < {n}),
hops AS (SELECT path, min(depth)::INT AS depth FROM (SELECT * FROM fwd UNION ALL SELECT * FROM bwd) WHERE path NOT LIKE 'external:%' AND path NOT IN ({seed}) GROUP BY 1)"""


@query(f"""
, ends AS (SELECT a.path AS source, b.path AS target FROM nodes a JOIN nodes b ON a.k % 7 = 1 AND b.k % 5 = 2 AND a.node_kind = 'file' AND b.node_kind = 'file'),
walked(source, node) AS (SELECT DISTINCT source, source FROM ends UNION SELECT w.source, e.target FROM walked w JOIN edges e ON e.source = w.node)
SELECT source, target, w.node IS NOT NULL AS reached FROM ends LEFT JOIN walked w USING (source) WHERE w.node = target
UNION ALL SELECT source, target, false FROM ends WHERE NOT EXISTS (SELECT 1 FROM walked w WHERE w.source = ends.source AND w.node = ends.target)""")
def g15_reachability(spark: SparkSession, d: str) -> DataFrame:
    """From every seventh supplier's file to every file of a fifth of the suppliers."""
    files = A.nodes(spark, d).filter("node_kind = 'file'")
    return graph.reachable_between(A.edges(spark, d), files.filter("k % 7 = 1").select("path"), files.filter("k % 5 = 2").select("path"), A.nodes(spark, d))


@query(_HOPS.format(seed=SEED_SQL, n=3) + f"""
, above(seed, node) AS (SELECT path, path FROM ({SEED_SQL}) UNION SELECT a.seed, e.source FROM above a JOIN edges e ON e.target = a.node),
told AS (
  SELECT source AS path, target AS seed, 0 AS kind FROM edges WHERE target IN ({SEED_SQL}) UNION ALL SELECT target, source, 1 FROM edges WHERE source IN ({SEED_SQL}) UNION ALL SELECT node, seed, 2 FROM above),
best AS (SELECT path, kind, row_number() OVER (PARTITION BY path ORDER BY seed, kind) AS r FROM told WHERE path <> seed)
SELECT h.path, CASE b.kind WHEN 0 THEN 'dependency' WHEN 1 THEN 'dependent' WHEN 2 THEN 'upstream' ELSE 'unknown' END AS direction FROM hops h LEFT JOIN best b ON b.path = h.path AND b.r = 1""")
def g15_directions(spark: SparkSession, d: str) -> DataFrame:
    """How each file that a change of the seeds reaches is related to them."""
    e, seeds = A.edges(spark, d), _seed(spark, d)
    return impact.directions(e, graph.k_hops(e, seeds, 3), seeds)


@query(_HOPS.format(seed=SEED_SQL, n=3) + " SELECT path, depth FROM hops")
def g11_k_hops(spark: SparkSession, d: str) -> DataFrame:
    return graph.k_hops(A.edges(spark, d), _seed(spark, d), 3)


@query(f"""
, seed AS ({SEED_SQL}), one AS (SELECT DISTINCT source AS path FROM edges WHERE target IN (SELECT path FROM seed)), two AS (SELECT DISTINCT source AS path FROM edges WHERE target IN (SELECT path FROM one))
SELECT path FROM (SELECT * FROM one UNION SELECT * FROM two) WHERE path NOT IN (SELECT path FROM seed)""")
def g13_dependents(spark: SparkSession, d: str) -> DataFrame:
    return graph.dependents(A.edges(spark, d), _seed(spark, d), 2).join(_seed(spark, d), "path", "left_anti")


@query("""
, hops1(path, depth) AS (SELECT path, 0 FROM nodes WHERE k = 1 UNION SELECT e.target, f.depth + 1 FROM hops1 f JOIN edges e ON e.source = f.path WHERE f.depth < 12),
ends AS (SELECT (SELECT path FROM nodes WHERE k = 1) AS a, (SELECT max(path) FROM hops1) AS b),
least AS (SELECT path, min(depth) AS depth FROM hops1 GROUP BY 1),
walk(path, depth, trail) AS (
  SELECT a, 0, [a] FROM ends UNION ALL
  SELECT path, depth, trail FROM (SELECT e.target AS path, w.depth + 1 AS depth, list_append(w.trail, e.target) AS trail, row_number() OVER (PARTITION BY e.target ORDER BY list_append(w.trail, e.target)) AS r
    FROM walk w JOIN edges e ON e.source = w.path JOIN least l ON l.path = e.target AND l.depth = w.depth + 1) WHERE r = 1)
SELECT depth::INT AS hops, array_to_string(trail, ' > ') AS trail FROM walk, ends WHERE path = b""")
def g10_shortest_path(spark: SparkSession, d: str) -> DataFrame:
    """From the file of supplier 1 to the greatest path it reaches within twelve hops."""
    start = A.nodes(spark, d).filter("k = 1").select(F.lit("s").alias("seed"), F.col("path").alias("node"))
    e = A.edges(spark, d)
    source = start.first()["node"]
    target = graph.reach(e, start, 12).agg(F.max("node")).first()[0]
    return graph.shortest_path(e, source, target).select("hops", F.array_join("path", " > ").alias("trail"))


def _pagerank_sql(rounds: int) -> str:
    out = """
, pe AS (SELECT DISTINCT source, target FROM edges), outs AS (SELECT source, count(*) AS n FROM pe GROUP BY 1), total AS (SELECT count(*)::DOUBLE AS n FROM nodes), r0 AS (SELECT path, 1.0 / (SELECT n FROM total) AS p FROM nodes)"""
    for k in range(rounds):
        out += f""",
lost{k} AS MATERIALIZED (SELECT coalesce(sum(p), 0) AS x FROM r{k} WHERE path NOT IN (SELECT source FROM outs)),
r{k + 1} AS MATERIALIZED (SELECT r.path, 0.85 * (coalesce(g.x, 0) + (SELECT x FROM lost{k}) / (SELECT n FROM total)) + 0.15 / (SELECT n FROM total) AS p FROM r{k} r
  LEFT JOIN (SELECT pe.target, sum(s.p / outs.n) AS x FROM pe JOIN r{k} s ON s.path = pe.source JOIN outs ON outs.source = pe.source GROUP BY 1) g ON g.target = r.path)"""
    return out + f" SELECT path, round(p, 6) AS pagerank FROM r{rounds}"


@query(_pagerank_sql(40))
def g1_pagerank_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Forty rounds whatever the change, so that SQL can say the same."""
    return graph.pagerank(A.nodes(spark, d), A.edges(spark, d), rounds=40, tolerance=None).select("path", *_six("pagerank"))


@query()
def g1_pagerank(spark: SparkSession, d: str) -> DataFrame:
    """Until the change is below the production tolerance."""
    return graph.pagerank(A.nodes(spark, d), A.edges(spark, d)).select("path", *_six("pagerank"))


@query("""
, step AS (SELECT DISTINCT source AS a, target AS b FROM edges WHERE source <> target),
far(s, v, d) AS (SELECT path, path, 0 FROM nodes UNION SELECT f.s, step.b, f.d + 1 FROM far f JOIN step ON step.a = f.v WHERE f.d < 40),
dist AS (SELECT s, v, min(d) AS d FROM far GROUP BY 1, 2),
trail(s, v, d) AS (SELECT path, path, 0 FROM nodes UNION ALL SELECT t.s, step.b, t.d + 1 FROM trail t JOIN step ON step.a = t.v JOIN dist x ON x.s = t.s AND x.v = step.b AND x.d = t.d + 1),
counted AS (SELECT s, v, d, count(*)::DOUBLE AS n FROM trail GROUP BY 1, 2, 3),
through AS (SELECT x.v AS path, sum(x.n * y.n / z.n) AS b FROM counted x JOIN counted y ON y.s = x.v JOIN counted z ON z.s = x.s AND z.v = y.v AND z.d = x.d + y.d WHERE x.d > 0 AND y.d > 0 GROUP BY 1)
SELECT n.path, round(coalesce(b, 0) / ((SELECT count(*) - 1 FROM nodes) * (SELECT count(*) - 2 FROM nodes)), 6) AS betweenness FROM nodes n LEFT JOIN through USING (path)""")
def g2_betweenness(spark: SparkSession, d: str) -> DataFrame:
    return graph.betweenness(A.nodes(spark, d), A.edges(spark, d)).select("path", *_six("betweenness"))


_REACH = """
, ie AS (SELECT DISTINCT source, target FROM import_edges WHERE target NOT LIKE 'external:%'),
walks(a, b) AS (SELECT source, target FROM ie UNION SELECT w.a, ie.target FROM walks w JOIN ie ON ie.source = w.b),
scc AS (SELECT n.path, coalesce(least(n.path, min(w.b)), n.path) AS component FROM nodes n LEFT JOIN (SELECT x.a, x.b FROM walks x JOIN walks y ON y.a = x.b AND y.b = x.a) w ON w.a = n.path WHERE n.node_kind = 'file' GROUP BY n.path)"""


@query(_REACH + " SELECT path, component FROM scc")
def g3_strong_components(spark: SparkSession, d: str) -> DataFrame:
    n = A.nodes(spark, d).filter("node_kind = 'file'")
    return graph.strong_components(n, A.imports(spark, d).filter("target not like 'external:%'"))


@query(_REACH + """
, big AS (SELECT component, count(*) AS size, array_to_string(list_sort(list(path)), ',') AS members FROM scc GROUP BY 1 HAVING count(*) >= 2),
ring(component, path, depth, trail) AS (
  SELECT component, component, 0, [component] FROM big UNION ALL
  SELECT component, path, depth, trail FROM (SELECT r.component, ie.target AS path, r.depth + 1 AS depth, list_append(r.trail, ie.target) AS trail, row_number() OVER (PARTITION BY r.component, ie.target ORDER BY list_append(r.trail, ie.target)) AS k
    FROM ring r JOIN ie ON ie.source = r.path JOIN scc s ON s.path = ie.target AND s.component = r.component WHERE ie.source <> ie.target AND NOT (r.depth > 0 AND r.path = r.component) AND r.depth < 40) WHERE k = 1),
closed AS (SELECT component, trail, row_number() OVER (PARTITION BY component ORDER BY depth, trail) AS k FROM ring WHERE path = component AND depth > 0)
SELECT b.component, b.size, b.members, array_to_string(c.trail, ' > ') AS cycle FROM big b JOIN closed c ON c.component = b.component AND c.k = 1""")
def q22_cycles(spark: SparkSession, d: str) -> DataFrame:
    c = graph.cycles(A.nodes(spark, d), A.edges(spark, d), 2)
    return c.select("component", "size", F.array_join("members", ",").alias("members"), F.array_join("cycle_path", " > ").alias("cycle"))


@query()
def g5_communities(spark: SparkSession, d: str) -> DataFrame:
    """Louvain, with names, cohesion and key files (the visiting order decides, so there is no SQL)."""
    n, e = A.nodes(spark, d), A.edges(spark, d)
    found = graph.pinned(communities.detect(n, e))
    return communities.summary(found, e).select("community_id", "name", "member_count", *_six("cohesion"), F.array_join("top_files", ",").alias("top_files"))


# ---- communities given

_COHESION = """
, ends AS (SELECT m1.community_id AS c1, m2.community_id AS c2 FROM edges e LEFT JOIN members m1 ON m1.path = e.source LEFT JOIN members m2 ON m2.path = e.target),
touched AS (SELECT c1 AS c, coalesce(c1 = c2, false) AS inside FROM ends WHERE c1 IS NOT NULL UNION ALL SELECT c2, false FROM ends WHERE c2 IS NOT NULL AND (c1 IS NULL OR c1 <> c2)),
cohesion AS (SELECT m.community_id, count(t.c) FILTER (t.inside) AS internal_edges, count(t.c) FILTER (NOT t.inside) AS external_edges FROM (SELECT DISTINCT community_id FROM members) m LEFT JOIN touched t ON t.c = m.community_id GROUP BY 1)"""


@query(_COHESION + " SELECT community_id, internal_edges, external_edges, round(CASE WHEN internal_edges + external_edges > 0 THEN internal_edges / (internal_edges + external_edges)::DOUBLE ELSE 0.0 END, 6) AS cohesion FROM cohesion")
def g7_cohesion(spark: SparkSession, d: str) -> DataFrame:
    return communities.cohesion(A.members(spark, d), A.edges(spark, d)).select("community_id", "internal_edges", "external_edges", *_six("cohesion"))


@query("""
, tops AS (SELECT community_id, CASE WHEN instr(path, '/') > 0 THEN split_part(path, '/', 1) ELSE '.' END AS dir, count(*) AS c FROM members GROUP BY 1, 2),
seconds AS (SELECT community_id, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS dir, count(*) AS c FROM members WHERE instr(path, '/') > 0 GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY community_id ORDER BY c DESC, dir) AS k FROM tops), s AS (SELECT *, row_number() OVER (PARTITION BY community_id ORDER BY c DESC, dir) AS k FROM seconds),
n AS (SELECT community_id, count(*) AS n FROM members GROUP BY 1)
SELECT n.community_id, CASE WHEN t1.c / n.n::DOUBLE > 0.6 THEN CASE WHEN s1.c / n.n::DOUBLE > 0.5 THEN s1.dir ELSE t1.dir END ELSE concat_ws(' + ', t1.dir, t2.dir) END AS name
FROM n JOIN t t1 ON t1.community_id = n.community_id AND t1.k = 1 LEFT JOIN t t2 ON t2.community_id = n.community_id AND t2.k = 2 LEFT JOIN s s1 ON s1.community_id = n.community_id AND s1.k = 1""")
def g8_community_names(spark: SparkSession, d: str) -> DataFrame:
    return communities.names(A.members(spark, d))


@query("""
, crossing AS (SELECT least(a.community_id, b.community_id) AS community_a, greatest(a.community_id, b.community_id) AS community_b, count(*) AS cross_edges FROM edges e JOIN members a ON a.path = e.source JOIN members b ON b.path = e.target WHERE a.community_id <> b.community_id GROUP BY 1, 2)
SELECT *, CASE WHEN cross_edges > 10 THEN 'high' WHEN cross_edges > 5 THEN 'moderate' ELSE 'low' END AS warning_level FROM crossing WHERE cross_edges >= 3""")
def g9_coupling(spark: SparkSession, d: str) -> DataFrame:
    return communities.coupling(A.members(spark, d), A.edges(spark, d))


# ---- dead code

_CALLERS = """
, callers AS (SELECT e.target AS path, o.community_id AS own, count(*) AS n, min(c.community_id) AS c1, max(c.community_id) AS c2 FROM edges e JOIN members o ON o.path = e.target LEFT JOIN members c ON c.path = e.source WHERE e.edge_type = 'IMPORTS_FROM' AND e.source NOT LIKE 'external:%' GROUP BY 1, 2)"""
_UNREACHABLE = f"""
, suspects AS (SELECT path FROM nodes WHERE node_kind = 'file' AND language NOT IN ({", ".join(f"'{x}'" for x in P.NON_CODE_LANGUAGES)}) AND NOT is_entry_point AND NOT is_test
  AND NOT regexp_matches(lower(path), '(?:^|/)(?:{"|".join(P.FIXTURE_SEGMENTS)})/') AND NOT {NEVER_SQL.format("path")} AND path NOT IN (SELECT target FROM edges)),
scored AS (SELECT s.path AS file_path, CASE WHEN coalesce(g.commit_count_90d, 0) = 0 AND floor(epoch(TIMESTAMP '{A.AS_OF}' - g.last_commit_at) / 86400) > 180 THEN 1.0 WHEN coalesce(g.commit_count_90d, 0) = 0 THEN 0.7 ELSE 0.4 END AS confidence,
  coalesce(g.commit_count_90d, 0) AS commit_count_90d, g.primary_owner, g.age_days FROM suspects s LEFT JOIN git g ON g.file_path = s.path),
unreachable AS (SELECT file_path, 'unreachable_file' AS kind, confidence::DOUBLE AS confidence, confidence >= 0.7 AND NOT {DYNAMIC_SQL.format(STEM_SQL.format("file_path"))} AS safe_to_delete, 0::BIGINT AS importers, commit_count_90d, primary_owner, age_days FROM scored),
packages AS (SELECT DISTINCT split_part(path, '/', 1) AS package FROM nodes WHERE node_kind = 'file' AND len(string_split(path, '/')) = 2 AND regexp_extract(path, '[^/]*$') IN ('package.json', '__init__.py')),
zombies AS (SELECT package AS file_path, 'zombie_package' AS kind, 0.5::DOUBLE AS confidence, false AS safe_to_delete, 0::BIGINT AS importers, 0::BIGINT AS commit_count_90d, NULL::VARCHAR AS primary_owner, NULL::INT AS age_days FROM packages
  WHERE (SELECT count(*) FROM packages) >= 2 AND package NOT IN (SELECT split_part(target, '/', 1) FROM edges WHERE source NOT LIKE 'external:%' AND instr(target, '/') > 0 AND split_part(source, '/', 1) <> split_part(target, '/', 1)))"""
_FINDING = ["file_path", "kind", "confidence", "safe_to_delete", "importers", "commit_count_90d", "primary_owner", "age_days"]


@query(_UNREACHABLE + " SELECT * FROM unreachable")
def q10_unreachable(spark: SparkSession, d: str) -> DataFrame:
    return deadcode.unreachable(A.nodes(spark, d), A.edges(spark, d), _git(spark, d), A.AS_OF).select(*_FINDING)


@query(_UNREACHABLE + " SELECT * FROM zombies")
def q13_zombie_packages(spark: SparkSession, d: str) -> DataFrame:
    return deadcode.zombie_packages(A.nodes(spark, d), A.edges(spark, d)).select(*_FINDING)


_MISPLACED = f"""
, misplaced AS (SELECT c.path AS file_path, c.own AS own, c.c1 AS suggested, c.n AS importers FROM callers c JOIN nodes n ON n.path = c.path WHERE c.n BETWEEN 1 AND 2 AND c.c1 = c.c2 AND c.c1 <> c.own AND n.node_kind = 'file'
  AND n.language NOT IN ({", ".join(f"'{x}'" for x in P.NON_CODE_LANGUAGES)}) AND NOT n.is_test AND NOT n.is_entry_point)"""


@query(_CALLERS + _MISPLACED + """
 SELECT file_path, 'misplaced_file' AS kind, 0.3::DOUBLE AS confidence, 'All ' || importers || ' importer(s) are in community ' || suggested || ', but file is in community ' || own || '. Consider moving.' AS reason, importers FROM misplaced""")
def q14_misplaced(spark: SparkSession, d: str) -> DataFrame:
    return deadcode.misplaced(A.nodes(spark, d), A.edges(spark, d), A.members(spark, d)).select("file_path", "kind", "confidence", "reason", "importers")


@query(_CALLERS + _MISPLACED + _UNREACHABLE + """
 SELECT file_path, kind, confidence FROM unreachable WHERE confidence >= 0.4 UNION ALL SELECT file_path, kind, confidence FROM zombies WHERE confidence >= 0.4 UNION ALL SELECT file_path, 'misplaced_file', 0.3 FROM misplaced""")
def q16_dead_code_report(spark: SparkSession, d: str) -> DataFrame:
    n, e = A.nodes(spark, d), A.edges(spark, d)
    return deadcode.report(deadcode.analyze(n, e, _git(spark, d), A.AS_OF), deadcode.misplaced(n, e, A.members(spark, d))).select("file_path", "kind", "confidence")


@query(_CALLERS + """
 SELECT path AS file_path, own AS current_community, c1 AS suggested_community, n AS caller_count, 'All ' || n || ' caller(s) are in community ' || c1 || ', but this file is in community ' || own AS reason FROM callers WHERE c1 = c2 AND c1 <> own""")
def q17_moves(spark: SparkSession, d: str) -> DataFrame:
    return refactor.move_suggestions(A.edges(spark, d), A.members(spark, d))


# ---- risk and impact

_RISK = f"""
, indeg AS (SELECT target AS path, count(*) AS n FROM edges GROUP BY 1), tests AS (SELECT DISTINCT source AS path FROM edges WHERE edge_type = 'TESTED_BY'),
cross_calls AS (SELECT e.target AS path, count(*) AS n FROM edges e JOIN members a ON a.path = e.source JOIN members b ON b.path = e.target WHERE a.community_id <> b.community_id GROUP BY 1),
risks AS (SELECT n.path, n.is_test, t.path IS NOT NULL AS has_tests, m.community_id, least(1.0, least(coalesce(i.n, 0) / 20.0, 0.10) + CASE WHEN t.path IS NULL AND NOT n.is_test THEN 0.30 ELSE 0 END + least(coalesce(c.n, 0) * 0.05, 0.15)
  + CASE WHEN coalesce(g.is_hotspot, false) OR coalesce(g.hotspot_score, 0) > 0.5 THEN 0.15 ELSE 0 END + CASE WHEN coalesce(g.bus_factor, 0) <= 1 AND NOT n.is_test THEN 0.10 ELSE 0 END + CASE WHEN n.pagerank > 0.005 THEN 0.10 ELSE 0 END
  + CASE WHEN {SECURITY_SQL.format("n.path")} THEN 0.10 ELSE 0 END)::DOUBLE AS risk
  FROM nodes n LEFT JOIN indeg i ON i.path = n.path LEFT JOIN tests t ON t.path = n.path LEFT JOIN cross_calls c ON c.path = n.path LEFT JOIN git g ON g.file_path = n.path LEFT JOIN members m ON m.path = n.path)"""
_LEVEL = "CASE WHEN {0} >= 0.7 - 1e-9 THEN 'CRITICAL' WHEN {0} >= 0.5 - 1e-9 THEN 'HIGH' WHEN {0} >= 0.3 - 1e-9 THEN 'MEDIUM' ELSE 'LOW' END"


@query(_RISK + " SELECT path, is_test, has_tests, community_id, round(risk, 6) AS risk FROM risks")
def q2_risk_scores(spark: SparkSession, d: str) -> DataFrame:
    return impact.risk_scores(A.nodes(spark, d), A.edges(spark, d), _git(spark, d), A.members(spark, d)).select("path", "is_test", "has_tests", "community_id", *_six("risk"))


@query(_RISK + _HOPS.format(seed=SEED_SQL, n=3) + " SELECT h.path, h.depth, round(r.risk, 6) AS risk_score, r.has_tests, r.is_test, r.community_id FROM hops h JOIN risks r ON r.path = h.path")
def q1_impact(spark: SparkSession, d: str) -> DataFrame:
    out = impact.impact(A.nodes(spark, d), A.edges(spark, d), _git(spark, d), A.members(spark, d), _seed(spark, d), 3)
    return out.select("path", "depth", *_six("risk_score"), "has_tests", "is_test", "community_id")


@query(_RISK + _HOPS.format(seed=SEED_SQL, n=2) + f"""
, i AS (SELECT h.path, r.risk, r.is_test FROM hops h JOIN risks r ON r.path = h.path)
SELECT count(*) AS total_impacted, round(coalesce(max(risk), 0), 6) AS max_risk, {_LEVEL.format("coalesce(max(risk), 0)")} AS risk_level, coalesce(array_to_string(list_sort(list(path) FILTER (is_test)), ','), '') AS tested_files FROM i""")
def q3_impact_summary(spark: SparkSession, d: str) -> DataFrame:
    out = impact.impact(A.nodes(spark, d), A.edges(spark, d), _git(spark, d), A.members(spark, d), _seed(spark, d), 2)
    return impact.summary(out).select("total_impacted", *_six("max_risk"), "risk_level", F.array_join("tested_files", ",").alias("tested_files"))


@query("""
, f AS (SELECT * FROM nodes WHERE k = 1), imports AS (SELECT * FROM edges WHERE edge_type = 'IMPORTS_FROM')
SELECT f.path AS file, f.language, f.symbol_count AS symbols, (SELECT count(*) FROM imports WHERE target = f.path)::INT AS importer_count, coalesce((SELECT string_agg(source, ',' ORDER BY source) FROM imports WHERE target = f.path), '') AS importers,
  (SELECT count(*) FROM imports WHERE source = f.path)::INT AS dependent_count, coalesce((SELECT string_agg(target, ',' ORDER BY target) FROM imports WHERE source = f.path), '') AS dependents,
  coalesce((SELECT string_agg(target, ',' ORDER BY target) FROM edges WHERE source = f.path AND edge_type = 'TESTED_BY'), '') AS tested_by, g.commit_count, round(g.hotspot_score, 6) AS hotspot_score, g.primary_owner, g.bus_factor
FROM f LEFT JOIN git g ON g.file_path = f.path""")
def q4_file_report(spark: SparkSession, d: str) -> DataFrame:
    path = A.nodes(spark, d).filter("k = 1").first()["path"]
    git = _git(spark, d).filter(F.col("file_path") == path).join(history.partners_of(A.commits(spark, d), A.AS_OF, path), "file_path", "left")
    r = impact.file_report(A.nodes(spark, d), A.edges(spark, d), git, path)
    listed = lambda c: F.array_join(c, ",").alias(c)
    return r.select("file", "language", "symbols", "importer_count", listed("importers"), "dependent_count", listed("dependents"), listed("tested_by"), F.col("git.commit_count").alias("commit_count"), F.round("git.hotspot_score", 6).alias("hotspot_score"), F.col("git.primary_owner").alias("primary_owner"), F.col("git.bus_factor").alias("bus_factor"))


# ---- flows

_ENTRY = f"""
, entries AS (SELECT path FROM nodes n WHERE node_kind = 'file' AND (is_entry_point OR (NOT is_test AND path NOT IN (SELECT target FROM import_edges)) OR lower({STEM_SQL.format("path")}) IN ({", ".join(f"'{x}'" for x in P.CONVENTIONAL_STEMS)})))"""
_FLOWS = _ENTRY + f"""
, walk(entry_point, path, depth) AS (SELECT path, path, 0 FROM entries UNION SELECT w.entry_point, e.target, w.depth + 1 FROM walk w JOIN import_edges e ON e.source = w.path WHERE e.target NOT LIKE 'external:%' AND w.depth < 15),
reached AS (SELECT entry_point, path, min(depth)::INT AS depth FROM walk GROUP BY 1, 2),
per_file AS (SELECT n.path, n.is_test, (SELECT count(*) FROM edges e WHERE e.source = n.path AND e.target LIKE 'external:%') AS calls, EXISTS (SELECT 1 FROM edges e WHERE e.source = n.path AND e.edge_type = 'TESTED_BY') AS tested FROM nodes n),
grouped AS (SELECT entry_point, count(*) AS n, count(DISTINCT {PARENT_SQL.format("path")}) AS dirs, sum(calls) AS calls, count(*) FILTER ({SECURITY_SQL.format("path")}) AS hits, count(*) FILTER (NOT is_test) AS plain, count(*) FILTER (NOT is_test AND tested) AS covered, bool_or(tested) AS has_test_coverage
  FROM reached JOIN per_file USING (path) GROUP BY 1 HAVING count(*) >= 2),
flows AS (SELECT substr(sha256(entry_point), 1, 8) AS flow_id, entry_point, n AS node_count, dirs AS file_spread, least(1.0, 0.30 * least((dirs - 1) / 4.0::DOUBLE, 1.0) + 0.20 * least(calls / 5.0::DOUBLE, 1.0) + 0.25 * (hits / n::DOUBLE) + 0.15 * (1 - covered / greatest(plain, 1)::DOUBLE) + 0.10 * least(n / 10.0::DOUBLE, 1.0)) AS criticality, has_test_coverage FROM grouped)"""


@query(_ENTRY + " SELECT path FROM entries")
def q5_entry_points(spark: SparkSession, d: str) -> DataFrame:
    return flows.entry_points(A.nodes(spark, d), A.edges(spark, d))


@query(_FLOWS + " SELECT flow_id, entry_point, node_count, file_spread, round(criticality, 6) AS criticality, has_test_coverage FROM flows")
def q6_flows(spark: SparkSession, d: str) -> DataFrame:
    found, _ = flows.trace(A.nodes(spark, d), A.edges(spark, d))
    return found.select("flow_id", "entry_point", "node_count", "file_spread", *_six("criticality"), "has_test_coverage")


@query(_FLOWS + " SELECT f.flow_id, r.path, r.depth, (row_number() OVER (PARTITION BY f.flow_id ORDER BY r.depth, r.path) - 1)::INT AS ord FROM flows f JOIN reached r USING (entry_point)")
def q6_flow_members(spark: SparkSession, d: str) -> DataFrame:
    return flows.trace(A.nodes(spark, d), A.edges(spark, d))[1]


@query(_FLOWS + """
 SELECT flow_id, entry_point, node_count FROM (SELECT *, row_number() OVER (ORDER BY CASE WHEN flow_id LIKE 'main.py%' OR entry_point = 'main.py' THEN 0 ELSE 1 END, criticality DESC, entry_point) AS r FROM flows WHERE flow_id LIKE 'main.py%' OR entry_point = 'main.py' OR instr(entry_point, 'main.py') > 0) WHERE r = 1""")
def q9_flow_detail(spark: SparkSession, d: str) -> DataFrame:
    return flows.find(flows.trace(A.nodes(spark, d), A.edges(spark, d))[0], "main.py").select("flow_id", "entry_point", "node_count")


# ---- history


@query(" SELECT file_path, commit_count, commit_count_90d, first_commit_at, last_commit_at, lines_added_90d, lines_deleted_90d, round(hotspot_score, 6) AS hotspot_score, contributor_count, age_days FROM history_counts")
def h1_history_counts(spark: SparkSession, d: str) -> DataFrame:
    c = history.counts(A.commits(spark, d), A.AS_OF)
    ntz = lambda x: F.col(x).cast("timestamp_ntz").alias(x)
    return c.select("file_path", "commit_count", "commit_count_90d", ntz("first_commit_at"), ntz("last_commit_at"), "lines_added_90d", "lines_deleted_90d", *_six("hotspot_score"), "contributor_count", "age_days")


@query(" SELECT file_path, bus_factor FROM bus")
def h3_bus_factor(spark: SparkSession, d: str) -> DataFrame:
    return history.bus_factor(A.commits(spark, d))


@query(" SELECT file_path, primary_owner FROM owners")
def h4_primary_owner(spark: SparkSession, d: str) -> DataFrame:
    return history.primary_owner(A.commits(spark, d))


def _category_sql() -> str:
    whens = " ".join(f"WHEN regexp_matches(substr(subject, 1, 200), '(?i){p}') THEN '{n}'" for n, p in P.CATEGORY_PATTERNS.items())
    return f", c AS (SELECT file_path, CASE {whens} END AS category FROM commits) SELECT file_path, category, count(*) AS n FROM c WHERE category IS NOT NULL GROUP BY 1, 2"


@query(_category_sql())
def h5_categories(spark: SparkSession, d: str) -> DataFrame:
    return history.categories(A.commits(spark, d)).select("file_path", F.explode("commit_categories").alias("category", "n"))


@query(f"""
, touched AS (SELECT DISTINCT sha, file_path, ts FROM commits WHERE NOT is_merge)
SELECT a.file_path AS file_a, b.file_path AS file_b, round(sum(exp(-greatest(epoch(TIMESTAMP '{A.AS_OF}' - a.ts) / 86400.0, 0) / 180.0)), 6) AS score, max(a.ts) AS last_ts FROM touched a JOIN touched b ON a.sha = b.sha AND a.file_path < b.file_path GROUP BY 1, 2
HAVING sum(exp(-greatest(epoch(TIMESTAMP '{A.AS_OF}' - a.ts) / 86400.0, 0) / 180.0)) >= 1.0""")
def h7_co_changes(spark: SparkSession, d: str) -> DataFrame:
    """With a least score of 1, which these commits reach."""
    c = history.co_changes(A.commits(spark, d), A.AS_OF, 1.0)
    return c.select("file_a", "file_b", *_six("score"), F.col("last_ts").cast("timestamp_ntz").alias("last_ts"))


@query(" SELECT file_path, round(churn_percentile, 6) AS churn_percentile, is_hotspot, is_stable, bus_factor, primary_owner FROM git")
def h8_hotspots(spark: SparkSession, d: str) -> DataFrame:
    return _git(spark, d).select("file_path", *_six("churn_percentile"), "is_hotspot", "is_stable", "bus_factor", "primary_owner")


@query(r"""
, raw AS (SELECT l_orderkey AS k, CASE l_linenumber % 4 WHEN 0 THEN 'src/{old => new}/f' || l_suppkey || '.py' WHEN 1 THEN 'a' || l_partkey || '.py => b/c' || l_partkey || '.py' WHEN 2 THEN 'src/{ => sub}/g.py' ELSE 'plain/p' || l_suppkey || '.go' END AS p FROM lineitem)
SELECT DISTINCT p, replace(regexp_replace(regexp_replace(p, '\{(.*?) => (.*?)\}', '\2'), '^.* => ', ''), '//', '/') AS new_path FROM raw""")
def h9_rename_paths(spark: SparkSession, d: str) -> DataFrame:
    lines = A.table(spark, d, "lineitem")
    n, s, p = F.col("l_linenumber") % 4, F.col("l_suppkey"), F.col("l_partkey")
    raw = F.when(n == 0, F.concat(F.lit("src/{old => new}/f"), s, F.lit(".py"))).when(n == 1, F.concat(F.lit("a"), p, F.lit(".py => b/c"), p, F.lit(".py"))).when(n == 2, F.lit("src/{ => sub}/g.py")).otherwise(F.concat(F.lit("plain/p"), s, F.lit(".go")))
    return lines.select(raw.alias("p")).distinct().select("p", git_log.new_path(F.col("p")).alias("new_path"))


@query("""
, ranked AS (SELECT file_path, sha, row_number() OVER (PARTITION BY file_path ORDER BY ts DESC, sha) AS k FROM commits) SELECT file_path, sha FROM ranked WHERE k <= 5""")
def s17_newest_commits(spark: SparkSession, d: str) -> DataFrame:
    return git_log.newest(A.commits(spark, d), 5).select("file_path", "sha")


# ---- refactoring, search, snapshots


@query(" SELECT path AS file_path, qualified_name AS name, kind, start_line, end_line, end_line - start_line + 1 AS line_count FROM symbols WHERE kind IN ('function', 'method') AND end_line - start_line + 1 >= 50")
def q18_large_functions(spark: SparkSession, d: str) -> DataFrame:
    return refactor.large_functions(A.symbols(spark, d), 50)


@query("""
, f AS (SELECT path FROM nodes WHERE k = 2)
SELECT source AS file, 'import_path' AS kind, (SELECT path FROM f) AS old_text, 'renamed.py' AS new_text FROM edges WHERE target = (SELECT path FROM f) AND source NOT LIKE 'external:%'
UNION ALL SELECT target, 'test_import', (SELECT path FROM f), 'renamed.py' FROM edges WHERE source = (SELECT path FROM f) AND edge_type = 'TESTED_BY'""")
def q19_rename_file(spark: SparkSession, d: str) -> DataFrame:
    path = A.nodes(spark, d).filter("k = 2").first()["path"]
    return refactor.rename_edits(A.nodes(spark, d), A.edges(spark, d), path, "renamed.py").select("file", "kind", "old_text", "new_text")


@query(" SELECT source AS file, 'symbol_reference' AS kind, target AS source_file FROM edges WHERE list_contains(imported_names, 'sym3')")
def q19_rename_symbol(spark: SparkSession, d: str) -> DataFrame:
    return refactor.rename_edits(A.nodes(spark, d), A.edges(spark, d), "sym3", "sym99").select("file", "kind", "source_file")


@query("""
, words AS (SELECT id || '#' || start_line AS doc, unnest(regexp_extract_all(lower(concat_ws(' ', qualified_name, name, kind, path, signature)), '[\\p{L}\\p{N}]+')) AS term FROM symbols),
tf AS (SELECT term, doc, count(*) AS tf FROM words GROUP BY 1, 2), dl AS (SELECT doc, count(*) AS dl FROM words GROUP BY 1), n AS (SELECT count(*) AS n FROM symbols), mean AS (SELECT (SELECT count(*) FROM words) / (SELECT n FROM n)::DOUBLE AS m),
idf AS (SELECT term, greatest(ln(((SELECT n FROM n) - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM tf WHERE term IN ('ring', 'class') GROUP BY 1)
SELECT doc, round(-sum(idf * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / (SELECT m FROM mean)))), 6) AS rank FROM tf JOIN idf USING (term) JOIN dl USING (doc) GROUP BY 1 HAVING count(*) = 2""".replace("\\\\", "\\"))
def q20_search_ranks(spark: SparkSession, d: str) -> DataFrame:
    """All hits of two words, without stemming, which SQL has not."""
    keyed = A.symbols(spark, d).withColumn("doc", F.concat_ws("#", "id", "start_line"))
    return search.ranked(keyed, "doc", search.COLUMNS, search.query_terms("ring class", False), stemmed=False).select("doc", *_six("rank"))


@query("""
, stems(word, stem) AS (VALUES ('large', 'larg'), ('economy', 'economi'), ('interface', 'interfac'), ('parts', 'part')),
words AS (SELECT id || '#' || start_line AS doc, unnest(regexp_extract_all(lower(concat_ws(' ', qualified_name, name, kind, path, signature)), '[\\p{L}\\p{N}]+')) AS word FROM symbols),
terms AS (SELECT doc, coalesce(stem, words.word) AS term FROM words LEFT JOIN stems ON stems.word = words.word),
tf AS (SELECT term, doc, count(*) AS tf FROM terms GROUP BY 1, 2), dl AS (SELECT doc, count(*) AS dl FROM terms GROUP BY 1), n AS (SELECT count(*) AS n FROM symbols), mean AS (SELECT (SELECT count(*) FROM terms) / (SELECT n FROM n)::DOUBLE AS m),
idf AS (SELECT term, greatest(ln(((SELECT n FROM n) - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM tf WHERE term IN ('larg', 'ring') GROUP BY 1),
ranked AS (SELECT doc, -sum(idf * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / (SELECT m FROM mean)))) AS rank FROM tf JOIN idf USING (term) JOIN dl USING (doc) GROUP BY 1 HAVING count(*) = 2),
best AS (SELECT * FROM ranked ORDER BY round(rank, 9), doc LIMIT 20)
SELECT qualified_name, name, kind, path, signature, round(rank, 6) AS rank FROM best JOIN symbols s ON s.id || '#' || s.start_line = best.doc""".replace("\\\\", "\\"))
def q20_search(spark: SparkSession, d: str) -> DataFrame:
    """Stemmed, the best twenty. The SQL has a table of the stems that differ from their words."""
    return search.search(A.symbols(spark, d), "large rings", 20).select("qualified_name", "name", "kind", "path", "signature", *_six("rank"))


_DIFF = """
, d AS (SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' WHEN o.content_hash <> n.content_hash THEN 'modified' END AS change_type FROM old_files o FULL JOIN new_files n ON o.path = n.path),
changed AS (SELECT * FROM d WHERE change_type IS NOT NULL)"""


@query(_DIFF + """
, one AS (SELECT DISTINCT source AS path FROM edges WHERE target IN (SELECT path FROM changed) AND source NOT IN (SELECT path FROM changed)), two AS (SELECT DISTINCT source AS path FROM edges WHERE target IN (SELECT path FROM one))
SELECT path, change_type FROM changed UNION ALL SELECT path, 'dependent' FROM (SELECT * FROM one UNION SELECT * FROM two) WHERE path NOT IN (SELECT path FROM changed) AND path IN (SELECT path FROM new_files)""")
def q26_changes(spark: SparkSession, d: str) -> DataFrame:
    old, new = A.snapshots(spark, d)
    return incremental.changes(old, new, A.edges(spark, d))


@query(" SELECT source, target, edge_type FROM edges WHERE source NOT IN (SELECT path FROM nodes WHERE k % 3 = 0) AND target NOT IN (SELECT path FROM nodes WHERE k % 3 = 0)")
def k10_delete_nodes(spark: SparkSession, d: str) -> DataFrame:
    gone = A.nodes(spark, d).filter("k % 3 = 0").select("path")
    return incremental.without(A.nodes(spark, d), A.edges(spark, d), gone)[1].select("source", "target", "edge_type")


@query(" SELECT path, CASE WHEN k % 29 = 0 AND k % 19 <> 0 THEN 'changed' || content_hash ELSE content_hash END AS content_hash FROM nodes WHERE node_kind = 'file'")
def k11_hash_update(spark: SparkSession, d: str) -> DataFrame:
    files_now = A.nodes(spark, d).filter("node_kind = 'file'").select("path", "content_hash")
    return incremental.with_hashes(files_now, A.snapshots(spark, d)[1])


@query(" SELECT path, content_hash FROM old_files WHERE path NOT IN (SELECT path FROM new_files) UNION ALL SELECT path, content_hash FROM new_files")
def k8_upsert(spark: SparkSession, d: str) -> DataFrame:
    old, new = A.snapshots(spark, d)
    return incremental.latest_wins(old, new, ["path"])


@query(" SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 10 MINUTE")
def k9_live_previews(spark: SparkSession, d: str) -> DataFrame:
    previews = A.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("created_at"))
    return refactor.live(previews, "2024-01-15 00:00:00").select("event_id")


@query(" SELECT path AS file_path, least(length(path) % 3, 1) AS kind_no, count(*) AS n FROM nodes GROUP BY 1, 2")
def k3_unique_findings(spark: SparkSession, d: str) -> DataFrame:
    n = A.nodes(spark, d).select(F.col("path").alias("file_path"), F.least(F.length("path") % 3, F.lit(1)).cast("long").alias("kind_no"))
    return n.unionByName(n).dropDuplicates(["file_path", "kind_no"]).groupBy("file_path", "kind_no").agg(F.count("*").alias("n"))


# ---- files and texts

_LANGUAGE_SQL = "CASE suffix " + " ".join(f"WHEN '{e}' THEN '{language}'" for e, language in P.EXTENSION_LANGUAGE.items()) + " END"


def _files_sql() -> str:
    blocked, ignore = ", ".join(f"'{x}'" for x in P.BLOCKED_DIRS), globs.ignore_rules(A.IGNORE)
    ignored = "false"
    for keep, pattern in ignore:
        ignored = f"CASE WHEN regexp_matches(path, '{pattern}') THEN {str(keep).lower()} ELSE {ignored} END"
    names = _regex([p for _, p in globs.ignore_rules(P.BLOCKED_NAMES)])
    return f"""
, raw AS (SELECT {A.sql_list(A.FOLDERS)}[((doc_id // 7) % {len(A.FOLDERS)} + 1)::INT] || 'f' || doc_id || {A.sql_list(A.FILE_NAMES)}[(doc_id % {len(A.FILE_NAMES)} + 1)::INT] AS path,
  CASE WHEN doc_id % 11 = 3 THEN '#!/usr/bin/env python3' || chr(10) WHEN doc_id % 11 = 4 THEN '#!/bin/bash' || chr(10) WHEN doc_id % 17 = 5 THEN '// Code generated by tool. DO NOT EDIT.' || chr(10) ELSE '' END || text AS text FROM documents),
named AS (SELECT path, text, strlen(text) AS size_bytes, lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\\.[^.]+)$', 1)) AS suffix, split_part(text, chr(10), 1)[:200] AS line FROM raw),
kept AS (SELECT *, coalesce({_LANGUAGE_SQL}, CASE WHEN line LIKE '#!%' THEN CASE WHEN line LIKE '%python%' THEN 'python' WHEN line LIKE '%node%' THEN 'javascript' WHEN line LIKE '%bash%' OR line LIKE '% sh%' THEN 'shell' WHEN line LIKE '%ruby%' THEN 'ruby' END END) AS language
  FROM named WHERE size_bytes <= 512000 AND suffix NOT IN ({", ".join(f"'{x}'" for x in P.BLOCKED_EXTENSIONS)}) AND NOT list_has_any(string_split(path, '/')[:-2], [{blocked}]) AND NOT ({ignored}) AND NOT regexp_matches(path, '{names}'))
SELECT path, language, size_bytes::BIGINT AS size_bytes, regexp_matches(lower({STEM_SQL.format("path")}), '^(?:test|spec)_|_(?:test|spec)$') OR regexp_matches(lower(path), '/(?:test|tests|spec)/') AS is_test,
  language IN ({", ".join(f"'{x}'" for x in P.CONFIG_LANGUAGES)}) AS is_config, lower({STEM_SQL.format("path")}) IN ({", ".join(f"'{x}'" for x in P.ENTRY_STEMS)}) AS is_entry_point, sha256(text) AS content_hash
FROM kept WHERE language IS NOT NULL AND (language IN ({", ".join(f"'{x}'" for x in P.NO_GENERATED_CHECK)}) OR NOT (regexp_matches(path, '(?:_pb2\\.py|_pb2_grpc\\.py|_pb\\.ts|_pb\\.js|_grpc\\.pb\\.go)$') OR regexp_matches(upper(text[:512]), '{"|".join(m.upper() for m in P.GENERATED_MARKERS)}')))"""


@query(_files_sql())
def s1_classify_files(spark: SparkSession, d: str) -> DataFrame:
    c = files.classify(A.raw_files(spark, d), A.IGNORE)
    return c.select("path", "language", "size_bytes", "is_test", "is_config", "is_entry_point", "content_hash")


@query("""
, j AS (SELECT conv_id, string_agg(CASE WHEN role = 'assistant' THEN text END, chr(10) ORDER BY turn) AS code FROM conversations GROUP BY 1) SELECT conv_id, sha256(coalesce(code, '')) AS code_sha, CASE WHEN conv_id % 5 = 0 THEN 'r' ELSE 'python' END AS language FROM j""")
def s14_notebooks(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as notebooks: what the assistant says is code."""
    cell = F.struct(F.when(F.col("role") == "assistant", "code").otherwise("markdown").alias("cell_type"), F.when(F.col("turn") % 2 == 0, F.array("text")).otherwise(F.array(F.substring("text", 1, 5), F.expr("substring(text, 6)"))).alias("source"))
    kernel = F.when(F.col("conv_id") % 5 == 0, F.struct(F.struct(F.lit("R").alias("language")).alias("kernelspec")))
    books = A.table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", cell.alias("c")))), lambda x: x["c"]).alias("cells"))
    text = books.select("conv_id", F.to_json(F.struct(kernel.alias("metadata"), "cells")).alias("text"))
    nb = documents.notebook(F.col("text"))
    return text.select("conv_id", nb.alias("nb")).select("conv_id", F.sha2("nb.code", 256).alias("code_sha"), F.col("nb.language").alias("language"))


@query(r"""
, parts AS (SELECT page_id, html, unnest(regexp_extract_all(html, '(?is)<script\b([^>]*)>(.*?)</script>', 2)) AS content, generate_subscripts(regexp_extract_all(html, '(?is)<script\b([^>]*)>(.*?)</script>', 2), 1) AS k FROM pages)
SELECT page_id, (k - 1)::INT AS block, content, len(string_split(regexp_extract(html, '(?is)^(.*?<script\b[^>]*>)', 1), chr(10)))::INT - 1 AS line_offset FROM parts WHERE k = 1""")
def s15_component_scripts(spark: SparkSession, d: str) -> DataFrame:
    """First script block of each page."""
    p = A.table(spark, d, "pages").select("page_id", F.posexplode(documents.scripts(F.col("html"))).alias("block", "s"))
    return p.filter("block = 0").select("page_id", "block", F.col("s.content").alias("content"), F.col("s.line_offset").alias("line_offset"))


@query(" SELECT doc_id, sha256(text) AS content_hash, strlen(text)::BIGINT AS size_bytes FROM documents")
def p14_content_hash(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("content_hash"), F.length(F.encode("text", "UTF-8")).cast("long").alias("size_bytes"))


@query(r"""
SELECT path, coalesce(nullif(regexp_replace(regexp_replace(lower(path), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unknown') AS slug,
  CASE WHEN len(string_split(path, '/')) <= 2 THEN path ELSE '.../' || array_to_string(string_split(path, '/')[-2:], '/') END AS label FROM nodes""")
def k15_slugs_and_labels(spark: SparkSession, d: str) -> DataFrame:
    return A.nodes(spark, d).select("path", paths.slug(F.col("path")).alias("slug"), paths.short_label(F.col("path")).alias("label"))


@query("""
, top AS (SELECT * FROM nodes ORDER BY pagerank DESC, path LIMIT 50), pos AS (SELECT betweenness, row_number() OVER (ORDER BY betweenness) - 1 AS r, count(*) OVER () AS n FROM top WHERE betweenness > 0),
t AS (SELECT betweenness AS th FROM pos WHERE r = least(floor(n * 0.75)::INT, n - 1)), most AS (SELECT max(pagerank) AS m FROM top)
SELECT path, CASE WHEN betweenness >= (SELECT th FROM t) THEN 'hotspot' WHEN is_entry_point THEN 'entry' WHEN is_test THEN 'test' ELSE 'regular' END AS type, round(5 + pagerank / (SELECT m FROM most) * 20, 6) AS radius FROM top""")
def q23_diagram_nodes(spark: SparkSession, d: str) -> DataFrame:
    return render.top_nodes(A.nodes(spark, d), A.members(spark, d), 50).select("path", "type", *_six("radius"))


@query("""
, top AS (SELECT path FROM nodes ORDER BY pagerank DESC, path LIMIT 50) SELECT source, target, edge_type FROM edges WHERE source IN (SELECT path FROM top) AND target IN (SELECT path FROM top)""")
def q23_diagram_edges(spark: SparkSession, d: str) -> DataFrame:
    kept = A.nodes(spark, d).orderBy(F.col("pagerank").desc(), "path").limit(50)
    return render.induced(A.edges(spark, d), kept)


@query("""
 SELECT 'nodes' AS key, count(*)::VARCHAR AS value FROM nodes UNION ALL SELECT 'edges', count(*)::VARCHAR FROM edges UNION ALL SELECT 'hotspots', count(*)::VARCHAR FROM git WHERE is_hotspot""")
def q24_status(spark: SparkSession, d: str) -> DataFrame:
    one = lambda df, key: df.agg(F.count("*").cast("string").alias("value")).select(F.lit(key).alias("key"), "value")
    return one(A.nodes(spark, d), "nodes").unionByName(one(A.edges(spark, d), "edges")).unionByName(one(_git(spark, d).filter("is_hotspot"), "hotspots"))


@query("""
 SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2""")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """The streaming job's windows, run over the table as one batch of a stream."""
    from quarrygraph.streaming.activity import hourly, run_once

    return run_once(spark, f"{d}/events.parquet", A.table(spark, d, "events").schema, hourly).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", *_six("total"))


# ---- parsing and resolution on generated sources

_SOURCE = "SELECT p_partkey AS k, 'src/p' || p_partkey || '.py' AS path FROM part"


#: Generated files that a task parses: a Parquet file's row group of keys is one task's, and makes some thousand times as much work as its size tells.
FILES_A_TASK = 10_000


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """A Python file for each part: two imports, a class with a method, a function. The keys are dealt to tasks before texts are made of them."""
    parts = A.table(spark, d, "part").select("p_partkey")
    dealt = parts.repartition(max(spark.sparkContext.defaultParallelism, -(-parts.count() // FILES_A_TASK)), "p_partkey")
    k = F.col("p_partkey")
    lines = ["import os.path", F.format_string("from pkg.m%d import a%d as b, c", k % 7, k), "", F.format_string("class C%d:", k), "    def _hidden(self):", "        return 1", "", F.format_string("async def f%d(x, y=2):", k), "    return x"]
    text = F.array_join(F.array(*(F.lit(x) if isinstance(x, str) else x for x in lines)), "\n")
    return dealt.select(F.concat(F.lit("src/p"), k, F.lit(".py")).alias("path"), F.lit("python").alias("language"), F.sha2(text, 256).alias("content_hash"), text.alias("text"))


@query(f"""
, s AS ({_SOURCE})
SELECT path, 'C' || k AS name, 'class' AS kind, 4 AS start_line, 6 AS end_line, 'public' AS visibility, NULL AS parent_name, 'src.p' || k || '.C' || k AS qualified_name, 'class C' || k AS signature FROM s
UNION ALL SELECT path, '_hidden', 'method', 5, 6, 'private', 'C' || k, 'src.p' || k || '.C' || k || '._hidden', 'def _hidden(self)' FROM s
UNION ALL SELECT path, 'f' || k, 'function', 8, 9, 'public', NULL, 'src.p' || k || '.f' || k, 'async def f' || k || '(x, y=2)' FROM s""")
def p1_symbols(spark: SparkSession, d: str) -> DataFrame:
    return parser.symbols(parser.parse(_sources(spark, d))).select("path", "name", "kind", "start_line", "end_line", "visibility", "parent_name", "qualified_name", "signature")


@query(f"""
, s AS ({_SOURCE}) SELECT path, 'os.path' AS module_path, 'path' AS names, false AS is_relative FROM s UNION ALL SELECT path, 'pkg.m' || (k % 7), 'm' || (k % 7) || ',a' || k || ',c', false FROM s""")
def p3_imports(spark: SparkSession, d: str) -> DataFrame:
    return parser.imports(parser.parse(_sources(spark, d))).select("path", "module_path", F.array_join("imported_names", ",").alias("names"), "is_relative")


@query(f", s AS ({_SOURCE}) SELECT path, 'C' || k || ',f' || k AS exports FROM s")
def p5_exports(spark: SparkSession, d: str) -> DataFrame:
    return parser.parse(_sources(spark, d)).select("path", F.array_join("exports", ",").alias("exports"))


def _script_files(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    stem = F.format_string("src/d%d/c%d", k % 10, k)
    return A.table(spark, d, "part").select("p_partkey", F.when(k % 3 == 0, F.concat(stem, F.lit(".ts"))).when(k % 3 == 1, F.concat(stem, F.lit(".tsx"))).otherwise(F.concat(stem, F.lit("/index.js"))).alias("path"))


@query("""
, n AS (SELECT count(*) AS n FROM part), f AS (SELECT p_partkey AS k, 'src/d' || (p_partkey % 10) || '/c' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' ELSE '/index.js' END AS path FROM part),
i AS (SELECT 'src/d' || (k % 10) || '/m' || k || '.ts' AS path, k, (k * 7) % (SELECT n FROM n) AS m FROM f)
SELECT i.path, CASE i.k % 4 WHEN 0 THEN '../d' || (m % 10) || '/c' || m WHEN 1 THEN '@/d' || (m % 10) || '/c' || m WHEN 2 THEN './gone' || i.k ELSE 'lib' || (i.k % 9) END AS module_path, CASE WHEN i.k % 4 < 2 THEN t.path WHEN i.k % 4 = 3 THEN 'external:lib' || (i.k % 9) END AS resolved
FROM i LEFT JOIN f t ON t.k = i.m""")
def r3_resolve_scripts(spark: SparkSession, d: str) -> DataFrame:
    """Relative paths, an alias, packages, and relative paths to nothing."""
    found = _script_files(spark, d)
    n = found.count()
    k, m = F.col("p_partkey"), (F.col("p_partkey") * 7) % n
    target = F.format_string("d%d/c%d", m % 10, m)
    module = F.when(k % 4 == 0, F.concat(F.lit("../"), target)).when(k % 4 == 1, F.concat(F.lit("@/"), target)).when(k % 4 == 2, F.concat(F.lit("./gone"), k)).otherwise(F.concat(F.lit("lib"), k % 9))
    imports = found.select(F.format_string("src/d%d/m%d.ts", k % 10, k).alias("path"), F.lit("typescript").alias("language"), module.alias("module_path"), F.array().cast("array<string>").alias("imported_names"))
    aliases = spark.createDataFrame([("", "@/", "src/"), ("", "@", "nowhere/")], "dir string, prefix string, target string")
    return resolve.resolve(imports, found.select("path"), aliases).select("path", "module_path", "resolved")


@query(f"""
 SELECT path, {SECURITY_SQL.format("path")} AS sensitive, {NEVER_SQL.format("path")} AS never_flagged,
  {DYNAMIC_SQL.format(STEM_SQL.format("path"))} AS is_dynamic, regexp_matches(lower(path), '(?:^|/)(?:{"|".join(P.FIXTURE_SEGMENTS)})/') AS is_fixture FROM nodes""")
def q12_path_flags(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return A.nodes(spark, d).select("path", impact.security_sensitive(p).alias("sensitive"), deadcode.never_flagged(p).alias("never_flagged"), deadcode.is_dynamic(p).alias("is_dynamic"), deadcode.is_fixture(p).alias("is_fixture"))


@query(r" SELECT path FROM nodes WHERE ends_with(path, '.py') AND (path LIKE 'm1/%' OR path LIKE '%/m1/%' OR regexp_matches(path, '^scripts/[^/]+$') OR path = 'main.py' OR path LIKE '%/main.py' OR regexp_matches(path, '^n1/[^/]+$'))")
def s24_entry_files(spark: SparkSession, d: str) -> DataFrame:
    return projects.entry_files(A.nodes(spark, d), ["**/m1/**/*.py", "scripts/*.py", "**/main.py", "n1/*.py"])


def _local_pagerank_sql(rounds: int) -> str:
    out = """
, ie AS (SELECT DISTINCT e.source, e.target FROM edges e JOIN members a ON a.path = e.source JOIN members b ON b.path = e.target AND a.community_id = b.community_id), outs AS (SELECT source, count(*) AS n FROM ie GROUP BY 1),
sizes AS (SELECT community_id, count(*)::DOUBLE AS n FROM members GROUP BY 1), r0 AS (SELECT path, community_id, n, 1.0 / n AS p FROM members JOIN sizes USING (community_id))"""
    for k in range(rounds):
        out += f""",
l{k} AS MATERIALIZED (SELECT community_id, sum(p) AS x FROM r{k} WHERE path NOT IN (SELECT source FROM outs) GROUP BY 1),
r{k + 1} AS MATERIALIZED (SELECT r.path, r.community_id, r.n, 0.85 * (coalesce(g.x, 0) + coalesce(l.x, 0) / r.n) + 0.15 / r.n AS p FROM r{k} r LEFT JOIN l{k} l ON l.community_id = r.community_id
  LEFT JOIN (SELECT ie.target, sum(s.p / outs.n) AS x FROM ie JOIN r{k} s ON s.path = ie.source JOIN outs ON outs.source = ie.source GROUP BY 1) g ON g.target = r.path)"""
    return out + f" SELECT path, community_id, round(p, 6) AS pagerank FROM r{rounds}"


def _inner(spark: SparkSession, d: str) -> DataFrame:
    """Edges inside a community."""
    m, e = A.members(spark, d), A.edges(spark, d)
    c1, c2 = m.select(F.col("path").alias("source"), F.col("community_id").alias("c1")), m.select(F.col("path").alias("target"), F.col("community_id").alias("c2"))
    return e.join(c1, "source").join(c2, "target").filter("c1 = c2").select("source", "target")


@query(_local_pagerank_sql(30))
def g6_community_pagerank_rounds(spark: SparkSession, d: str) -> DataFrame:
    """PageRank inside each community, thirty rounds whatever the change, so that SQL can say the same."""
    return communities.pagerank_by(A.members(spark, d), _inner(spark, d), rounds=30, tolerance=None).select("path", "community_id", *_six("pagerank"))


@query()
def g6_community_pagerank(spark: SparkSession, d: str) -> DataFrame:
    """PageRank inside each community until the change is below the production tolerance."""
    return communities.pagerank_by(A.members(spark, d), _inner(spark, d)).select("path", "community_id", *_six("pagerank"))


@query("""
, words AS (SELECT id AS doc, unnest(regexp_extract_all(lower(concat_ws(' ', name, signature)), '[\\p{L}\\p{N}]+')) AS term FROM symbols) SELECT term, doc, count(*) AS tf FROM words GROUP BY 1, 2""".replace("\\\\", "\\"))
def k6_postings(spark: SparkSession, d: str) -> DataFrame:
    return search.postings(A.symbols(spark, d), "id", ("name", "signature"), stemmed=False)


@query("""
, wanted AS (SELECT path FROM nodes WHERE k % 2 = 0), h AS (SELECT * FROM history_counts WHERE file_path IN (SELECT path FROM wanted))
SELECT file_path, round((row_number() OVER (ORDER BY hotspot_score, commit_count_90d, file_path) - 1) / (count(*) OVER ())::DOUBLE, 6) AS churn_percentile FROM h""")
def h11_subset(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of some files: percentiles count among these."""
    only = A.nodes(spark, d).filter("k % 2 = 0").select("path")
    return history.metadata(A.commits(spark, d), A.AS_OF, only).select("file_path", *_six("churn_percentile"))


@query("""
, top AS (SELECT path, row_number() OVER (ORDER BY pagerank DESC, path) - 1 AS i FROM nodes QUALIFY i < 20)
SELECT 'flowchart LR' AS line UNION ALL SELECT '    n' || i || '["' || CASE WHEN length(path) <= 40 THEN path ELSE '...' || right(path, 37) END || '"]' FROM top
UNION ALL SELECT '    n' || a.i || ' --> n' || b.i FROM edges e JOIN top a ON a.path = e.source JOIN top b ON b.path = e.target""")
def k14_mermaid(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in render.mermaid(A.nodes(spark, d), A.edges(spark, d), 20).splitlines()], "line string")


@query()
def q25_wiki(spark: SparkSession, d: str) -> DataFrame:
    """Pages of the given communities, by name and length (text is for people)."""
    m, e = A.members(spark, d), A.edges(spark, d)
    found, _ = flows.trace(A.nodes(spark, d), e)
    pages = render.wiki(communities.summary(m, e), m, found, {"repo_name": "data", "file_count": m.count()})
    return spark.createDataFrame([(k, len(v)) for k, v in sorted(pages.items())], "page string, n_chars long")


@query()
def k17_node_link(spark: SparkSession, d: str) -> DataFrame:
    return graph.node_link(A.nodes(spark, d), A.edges(spark, d))


# ---- streams over windows that overlap, and sessions


@query("""
, quarters AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS window_start FROM events, range(4) r(k))
SELECT window_start, count(*) AS n FROM quarters GROUP BY 1""")
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Hours that begin every quarter of an hour, run over the table as a stream."""
    from quarrygraph.streaming import activity

    out = activity.run_once(spark, f"{d}/events.parquet", spark.read.parquet(f"{d}/events.parquet").schema, activity.sliding)
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@query("""
, gaps AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w > INTERVAL 30 MINUTE, true)::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
islands AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM gaps)
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS n FROM islands GROUP BY user_id, session""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events without a gap of half an hour between them, run over the table as a stream."""
    from quarrygraph.streaming import activity

    out = activity.run_once(spark, f"{d}/events.parquet", spark.read.parquet(f"{d}/events.parquet").schema, activity.sessions)
    return out.select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), F.col("ended").cast("timestamp_ntz").alias("ended"), "n")


# ---- sources and resolution, against patterns written for the SQL


@query(" SELECT sha, file_path, author, email, ts, is_merge, subject, added, deleted FROM commits")
def s18_log_records(spark: SparkSession, d: str) -> DataFrame:
    """The commits written as records of git's log, one for each commit with a line for each file, and read again."""
    lines = F.concat_ws("\n", F.array_sort(F.collect_list(F.concat_ws("\t", "added", "deleted", "file_path"))))
    parents = F.when(F.col("is_merge"), "aaaa bbbb").otherwise("aaaa")
    head = F.concat_ws("\x1f", "sha", "author", "email", F.unix_seconds("ts").cast("string"), parents, "subject")
    records = A.commits(spark, d).groupBy("sha", "author", "email", "ts", "is_merge", "subject").agg(lines.alias("lines")).select(F.concat_ws("\n", head, F.lit(""), "lines").alias("value"))
    return git_log.parse_log(records).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(f"""
, raw AS (SELECT {A.sql_list(A.FOLDERS)}[((doc_id // 7) % {len(A.FOLDERS)} + 1)::INT] || 'f' || doc_id || {A.sql_list(A.FILE_NAMES)}[(doc_id % {len(A.FILE_NAMES)} + 1)::INT] AS file_path FROM documents)
SELECT file_path FROM raw WHERE regexp_matches(file_path, '\\.(py|pyi|ts|tsx|js|jsx|mjs|cjs|go|rs|java|kt|kts|scala|c|h|cpp|cc|cxx|hpp|hxx|cs|rb|php|swift)$')""")
def h10_code_files(spark: SparkSession, d: str) -> DataFrame:
    """Of all kinds of files those whose history is indexed."""
    return git_log.code_files(A.raw_files(spark, d).select(F.col("path").alias("file_path")))


@query("""
, cut AS (SELECT doc_id, text, (doc_id * 37) % 12000 AS place FROM documents WHERE text IS NOT NULL)
SELECT doc_id, doc_id % 3 = 0 AND strlen(substr(text, 1, place)) < 8192 AS is_binary FROM cut""")
def s9_binary_contents(spark: SparkSession, d: str) -> DataFrame:
    """Texts, a third of them with a NUL after some characters: binary if it is among the first 8192 bytes."""
    at = (F.col("doc_id") * 37 % 12000).cast("int")
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.substring(F.col("text"), F.lit(1), at), F.lit("\0"), F.substring(F.col("text"), at + 1, F.length("text")))).otherwise(F.col("text"))
    return A.table(spark, d, "documents").filter("text is not null").select("doc_id", files.is_binary(F.encode(text, "UTF-8")).alias("is_binary"))


def _other(spark: SparkSession, d: str) -> tuple[DataFrame, Column, Column]:
    """part's keys k with another key j of the same table (or none)."""
    parts = A.table(spark, d, "part").select(F.col("p_partkey").alias("k"))
    return parts, F.col("k"), F.col("k") * 7 % parts.count()


@query("""
, f AS (SELECT p_partkey AS k, 'p' || (p_partkey % 10) || '/s' || (p_partkey % 3) || '/m' || p_partkey || '.py' AS path FROM part),
i AS (SELECT k, path, (k * 7) % (SELECT count(*) FROM part) AS j FROM f)
SELECT i.path, CASE i.k % 3 WHEN 0 THEN '.m' || j WHEN 1 THEN '..s' || (j % 3) || '.m' || j ELSE '...p' || (j % 10) || '.s' || (j % 3) || '.m' || j END AS module_path,
  CASE WHEN i.k % 3 = 2 OR j % 10 = i.k % 10 AND (i.k % 3 = 1 OR j % 3 = i.k % 3) THEN t.path END AS resolved
FROM i LEFT JOIN f t ON t.k = i.j""")
def r1_resolve_relative(spark: SparkSession, d: str) -> DataFrame:
    """Python imports with one, two and three leading dots, some of files that aren't there."""
    parts, k, j = _other(spark, d)
    found = parts.select("k", F.format_string("p%d/s%d/m%d.py", k % 10, k % 3, k).alias("path"))
    module = F.when(k % 3 == 0, F.format_string(".m%d", j)).when(k % 3 == 1, F.format_string("..s%d.m%d", j % 3, j)).otherwise(F.format_string("...p%d.s%d.m%d", j % 10, j % 3, j))
    imports = found.select("path", F.lit("python").alias("language"), module.alias("module_path"), F.array().cast("array<string>").alias("imported_names"))
    return resolve.resolve(imports, found.select("path")).select("path", "module_path", "resolved")


@query("""
, f AS (SELECT p_partkey AS k, 'c' || (p_partkey % 10) || '/h' || p_partkey || '.h' AS path FROM part UNION ALL SELECT p_partkey, 'c' || (p_partkey % 7) || '/H' || p_partkey || '.hpp' FROM part),
i AS (
  SELECT p_partkey AS k, (p_partkey * 7) % (SELECT count(*) FROM part) AS j, 'c' || (p_partkey % 10) || '/x' || p_partkey AS path, ['c', 'cpp', 'go', 'ruby'][p_partkey % 4 + 1] AS language FROM part),
w AS (SELECT *, CASE language WHEN 'c' THEN '"h' || j || '.h"' WHEN 'cpp' THEN '<h' || j || '.h>' WHEN 'go' THEN 'example.com/lib/h' || j ELSE 'lib/h' || j || '.rb' END AS module_path FROM i),
c AS (SELECT w.path, module_path, f.path AS found, row_number() OVER (PARTITION BY w.path ORDER BY
    (language IN ('c', 'cpp') AND f.path = regexp_replace(w.path, '/.*', '') || '/h' || j || '.h') DESC, (regexp_replace(f.path, '/.*', '') = regexp_replace(w.path, '/.*', '')) DESC, f.path) AS r
  FROM w LEFT JOIN f ON f.k = w.j)
SELECT path, module_path, found AS resolved FROM c WHERE r = 1""")
def r6_resolve_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Includes of C and C++, Go packages, and Ruby as a language without rules: the includer's folder first, then the file of that stem that shares most of the path."""
    parts, k, j = _other(spark, d)
    headers = parts.select(F.format_string("c%d/h%d.h", k % 10, k).alias("path")).unionByName(parts.select(F.format_string("c%d/H%d.hpp", k % 7, k).alias("path")))
    language = F.get(F.array(*(F.lit(x) for x in ("c", "cpp", "go", "ruby"))), (k % 4).cast("int"))
    module = F.when(k % 4 == 0, F.format_string('"h%d.h"', j)).when(k % 4 == 1, F.format_string("<h%d.h>", j)).when(k % 4 == 2, F.format_string("example.com/lib/h%d", j)).otherwise(F.format_string("lib/h%d.rb", j))
    imports = parts.select(F.format_string("c%d/x%d", k % 10, k).alias("path"), language.alias("language"), module.alias("module_path"), F.array().cast("array<string>").alias("imported_names"))
    return resolve.resolve(imports, headers).select("path", "module_path", "resolved")


# ---- every pair an edge


def _over_all_pairs(f: Query) -> Query:
    @wraps(f)
    def whole(spark: SparkSession, d: str) -> DataFrame:
        with A.all_pairs():
            return f(spark, d)

    return whole


#: Queries on edges that run on every ordered pair too, under a name of their own.
EDGE_QUERIES = """
r10_tested_by g2_betweenness g3_strong_components g5_communities g7_cohesion g9_coupling g10_shortest_path g11_k_hops g15_reachability g15_directions g13_dependents g14_degrees g1_pagerank_rounds g1_pagerank q1_impact q2_risk_scores q3_impact_summary q4_file_report
q5_entry_points q6_flows q6_flow_members q9_flow_detail q19_rename_file q22_cycles q23_diagram_edges q26_changes""".split()
#: Of these, SQL's recursion can't manage: paths as arrays, and walks of so many rows. They are tested against brute force.
WITHOUT_SQL = {"g10_shortest_path"}
for _name in EDGE_QUERIES:
    QUERIES[f"{_name}_all_pairs"] = _over_all_pairs(QUERIES[_name])
    if _name in ORACLE_SQL and _name not in WITHOUT_SQL:
        ORACLE_SQL[f"{_name}_all_pairs"] = ORACLE_SQL[_name].replace(A.CTES.strip(), A.ALL_PAIRS_CTES.strip())
