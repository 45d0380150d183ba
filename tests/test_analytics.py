import math
from datetime import datetime, timedelta

import pytest

from quarrygraph.operators import deadcode, flows, history, impact, incremental, refactor, search
from quarrygraph.schemas import schema

NOW = datetime(2024, 6, 1)
COMMITS = "sha string, file_path string, author string, email string, ts timestamp, is_merge boolean, subject string, added long, deleted long"


def commits(spark, rows):
    return spark.createDataFrame([(s, f, a, f"{a}@x", NOW - timedelta(days=d), m, subj, add, rem) for s, f, a, d, m, subj, add, rem in rows], COMMITS)


@pytest.fixture(scope="module")
def no_git(spark):
    return spark.createDataFrame([], schema("git_metadata"))


def test_history(spark):
    rows = [(f"s{i}", "a.py", "ann" if i < 8 else "bob", i * 30, False, "Fix bug" if i % 2 else "Add thing", 50, 50) for i in range(10)]
    rows += [("m", "b.py", "cid", 400, True, "nothing", 1, 0), ("n", "b.py", "dee", 10, False, "Bump x", 1000, 0)]
    got = {r.file_path: r for r in history.metadata(commits(spark, rows), NOW).collect()}
    a, b = got["a.py"], got["b.py"]
    assert (a.commit_count, a.commit_count_90d, a.lines_added_90d, a.contributor_count, a.age_days, a.bus_factor, a.primary_owner, a.primary_email) == (10, 4, 200, 2, 270, 1, "ann", "ann@x")
    assert abs(a.hotspot_score - sum(math.exp(-math.log(2) * i * 30 / 180) for i in range(10))) < 1e-9
    assert abs(b.hotspot_score - (3 * math.exp(-math.log(2) * 10 / 180) + 0.01 * math.exp(-math.log(2) * 400 / 180))) < 1e-9
    assert a.commit_categories == {"feature": 5, "fix": 5} and b.commit_categories == {"dependency": 1} and b.primary_owner == "dee"  # the newer of two with one commit
    assert (b.churn_percentile, a.churn_percentile) == (0.0, 0.5) and not a.is_hotspot and not a.is_stable


def test_bus_factor_at_exactly_the_share(spark):
    rows = [(f"{a}{i}", "f.py", a, i, False, "", 1, 1) for a, n in (("x", 4), ("y", 4), ("z", 2)) for i in range(n)]
    assert history.bus_factor(commits(spark, rows)).first().bus_factor == 2


def test_co_changes(spark):
    rows = [(f"s{i}", f, "a", i, False, "", 1, 1) for i in range(4) for f in ("a.py", "b.py")] + [(f"t{i}", f, "a", 0, False, "", 1, 1) for i in range(2) for f in ("a.py", "c.py")] + [(f"m{i}", f, "a", 0, True, "", 1, 1) for i in range(9) for f in ("b.py", "c.py")]
    got = history.co_changes(commits(spark, rows), NOW).collect()
    assert [(r.file_a, r.file_b) for r in got] == [("a.py", "b.py")] and abs(got[0].score - sum(math.exp(-i / 180) for i in range(4))) < 1e-9
    p = {r.file_path: r.co_change_partners for r in history.partners(history.co_changes(commits(spark, rows), NOW)).collect()}
    assert p["a.py"][0].file_path == "b.py" and p["b.py"][0].file_path == "a.py" and p["a.py"][0].last_co_change == NOW.date()
    assert history.co_changes(commits(spark, rows), NOW, widest=1).count() == 0


def test_history_of_nothing(spark):
    assert history.metadata(spark.createDataFrame([], COMMITS), NOW).count() == 0


def test_unreachable(spark, sample, no_git):
    nodes, edges = sample
    got = deadcode.unreachable(nodes, edges, no_git, NOW).collect()
    assert [(r.file_path, r.confidence, r.safe_to_delete) for r in got] == [("src/orphan.py", 0.7, True)]
    git = history.metadata(commits(spark, [("s", "src/orphan.py", "a", 200, False, "x", 1, 1)]), NOW)
    r = deadcode.unreachable(nodes, edges, git, NOW).first()
    assert (r.confidence, r.primary_owner, r.age_days) == (1.0, "a", 200)
    git = history.metadata(commits(spark, [("s", "src/orphan.py", "a", 3, False, "x", 1, 1)]), NOW)
    r = deadcode.unreachable(nodes, edges, git, NOW).first()
    assert (r.confidence, r.safe_to_delete) == (0.4, False)
    assert deadcode.unreachable(nodes, edges, no_git, NOW, ["src/orphan.py"]).count() == 0


def test_never_flagged_and_dynamic(spark, no_git):
    names = ["pkg/__init__.py", "conftest.py", "setup.py", "fixtures/x.py", "a/PayHandler.py", "a/plain.py", "tools/run.py", "doc.md"]
    nodes = spark.createDataFrame([(n, "markdown" if n.endswith("md") else "python", False, False) for n in names], "path string, language string, is_entry_point boolean, is_test boolean")
    edges = spark.createDataFrame([], "source string, target string, edge_type string")
    got = {r.file_path: r.safe_to_delete for r in deadcode.unreachable(nodes, edges, no_git, NOW).collect()}
    assert got == {"a/PayHandler.py": False, "a/plain.py": True}


def test_zombies_moves_and_report(spark, no_git):
    names = ["p/__init__.py", "p/a.py", "q/package.json", "q/b.js", "r/c.py"]
    nodes = spark.createDataFrame([(n, "python", False, False) for n in names], "path string, language string, is_entry_point boolean, is_test boolean")
    edges = spark.createDataFrame([("r/c.py", "p/a.py", "IMPORTS_FROM"), ("q/b.js", "q/package.json", "IMPORTS_FROM")], "source string, target string, edge_type string")
    assert [r.file_path for r in deadcode.zombie_packages(nodes, edges).collect()] == ["q"]
    assert deadcode.zombie_packages(nodes, edges, ["q"]).count() == 0
    members = spark.createDataFrame([("p/a.py", 0), ("r/c.py", 1), ("q/b.js", 2), ("q/package.json", 2)], "path string, community_id int")
    moves = deadcode.misplaced(nodes, edges, members, no_git)
    assert [(r.file_path, r.importers) for r in moves.collect()] == [("p/a.py", 1)]
    report = deadcode.report(deadcode.analyze(nodes, edges, no_git, NOW), moves).collect()
    assert [r.kind for r in report] == ["unreachable_file", "unreachable_file", "zombie_package", "misplaced_file"]
    assert refactor.move_suggestions(edges, members).first().suggested_community == 1


def test_risk_levels(spark):
    df = spark.createDataFrame([(0.0,), (0.29,), (0.3,), (0.5,), (0.69,), (0.7,), (1.0,)], "s double")
    assert [r.l for r in df.select(impact.risk_level(df.s).alias("l")).collect()] == ["LOW", "LOW", "MEDIUM", "HIGH", "HIGH", "CRITICAL", "CRITICAL"]


def test_impact(spark, sample, no_git):
    nodes, edges = sample
    members = spark.createDataFrame([("src/auth.py", 1), ("src/main.py", 2), ("src/api.py", 2)], "path string, community_id int")
    got = {r.path: r for r in impact.impact(nodes, edges, no_git, members, spark.createDataFrame([("src/config.py",)], "path string"), 3).collect()}
    assert {p: r.depth for p, r in got.items()} == {"src/db.py": 1, "src/api.py": 2, "src/main.py": 3}
    r = {x.path: x for x in impact.risk_scores(nodes, edges, no_git, members).collect()}
    # auth: 4 callers 0.10, tested, two callers of another community 0.10, no history 0.10, rank 0.10, name 0.10
    assert abs(r["src/auth.py"].risk - 0.5) < 1e-9 and r["src/auth.py"].has_tests
    assert abs(r["src/orphan.py"].risk - 0.4) < 1e-9  # the rank's threshold is strict
    s = impact.summary(impact.impact(nodes, edges, no_git, members, spark.createDataFrame([("src/utils.py",)], "path string"), 1)).first()
    assert s.total_impacted == 2 and s.tested_files == ["tests/test_utils.py"]
    assert impact.summary(impact.impact(nodes, edges, no_git, members, spark.createDataFrame([], "path string"))).first().risk_level == "LOW"


def test_file_report(spark, sample, no_git):
    r = impact.file_report(*sample, no_git, "src/auth.py").first()
    assert r.importers == ["src/api.py", "src/main.py", "tests/test_auth.py"] and r.tested_by == ["tests/test_auth.py"] and r.git is None and r.dependent_count == 0
    assert impact.file_report(*sample, no_git, "none").count() == 0


def test_flows(spark, sample):
    nodes, edges = sample
    found, members = flows.trace(nodes, edges)
    f = {r.entry_point: r for r in found.collect()}
    assert set(f) == {"src/main.py"} and f["src/main.py"].node_count == 7 and f["src/main.py"].has_test_coverage
    assert abs(f["src/main.py"].criticality - (0.25 / 7 + 0.15 * (1 - 2 / 7) + 0.07)) < 1e-9
    assert [(r.path, r.depth) for r in members.orderBy("ord").collect()][:3] == [("src/main.py", 0), ("src/api.py", 1), ("src/auth.py", 1)]
    assert {r.path for r in flows.entry_points(nodes, edges).collect()} == {"src/main.py", "src/orphan.py"}
    assert flows.find(found, "main").first().entry_point == "src/main.py" and flows.find(found, f["src/main.py"].flow_id[:4]).count() == 1 and flows.find(found, "zzz").count() == 0
    _, short = flows.trace(nodes, edges, 1)
    assert short.count() == 4


def test_rename(spark, sample):
    nodes, edges = sample
    got = {(r.file, r.kind) for r in refactor.rename_edits(nodes, edges, "src/utils.py", "src/helpers.py").collect()}
    assert got == {("src/main.py", "import_path"), ("tests/test_utils.py", "import_path"), ("tests/test_utils.py", "test_import")}
    assert {r.file for r in refactor.rename_edits(nodes, edges, "config", "settings").collect()} == {"src/db.py"}
    p = refactor.preview(nodes, edges, "config", "settings", NOW)
    assert len(p.first().edits) == 1 and refactor.live(p, NOW + timedelta(minutes=9)).count() == 1 and refactor.live(p, NOW + timedelta(minutes=11)).count() == 0


def test_large_functions(spark):
    s = spark.createDataFrame([("a", "f", "a.f", "function", 1, 50), ("a", "g", None, "method", 1, 49), ("a", "C", "a.C", "class", 1, 99)], "path string, name string, qualified_name string, kind string, start_line int, end_line int")
    assert [(r.name, r.line_count) for r in refactor.large_functions(s).collect()] == [("a.f", 50)]


def test_changes(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("u", "1"), ("v", "1"), ("e", "")], "path string, content_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1"), ("u", "1"), ("v", "1"), ("e", "1")], "path string, content_hash string")
    edges = spark.createDataFrame([("u", "b"), ("v", "u"), ("a", "v")], "source string, target string")
    got = {r.path: r.change_type for r in incremental.changes(old, new, edges).collect()}
    assert got == {"b": "modified", "c": "deleted", "d": "added", "e": "added", "u": "dependent", "v": "dependent"}


def test_search(spark):
    rows = [("m.validate_user", "validate_user", "function", "m.py", "def validate_user()"), ("m.UserValidator", "UserValidator", "class", "m.py", "class UserValidator"), ("m.create_users", "create_users", "function", "m.py", "def create_users()"), ("n.parse", "parse", "function", "n.py", "def parse()"), ("n.Tree", "Tree", "class", "n.py", "class Tree")]
    s = spark.createDataFrame([(f"{q}", *r[1:3], q, r[3], r[4], 1) for r in rows for q in (r[0],)], "id string, name string, kind string, qualified_name string, path string, signature string, start_line int")
    got = search.search(s, "user").collect()
    assert {r.name for r in got} == {"validate_user", "create_users"} and all(r.rank < 0 for r in got)  # stems; words are not cut inside
    assert [r.name for r in search.search(s, "validating users").collect()] == ["validate_user"]
    assert search.search(s, "user", kind="class").count() == 0 and search.search(s, "user", limit=1).count() == 1 and search.search(s, "a.b-").count() == 0 and search.search(s, "").count() == 0
    plain = {r.name: r.rank for r in search.search(s, "Create").collect()}
    boosted = {r.name: r.rank for r in search.search(s, "create_users").collect()}
    assert set(plain) == {"create_users"} and set(boosted) == {"create_users"}
    n, k, dl = 5, 1, 0
    idf = math.log((n - k + 0.5) / (k + 0.5))
    words = {r[1]: len([w for t in r for w in __import__("re").findall(r"[^\W_]+", t)]) for r in rows}
    dl, mean, tf = words["create_users"], sum(words.values()) / n, 3
    assert abs(plain["create_users"] + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) < 1e-9


def test_facts_and_the_partners_of_one_file_are_those_of_metadata_without_its_pairs(spark, monkeypatch):
    """The relation of all files needs no pairs; one file's partners need the commits that touch it only."""
    rows = [(str(i), f, f"w{i % 3}", i % 50, i % 11 == 0, ("Fix crash", "Add parser", "x")[i % 3], i % 7, 1) for i in range(200) for f in (f"f{i % 4}", f"g{i % 3}", "h")]
    given = commits(spark, rows)
    whole = {r.file_path: r.asDict(True) for r in history.metadata(given, NOW).collect()}
    for path in whole:
        got = [r.co_change_partners for r in history.partners_of(given, NOW, path).collect()]
        assert [[p.asDict() for p in x] for x in got] == ([whole[path]["co_change_partners"]] if whole[path]["co_change_partners"] else [])
    counts, bus, owner = ({r.file_path: r.asDict(True) for r in df.collect()} for df in (history.counts(given, NOW), history.bus_factor(given), history.primary_owner(given)))
    monkeypatch.setattr(history, "co_changes", lambda *a: pytest.fail("pairs were made"))
    for r in history.facts(given, NOW).collect():
        path, row = r.file_path, r.asDict(True)
        assert all(row[k] == (pytest.approx(v) if isinstance(v, float) else v) for k, v in (counts[path] | bus[path] | owner[path]).items())
        assert row["commit_categories"] == whole[path]["commit_categories"] and row["primary_email"] == whole[path]["primary_email"]


@pytest.mark.parametrize("stemmed", [True, False])
def test_a_query_makes_no_postings_of_other_terms(spark, monkeypatch, stemmed):
    """Ranks of a query without an index are those of all postings; repeated and empty documents, and words of one stem, count. Only hits are aggregated."""
    from quarrygraph.operators import search

    rows = [("a", "large rings ring"), ("a", "other words"), ("b", "Large, larger ring"), ("c", ""), ("d", None), ("e", "ring"), ("f", "LARGE ringing rings rings")] + [(f"x{i}", f"word{i} text") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc string, text string")
    terms = search.query_terms("large rings", stemmed)
    want = {r.doc: round(r["rank"], 9) for r in search.rank(search.postings(docs, "doc", ("text",), stemmed), docs, "doc", terms).collect()}
    sizes = []
    monkeypatch.setattr(search, "pinned", lambda df, f=search.pinned: (out := f(df), sizes.append(out.count()))[0])
    got = {r.doc: round(r["rank"], 9) for r in search.ranked(docs, "doc", ("text",), terms, stemmed).collect()}
    assert got == want and want and max(sizes) < 10
    assert search.ranked(docs, "doc", ("text",), [], stemmed).count() == 0 and search.ranked(docs.limit(0), "doc", ("text",), terms, stemmed).count() == 0
