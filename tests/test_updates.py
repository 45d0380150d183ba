"""An update of an index against a full build of the same tree, the store's buckets, migration, and the sources in tasks."""

import json
import math
import os
import subprocess
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarrygraph.operators import search
from quarrygraph.plans import index
from quarrygraph.schemas import DDL, schema
from quarrygraph.sources import files, history, tree
from quarrygraph.sources.store import Store, bucket_of

AS_OF = datetime(2026, 6, 1)
TABLES = [t for t in DDL if t not in ("meta", "refactor_previews")]


def git(root, *args, author="Ann", when="2026-05-01T00:00:00"):
    env = os.environ | {"GIT_AUTHOR_DATE": when, "GIT_COMMITTER_DATE": when}
    subprocess.run(["git", "-C", str(root), "-c", f"user.name={author}", "-c", f"user.email={author}@example.com", *args], check=True, capture_output=True, env=env)


def plain(x):
    if isinstance(x, float):
        return float(f"{x:.4g}")
    if isinstance(x, dict):
        return sorted(x.items())
    return [plain(y) for y in x] if isinstance(x, list | tuple) else x


def content(store):
    """Every table as a bag of rows, times of indexing left out; ranks to four digits, as an update starts from the stored ones."""
    out = {}
    for t in TABLES:
        rows = store.read(t).drop("indexed_file_at").collect()
        out[t] = Counter(json.dumps(plain(list(r)), default=str) for r in rows)
    return out


@pytest.fixture
def repository(tmp_path):
    root = tmp_path / "repo"
    tree_ = {
        "pkg/__init__.py": "", "pkg/main.py": "from pkg.utils import helper\nfrom . import auth\n\ndef main():\n    helper()\n", "pkg/utils.py": "from pkg.auth import login\n\ndef helper():\n    return 1\n", "pkg/auth.py": "import os\n\ndef login(password):\n    return password\n",
        "tests/test_utils.py": "from pkg.utils import helper\n\ndef test_helper():\n    assert helper()\n", "src/index.ts": 'import { x } from "./utils";\nimport React from "react";\nimport { z } from "@lib/z";\n', "src/utils.ts": "export function x(): number {\n  return 1;\n}\n",
        "src/lib/z.ts": "export const z = 1;\n", "tsconfig.json": '{"compilerOptions": {"paths": {"@lib/*": ["src/lib/*"]}}}', "pkg/orphan.py": "def lost():\n    pass\n", ".gitignore": "*.log\n", "other/deep/a.py": "import pkg.main\n", "other/deep/b.py": "from other.deep import a\n",
    }
    for path, text in tree_.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    git(root, "init", "-q")
    git(root, "add", ".")
    git(root, "commit", "-qm", "Add everything")
    return root


def write(root, path, text, mode="w"):
    (root / path).parent.mkdir(parents=True, exist_ok=True)
    with open(root / path, mode) as f:
        f.write(text)


def steps(root):
    """Changes one after another; each name says what it moves."""
    yield "a body", lambda: write(root, "pkg/orphan.py", "def found():\n    pass\n\nclass Kept:\n    pass\n")
    yield "an edge", lambda: write(root, "pkg/orphan.py", "from pkg.auth import login\n\ndef found():\n    pass\n")
    yield "names of an edge", lambda: write(root, "pkg/orphan.py", "from pkg.auth import login, other\n\ndef found():\n    pass\n")
    yield "a new file that an import meant", lambda: (write(root, "pkg/late.py", "from pkg.utils import helper\n"), write(root, "other/deep/a.py", "import pkg.main\nimport pkg.late\n"))
    yield "a deleted file", lambda: os.remove(root / "src/lib/z.ts")
    yield "a commit", lambda: (git(root, "add", "."), git(root, "commit", "-qm", "Fix late things", author="Bob", when="2026-05-20T00:00:00"))
    yield "an alias", lambda: (write(root, "lib2/z.ts", "export const z = 2;\n"), write(root, "tsconfig.json", '{"compilerOptions": {"paths": {"@lib/*": ["lib2/*"]}}}'))
    yield "a rename and a merge", lambda: (git(root, "mv", "pkg/late.py", "pkg/later.py"), git(root, "checkout", "-qb", "side"), git(root, "commit", "-qam", "Move late", when="2026-05-21T00:00:00"), git(root, "checkout", "-q", "-"), write(root, "src/utils.ts", "export function y() {\n}\n"), git(root, "commit", "-qam", "Refactor utils", when="2026-05-22T00:00:00"), git(root, "merge", "-q", "--no-edit", "side", when="2026-05-23T00:00:00"))
    yield "history written anew", lambda: git(root, "commit", "-q", "--amend", "-m", "Another subject", when="2026-05-24T00:00:00")


@pytest.mark.parametrize(("bucket_files", "done", "compared"), [(20_000, range(9), (0, 2, 4, 8)), (4, (1, 3, 4, 5), (5,))])
def test_updates_equal_full_builds(spark, repository, tmp_path, monkeypatch, bucket_files, done, compared):
    monkeypatch.setattr(index, "BUCKET_FILES", bucket_files)
    log = lambda: history.GitLog(spark, str(repository))
    store = Store(spark, str(tmp_path / "store"))
    index.build(spark, str(repository), store, log=log(), as_of=AS_OF)
    assert (store.manifest("symbols")["buckets"] > 1) == (bucket_files == 4)
    for k, (what, change) in enumerate(steps(repository)):
        if k not in done:
            continue
        change()
        meta = index.build(spark, str(repository), store, log=log(), as_of=AS_OF)
        if k not in compared:
            continue
        fresh = Store(spark, str(tmp_path / f"fresh{k}"))
        whole = index.build(spark, str(repository), fresh, log=log(), as_of=AS_OF, full=True)
        a, b = content(store), content(fresh)
        for t in TABLES:
            assert a[t] == b[t], (what, t, list((a[t] - b[t]).elements())[:3], list((b[t] - a[t]).elements())[:3])
        counted = [c for c in whole if c.endswith("_count") or c.startswith("search_")]
        assert len(counted) == 8 and all(meta[c] == whole[c] for c in counted), what
        found = lambda s: [tuple(r) for r in search.search(s.read("symbols"), "helper", store=s).collect()]
        assert found(store) == found(fresh) == [tuple(r) for r in search.search(store.read("symbols"), "helper").collect()]


def test_what_no_change_reaches_is_not_written(spark, repository, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "BUCKET_FILES", 1)
    log = history.GitLog(spark, str(repository))
    store = Store(spark, str(tmp_path / "store"))
    for folder, _, names in os.walk(repository):
        for n in names:
            os.utime(os.path.join(folder, n), (1_700_000_000, 1_700_000_000))
    first = index.build(spark, str(repository), store, log=log, as_of=AS_OF)
    before = {t: store.manifest(t) for t in TABLES}
    assert index.build(spark, str(repository), store, log=log, as_of=AS_OF) == first
    write(repository, "pkg/orphan.py", "def found():\n    pass\n")
    seen = []
    monkeypatch.setattr(index.parser, "parse", lambda df, f=index.parser.parse: seen.extend(r.path for r in df.select("path").collect()) or f(df))
    meta = index.build(spark, str(repository), store, log=log, as_of=AS_OF)
    assert seen == ["pkg/orphan.py"] and meta["last_change"] == "modified=1" and meta["indexed_at"] != first["indexed_at"]
    now = {t: store.manifest(t) for t in TABLES}
    for t in ("edges", "git_metadata", "commits", "communities", "community_members", "flows", "flow_members", "dead_code"):
        assert now[t] == before[t], t
    for t in ("files", "symbols", "nodes"):
        same = [b for b in before[t]["parts"] if now[t]["parts"].get(b) == before[t]["parts"][b]]
        assert len(same) >= len(before[t]["parts"]) - 1 >= 3, t
    old = store.manifest("git_metadata")
    index.build(spark, str(repository), store, log=log, as_of=AS_OF + timedelta(days=2))  # nothing has changed: nor is anything done
    assert store.manifest("git_metadata") == old
    write(repository, "pkg/orphan.py", "def again():\n    pass\n")
    index.build(spark, str(repository), store, log=log, as_of=AS_OF + timedelta(days=2))
    assert store.manifest("git_metadata") != old  # the day has changed


def test_same_size_and_time_soon_after_is_read_again(spark, repository, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    index.build(spark, str(repository), store, as_of=AS_OF)
    at = os.stat(repository / "pkg/orphan.py")
    write(repository, "pkg/orphan.py", "def last():\n    pass\n")
    os.utime(repository / "pkg/orphan.py", ns=(at.st_atime_ns, at.st_mtime_ns))
    assert os.stat(repository / "pkg/orphan.py").st_size == at.st_size
    index.build(spark, str(repository), store, as_of=AS_OF)
    assert {r.name for r in store.read("symbols", path="pkg/orphan.py").collect()} == {"last"}


def test_buckets_are_pruned_and_replaced(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=5)
    rows = [(f"n{i}", f"d{i % 3}", i, 9, f"p{i % 4}") for i in range(60)] + [(None, "d", 1, 1, "p0")]
    store.write("postings", spark.createDataFrame(rows, schema("postings")))
    assert {tuple(r) for r in store.read("postings").collect()} == set(rows)
    one = store.read("postings", term="n7")
    assert [tuple(r) for r in one.collect()] == [rows[7]] and len({f.split("bucket=")[1][0] for f in one.inputFiles()}) == 1
    some = store.read_keys("postings", ["n1", "n2"])
    assert {r.term for r in some.collect()} == {"n1", "n2"} and len({f.split("bucket=")[1][0] for f in some.inputFiles()}) <= 2
    assert "n1" in some._jdf.queryExecution().executedPlan().toString() and "PushedFilters: [In(term" in some._jdf.queryExecution().executedPlan().toString()
    gone = spark.createDataFrame([("n7", "p3")], "term string, path string")
    store.replace("postings", gone, spark.createDataFrame([("n7", "new", 1, 1, "q")], schema("postings")))
    want = (set(rows) - {rows[7]}) | {("n7", "new", 1, 1, "q")}
    assert {tuple(r) for r in store.read("postings").collect()} == want
    expected = spark.createDataFrame(sorted(want, key=str), schema("postings")).groupBy(bucket_of(F.col("term"), 5).alias("b")).count().collect()
    assert {str(r.b) for r in expected} == set(store.manifest("postings")["parts"])
    store.replace("postings", spark.createDataFrame([(r[0],) for r in want if r[0]], "term string"), spark.createDataFrame([], schema("postings")))
    assert [r.term for r in store.read("postings").collect()] == [None]
    store.append("commits", spark.createDataFrame([("a", "f", "x", "e", AS_OF, False, "s", 1, 2)], schema("commits")))
    store.append("commits", spark.createDataFrame([("b", "f", "x", "e", AS_OF, False, "s", 1, 2)], schema("commits")))
    assert {r.sha for r in store.read("commits").collect()} == {"a", "b"}
    folders = [d for d in os.listdir(tmp_path / "s" / "postings") if d.startswith("v-")]
    assert len(folders) <= len({f.split("/")[0] for f in store.manifest("postings")["parts"].values()}) + 3


def test_a_store_of_version_1_opens_and_migrates(spark, tmp_path):
    """Pointers were plain text, flow members were called node_qualified_name, postings had no lengths; nodes had no community."""
    old = {
        "flow_members": spark.createDataFrame([("f", "a.py", 0), ("f", "b.py", 1)], "flow_id string, node_qualified_name string, depth int"),
        "community_members": spark.createDataFrame([("a.py", 3)], "file_path string, community_id int"),
        "nodes": spark.createDataFrame([("a.py", "python", 3, "h")], "path string, language string, symbol_count long, content_hash string"),
        "postings": spark.createDataFrame([("t", "a.py::f#1", 2)], "term string, doc string, tf long"),
        "meta": spark.createDataFrame([("schema_version", "1"), ("repo_name", "r")], "key string, value string"),
    }
    for name, df in old.items():
        df.write.parquet(f"{tmp_path}/s/{name}/v-old")
        (tmp_path / "s" / name / "CURRENT").write_text("v-old")
    store = Store(spark, str(tmp_path / "s"))
    opened = {n: sorted(map(str, store.read(n).collect())) for n in old}
    assert [(r.flow_id, r.path, r.depth, r.ord) for r in store.read("flow_members").orderBy("path").collect()] == [("f", "a.py", 0, None), ("f", "b.py", 1, None)]
    assert store.read("community_members", path="a.py").first().community_id == 3 and store.hashes().first().content_hash == "h"
    assert set(store.migrate()) == set(old) and store.migrate() == []
    assert {n: sorted(map(str, store.read(n).collect())) for n in old} == opened
    assert all(store.read(n).schema == schema(n) for n in old) and store.meta()["repo_name"] == "r"


def test_a_build_over_an_old_store_equals_a_fresh_one(spark, repository, tmp_path):
    store, fresh = Store(spark, str(tmp_path / "old")), Store(spark, str(tmp_path / "fresh"))
    index.build(spark, str(repository), fresh, as_of=AS_OF)
    for name in ("nodes", "edges", "symbols"):
        fresh.read(name).write.parquet(f"{store.path}/{name}/v-old")
        (tmp_path / "old" / name / "CURRENT").write_text("v-old")
    index.build(spark, str(repository), store, as_of=AS_OF)
    assert content(store) == content(fresh)


@pytest.fixture(scope="module")
def planted(tmp_path_factory):
    """100,000 files: a flat folder, a deep chain, many small folders, and blocked ones."""
    root = tmp_path_factory.mktemp("tree")
    wanted = {}

    def put(path, text="x"):
        with open(root / path, "w") as f:
            f.write(text)
        wanted[path] = len(text)

    (root / "flat").mkdir()
    for i in range(60_000):
        put(f"flat/f{i}.py")
    for a in range(200):
        (root / f"many/{a}/sub").mkdir(parents=True)
        for i in range(190):
            put(f"many/{a}/sub/g{i}.py", "yy")
    deep = "deep"
    (root / deep).mkdir()
    for i in range(60):
        deep += f"/d{i}"
        (root / deep).mkdir()
        for j in range(33):
            put(f"{deep}/h{j}.py", "zzz")
    put("_hidden.py")
    put(".dot.py")
    (root / "many/1/node_modules").mkdir()
    (root / "many/1/node_modules/no.py").write_text("n")
    return root, wanted


def test_tree_is_listed_by_tasks(spark, planted):
    root, wanted = planted
    found = tree.files(spark, str(root))
    got = {r.path: r.length for r in found.select("path", "length").collect()}
    assert got == wanted and len(got) > 99_000
    reader = tree.TreeReader(str(root), 4)
    parts = reader.partitions()
    assert len(parts) > 4 and sum(len(p.files) for p in parts) < 70_000
    opened = []
    reader._open = lambda fs, base, folder: opened.append(folder) or tree.TreeReader._open(reader, fs, base, folder)
    reader.partitions()
    assert len(opened) <= tree.SEED_FOLDERS


def test_filters_reach_the_tree(spark, planted):
    root, wanted = planted
    found = tree.files(spark, str(root)).filter(F.col("path").startswith("many/7") & (F.col("length") <= 2))
    assert {r.path for r in found.collect()} == {p for p, n in wanted.items() if p.startswith("many/7") and n <= 2}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "StartsWith" not in plan and "<= 2" not in plan  # the source has taken both over
    one = tree.files(spark, str(root)).filter(F.col("path") == "flat/f7.py")
    assert [r.path for r in one.collect()] == ["flat/f7.py"] and tree.files(spark, str(root)).filter("path = 'no'").count() == 0
    reader = tree.TreeReader(str(root), 4)
    assert list(reader.pushFilters([tree.StringStartsWith(("path",), "many/7")])) == []
    assert {p.split("/")[-1][0] for x in reader.partitions() for p in x.folders} <= set("7s")


def test_log_is_read_in_ranges(spark, tmp_path, monkeypatch):
    root = tmp_path / "r"
    root.mkdir()
    git(root, "init", "-q")
    for i in range(23):
        write(root, f"f{i % 5}.py", f"x = {i}\n", "a")
        git(root, "add", ".")
        git(root, "commit", "-qm", f"Add {i}\n\nbody", when=f"2026-01-{i + 1:02}T00:00:00")
    monkeypatch.setattr(tree, "TASK_COMMITS", 5)
    log = history.GitLog(spark, str(root))
    shas = subprocess.run(["git", "-C", str(root), "rev-list", "HEAD"], capture_output=True, text=True, check=True).stdout.split()
    reader = tree.LogReader(str(root), log.head, None)
    assert [(p.skip, p.count) for p in reader.partitions()] == [(0, 5), (5, 5), (10, 5), (15, 5), (20, 5)]
    texts = [v for p in reader.partitions() for b in reader.read(p) for v in b.column(0).to_pylist()]
    assert [t[:40] for t in texts] == shas
    got = log.commits().collect()
    assert len(got) == 23 and {r.sha for r in got} == set(shas) and {r.added for r in got} == {1} and not any(r.is_merge for r in got)
    since = log.commits(since=shas[3]).collect()
    assert {r.sha for r in since} == set(shas[:3]) and log.reaches(shas[9]) and not log.reaches("0" * 40)
    late = log._read(head=log.head).filter(F.col("ts") >= datetime(2026, 1, 20))
    assert late.count() == 4
    assert {r.path for r in log.tracked().collect()} == {f"f{i}.py" for i in range(5)}


def test_git_errors_are_raised(spark, tmp_path):
    with pytest.raises(Exception, match="not a git repository|non-zero exit status"):
        spark.read.format("repository_log").option("path", str(tmp_path)).option("tracked", "true").load().collect()
    log = history.GitLog(spark, str(tmp_path))
    assert log.head == ""
    with pytest.raises(Exception, match="non-zero exit status|not a git repository"):
        log.tracked().collect()


def test_empty_repository(spark, tmp_path):
    root = tmp_path / "r"
    root.mkdir()
    git(root, "init", "-q")
    store = Store(spark, str(tmp_path / "s"))
    meta = index.build(spark, str(root), store, log=history.GitLog(spark, str(root)), as_of=AS_OF)
    assert meta["file_count"] == "0" and store.read("commits").count() == 0
    write(root, "a.py", "x = 1\n")
    assert index.build(spark, str(root), store, log=history.GitLog(spark, str(root)), as_of=AS_OF)["file_count"] == "1"
    assert not math.isnan(store.read("nodes").first().pagerank) and files.tree(spark, str(root)).count() == 1
