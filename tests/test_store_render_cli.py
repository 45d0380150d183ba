import json
import os
import subprocess
from datetime import datetime

import pytest

from quarrygraph import cli, render
from quarrygraph.plans import index
from quarrygraph.schemas import DDL, schema
from quarrygraph.sources import history
from quarrygraph.sources.store import Store


def test_round_trip(spark, tmp_path):
    s = Store(spark, str(tmp_path / "w"))
    assert not s.exists("meta") and s.read("meta").count() == 0
    s.put_meta(a=1, b="x")
    s.put_meta(a=2)
    assert s.meta() == {"a": "2", "b": "x"} and s.read("meta", key="b").count() == 1 and s.size_bytes() > 0
    edges = spark.createDataFrame([("a", "b", ["x"], "IMPORTS_FROM")], schema("edges"))
    s.write("edges", edges)
    s.write("edges", s.read("edges").unionByName(edges))
    assert s.read("edges").count() == 2 and len(os.listdir(tmp_path / "w" / "edges")) <= 4
    for name in DDL:
        s.write(name, spark.createDataFrame([], schema(name)))
        assert s.read(name).count() == 0


def test_diagrams(spark, sample):
    nodes, edges = sample
    members = nodes.selectExpr("path", "cast(0 as int) AS community_id")
    communities = spark.createDataFrame([(0, "</script><b>", 10, 0.5, [])], schema("communities"))
    data = render.graph_data(nodes, edges, communities, members, "repo <x>", 3)
    assert [n["id"] for n in data["nodes"]] == ["src/main.py", "src/utils.py", "src/auth.py"] and data["nodes"][0]["radius"] == 25.0 and data["nodes"][0]["type"] == "entry" and {(e["source"], e["target"]) for e in data["links"]} == {("src/main.py", "src/utils.py"), ("src/main.py", "src/auth.py")}
    page = render.html_page(data)
    assert page.count("</script>") == 2 and "repo &lt;x&gt;" in page
    text = render.mermaid(nodes, edges, 3)
    assert text.startswith("flowchart LR") and "n0 --> n1" in text and 'n0["src/main.py"]' in text


def test_wiki(spark):
    communities = spark.createDataFrame([(0, "src/a + b", 2, 0.25, ["x.py"]), (1, "!!", 1, 0.0, [])], schema("communities"))
    members = spark.createDataFrame([("x.py", 0), ("a.py", 0), ("z", 1)], schema("community_members"))
    flows = spark.createDataFrame([("abcdefgh", "main.py", 3, 2, 0.5, True)], schema("flows"))
    pages = render.wiki(communities, members, flows, {"repo_name": "R", "file_count": 3})
    assert set(pages) == {"index.md", "community-src-a-b.md", "community-unknown.md", "flows.md"} and "| 0 | [src/a + b](community-src-a-b.md) | 2 | 0.250 |" in pages["index.md"] and "- `a.py`\n- `x.py`" in pages["community-src-a-b.md"] and "| abcdefgh | `main.py` | 3 | 2 | 0.500 | Yes |" in pages["flows.md"]


def test_wiki_keeps_pages_of_one_slug_apart(spark):
    communities = spark.createDataFrame([(0, "a b", 3, 0.5, []), (1, "a-b", 2, 0.5, []), (2, "A B", 1, 0.5, [])], schema("communities"))
    members = spark.createDataFrame([("x", 0), ("y", 1), ("z", 2)], schema("community_members"))
    pages = render.wiki(communities, members, spark.createDataFrame([], schema("flows")), {})
    own = {n: t for n, t in pages.items() if n.startswith("community-")}
    assert set(own) == {"community-a-b.md", "community-a-b-1.md", "community-a-b-2.md"} and all(n in pages["index.md"] for n in own)
    assert "`x`" in own["community-a-b.md"] and "`y`" in own["community-a-b-1.md"] and "`z`" in own["community-a-b-2.md"]


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    tree = {
        "mypackage/__init__.py": "", "mypackage/main.py": "from mypackage.utils import helper\nfrom . import auth\n\ndef main():\n    helper()\n", "mypackage/utils.py": '"""Utils."""\nfrom mypackage.auth import login\n\ndef helper():\n    """Help."""\n    return 1\n\nclass Box:\n    def open_box(self):\n        pass\n',
        "mypackage/auth.py": "import os\nfrom mypackage.utils import helper\n\ndef login(password):\n    return password\n", "tests/__init__.py": "", "tests/test_utils.py": "from mypackage.utils import helper\n\ndef test_helper():\n    assert helper()\n", "src/index.ts": 'import { x } from "./utils";\nimport React from "react";\nexport const y = x;\n',
        "src/utils.ts": "/** Doc */\nexport function x(): number {\n  return 1;\n}\n", "src/legacy.js": 'const l = require("lodash");\n', "pyproject.toml": "[project]\n", ".gitignore": "*.log\n", "mypackage/orphan.py": "def lost():\n    pass\n",
    }
    for path, text in tree.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    git = ["git", "-C", str(root), "-c", "user.name=Ann", "-c", "user.email=ann@example.com"]
    for args in (["init", "-q"], ["add", "."], ["commit", "-qm", "Add everything"]):
        subprocess.run([*git, *args], check=True, capture_output=True)
    return root


def test_index_and_commands(spark, repository, tmp_path, capsys):
    base = ["--repo", str(repository), "--warehouse", str(tmp_path / "w")]

    def run(*args):
        code = cli.main([*base, *args])
        return code, capsys.readouterr().out

    assert cli.main([*base, "status"]) == 1
    capsys.readouterr()
    code, out = run("init", "--json")
    meta = json.loads(out)
    assert code == 0 and meta["file_count"] == "11" and int(meta["edge_count"]) >= 5
    store = Store(spark, str(tmp_path / "w"))
    edges = {(r.source, r.target, r.edge_type) for r in store.read("edges").collect()}
    assert ("mypackage/main.py", "mypackage/utils.py", "IMPORTS_FROM") in edges and ("mypackage/utils.py", "tests/test_utils.py", "TESTED_BY") in edges and ("src/index.ts", "src/utils.ts", "IMPORTS_FROM") in edges and ("src/index.ts", "external:react", "IMPORTS_FROM") in edges and ("src/legacy.js", "external:lodash", "IMPORTS_FROM") in edges
    git = {r.file_path: r for r in store.read("git_metadata").collect()}
    assert git["mypackage/main.py"].primary_owner == "Ann" and git["mypackage/main.py"].commit_categories == {"feature": 1}
    assert abs(sum(r.pagerank for r in store.read("nodes").collect()) - 1) < 1e-3

    rows = lambda *a: [json.loads(x) for x in run(*a, "--json")[1].splitlines()]
    assert {r["file_path"] for r in rows("dead-code")} >= {"mypackage/orphan.py"}
    assert rows("risk", "mypackage/utils.py")[0]["importer_count"] == 3 and run("risk", "no.py")[0] == 1
    assert rows("deps", "mypackage/main.py", "mypackage/auth.py")[0]["hops"] in (1, 2)
    assert [r["members"] for r in rows("cycles")] == [["mypackage/auth.py", "mypackage/utils.py"]]
    assert rows("communities") and rows("communities", "--coupling") is not None and rows("flows") and rows("flow", "main.py")
    assert {r["path"] for r in rows("impact", "mypackage/auth.py") if "path" in r} >= {"mypackage/utils.py", "mypackage/main.py"}
    assert rows("search", "helper")[0]["name"] == "helper"
    assert rows("refactor", "large", "--threshold", "2") and rows("refactor", "moves") is not None and rows("refactor", "rename", "helper", "assist")[0]["edits"]
    assert store.read("refactor_previews").count() == 1
    assert run("diagram", "--format", "mermaid")[1].startswith("flowchart LR") and json.loads(run("diagram", "--json")[1])["nodes"]
    assert run("diagram", "--output", str(tmp_path / "d.html"))[0] == 0 and (tmp_path / "d.html").exists()
    assert len(json.loads(run("wiki", "--output", str(tmp_path / "wiki"), "--json")[1])) >= 2
    assert json.loads(run("status", "--json")[1])["file_count"] == "11"

    # nothing changed: nothing is done; one file changed: it alone is parsed again
    before = store.meta()["indexed_at"]
    run("init")
    assert store.meta()["indexed_at"] == before
    (repository / "mypackage/orphan.py").write_text("import mypackage.utils\ndef found():\n    pass\n")
    run("init")
    assert store.meta()["indexed_at"] != before and store.meta()["last_change"] == "modified=1"
    assert {r.name for r in store.read("symbols", path="mypackage/orphan.py").collect()} == {"found"} and store.read("symbols", path="mypackage/utils.py").count() == 3
    assert history.changed(str(repository)) == ["mypackage/orphan.py"]


def test_build_without_history(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.py").write_text("x = 1\n")
    meta = index.build(spark, str(tmp_path / "r"), Store(spark, str(tmp_path / "w")), as_of=datetime(2024, 1, 1))
    assert meta["file_count"] == "1" and meta["flow_count"] == "0"
