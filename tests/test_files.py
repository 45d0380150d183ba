import json

from pyspark.sql import functions as F

from quarrygraph.sources import documents, files, history, projects


def test_scan_of_a_tree(spark, tmp_path):
    tree = {
        "pkg/__init__.py": b"", "pkg/main.py": b"import pkg.utils\n", "tests/test_utils.py": b"x", "a/tests/helpers.py": b"x", "tests/helpers.py": b"x", "src/index.ts": b"export {}", "Makefile": b"all:", ".gitignore": b"ignored/\n*.log\n!ignored/keep.py\n",
        "ignored/keep.py": b"x", "x.log": b"x", "data/big.py": b"#" * 600_000, "binary": b"\x00\x01", "tool": b"#!/usr/bin/env python\nx", "run": b"#!/bin/sh\n", "shell": b"#!/bin/bash\n", "note": b"no", "a_pb2.py": b"x", "g.py": b"# @generated\n", "g.json": b'{"x": "DO NOT EDIT"}',
        "node_modules/m.js": b"x", "x.min.js": b"x", "y.lock": b"x", "Z.PY": b"x", "lib.so": b"x",
    }
    for path, content in tree.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(content)
    got = {r.path: r for r in files.scan(spark, str(tmp_path)).collect()}
    assert set(got) == {"pkg/__init__.py", "pkg/main.py", "tests/test_utils.py", "a/tests/helpers.py", "tests/helpers.py", "src/index.ts", "Makefile", "tool", "shell", "g.json", "Z.PY"}
    assert got["pkg/main.py"].is_entry_point and got["src/index.ts"].is_entry_point and not got["Z.PY"].is_entry_point
    assert got["tests/test_utils.py"].is_test and got["a/tests/helpers.py"].is_test and not got["tests/helpers.py"].is_test
    assert got["tool"].language == "python" and got["shell"].language == "shell" and got["Makefile"].is_config and got["g.json"].is_config
    assert got["pkg/main.py"].abs_path == str(tmp_path / "pkg/main.py") and got["Z.PY"].language == "python"
    assert {r.path for r in files.scan(spark, str(tmp_path), ["pkg/"]).collect()} == set(got) - {"pkg/__init__.py", "pkg/main.py"}


def test_empty_raw(spark):
    assert files.classify(spark.createDataFrame([], "path string, content binary")).count() == 0


def test_notebook(spark):
    nb = {"metadata": {"kernelspec": {"language": "Python"}}, "cells": [{"cell_type": "markdown", "source": ["# t"]}, {"cell_type": "code", "source": ["a = 1\n", "b = 2"]}, {"cell_type": "code", "source": "c = [3]"}]}
    rows = [(json.dumps(nb),), ("{}",), ("not json",), ("[1]",), (None,)]
    got = [r.nb for r in spark.createDataFrame(rows, "t string").select(documents.notebook(F.col("t")).alias("nb")).collect()]
    assert got[0].code == "a = 1\nb = 2\nc = [3]" and got[0].language == "python" and got[0].error is None
    assert got[1].code == "" and got[1].language == "python"
    assert got[2].error == "Invalid notebook JSON" and got[3].error == "Invalid notebook JSON"


def test_scripts(spark):
    text = '<template>\n<p/></template>\n<script setup lang="ts">\nconst a = 1\n</script>\n<script>\nb\n</script>'
    got = spark.createDataFrame([(text,), ("<p>",)], "t string").select(documents.scripts(F.col("t")).alias("s")).collect()
    assert [(s.content, s.lang, s.line_offset, s.is_setup) for s in got[0].s] == [("\nconst a = 1\n", "ts", 2, True), ("\nb\n", "js", 5, False)]
    assert got[1].s == []


def test_log(spark):
    record = "\x1f".join(["abc", "Ann", "a@x", "1700000000", "p1 p2", "Fix it"]) + "\n\n3\t1\tsrc/{old => new}/a.py\n-\t-\timg.png\n2\t0\ta.py => b.py\n"
    rows = history.parse_log(spark.createDataFrame([("",), (record,)], "value string")).orderBy("file_path").collect()
    assert [(r.file_path, r.added, r.deleted, r.is_merge, r.author) for r in rows] == [("b.py", 2, 0, True, "Ann"), ("img.png", 0, 0, True, "Ann"), ("src/new/a.py", 3, 1, True, "Ann")]
    moved = spark.createDataFrame([("src/{ => sub}/g.py",), ("src/{a => }/g.py",), ("plain.py",)], "p string").select(history.new_path(F.col("p")).alias("n"), history.old_path(F.col("p")).alias("o")).collect()
    assert [tuple(r) for r in moved] == [("src/sub/g.py", "src/g.py"), ("src/g.py", "src/a/g.py"), ("plain.py", "plain.py")]


def test_aliases(spark):
    raw = [
        ("tsconfig.json", b'{// c\n "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["./src/*", "x"], "~": ["lib"],}}}'), ("web/tsconfig.json", b'{"extends": "./base", "compilerOptions": {"strict": true}}'),
        ("web/base.json", b'{"compilerOptions": {"baseUrl": "./app", "paths": {"#/*": ["ui/*"]}}}'), ("web/jsconfig.json", b'{"compilerOptions": {"paths": {"no/*": ["no/*"]}}}'), ("node_modules/m/tsconfig.json", b'{"compilerOptions": {"paths": {"z": ["z"]}}}'),
    ]
    got = {tuple(r) for r in projects.aliases(spark, spark.createDataFrame(raw, "path string, content binary")).collect()}
    assert got == {("", "@/", "src/"), ("", "~", "lib/"), ("web", "#/", "web/app/ui/")}


def test_frameworks(spark):
    assert projects.framework_of('{"dependencies": {"react": "1", "next": "14"}}', "")["framework"] == "nextjs"
    assert projects.framework_of('{"devDependencies": {"vite": "1"}}', "")["framework"] == "vite"
    assert projects.framework_of("", 'deps = ["FastAPI"]')["framework"] == "fastapi"
    assert projects.framework_of("{bad", "")["framework"] is None
    df = spark.createDataFrame([("src/main.ts", False), ("src/x.ts", False)], "path string, is_entry_point boolean")
    assert {r.path: r.is_entry_point for r in projects.mark_entries(df, ["src/main.*"]).collect()} == {"src/main.ts": True, "src/x.ts": False}
