from quarrygraph.sources import parser
from quarrygraph.sources.parser import parse_source


def by_name(p):
    return {s.name: s for s in p.symbols}


def test_python():
    p = parse_source("python", '"""Doc."""\nimport os, sys\nfrom a.b import c as d, e\nfrom . import z\nfrom q import *\nclass A(B):\n    """In A"""\n    @property\n    def x(self) -> int:\n        return 1\nasync def _f(a, b=2):\n    pass\n')
    s = by_name(p)
    assert p.docstring == "Doc." and s["A"].kind == "class" and s["A"].docstring == "In A" and s["x"].kind == "method" and s["x"].parent_name == "A" and s["x"].decorators == ["@property"]
    assert s["_f"].is_async and s["_f"].visibility == "private" and s["_f"].signature == "async def _f(a, b=2)" and s["x"].signature == "def x(self) -> int"
    assert [(i.module_path, i.imported_names, i.is_relative) for i in p.imports] == [("os", ["os", "sys"], False), ("a.b", ["b", "c", "e"], False), (".", ["z"], True), ("q", ["*"], False)]


def test_broken_python_still_has_symbols():
    p = parse_source("python", "def ok():\n    return 1\n\nclass C:\n    def m(self):\n        pass\n\ndef bad(:\n")
    assert p.errors and {"ok", "C", "m"} <= set(by_name(p)) and by_name(p)["m"].parent_name == "C"


def test_script():
    p = parse_source("typescript", '/** Top */\nimport R, { a as b } from "react";\nimport * as p from "./p";\nexport { y } from "../y";\n/** Adds. */\nexport function add(x: number): number {\n  return x;\n}\nexport interface I { a: string }\nclass K {\n  private m(): void {\n    if (x) { y(); }\n  }\n}\nexport const f = async (a: string) => {\n  return a;\n};\n')
    s = by_name(p)
    assert p.docstring == "Top" and s["add"].docstring == "Adds." and (s["add"].start_line, s["add"].end_line) == (6, 8) and s["I"].kind == "interface" and s["m"].visibility == "private" and s["m"].parent_name == "K" and s["f"].kind == "function"
    assert [(i.module_path, i.imported_names, i.is_relative) for i in p.imports] == [("react", ["R", "a"], False), ("./p", ["*"], True), ("../y", [], True)]
    q = parse_source("javascript", "const x = require('lodash');\n// require('no')\nimport('./lazy');\nfunction g() {}\n")
    assert [i.module_path for i in q.imports] == ["lodash", "./lazy"] and by_name(q)["g"].kind == "function"


def test_other_languages():
    go = parse_source("go", 'package x\nimport (\n\t"fmt"\n)\n// Does it\nfunc Do(a int) error {\n\treturn nil\n}\nfunc (s *Server) run() {}\ntype Server struct {\n a int\n}\ntype I interface { X() }\n')
    s = by_name(go)
    assert s["Do"].visibility == "public" and s["Do"].docstring == "Does it" and s["run"].parent_name == "Server" and s["Server"].kind == "struct" and s["I"].kind == "interface" and go.imports[0].module_path == "fmt"
    rust = by_name(parse_source("rust", "pub fn a() {}\nstruct S;\nimpl S {\n  fn m(&self) {}\n}\npub trait T {}\n"))
    assert rust["a"].visibility == "public" and rust["m"].kind == "method" and rust["T"].kind == "trait"
    java = by_name(parse_source("java", "import java.util.List;\npublic class A {\n  private int f(int x) { return x; }\n  public A() {}\n}\ninterface B {}\n"))
    assert java["f"].visibility == "private" and java["f"].parent_name == "A" and java["B"].kind == "interface"
    cpp = parse_source("cpp", '#include <vector>\n#include "a/b.h"\nclass C {\n  int g(int a) const { return a; }\n};\nint main() { return 0; }\n')
    assert by_name(cpp)["g"].kind == "method" and by_name(cpp)["main"].kind == "function" and [i.module_path for i in cpp.imports] == ["<vector>", "a/b.h"]
    ruby = by_name(parse_source("ruby", "module M\n  class A\n    def go(x)\n      if x\n        1\n      end\n    end\n  end\nend\n"))
    assert ruby["go"].parent_name == "A" and ruby["go"].end_line == 7 and ruby["M"].end_line == 9
    assert by_name(parse_source("kotlin", "class A {\n  private fun f(a: Int) = a\n}\ninterface I\n"))["f"].visibility == "private"
    assert by_name(parse_source("c", "static int add(int a) {\n  return a;\n}\nstruct P { int x; };\n"))["add"].end_line == 3


def test_nothing_to_parse():
    for text in ("", None, "\n\n"):
        for language in (*parser.LANGUAGES, "yaml", None):
            p = parse_source(language, text)
            assert not p.symbols and not p.imports


def test_operator(spark):
    rows = [
        ("a/m.py", "python", "h", "import x.y\nclass A:\n    def f(self): pass\ndef _g(): pass\n"), ("n.ipynb", "python", "h", '{"cells": [{"cell_type": "code", "source": ["def nb(): pass"]}]}'), ("bad.ipynb", "python", "h", "nope"),
        ("c.vue", "vue", "h", '<template/>\n<script lang="ts">\nimport a from "./a"\nexport function v() {}\n</script>'), ("x.yml", "yaml", "h", "a: 1"), ("null.py", "python", "h", None),
    ]
    got = parser.parse(spark.createDataFrame(rows, "path string, language string, content_hash string, text string"))
    r = {x.path: x for x in got.collect()}
    assert r["a/m.py"].exports == ["A"] and [s.name for s in r["n.ipynb"].symbols] == ["nb"] and r["bad.ipynb"].errors == ["Invalid notebook JSON"] and r["x.yml"].symbols == [] and r["null.py"].symbols == []
    assert r["c.vue"].symbols[0].start_line == 4
    s = {x.id: x for x in parser.symbols(got).collect()}
    assert s["a/m.py::A::f"].qualified_name == "a.m.A.f" and s["a/m.py::A"].qualified_name == "a.m.A"
    assert {(x.path, x.language, x.module_path) for x in parser.imports(got).collect()} == {("a/m.py", "python", "x.y"), ("c.vue", "typescript", "./a")}
