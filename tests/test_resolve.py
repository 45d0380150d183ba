from quarrygraph.operators import resolve


def frame(spark, rows):
    return spark.createDataFrame(rows, "path string, language string, module_path string, imported_names array<string>")


def test_rules(spark):
    files = spark.createDataFrame([(p,) for p in ("pkg/__init__.py", "pkg/a.py", "pkg/sub/b.py", "pkg/sub/__init__.py", "other/a.py", "src/x.ts", "src/u/index.tsx", "src/y.js", "lib/q.ts", "web/app/ui/k.ts", "go/srv/server.go", "c/inc/h.h", "c/m.c", "Foo.java", "z/foo.java")], "path string")
    n: list[str] = []
    imports = frame(spark, [
        ("pkg/sub/b.py", "python", "..a", ["f"]), ("pkg/sub/b.py", "python", ".", ["x"]), ("pkg/a.py", "python", ".sub", n), ("pkg/a.py", "python", "pkg.sub.b", n), ("pkg/a.py", "python", "pkg.sub", n), ("pkg/a.py", "python", "nowhere.a", n), ("pkg/a.py", "python", "os", n),
        ("src/x.ts", "typescript", "./u", n), ("src/u/index.tsx", "typescript", "../x", n), ("src/x.ts", "typescript", "./y.js", n), ("src/x.ts", "typescript", "./gone", n), ("src/x.ts", "typescript", "@/q", n), ("web/app/p.ts", "typescript", "#/k", n), ("web/app/p.ts", "typescript", "react", n),
        ("go/main.go", "go", "example.com/srv/server", n), ("c/m.c", "c", "inc/h.h", n), ("c/m.c", "c", "<h.h>", n), ("Main.java", "java", "z/foo", n), ("Main.java", "java", "q.foo", n),
    ])
    aliases = spark.createDataFrame([("", "@/", "lib/"), ("", "@", "wrong/"), ("web", "#/", "web/app/ui/")], "dir string, prefix string, target string")
    got = {(r.path, r.module_path): r.resolved for r in resolve.resolve(imports, files, aliases).collect()}
    assert got == {
        ("pkg/sub/b.py", "..a"): "pkg/a.py", ("pkg/sub/b.py", "."): None, ("pkg/a.py", ".sub"): "pkg/sub/__init__.py", ("pkg/a.py", "pkg.sub.b"): "pkg/sub/b.py", ("pkg/a.py", "pkg.sub"): "pkg/sub/__init__.py", ("pkg/a.py", "nowhere.a"): "pkg/a.py", ("pkg/a.py", "os"): None,
        ("src/x.ts", "./u"): "src/u/index.tsx", ("src/u/index.tsx", "../x"): "src/x.ts", ("src/x.ts", "./y.js"): "src/y.js", ("src/x.ts", "./gone"): None, ("src/x.ts", "@/q"): "lib/q.ts", ("web/app/p.ts", "#/k"): "web/app/ui/k.ts", ("web/app/p.ts", "react"): "external:react",
        ("go/main.go", "example.com/srv/server"): "go/srv/server.go", ("c/m.c", "inc/h.h"): "c/inc/h.h", ("c/m.c", "<h.h>"): "c/inc/h.h", ("Main.java", "z/foo"): "Foo.java", ("Main.java", "q.foo"): "lib/q.ts",
    }


def test_stem_tie_takes_most_shared_parts_then_least_path(spark):
    files = spark.createDataFrame([("b/util.py",), ("a/util.py",), ("c/d/util.py",)], "path string")
    imports = frame(spark, [("x/m.py", "python", "util", []), ("c/d/m.py", "python", "p.util", [])])
    assert {r.path: r.resolved for r in resolve.resolve(imports, files).collect()} == {"x/m.py": "a/util.py", "c/d/m.py": "c/d/util.py"}


def test_edges_merge_and_tested_by(spark):
    r = spark.createDataFrame([("a", "m", ["x"], "b"), ("a", "m2", ["y", "x"], "b"), ("a", "m", [], "a"), ("t", "m", ["z"], "b"), ("t", "m", None, "external:q"), ("b", "m", [], None), ("t2", "m", [], "a"), ("a", "k", [], "t2")], "path string, module_path string, imported_names array<string>, resolved string")
    e = resolve.edges(r)
    assert {(x.source, x.target, tuple(x.imported_names)) for x in e.collect()} == {("a", "b", ("x", "y")), ("t", "b", ("z",)), ("t", "external:q", ()), ("t2", "a", ()), ("a", "t2", ())}
    nodes = spark.createDataFrame([("a", False), ("b", False), ("t", True), ("t2", True)], "path string, is_test boolean")
    back = {(x.source, x.target) for x in resolve.with_tested_by(e, nodes).collect() if x.edge_type == "TESTED_BY"}
    assert back == {("b", "t")}  # a -> t2 stands there already


def test_empty(spark):
    files = spark.createDataFrame([], "path string")
    assert resolve.resolve(frame(spark, []), files, spark.createDataFrame([], "dir string, prefix string, target string")).count() == 0
