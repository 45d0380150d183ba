import re

import pytest
from pyspark.sql import functions as F

from quarrygraph.functions import globs, paths
from quarrygraph.functions.stem import stem


@pytest.mark.parametrize(
    ("pattern", "path", "expected"),
    [
        ("*__init__.py", "a/b/__init__.py", True), ("*migrations*", "a/migrations/x.py", False), ("*migrations*", "a/migrations.py", True), ("**/app/**/page.tsx", "x/app/y/page.tsx", True),
        ("**/app/**/page.tsx", "app/page.tsx", False), ("scripts/*", "x/scripts/y.py", True), ("scripts/*", "scripts/a/y.py", False), ("*.d.ts", "a/b.d.ts", True), ("middleware.ts", "src/middleware.ts", True),
        ("*alembic/env.py", "x/alembic/env.py", True), ("*alembic/env.py", "myalembic/env.py", True), ("*next.config.*", "next.config.js", True),
    ],
)
def test_path_match(pattern, path, expected):
    assert bool(re.search(globs.path_match(pattern), path)) is expected


@pytest.mark.parametrize(
    ("pattern", "path", "expected"),
    [("**/urls.py", "urls.py", True), ("**/urls.py", "a/b/urls.py", True), ("src/main.*", "src/main.ts", True), ("src/main.*", "x/src/main.ts", False), ("**/app/**/page.tsx", "app/page.tsx", True), ("**/app/**/page.tsx", "w/app/a/b/page.tsx", True), ("src/routes/**/+page.svelte", "src/routes/a/+page.svelte", True)],
)
def test_directory_glob(pattern, path, expected):
    assert bool(re.search(globs.directory_glob(pattern), path)) is expected


@pytest.mark.parametrize(
    ("lines", "path", "expected"),
    [
        (["*.log"], "a/b.log", True), (["logs/"], "logs/x", True), (["logs/"], "logs", False), (["/top.txt"], "top.txt", True), (["/top.txt"], "a/top.txt", False), (["a/*.py"], "a/x.py", True), (["a/*.py"], "b/a/x.py", False),
        (["*.py", "!keep.py"], "keep.py", False), (["!keep.py", "*.py"], "keep.py", True), (["**/tmp"], "x/tmp", True), (["a/**/z"], "a/z", True), (["a/**/z"], "a/b/c/z", True), (["# note", ""], "note", False), (["build"], "x/build/y", True),
        (["\\#x"], "#x", True), (["a[0-9].t"], "a5.t", True), (["a[!0-9].t"], "a5.t", False), (["doc/**"], "doc/a/b", True),
    ],
)
def test_ignore_rules(spark, lines, path, expected):
    hit = False
    for ignore, pattern in globs.ignore_rules(lines):
        hit = ignore if re.search(pattern, path) else hit
    assert hit is expected
    assert spark.range(1).select(globs.ignored(F.lit(path), globs.ignore_rules(lines)).alias("x")).first().x is expected


def test_paths(spark):
    df = spark.createDataFrame([("a/b.c/D.Test.PY",), ("x",), (".rc",), ("a/../b/./c.py",)], "p string")
    got = df.select(paths.name(F.col("p")).alias("n"), paths.suffix(F.col("p")).alias("s"), paths.stem(F.col("p")).alias("t"), paths.parent(F.col("p")).alias("d"), paths.normalized(F.col("p")).alias("z"), paths.ancestors(F.col("p")).alias("a")).collect()
    assert [tuple(r)[:4] for r in got] == [("D.Test.PY", ".py", "D.Test", "a/b.c"), ("x", "", "x", "."), (".rc", "", ".rc", "."), ("c.py", ".py", "c", "a/../b/.")]
    assert got[3].z == "b/c.py" and got[0].a == ["a/b.c", "a", ""] and got[1].a == [""]


@pytest.mark.parametrize(
    ("word", "expected"),
    [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"),
     ("rational", "ration"), ("digitizer", "digit"), ("vietnamization", "vietnam"), ("hopefulness", "hope"), ("triplicate", "triplic"), ("formative", "form"), ("electrical", "electr"), ("goodness", "good"), ("revival", "reviv"), ("adjustment", "adjust"), ("adoption", "adopt"),
     ("bowdlerize", "bowdler"), ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll"), ("sky", "sky"), ("by", "by")],
)
def test_stem(word, expected):
    assert stem(word) == expected
