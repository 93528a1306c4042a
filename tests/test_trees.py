"""Printed dependency trees, written by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.sources import trees

SBT = """[info] welcome to sbt 1.5.5
[info] set current project to a:b (in build file:/path)
[info] org.PARENT:PROJECT:1.0-SNAPSHOT [S]
[info] Updating {file:/some-path/}one...
[info] org:A:1.0-SNAPSHOT [S]
[info]   +-org:B:1.0
[info]   | +-org:C:1.0
[info]   | +-org:D:1.0
[info]   |\x20
[info]   +-org:E:1.0
[info]   +-org:F:1.0 [S]
[info]     +-org:G:1.0
[info]       +-org:H:1.0
[info]       | +-org:J:1.0
[info]       | |\x20
[info]       | +-org:L:1.0
[info]       +-org:S:1.0
[info]\x20\x20\x20\x20\x20
[info] Done updating.
[info] org:P:1.0-SNAPSHOT
[info]   +-org:T:1.0
[info]   | +-org:A:1.0-SNAPSHOT
[info]   |\x20
[info]   +-org:W:1.0 (evicted by: 2.0)
[info]         +-org:TOODEEP:1.0
[info]   +-org:LOST:1.0
[success] Total time: 0 s"""


def table(spark, **texts):
    return spark.createDataFrame(list(texts.items()) or [("", "")], "file string, content string")


def test_sbt(spark):
    files = table(spark, f=SBT, g=SBT.replace("\n", "\r\n"), empty="", none="[error] no such task")
    projects = spark.createDataFrame([("f", "org:A", "1.0-SNAPSHOT"), ("g", "org:P", "1.0-SNAPSHOT"), ("none", "org:A", "1"), ("empty", "x:y", "1")], "file string, name string, version string")
    rows, edges = trees.sbt(files, projects)
    got = {(r.file, r.name): (r.version, r.is_direct) for r in rows.collect()}
    assert {n[1] for n in got if n[0] == "f"} == {f"org:{x}" for x in "BCDEFGHJLS"} and {n[1] for n in got if got[n][1] and n[0] == "f"} == {"org:B", "org:E", "org:F"}
    links = {(r.file, r.src.name[4:] + r.dst.name[4:]) for r in edges.collect()}
    assert {x for f, x in links if f == "f"} == {"BC", "BD", "FG", "GH", "HJ", "HL", "GS"}
    assert {n for f, n in got if f == "g"} == {f"org:{x}" for x in "TWBCDEFGHJLS"} and got["g", "org:W"] == ("2.0", True)
    assert {x for f, x in links if f == "g"} >= {"TB", "TE", "TF", "BC"} and got["g", "org:B"][1]  # the other project gives way
    assert not [n for n in got if n[0] in ("none", "empty")]


MIX = """app
|-- one (https://github.com/dep/one.git)
|   |-- one_one (https://github.com/dep/one_one - 2.11.0)
|   `-- one_two (https://github.com/dep/one_two - 1.8.0)
|-- two ~> 2.0 (Hex package)
|   |-- pkg ~> 1.1 (Hex package)
|   |   `-- pkgC ~> 1.5 or ~> 2.0 (Hex package)
|   `-- any * (Hex package)
|-- local (/some/dir)
|   `-- below ~> 1.5 (Hex package)
`-- exact == 3.0.0 (Hex package)
    `-- last >= 0.8.1 and < 3.0.0 (Hex package)
"""
DEPS = """* one (https://github.com/dep/one.git) (mix)
  locked at 2d4eb8a
  ok
* two 2.0.5 (Hex package) (mix)
  locked at 2.0.4 (two) 6fcb1ea5
  ok
* pkg (Hex package)
  locked at 1.1.9 (pkg) 1b2b
  the dependency is not available
* any (Hex package)
  the dependency is not available
* local 0.1.0 (/some/dir) (mix)
  ok"""


def test_mix(spark):
    rows, edges = trees.mix(table(spark, f=MIX, g="app\n"), table(spark, f=DEPS, g=""))
    assert {tuple(r)[1:] for r in rows.collect()} == {
        ("https://github.com/dep/one.git", "2d4eb8a", "git", True), ("https://github.com/dep/one_one", "2.11.0", "git", False), ("https://github.com/dep/one_two", "1.8.0", "git", False), ("two", "2.0.5", "hex", True),
        ("pkg", "1.1.9", "hex", False), ("pkgC", "~> 1.5 or ~> 2.0", "hex", False), ("any", None, "hex", False), ("exact", "3.0.0", "hex", True), ("last", ">= 0.8.1 and < 3.0.0", "hex", False),
    }
    assert {(r.src.rpartition("/")[2], r.dst.rpartition("/")[2]) for r in edges.collect()} == {("one.git", "one_one"), ("one.git", "one_two"), ("two", "pkg"), ("pkg", "pkgC"), ("two", "any"), ("exact", "last")}


REBAR = """===> Verifying dependencies...
   ├─ one─1.0.0 (https://github.com/dep/one)
   │  ├─ two─2.0.0 (hex package)
   │  │  └─ three─3.0.0 (hex package)
   │  └─ four─4.0.0 (https://github.com/dep/four)
   └─ five─5.0.0 (hex package)
      └─ six─6.0.0 (hex package)
"""
CONFIG = """{erl_opts, [debug_info]}.
{deps, [
    {five, "5.0.0", {pkg, five_real}}, {six, {pkg, six_real}}, plain,
    {one, {git, "https://github.com/dep/one", {tag, "1.0.0"}}}
]}.
{profiles, [{test, [{deps, [{two, {pkg, wrong}}]}]}]}."""


def test_rebar3(spark):
    rows, edges = trees.rebar3(table(spark, f=REBAR, g=""), table(spark, f=CONFIG))
    assert {tuple(r)[1:] for r in rows.collect()} == {
        ("https://github.com/dep/one", "1.0.0", "git", True), ("two", "2.0.0", "hex", False), ("three", "3.0.0", "hex", False), ("https://github.com/dep/four", "4.0.0", "git", False), ("five_real", "5.0.0", "hex", True), ("six", "6.0.0", "hex", False),
    }
    assert {(r.src.rpartition("/")[2], r.dst.rpartition("/")[2]) for r in edges.collect()} == {("one", "two"), ("two", "three"), ("one", "four"), ("five_real", "six")}


@pytest.mark.parametrize("seed", range(3))
def test_parents_by_a_stack(spark, seed):
    import random

    rng, rows, want = random.Random(seed), [], {}
    stack, dead, room = [], True, 0
    for at in range(300):
        depth = rng.choice([None, *[min(len(stack), rng.randrange(6))] * 30, 9])
        item = None if depth is None or (depth and rng.random() < 0.05) else f"i{at}"
        rows.append((at, depth, item))
        if depth == 0 and item:
            stack, dead, room = [item], False, 1
            want[at] = None
        elif dead or depth is None or not 1 <= depth <= room:
            dead = True
        elif item:
            stack = [*stack[:depth], item]
            want[at], room = stack[depth - 1], depth + 1
        else:
            room = depth
    got = trees.with_parents(spark.createDataFrame(rows, "at int, depth int, item string").withColumn("file", F.lit("f")))
    assert {r.at: r.parent for r in got.collect()} == want
