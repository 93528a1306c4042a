"""Maven projects over hand-written files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.functions.dependencies import interpolate
from lodestone.operators.closure import lineage
from lodestone.sources import maven


def pom(artifact, parent=None, body="", group="g", version="1"):
    up = f"<parent><groupId>{parent[0]}</groupId><artifactId>{parent[1]}</artifactId><version>{parent[2]}</version>{parent[3] if len(parent) > 3 else ''}</parent>" if parent else ""
    tag = lambda k, v: f"<{k}>{v}</{k}>" if v else ""
    return f'<?xml version="1.0"?><!-- a file --><project xmlns="http://maven.apache.org/POM/4.0.0">{up}{tag("groupId", group)}<artifactId>{artifact}</artifactId>{tag("version", version)}{body}</project>'


def deps(*rows, managed=False):
    keys = ("groupId", "artifactId", "version", "scope", "classifier", "optional")
    text = "".join("<dependency>" + "".join(f"<{k}>{v}</{k}>" for k, v in zip(keys, r, strict=False) if v) + "</dependency>" for r in rows)
    return f"<dependencyManagement><dependencies>{text}</dependencies></dependencyManagement>" if managed else f"<dependencies>{text}</dependencies>"


def props(**values):
    return "<properties>" + "".join(f"<{k.replace('_', '.')}>{v}</{k.replace('_', '.')}>" for k, v in values.items()) + "</properties>"


FILES = {
    "pom.xml": pom("root", body=props(a_v="1.0", both="root") + "<modules><module>one</module><module>two/other-name.xml</module></modules>" + deps(("x", "managed", "9.9"), ("x", "scoped", "2", "test"), managed=True) + deps(("x", "shared", "${a.v}"))),
    "one/pom.xml": pom("one", ("g", "root", "1"), body=props(both="one") + deps(("x", "managed"), ("x", "scoped"), ("${project.groupId}", "own", "${project.version}"), ("x", "b", "${both}", "", "sources")), group="", version=""),
    "two/other-name.xml": pom("two", ("g", "root", "1"), body=deps(("x", "shared", "", "provided", "", "true"), ("x", "gone", "${no}"), ("g", "one", "1"))),
    "one/sub/pom.xml": pom("sub", ("g", "one", "1", "<relativePath>../pom.xml</relativePath>"), body=deps(("x", "managed", "1.1", "runtime"))),
    "apart/pom.xml": pom("apart", ("far", "parent", "3"), body=deps(("x", "b", "5")), group=""),
    "apart/target/pom.xml": pom("built"),
    "lists/pom.xml": pom("lists", body=deps(("x", "fine", "1"), ("x", "", "2"))),
    "broken/pom.xml": "<project><artifactId>broken",
    "no/pom.xml": pom("noversion", version=""),
    "README": "text",
}


@pytest.fixture(scope="module")
def read(spark):
    rows = [("r", p, t) for p, t in FILES.items()] + [("s", "pom.xml", pom("root", body=deps(("x", "alone", "1"))))]
    c = maven.closure(maven.project_files(spark.createDataFrame(rows, "repo string, path string, content string")))
    packages, edges = maven.graph(c)
    return c, packages, edges


def packages_of(read, project, repo="r"):
    return {(r.name, r.version): (r.is_direct, r.env, r.scopes, r.optional) for r in read[1].where((F.col("repo") == repo) & (F.col("project") == project)).collect()}


def test_projects_and_targets(read):
    c = read[0]
    assert {tuple(r) for r in c.projects.select("repo", "project").collect()} == {("r", "pom.xml"), ("r", "apart/pom.xml"), ("r", "lists/pom.xml"), ("s", "pom.xml")}
    assert {r.name for r in maven.submodules(c).where("repo = 'r' AND project = 'pom.xml'").collect()} == {"g:root", "g:one", "g:two", "g:sub"}


def test_inheritance_and_management(read):
    got = packages_of(read, "pom.xml")
    assert got == {
        ("g:root", "1"): (True, None, [], []), ("g:one", "1"): (False, None, [], []), ("g:two", "1"): (False, None, [], []), ("g:sub", "1"): (False, None, [], []),
        ("x:shared", "1.0"): (False, None, ["provided"], ["true"]), ("x:managed", "9.9"): (False, None, [], []), ("x:managed", "1.1"): (False, None, ["runtime"], []),
        ("x:scoped", "2"): (False, "testing", ["test"], []), ("g:own", "1"): (False, None, [], []), ("x:b", "one:sources"): (False, None, [], []), ("x:gone", "PROPERTY NOT FOUND: no"): (False, None, [], []),
    }
    edges = {(r.src.name, r.dst.name, r.dst.version) for r in read[2].where("repo = 'r' AND project = 'pom.xml'").collect()}
    assert {("g:root", "g:one", "1"), ("g:one", "g:sub", "1"), ("g:root", "g:two", "1"), ("g:sub", "x:managed", "1.1"), ("g:one", "x:managed", "9.9"), ("g:sub", "x:shared", "1.0"), ("g:two", "g:one", "1")} <= edges
    assert ("g:root", "g:sub", "1") not in edges


def test_absent_parents_bad_lists_and_other_repositories(read):
    assert packages_of(read, "apart/pom.xml") == {("far:apart", "1"): (True, None, [], []), ("x:b", "5"): (False, None, [], [])}
    assert packages_of(read, "lists/pom.xml") == {("g:lists", "1"): (True, None, [], [])}
    assert packages_of(read, "pom.xml", "s") == {("g:root", "1"): (True, None, [], []), ("x:alone", "1"): (False, None, [], [])}


def test_only_submodules(spark, read):
    c, packages, edges = read
    modules = maven.submodules(c)
    names = lambda included: {r.name for r in maven.only_submodules(packages, edges, modules, modules.where(included))[0].where("repo = 'r' AND project = 'pom.xml'").collect()}
    assert names("name = 'g:two' OR project <> 'pom.xml'") == {"g:two", "x:shared", "x:gone"}  # not what it has by module one
    assert names("name <> 'g:nothing'") == {r[0] for r in packages_of(read, "pom.xml")}
    kept, links = maven.only_submodules(packages, edges, modules, modules.where("name IN ('g:sub', 'g:root')"))
    assert {r.name for r in kept.where("repo = 'r'").collect()} == {"g:root", "x:shared", "g:sub", "x:managed", "x:scoped", "g:own", "x:b"}
    assert {(r.src.name, r.dst.name) for r in links.where("repo = 'r'").collect()} >= {("g:root", "x:shared"), ("g:sub", "x:managed")}


def test_licenses(spark):
    body = "<licenses><license><name>MIT</name></license><license><name>A</name><url>http://l</url></license><license/></licenses>"
    rows = [("r", "pom.xml", pom("root", body=body)), ("r", "m/pom.xml", pom("m", ("g", "root", "1"), body="<licenses><license><name>M</name></license></licenses>"))]
    c = maven.closure(maven.project_files(spark.createDataFrame(rows, "repo string, path string, content string")))
    assert {tuple(r) for r in maven.licenses(c).collect()} == {("r", "pom.xml", "pom.xml", "spdx", "MIT"), ("r", "pom.xml", "pom.xml", "url", "http://l"), ("r", "pom.xml", "m/pom.xml", "spdx", "M")}


def test_no_files(spark):
    c = maven.closure(maven.project_files(spark.createDataFrame([], "repo string, path string, content string")))
    assert maven.graph(c)[0].count() == 0


@pytest.mark.parametrize(("text", "values", "want"), [
    ("${project.groupId}", {"project.groupId": "OTHER"}, "OTHER"), ("foo${a}bar", {"a": "1"}, "foo1bar"), ("${a}${b}", {"a": "1", "b": "2"}, "12"),
    ("${a}", {"a": "${a}"}, "a"), ("${a}", {"a": "\\${a}"}, "\\a"), ("${a}-${a}", {"a": "1"}, "1-a"), ("${x}${a}", {"a": "1"}, "PROPERTY NOT FOUND: x1"),
    ("${a}", {"a": "${b}", "b": "${a}"}, "a"), ("${a", {"a": "1"}, "${a"), ("a}${", {}, "a}${"), ("plain", {}, "plain"), (None, {}, None), ("${}", {"": "e"}, "e"),
    ("".join(f"${{p{i}}}" for i in range(80)), {f"p{i}": str(i % 10) for i in range(80)}, "".join(str(i % 10) for i in range(80))),
    ("${n0}", {f"n{i}": f"${{n{i + 1}}}" for i in range(120)} | {"n120": "end"}, "end"),
])
def test_interpolation(spark, text, values, want):
    row = spark.createDataFrame([(text, values)], "t string, p map<string,string>")
    assert row.select(interpolate(F.col("t"), F.col("p"))).first()[0] == want


def test_names_in_a_circle_end(spark):
    row = spark.createDataFrame([("${a}", {"a": "${no}${a}"})], "t string, p map<string,string>")
    assert row.select(interpolate(F.col("t"), F.col("p"))).first()[0].endswith("a")


def test_lineage(spark):
    pairs = [(i, i // 2) for i in range(2, 60)] + [(i, i - 1) for i in range(101, 140)] + [(201, 202), (202, 203), (203, 201), (204, 201)]
    up = dict(pairs)
    want = set()
    for n in {x for p in pairs for x in p}:
        at, depth, seen = n, 0, set()
        while at is not None and at not in seen:
            want.add((n, at, depth))
            seen.add(at)
            at, depth = up.get(at), depth + 1
    links = spark.createDataFrame(pairs, "node long, to long")
    nodes = spark.createDataFrame([(x,) for p in pairs for x in p], "node long")
    assert {tuple(r) for r in lineage(links, nodes).collect()} == want
