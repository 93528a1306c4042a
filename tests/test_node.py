"""Workspaces and version 3 locks, written by hand."""

from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import paths
from lodestone.sources import node


def entry(version=None, deps=(), dev=False, **more):
    return {k: v for k, v in {"version": version, "dependencies": {d: "^1" for d in deps}, "dev": dev or None, **more}.items() if v}


def lock(packages, version=3):
    return json.dumps({"name": "x", "lockfileVersion": version, "packages": packages})


SIMPLE = lock({
    "": {"dependencies": {"3": "^2", "aws": "^2", "react": "*"}, "devDependencies": {"mocha": "*"}, "peerDependencies": {"chalk": "*"}, "workspaces": ["packages/a"]},
    "packages/a": {"name": "ws-a", "version": "2.0.0", "dependencies": {"aws": "1.0.0", "commander": "*"}},
    "node_modules/3": entry("2.1.0", ["2"], resolved="https://r/3.tgz"), "node_modules/2": entry("1.0.2", resolved=False) | {"resolved": False}, "node_modules/aws": entry("2.1134.0", ["sax"]), "node_modules/react": entry("18.1.0"),
    "node_modules/mocha": entry("10.0.0", ["log-symbols"], dev=True), "node_modules/log-symbols": entry("4.1.0", ["chalk"], dev=True), "node_modules/log-symbols/node_modules/chalk": entry("4.1.2", dev=True),
    "node_modules/chalk": entry("5.0.1"), "node_modules/sax": entry("1.2.1"), "node_modules/commander": entry("9.2.0"), "packages/a/node_modules/aws": entry("1.0.0", ["xml2js"]),
    "packages/a/node_modules/xml2js": entry("0.2.4", ["sax"]), "node_modules/ws-a": {"resolved": "packages/a", "link": True}, "node_modules/unused": entry("1.0.0"),
})
LINKS = lock({
    "": {"dependencies": {"root-only": "*"}}, "packages/a": {"dependencies": {"external-a": "*", "@s/b": "*"}}, "packages/b": {"dependencies": {"external-b": "*", "@s/a": "*"}}, "packages/c": {"dependencies": {"external-c": "*"}, "devDependencies": {"gone": "*"}},
    "node_modules/@s/a": {"resolved": "packages/a", "link": True}, "node_modules/@s/b": {"resolved": "packages/b", "link": True},
    **{f"node_modules/{n}": entry("1.0.0", d) for n, d in (("root-only", []), ("external-a", []), ("external-b", ["transitive-b"]), ("external-c", []))}, "node_modules/transitive-b": entry("2.0.0"),
})
DEEP = lock({
    "": {"dependencies": {"x": "*"}}, "node_modules/x": entry("1.0.0", ["y", "z"]), "node_modules/x/node_modules/y": entry("2.0.0", ["z", "m"]), "node_modules/x/node_modules/y/node_modules/z": entry("3.0.0", ["m", "y"]),
    "node_modules/x/node_modules/m": entry("0.5.0"), "node_modules/m": entry("0.1.0"), "node_modules/z": entry("0.2.0", ["m"]), "node_modules/@o/p": entry("1.0.0", ["m"]), "node_modules/@o/p/node_modules/m": entry("9.0.0"),
})


@pytest.fixture(scope="module")
def read(spark):
    def run(text, places=None):
        files = spark.createDataFrame([("f", text), ("broken", "{"), ("old", lock({"": {}}, 2)), ("rootless", lock({"node_modules/a": {}}))], "file string, content string")
        chosen = None if places is None else spark.createDataFrame([("f", p) for p in places] or [("f", None)], "file string, place string")
        packages, edges = node.npm_v3(files, chosen)
        packages, edges = packages.collect(), edges.collect()
        assert {r.file for r in packages} <= {"f"}
        at = {r.place: f"{r.name}@{r.version}" if r.version else r.name for r in packages}
        return {at[r.place] for r in packages if r.is_direct}, set(at.values()), {(at[r.src], at[r.dst]) for r in edges}, {at[r.place] for r in packages if r.env == "development"}

    return run


def test_root_and_workspace(read):
    direct, every, edges, development = read(SIMPLE)
    assert direct == {"3@2.1.0", "aws@2.1134.0", "react@18.1.0", "chalk@5.0.1", "mocha@10.0.0", "aws@1.0.0", "commander@9.2.0"}
    assert every == direct | {"2@1.0.2", "log-symbols@4.1.0", "chalk@4.1.2", "sax@1.2.1", "xml2js@0.2.4"}
    assert edges == {("3@2.1.0", "2@1.0.2"), ("aws@2.1134.0", "sax@1.2.1"), ("mocha@10.0.0", "log-symbols@4.1.0"), ("log-symbols@4.1.0", "chalk@4.1.2"), ("aws@1.0.0", "xml2js@0.2.4"), ("xml2js@0.2.4", "sax@1.2.1")}
    assert development == {"mocha@10.0.0", "log-symbols@4.1.0", "chalk@4.1.2"}


def test_narrowed(read):
    direct, every, _, _ = read(SIMPLE, ["packages/a"])
    assert direct == {"aws@1.0.0", "commander@9.2.0"} and every == direct | {"xml2js@0.2.4", "sax@1.2.1"}
    direct, every, _, _ = read(SIMPLE, [""])
    assert direct == {"3@2.1.0", "aws@2.1134.0", "react@18.1.0", "chalk@5.0.1", "mocha@10.0.0"} and "aws@1.0.0" not in every and "commander@9.2.0" not in every
    assert read(SIMPLE, ["", "packages/a"]) == read(SIMPLE)
    assert read(SIMPLE, ["packages/none"])[:2] == (set(), set()) == read(SIMPLE, [])[:2]


def test_links(read):
    assert read(LINKS)[0] == {"root-only@1.0.0", "external-a@1.0.0", "external-b@1.0.0", "external-c@1.0.0", "@s/a", "@s/b"}
    for places, want in ((["packages/a"], {"external-a@1.0.0", "external-b@1.0.0"}), (["packages/b"], {"external-a@1.0.0", "external-b@1.0.0"})):
        direct, every, edges, _ = read(LINKS, places)
        assert direct == want and every == want | {"transitive-b@2.0.0"} and edges == {("external-b@1.0.0", "transitive-b@2.0.0")}
    assert read(LINKS, ["packages/c"])[:2] == ({"external-c@1.0.0"}, {"external-c@1.0.0"})
    assert read(LINKS, [""])[:2] == ({"root-only@1.0.0"}, {"root-only@1.0.0"})


def test_nearest_place_at_any_depth(read):
    _, _, edges, _ = read(DEEP)
    assert edges == {
        ("x@1.0.0", "y@2.0.0"), ("x@1.0.0", "z@0.2.0"), ("y@2.0.0", "z@3.0.0"), ("y@2.0.0", "m@0.5.0"), ("z@3.0.0", "m@0.5.0"), ("z@3.0.0", "y@2.0.0"), ("z@0.2.0", "m@0.1.0"), ("@o/p@1.0.0", "m@9.0.0"),
    }


FILES = [
    ("r", "package.json", json.dumps({"name": "root", "workspaces": ["packages/*", "./tools/**", "!packages/out"], "dependencies": {"a": "1"}, "peerDependencies": {"a": "2", "p": "3"}, "devDependencies": {"d": "4"}})),
    ("r", "packages/one/package.json", json.dumps({"name": "one", "workspaces": {"packages": ["inner"]}, "dependencies": {"b": "1"}})),
    ("r", "packages/one/inner/package.json", '﻿{"name": "inner"}'), ("r", "packages/out/package.json", '{"name": "out"}'), ("r", "packages/one/node_modules/x/package.json", "{}"),
    ("r", "tools/a/b/package.json", "{}"), ("r", "tools/package.json", '{"name": "tools"}'), ("r", "apart/package.json", '{"name": "apart"}'), ("r", "apart/yarn.lock", ""), ("r", "package-lock.json", ""), ("r", "pnpm-lock.yaml", ""),
    ("r", "broken/package.json", "{"), ("c", "package.json", '{"name": "x", "workspaces": ["a"]}'), ("c", "a/package.json", '{"workspaces": ["b"]}'), ("c", "a/b/package.json", '{"workspaces": ["../b/c"]}'), ("c", "a/b/c/package.json", "{}"),
    ("q", "sub/package.json", '{"name": "pn"}'), ("q", "sub/pnpm-workspace.yaml", "packages:\n  # all\n  - 'libs/*' # one\n  - \"!libs/no\"\nother: 1\n"), ("q", "sub/libs/yes/package.json", '{"name": "yes"}'), ("q", "sub/libs/no/package.json", "{}"), ("q", "libs/far/package.json", "{}"),
    ("z", "a/package.json", '{"workspaces": ["*"]}'), ("z", "a/b/package.json", '{"workspaces": ["**"]}'), ("z", "a/b/c/package.json", "{}"),
]


@pytest.fixture(scope="module")
def listing(spark):
    return spark.createDataFrame(FILES, "repo string, path string, content string")


def test_projects(listing):
    roots, members, problems = node.projects(listing)
    assert {tuple(r) for r in roots.where("repo = 'r'").collect()} == {("r", "package.json", "npm", "package-lock.json"), ("r", "apart/package.json", "yarn", "apart/yarn.lock"), ("r", "packages/out/package.json", "npm", None)}
    got = {(r.repo, r.root, r.path, r.place) for r in members.collect()}
    assert {x[2:] for x in got if x[:2] == ("r", "package.json")} == {("package.json", ""), ("packages/one/package.json", "packages/one"), ("packages/one/inner/package.json", "packages/one/inner"), ("tools/a/b/package.json", "tools/a/b"), ("tools/package.json", "tools")}
    assert {x[2:] for x in got if x[:2] == ("q", "sub/package.json")} == {("sub/package.json", ""), ("sub/libs/yes/package.json", "libs/yes")}
    assert not problems.where("repo IN ('r', 'q')").count()
    assert {r.name for r in node.targets(roots, members).where("repo = 'r'").collect()} == {"root", "one", "inner", "tools"}
    want = {("a", "1", "production"), ("p", "3", "production"), ("d", "4", "development"), ("b", "1", "production")}
    assert {tuple(r)[2:] for r in node.asked(listing, members).where("repo = 'r'").collect()} == want
    chosen = members.where("name = 'one'").select("repo", "root", "name")
    assert {tuple(r)[2:] for r in node.asked(listing, members, chosen).where("repo = 'r'").collect()} == {("b", "1", "production")}


def test_circles_are_problems_of_their_repository(spark, listing):
    more = spark.createDataFrame([("o", "package.json", '{"workspaces": ["a"]}'), ("o", "a/package.json", '{"workspaces": ["../a/b"]}'), ("k", "a/package.json", '{"workspaces": ["b"]}'), ("k", "a/b/package.json", '{"workspaces": ["**"]}')], listing.schema)
    edges = node.workspace_links(node.manifests(more)).unionByName(spark.createDataFrame([("k", "a/b/package.json", "a/package.json")], "repo string, src string, dst string"))
    from lodestone.operators.closure import left_in_circles

    assert {r.repo for r in left_in_circles(edges.select(F.struct("repo", "src").alias("src"), F.struct("repo", F.col("dst").alias("src")).alias("dst"))).select("src.repo").distinct().collect()} == {"k"}


def test_npm_projects(spark, listing):
    files = listing.where("path <> 'package-lock.json'").unionByName(spark.createDataFrame([("r", "package-lock.json", lock({"": {"dependencies": {"a": "1"}}, "packages/one": {"dependencies": {"b": "1"}}, "node_modules/a": entry("1.0.0"), "packages/one/node_modules/b": entry("1.5.0")}))], listing.schema))
    roots, members, _ = node.projects(files)
    packages, _ = node.npm_projects(files)
    assert {(r.repo, r.root, r.name, r.version) for r in packages.collect()} == {("r", "package.json", "a", "1.0.0"), ("r", "package.json", "b", "1.5.0")}
    chosen = spark.createDataFrame([("r", "package.json", "one")], "repo string, root string, name string")
    assert {r.name for r in node.npm_projects(files, chosen)[0].collect()} == {"b"}
    nothing = spark.createDataFrame([("r", "package.json", "no such")], "repo string, root string, name string")
    assert node.npm_projects(files, nothing)[0].count() == 0


def test_globs_in_a_column(spark):
    globs = ["packages/*", "./a/b", "a//b/", "**/x", "a/**", "a/**/b", "**", "*", "a*b/c.d", "a/./b", "x(y)+[z]"]
    tries = ["packages/a", "packages", "packages/a/b", "a/b", "x", "q/x", "q/r/x", "a", "a/q/b", "a/b/c", "aXb/c.d", "aXb/cXd", "", "x(y)+[z]"]
    rows = spark.createDataFrame([(g,) for g in globs], "g string").select("g", paths.glob_pattern(F.col("g")).alias("p")).collect()
    for r in rows:
        assert [bool(re.search(r.p, t)) for t in tries] == [bool(re.search(paths.glob_regex(r.g), t)) for t in tries], r
