"""The analysis operators on small literals, and every query with SQL against DuckDB."""

from __future__ import annotations

import itertools
import json
import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lodestone.functions import content, locators, paths
from lodestone.operators import graph as g
from lodestone.operators import joins, rollups, rows, targets
from lodestone.operators.closure import acyclic, reach
from lodestone.operators.components import connected_components
from lodestone.operators.numbering import numbered
from lodestone.plans import catalogue
from lodestone.sources import manifests
from lodestone.sources import registry as reading
from lodestone.streaming import rescan

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def graph(spark, directs, edges, deeps=()):
    nodes = lambda x: spark.createDataFrame([(n,) for n in x], "node int")
    return g.Graph.build(nodes(directs), spark.createDataFrame(list(edges), "src int, dst int"), nodes(deeps))


def edges_of(x):
    return {tuple(r) for r in x.edges.collect()}


def directs_of(x):
    return {r.node for r in x.directs().collect()}


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first().y


def test_shrink_by_hand(spark):
    nodes = lambda *x: spark.createDataFrame([(n,) for n in x], "node int")
    assert edges_of(graph(spark, [1], [(1, 2), (2, 3), (3, 4)]).shrink(nodes(3))) == {(1, 2), (2, 4)}
    assert edges_of(graph(spark, [1], [(1, 2), (2, 1)]).shrink(nodes(2))) == {(1, 1)}
    promoted = graph(spark, [1], [(1, 2), (3, 2)]).shrink(nodes(1))
    assert directs_of(promoted) == {2} and edges_of(promoted) == {(3, 2)}
    assert directs_of(graph(spark, [1], [(1, 2)]).shrink(nodes(1), promote=False)) == set()


def test_shrink_matches_vertex_by_vertex(spark):
    rng = random.Random(1)
    for _ in range(3):
        edges = {(rng.randrange(12), rng.randrange(12)) for _ in range(22)}
        gone = set(rng.sample(range(12), 5))
        want = {(-1, 0), (-1, 1)} | edges
        for v in gone:
            before, after = {a for a, b in want if b == v and a != v}, {b for a, b in want if a == v and b != v}
            want = {(a, b) for a, b in want if v not in (a, b)} | set(itertools.product(before, after))
        got = graph(spark, [0, 1], edges).shrink(spark.createDataFrame([(v,) for v in gone], "node int"))
        assert edges_of(got) == {e for e in want if e[0] >= 0} and directs_of(got) == {b for a, b in want if a == -1}


def test_reach_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5), (None, 1)], "src int, dst int")
    seeds = spark.createDataFrame([("a", 1), ("b", 4), ("c", None)], "k string, node int")
    assert {tuple(r) for r in reach(edges, seeds).collect()} == {("a", 1), ("a", 2), ("a", 3), ("b", 4), ("b", 5)}
    assert {tuple(r) for r in reach(edges, seeds, inclusive=False).collect()} == {("a", 1), ("a", 2), ("a", 3), ("b", 5)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "src int, dst int")
    assert reach(chain, spark.createDataFrame([(0,)], "node int")).count() == 41
    assert not acyclic(edges) and acyclic(edges.where("src = 4"))


def test_graph_questions(spark):
    x = graph(spark, [1, 5], [(1, 2), (2, 3), (4, 5)], deeps=[9])
    assert {r.node for r in x.prune_unreachable().vertices.collect()} == {1, 2, 3, 5}
    assert {r.node for r in x.sources().collect()} == {1, 4, 9}
    assert {(r.source, r.node) for r in x.split().collect()} == {(1, 1), (1, 2), (1, 3), (4, 4), (4, 5), (9, 9)}
    assert graph(spark, [1], [(1, 2), (2, 1)]).split().count() == 0
    assert directs_of(x.strip_root()) == {2} and directs_of(x.shrink_roots()) == {2}
    assert x.size().first().n == 6
    labels = spark.createDataFrame([(1, "prod"), (4, "dev")], "node int, label string")
    assert {tuple(r) for r in x.hydrate(labels).collect()} == {(1, "prod"), (2, "prod"), (3, "prod"), (4, "dev"), (5, "dev")}
    assert {r.node for r in x.roots_of(spark.createDataFrame([(3,), (5,)], "node int")).collect()} == {1}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(500 + i, 501 + i) for i in range(60)] + [(None, 1)]
    root = {}

    def find(v):
        root.setdefault(v, v)
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        if a is not None and a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {v: find(v) for v in root}
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_numbers_are_dense(spark):
    out, n = numbered(spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")), ["k"], "no")
    assert n == 1000 and out.where("k <> no").count() == 0 and out.count() == 1000
    assert numbered(spark.range(0), ["id"])[1] == 0


def test_rows_keep_their_columns(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "k int, `row` string")
    gone = spark.createDataFrame([(None,), (2,)], "k int")
    assert rows.without(df, gone, k=F.col("k")).collect() == [(1, "a")]


def test_locators(spark):
    parse = lambda t: tuple(one(spark, t, locators.parse))
    assert parse("git+github.com/a/b$v1") == ("git", "github.com/a/b", "v1")
    assert parse("npm+x$") == ("npm", "x", None) and parse("nofetcher") == ("nofetcher", "", None)
    assert one(spark, "a\u0007b", lambda c: locators.render(F.lit("f"), c, F.lit(None).cast("string"))) == "f+ab$"
    assert one(spark, "v0.0.0-20210101000000-abcdefabcdef", locators.go_version) == "abcdefabcdef"
    assert [tuple(c) for c in one(spark, "~=1.4, !=1.5", locators.pip_constraints)] == [("COMPATIBLE", "1.4"), ("NOT", "1.5")]
    assert tuple(one(spark, "serde 1.0 (registry+https://x)", locators.cargo_package)) == ("serde", "1.0", "registry+https://x")
    assert tuple(one(spark, "path+file:///a/my-crate#0.1.0", locators.cargo_package)) == ("my-crate", "0.1.0", "path+file:///a/my-crate")


@pytest.mark.parametrize(
    ("glob", "path", "hit"),
    [("a/*", "a/b", True), ("a/*", "a/b/c", False), ("**/v", "v", True), ("**/v", "x/y/v", True), ("a/**", "a", True), ("a/**/b", "a/b", True), ("a/**/b", "a/x/b", True), ("a.b", "axb", False), ("**", "x/y", True), ("x?", "xy", False), ("a\\b/", "a/b", True)],
)
def test_globs(glob, path, hit):
    assert bool(re.match(paths.glob_regex(glob), path)) == hit


def test_paths(spark):
    allow = lambda p, i=(), e=(): one(spark, p, lambda c: paths.path_allowed(c, i, e))
    assert [allow(p, ["a/b"]) for p in ("a", "a/b", "a/b/c", "z", "ab")] == [True, True, True, False, False]
    assert [allow(p, (), ["a"]) for p in ("a", "a/x", "b")] == [False, False, True]
    assert [allow(p, ["apps/*"]) for p in ("apps", "apps/x", "apps/x/y", "other")] == [True, True, True, False]
    assert allow("x/vendor", (), ["**/vendor"]) is False and allow("any", ["**/foo"]) is True
    assert one(spark, "/base/mytest/x", lambda c: paths.non_production(c, "/base/")) is True
    assert one(spark, "../../../x", lambda c: paths.resolve_link(c, F.lit("a/b"))) == "x"


def test_prefixes(spark):
    df = spark.createDataFrame([("/foo/bar.h",), ("/foo/bar/baz.c",), ("/other/dir/x",)], "path string")
    assert {r.prefix for r in rollups.minimal_prefixes(df).collect()} == {"/foo/", "/other/dir/"}
    fold = spark.createDataFrame([(["/foo/a.c", "/foo/b/x.c", "/other/w.c"],)], "p array<string>").select(rollups.folded_prefixes(F.col("p")).alias("f")).first().f
    assert set(fold) == {"/foo/", "/foo/b/", "/other/"}


def test_layers(spark):
    df = spark.createDataFrame([("i", "d/x", 1, "insert"), ("i", "d/y", 2, "insert"), ("i", "d", 3, "remove"), ("i", "d/z", 4, "insert"), ("i", "dd", 0, "insert")], "image string, path string, seq int, op string")
    assert {r.path for r in rollups.squash_layers(df).collect()} == {"d/z", "dd"}


def test_target_filters(spark):
    df = spark.createDataFrame([("mvn", "a", ["x", "y"]), ("mvn", "b", None), ("npm", "a", ["x"])], "type string, dir string, targets array<string>")
    got = lambda i=targets.Filters(), e=targets.Filters(): {(r.type, r.dir, tuple(r.targets or ())) for r in targets.apply_filters(df, i, e).collect()}
    assert got(targets.Filters([("mvn", None, None)])) == {("mvn", "a", ("x", "y")), ("mvn", "b", ())}
    assert got(targets.Filters([("mvn", None, None), ("mvn", "a", "x")])) == {("mvn", "a", ("x",)), ("mvn", "b", ())}
    assert got(e=targets.Filters([("mvn", "a", "x")])) == {("mvn", "a", ("y",)), ("mvn", "b", ()), ("npm", "a", ("x",))}
    assert got(targets.Filters([("npm", "a", "nosuch")])) == set() and got(e=targets.Filters(paths=["a"])) == {("mvn", "b", ())}


def test_aliases(spark):
    locs = spark.createDataFrame([("git", "my/fork", "1"), ("git", "my/fork", None), ("git", "other", "1")], "fetcher string, project string, revision string")
    alias = spark.createDataFrame([("git", "my/fork", None, "git", "old", None, 1), ("git", "my/fork", "1", "git", "base", "9", 2)], "fetcher string, project string, version string, base_fetcher string, base_project string, base_version string, ord int")
    assert {tuple(r) for r in joins.translate(locs, alias).collect()} == {("git", "base", "9"), ("git", "my/fork", None), ("git", "other", "1")}


def test_comments():
    cases = [("x // c", "x"), ("a /* b */ c\nd", "a"), ("a /* b\n c */ d\n\n e", "a\nd\ne"), ("// x /* y\nz */ w", "// x\nw"), ("a\r\n\r\nb", "a\nb")]
    for text, want in cases:
        assert content.strip_comments(text) == want


def test_keyword_positions(spark):
    text = "é one\ntwo three two"
    df = spark.createDataFrame([("p", text), ("q", None)], "path string, text string")
    got = [(r.match, r.start_byte, r.end_byte, r.start_line, r.end_line) for r in content.keyword_positions(df, {"t": "tw."}).collect()]
    assert got == [("two", 7, 10, 2, 2), ("two", 17, 20, 2, 2)]
    assert all(text.encode()[s:e].decode() == m for m, s, e, _, _ in got)


def test_broken_manifests_give_nothing(spark):
    files = spark.createDataFrame([(f"d/{n}", text) for n in ("package-lock.json", "package.json", "composer.lock", "Pipfile.lock", "renv.lock", "Package.resolved", "go.mod", "Gemfile.lock", "requirements.txt") for text in ("", "{", None, "[1]", "{}")], "path string, content string")
    assert reading.read_all(files.where("content IS NULL OR content <> '['")).where("reader <> 'requirements'").count() == 0


def test_os_identity(spark):
    get = lambda r, c, b: tuple(spark.range(1).select(manifests.os_identity(F.lit(r), F.lit(c), F.lit(b)).alias("o")).first().o)
    assert get('ID="alpine"\nVERSION_ID=3.18', None, None) == ("alpine", "3.18")
    assert get(None, "cpe:/o:centos:linux:6:GA", None) == ("linux", "6") and get(None, None, None) == ("linux", None)


def test_rescan_counts_each_content_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    args = (spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), {"mit": "MIT Licen[sc]e"})

    def arrive(name, rows):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps({"path": p, "text": t}) for p, t in rows))
        rescan.rescan(*args).awaitTermination(120)

    arrive("a.json", [("x", "MIT License"), ("y", "nothing"), ("z", None)])
    arrive("b.json", [("x2", "MIT License"), ("w", "MIT Licence MIT License")])
    matches = spark.read.parquet(str(tmp_path / "out" / "matches"))
    assert sorted(r.match for r in matches.collect()) == ["MIT Licence", "MIT License", "MIT License"]
    assert spark.read.parquet(str(tmp_path / "out" / "files")).count() == 4


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def _plain(value):
    return repr(round(value, 6)) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    want = con.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    df = catalogue.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    got = sorted("|".join(_plain(r[c]) for c in names) for r in df.collect())
    assert got == sorted("|".join(map(_plain, r)) for r in want.fetchall())
