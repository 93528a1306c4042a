"""Source units and graph documents of small graphs."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lodestone.operators import units
from lodestone.operators.graph import Graph

VERTICES = "project string, node string, type string, name string, leaves array<struct<op:string,value:string>>, environments array<string>, is_direct boolean"


def test_source_units(spark):
    leaf = lambda v: [("EQUAL", v)] if v else []
    rows = [
        ("p", "a", "gem", "a", leaf("1"), [], True), ("p", "dev", "gem", "dev", leaf("2"), ["development"], False), ("p", "b", "nodejs", "b", [], ["production"], False), ("p", "b2", "nodejs", "b", [], [], False),
        ("p", "sub", "subproject", "s", [], [], True), ("p", "up", "unresolved-path", "x", [], [], True), ("p", "c", "pip", "c", leaf("3"), ["other:q"], False), ("q", "a", "gem", "a", leaf("9"), [], False),
    ]
    vertices = spark.createDataFrame(rows, VERTICES)
    edges = spark.createDataFrame([("p", "a", "dev"), ("p", "dev", "b"), ("p", "b", "b2"), ("p", "sub", "c"), ("p", "a", "b2")], "project string, src string, dst string")
    found = units.source_units(vertices, edges)
    assert {tuple(r) for r in found.imports.collect()} == {("p", "gem+a$1")}  # what hung on the project below is not direct
    assert {tuple(r) for r in found.dependencies.collect()} == {("p", "gem+a$1"), ("p", "npm+b$"), ("p", "pip+c$3"), ("q", "gem+a$9")}
    assert {tuple(r) for r in found.links.collect()} == {("p", "gem+a$1", "npm+b$"), ("p", "npm+b$", "npm+b$")}
    whole = units.source_units(vertices, edges, unfiltered=True)
    assert ("p", "gem+dev$2") in {tuple(r) for r in whole.dependencies.collect()} and whole.dependencies.count() == 5


def test_graph_json(spark):
    vertices = spark.createDataFrame([("p", "b", "t", True), ("p", "a", "u", False), ("p", "c", "t", False), ("q", "x", "t", False)], "project string, node string, type string, is_direct boolean")
    edges = spark.createDataFrame([("p", "b", "c"), ("p", "b", "a"), ("p", "b", "a"), ("p", "a", "c")], "project string, src string, dst string")
    got = {r.project: json.loads(r.json) for r in units.graph_json(vertices.select("project", "node", F.struct("type").alias("dep"), "is_direct"), edges).collect()}
    assert got == {"p": {"deps": [{"type": "u"}, {"type": "t"}, {"type": "t"}], "assocs": [[0, [2]], [1, [0, 2]]], "direct": [1]}, "q": {"deps": [{"type": "t"}], "assocs": [], "direct": []}}


def test_unit_and_scan_documents(spark):
    text = "project string, locator string"
    found = units.Units(spark.createDataFrame([("p", "gem+b$1"), ("p", "gem+a$")], text), spark.createDataFrame([("p", "gem+b$1"), ("p", "gem+a$"), ("p", "gem+c$")], text), spark.createDataFrame([("p", "gem+b$1", "gem+c$"), ("p", "gem+b$1", "gem+a$")], text + ", needs string"))
    projects = spark.createDataFrame([("p", "dir/p", "gem", "complete", ["Gemfile"]), ("none", "dir/n", "gem", "partial", [])], "project string, name string, type string, breadth string, paths array<string>")
    docs = units.unit_documents(found, projects)
    got = {r.project: json.loads(r.json) for r in docs.collect()}
    deps = [{"locator": "gem+a$", "imports": [], "metadata": None}, {"locator": "gem+b$1", "imports": ["gem+a$", "gem+c$"], "metadata": None}, {"locator": "gem+c$", "imports": [], "metadata": None}]
    assert got["p"] == {"Name": "dir/p", "Type": "gem", "Manifest": "dir/p", "Build": {"Artifact": "default", "Succeeded": True, "Imports": ["gem+a$", "gem+b$1"], "Dependencies": deps}, "GraphBreadth": "complete", "NoticeFiles": [], "OriginPaths": ["Gemfile"]}
    assert got["none"]["Build"] == {"Artifact": "default", "Succeeded": True, "Imports": [], "Dependencies": []}
    images = spark.createDataFrame([("i", 'al"pine', "3"), ("j", None, None)], "image string, os string, release string")
    layers = spark.createDataFrame([("i", "base", 0), ("i", "other layers", 1)], "image string, layer string, ord int")
    placed = docs.where("project = 'p'").select(F.lit("i").alias("image"), F.lit("other layers").alias("layer"), "json")
    seen = spark.createDataFrame([("i", "base", '{"path":"a.jar"}')], "image string, layer string, json string")
    scans = {r.image: json.loads(r.json) for r in units.scan_documents(images, layers, placed, seen).collect()}
    assert scans["i"] == {"image": {"os": 'al"pine', "osRelease": "3", "layers": [{"layerId": "base", "srcUnits": [], "observations": [{"path": "a.jar"}]}, {"layerId": "other layers", "srcUnits": [got["p"]], "observations": []}]}}
    assert scans["j"] == {"image": {"os": None, "osRelease": None, "layers": []}}


def test_traverse(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "node string")
    graph = Graph.build(nodes.where("node = 'a'"), spark.createDataFrame([("a", "b")], "src string, dst string"))
    table = lambda rows: spark.createDataFrame(rows, "node string, to string, problem string")
    done, problems = graph.traverse(table([("a", "x", None), ("b", "y", None)]))
    assert [tuple(r) for r in done.edges.collect()] == [("x", "y")] and problems.count() == 0
    for rows, why in (([("a", "x", None), ("b", None, "bad")], "bad"), ([("a", "x", None)], "no name")):
        failed, problems = graph.traverse(table(rows))
        assert failed.vertices.count() == failed.edges.count() == 0 and [tuple(r) for r in problems.collect()] == [("b", why)]
