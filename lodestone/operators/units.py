"""Source units: what is reported of a project's dependencies, as locators, and its graph as JSON.

Graphs of all projects are worked on at once. Imports and links are rows, so that a dependency that everything needs
is many rows and no long array.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.dependencies import dependency_locator
from lodestone.functions.locators import publishable, render, supported
from lodestone.operators.graph import Graph
from lodestone.plans.scratch import materialise


class Units(NamedTuple):
    """``imports``: (project, locator), what a project needs itself. ``dependencies``: (project, locator). ``links``: (project, locator, needs)."""

    imports: DataFrame
    dependencies: DataFrame
    links: DataFrame


def _node(c: str) -> Column:
    return F.struct("project", F.col(c).alias("node"))


def source_units(vertices: DataFrame, edges: DataFrame, unfiltered: bool = False) -> Units:
    """Units of ``vertices`` (project, node, type, name, leaves, environments, is_direct) and ``edges`` (project, src, dst).

    Types that units cannot hold go, and unless ``unfiltered`` dependencies that are only for development or tests; what
    they led to hangs on what led to them, but does not become direct. Dependencies of one locator are one. ``leaves`` are
    those of the version's constraint, as :func:`lodestone.functions.dependencies.dependency_locator` takes them.
    """
    kept = supported(F.col("type")) & (F.col("type") != "unresolved-path")
    kept = kept if unfiltered else kept & publishable(F.col("environments"))
    rows = vertices.select(_node("node").alias("node"), "is_direct", F.coalesce(kept, F.lit(False)).alias("kept"), "type", "name", "leaves")
    graph = Graph(rows.select("node", "is_direct"), edges.select(_node("src").alias("src"), _node("dst").alias("dst")).distinct())
    graph = graph.shrink(rows.where("NOT kept").select("node"), promote=False)
    at = dependency_locator(F.col("type"), F.col("name"), F.col("leaves"))
    names = rows.where("kept").select("node", F.struct("node.project", render(at["fetcher"], at["project"], at["revision"]).alias("locator")).alias("to"))
    graph = graph.relabel(names).saved()
    imports = graph.directs().select("node.project", "node.locator")
    return Units(imports, graph.vertices.select("node.project", "node.locator"), graph.edges.select("src.project", "src.locator", F.col("dst.locator").alias("needs")))


def graph_json(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(project, json): each project's graph as one document with its dependencies, and links and direct ones by number.

    ``vertices``: (project, node, dep, is_direct), ``dep`` a struct; ``edges``: (project, src, dst). Numbers follow the
    order of nodes. A document holds one project, as its format asks.
    """
    order = Window.partitionBy("project").orderBy("node")
    ids = materialise(vertices.select("project", "node", "dep", "is_direct", (F.row_number().over(order) - 1).alias("id")), "graph-ids")
    end = lambda c, to: ids.select("project", F.col("node").alias(c), F.col("id").alias(to))
    pairs = edges.select("project", "src", "dst").distinct().join(end("src", "a"), ["project", "src"]).join(end("dst", "b"), ["project", "dst"])
    text = lambda c: F.array_join(F.array_sort(F.collect_list(c)), ",")
    one = pairs.groupBy("project", "a").agg(text(F.col("b")).alias("children"))
    assocs = one.groupBy("project").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", "children"))), lambda x: F.format_string("[%s,[%s]]", x["a"], x["children"])), ",").alias("assocs"))
    deps = ids.groupBy("project").agg(F.array_sort(F.collect_list(F.struct("id", F.to_json("dep").alias("d")))).alias("d"), text(F.when(F.col("is_direct"), F.col("id"))).alias("direct"))
    listed = F.array_join(F.transform("d", lambda x: x["d"]), ",")
    return deps.join(assocs, "project", "left").select("project", F.format_string('{"deps":[%s],"assocs":[%s],"direct":[%s]}', listed, F.coalesce("assocs", F.lit("")), "direct").alias("json"))


_WHOLE = {"ignoreNullFields": "false"}


def unit_documents(units: Units, projects: DataFrame) -> DataFrame:
    """(project, json): one source unit as a document for each of ``projects`` (project, name, type, breadth, paths array).

    Locators are in order. A document holds one project, as its format asks; projects without dependencies have empty lists.
    """
    needs = units.links.groupBy("project", "locator").agg(F.array_sort(F.collect_set("needs")).alias("imports"))
    none = F.array().cast("array<string>")
    rows = units.dependencies.join(needs, ["project", "locator"], "left")
    each = F.struct("locator", F.coalesce("imports", none).alias("imports"), F.lit(None).cast("string").alias("metadata"))
    rows = rows.groupBy("project").agg(F.array_sort(F.collect_list(each)).alias("deps"))
    own = units.imports.groupBy("project").agg(F.array_sort(F.collect_list("locator")).alias("own"))
    rows = projects.join(rows, "project", "left").join(own, "project", "left")
    empty = F.array().cast("array<struct<locator:string,imports:array<string>,metadata:string>>")
    build = F.struct(F.lit("default").alias("Artifact"), F.lit(True).alias("Succeeded"), F.coalesce("own", none).alias("Imports"), F.coalesce("deps", empty).alias("Dependencies"))
    unit = F.struct(F.col("name").alias("Name"), F.col("type").alias("Type"), F.col("name").alias("Manifest"), build.alias("Build"), F.col("breadth").alias("GraphBreadth"), none.alias("NoticeFiles"), F.col("paths").alias("OriginPaths"))
    return rows.select("project", F.to_json(unit, _WHOLE).alias("json"))


def scan_documents(images: DataFrame, layers: DataFrame, documents: DataFrame, observations: DataFrame) -> DataFrame:
    """(image, json): the scan of each of ``images`` (image, os, release), with its ``layers`` (image, layer, ord) in order.

    ``documents`` (image, layer, json) are the layers' source units, ``observations`` (image, layer, json) what was found in
    JARs; both stand in the scan as they are, in their order as text. An unknown system is null.
    """
    texts = lambda rows, c: rows.groupBy("image", "layer").agg(F.array_join(F.array_sort(F.collect_list("json")), ",").alias(c))
    rows = layers.join(texts(documents, "u"), ["image", "layer"], "left").join(texts(observations, "o"), ["image", "layer"], "left")
    quoted = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(F.col(c).alias("x"))), r'^\{"x":(.*)\}$', 1), F.lit(""))
    empty = F.lit("")
    one = F.format_string('{"layerId":%s,"srcUnits":[%s],"observations":[%s]}', quoted("layer"), F.coalesce("u", empty), F.coalesce("o", empty))
    listed = rows.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("ord", one.alias("t")))).alias("x"))
    value = lambda c: F.when(F.col(c).isNull(), "null").otherwise(quoted(c))
    whole = F.format_string('{"image":{"os":%s,"osRelease":%s,"layers":[%s]}}', value("os"), value("release"), F.coalesce(F.array_join(F.transform("x", lambda x: x["t"]), ","), empty))
    return images.join(listed, "image", "left").select("image", whole.alias("json"))
