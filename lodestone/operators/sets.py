"""Set and ordering operators of the analysis over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.closure import reach
from lodestone.operators.graph import Graph
from lodestone.operators.joins import translate

NO_LICENSE = "No_license_found"


def grouped_lists(rows: DataFrame, key: str, values: str, order: str) -> DataFrame:
    """(key, values): the arrays ``values`` of each key joined, that of the last row by ``order`` first."""
    lists = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(values).alias("v"))), asc=False)
    return rows.groupBy(key).agg(F.flatten(F.transform(lists, lambda x: x["v"])).alias(values))


def checked_names(rows: DataFrame, key: str) -> DataFrame:
    """Different rows, with ambiguous: whether another of them has the same name."""
    once = rows.distinct()
    again = once.groupBy(key).agg((F.count("*") > 1).alias("ambiguous"))
    return once.join(again, key)


def unit_locators(units: DataFrame) -> DataFrame:
    """(unit, locator): each once, of a unit's imports, its dependencies and what these import.

    ``units``: (unit, imports array, deps array of struct locator, imports array).
    """
    own = units.select("unit", F.explode("imports").alias("locator"))
    deps = units.select("unit", F.explode("deps").alias("d"))
    return own.unionByName(deps.select("unit", F.col("d.locator").alias("locator"))).unionByName(deps.select("unit", F.explode("d.imports").alias("locator"))).distinct()


def joined_units(a: Column, b: Column) -> Column:
    """Two licence units (name, files, data): name of the first, files once each, data of both."""
    return F.struct(a["name"].alias("name"), F.array_distinct(F.concat(a["files"], b["files"])).alias("files"), F.concat(a["data"], b["data"]).alias("data"))


def all_units(source: DataFrame, license_: DataFrame) -> DataFrame:
    """Source units, then licence units (name, type, ...), in one form; columns that one side lacks are null."""
    one, two = source.withColumn("part", F.lit(0)), license_.withColumn("part", F.lit(1))
    return one.unionByName(two, allowMissingColumns=True)


def united_rules(organisation: DataFrame, local: DataFrame) -> DataFrame:
    """Rules of the organisation and local ones, each once."""
    return organisation.unionByName(local).distinct()


def combined(results: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows of successes, (key, succeeded, warnings, fatal)): failures are warnings unless nothing of a key succeeded.

    ``results``: key, ok, and what a success holds.
    """
    counts = results.groupBy(key).agg(F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("warnings"))
    return results.where("ok").drop("ok"), counts.withColumn("fatal", F.col("succeeded") == 0)


def united_environments(rows: DataFrame) -> DataFrame:
    """(node, envs): the environments (node, envs array) that any source gives a node, ascending; none makes an empty array."""
    each = rows.select("node", F.explode_outer("envs").alias("env")).distinct()
    return each.groupBy("node").agg(F.array_sort(F.collect_set("env")).alias("envs"))


def partitioned(rows: DataFrame, test: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, the others); a null test does not pass."""
    passes = F.coalesce(test, F.lit(False))
    return rows.where(passes), rows.where(~passes)


def without_first(items: Column, gone: Column) -> Column:
    """``items`` less the first occurrence of each of ``gone``."""

    def drop(acc: Column, x: Column) -> Column:
        at = F.array_position(acc, x).cast("int")
        return F.when(at > 0, F.concat(F.slice(acc, F.lit(1), at - 1), F.slice(acc, at + 1, F.size(acc)))).otherwise(acc)

    return F.aggregate(gone, items, drop)


def only_tool(includes: Column, tool: str) -> Column:
    """Whether a list of (type, dir, target) includes is nothing but the bare ``tool``."""
    first = F.get(includes, F.lit(0))
    return (F.size(includes) == 1) & (first["type"] == tool) & first["dir"].isNull() & first["target"].isNull()


def binary_folder(path: Column, include: Column, exclude: Column) -> Column:
    """Whether a folder is scanned for binaries: under no excluded prefix, and under an included one if there is any."""
    under = lambda p: F.startswith(path, p)
    return ~F.exists(exclude, under) & ((F.size(include) == 0) | F.exists(include, under))


def result_outcome(found: Column, kept: Column, units: Column, licenses: Column) -> Column:
    """What a scan ends in, from its numbers of projects found and kept and of source units, and the names of its licences."""
    named = F.exists(licenses, lambda x: x != NO_LICENSE)
    return (
        F.when(units > 0, F.when(named, "source and license units").otherwise("source units"))
        .when(~named & (found == 0), "none found").when(~named & (kept == 0), "all filtered").when(~named, "source units")
        .when((found == 0) | (kept == 0), "license units").otherwise("source and license units")
    )


def license_scan_globs(exclude: Column, vendored: Column) -> Column:
    """Globs that a licence scan leaves out: the given ones, and vendored folders with all below them."""
    return F.concat(exclude, F.flatten(F.transform(vendored, lambda d: F.array(F.concat(d, F.lit("/*")), F.concat(d, F.lit("/**"))))))


def of_scan_type(matches: Column, kind: str) -> Column:
    """The matches (name, scan_type, ...) of one type of scan; null if there is none."""
    own = F.filter(matches, lambda m: m["scan_type"] == kind)
    return F.when(F.size(own) > 0, own)


def translated(graph: Graph, locators: DataFrame, aliases: DataFrame) -> Graph:
    """``graph`` with forks named as their base: :func:`translate` for the nodes in ``locators`` (node, fetcher, project, revision)."""
    to = translate(locators, aliases)
    name = F.concat("fetcher", F.lit("+"), "project", F.lit("$"), F.coalesce("revision", F.lit("")))
    return graph.relabel(to.select("node", name.alias("to")))


def central_versions(references: DataFrame, central: DataFrame) -> DataFrame:
    """``references`` (id, version, ...) with missing versions from ``central`` (id, version), ids in any case."""
    known = central.groupBy(F.lower("id").alias("_id")).agg(F.max("version").alias("_version"))
    rows = references.join(known, F.lower("id") == F.col("_id"), "left")
    return rows.withColumn("version", F.coalesce("version", "_version")).drop("_id", "_version")


def module_labels(packages: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, labels): labels (package, label) of the packages of each module (package, module), once each, ascending."""
    rows = modules.join(packages, "package", "left").select("module", "label").distinct()
    return rows.groupBy("module").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def edges_by_id(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(src, dst): names (id, name) of the ends of ``links`` (from_id, to_id); links with an unknown end go."""
    ends = links.join(nodes.select(F.col("id").alias("from_id"), F.col("name").alias("src")), "from_id")
    return ends.join(nodes.select(F.col("id").alias("to_id"), F.col("name").alias("dst")), "to_id").select("src", "dst").distinct()


def resolved_paths(deps: DataFrame, resolved: DataFrame, every: bool = False) -> DataFrame:
    """``deps`` (path, type, version, publishable) with what ``resolved`` (path, new_type, new_version) says; others stay.

    Without ``every`` only dependencies that can be published are looked up.
    """
    rows = deps.join(resolved, "path", "left")
    hit = F.col("new_type").isNotNull() & (F.lit(every) | F.col("publishable"))
    return rows.select("path", F.when(hit, F.col("new_type")).otherwise(F.col("type")).alias("type"), F.when(hit, F.col("new_version")).otherwise(F.col("version")).alias("version"), "publishable")


def concat_refs(first: tuple[DataFrame, DataFrame], second: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Two graphs of numbered nodes (id, node, is_direct) and edges (parent, child) as one: ids of the second follow those of the first."""
    n = first[0].count()
    nodes = second[0].withColumn("id", F.col("id") + n)
    edges = second[1].select((F.col("parent") + n).alias("parent"), (F.col("child") + n).alias("child"))
    return first[0].unionByName(nodes), first[1].unionByName(edges)


def unfolded(seeds: DataFrame, children: DataFrame, direct: bool = True) -> Graph:
    """The graph that grows from ``seeds`` (node) by ``children`` (node, child); a seed is direct if asked.

    Children that are known already are not grown again, so a circle ends.
    """
    edges = children.select(F.col("node").alias("src"), F.col("child").alias("dst"))
    found = reach(edges, seeds.select("node"))
    grown = edges.join(found.withColumnRenamed("node", "src"), "src", "left_semi").select("src", "dst")
    return Graph.build(seeds if direct else seeds.limit(0), grown, found)


def labelled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """``nodes`` (node, ...) with labels: those of ``labels`` (node, label) that the node has, once each, ascending."""
    sets = labels.distinct().groupBy("node").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return nodes.join(sets, "node", "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))


def mapped(keys: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, value) of ``keys`` (key), and the keys without a value: any of these makes a graph over the keys fail."""
    found = keys.join(mapping, "key", "left")
    return found.where("value IS NOT NULL").select("key", "value"), found.where("value IS NULL").select("key").distinct()
