"""Joins of the analysis: aliases, labels, version look-ups, rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.paths import ancestors


def translate(locators: DataFrame, aliases: DataFrame) -> DataFrame:
    """``locators`` (fetcher, project, revision, ...) with forks named as their base.

    ``aliases``: (fetcher, project, version, base_fetcher, base_project, base_version, ord). Of several for one project
    the last counts; one with a version needs an equal revision; the base's version, if any, becomes the revision.
    """
    last = aliases.groupBy("fetcher", "project").agg(F.max_by(F.struct("version", "base_fetcher", "base_project", "base_version"), "ord").alias("_a"))
    rows = locators.join(last, ["fetcher", "project"], "left")
    a, hit = F.col("_a"), F.col("_a").isNotNull() & F.coalesce(F.col("_a.version").isNull() | (F.col("_a.version") == F.col("revision")), F.lit(False))
    return rows.withColumns(
        {
            "fetcher": F.when(hit, a["base_fetcher"]).otherwise(F.col("fetcher")),
            "project": F.when(hit, a["base_project"]).otherwise(F.col("project")),
            "revision": F.when(hit, F.coalesce(a["base_version"], "revision")).otherwise(F.col("revision")),
        }
    ).drop("_a")


def merge_labels(units: DataFrame, alias_labels: DataFrame) -> DataFrame:
    """(unit, locator, labels): the labels of each unit's locators, those of aliases first.

    ``units``: (unit, locator, labels array); ``alias_labels``: (locator, labels array). Labels of locators that the unit
    has not are left out.
    """
    rows = units.join(alias_labels.withColumnRenamed("labels", "_more"), "locator", "left")
    none = F.array().cast("array<string>")
    return rows.select("unit", "locator", F.concat(F.coalesce("_more", none), F.coalesce("labels", none)).alias("labels"))


def split_known(rows: DataFrame, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is known, the others)."""
    return rows.join(known.select(key).distinct(), key, "left_semi"), rows.join(known.select(key).distinct(), key, "left_anti")


def first_of(rows: DataFrame, lookups: list[tuple[DataFrame, list[str]]], value: str, otherwise: Column) -> DataFrame:
    """``rows`` with ``value`` from the first look-up that has it; each is a table of its keys and the value."""
    found = []
    for i, (t, keys) in enumerate(lookups):
        rows = rows.join(t.select(*keys, F.col(value).alias(f"_v{i}")), keys, "left")
        found.append(F.col(f"_v{i}"))
    return rows.withColumn(value, F.coalesce(*found, otherwise)).drop(*[f"_v{i}" for i in range(len(lookups))])


def replaced(requires: DataFrame, replaces: DataFrame) -> DataFrame:
    """``requires`` (package, version) under ``replaces`` (package, new_package, new_version, is_local): local ones vanish."""
    rows = requires.join(replaces, "package", "left")
    rows = rows.where("NOT coalesce(is_local, false)")
    return rows.select(F.coalesce("new_package", "package").alias("package"), F.coalesce("new_version", "version").alias("version"))


def members(manifests: DataFrame, patterns: DataFrame) -> DataFrame:
    """(root, dir): folders of ``manifests`` (dir) that the workspace ``patterns`` (root, regex, negated) of another folder match.

    The patterns are few, written by hand in manifests: the join on a pattern sends the patterns to the folders.
    """
    pairs = manifests.join(patterns, F.rlike("dir", F.col("regex")) & (F.col("dir") != F.col("root")))
    return pairs.groupBy("root", "dir").agg(F.bool_or("negated").alias("out")).where("NOT out").select("root", "dir")


def owning_rule(paths: DataFrame, rules: DataFrame, col: str = "path") -> DataFrame:
    """``paths`` with prefix and rule of the shortest prefix among ``rules`` (prefix, rule) that is an ancestor or the path itself.

    An equi join on each path's ancestors, not a comparison with every rule.
    """
    candidates = paths.select(col, F.explode(F.array_append(ancestors(F.col(col)), F.col(col))).alias("prefix")).distinct()
    best = candidates.join(rules, "prefix").groupBy(col).agg(F.min_by(F.struct("prefix", "rule"), F.struct(F.length("prefix"), "prefix", "rule")).alias("r"))
    return paths.join(best, col, "left").select(*paths.columns, F.col("r.prefix").alias("prefix"), F.col("r.rule").alias("rule"))


def overlay_parents(properties: DataFrame, lineage: DataFrame) -> DataFrame:
    """(node, key, value): inherited properties, a nearer one before a farther.

    ``lineage``: (node, ancestor, depth) with the node itself at depth 0; ``properties``: (node, key, value).
    """
    own = properties.withColumnRenamed("node", "ancestor")
    return lineage.join(own, "ancestor").groupBy("node", "key").agg(F.min_by("value", "depth").alias("value"))
