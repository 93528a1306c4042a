"""Target filters: which projects and which of their targets are analysed."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.paths import glob_regex

GRAMMAR = r"^([A-Za-z0-9]+)(?:@([^:]+)(?::(.+))?)?$"
_NONE = "array<string>"


def parse_filter(text: Column) -> Column:
    """A struct of type, dir and target of ``type``, ``type@dir`` or ``type@dir:target``; null for other text."""
    part = lambda i: F.nullif(F.regexp_extract(text, GRAMMAR, i), F.lit(""))
    return F.when(F.rlike(text, F.lit(GRAMMAR)), F.struct(part(1).alias("type"), part(2).alias("dir"), part(3).alias("target")))


@dataclass(frozen=True)
class Filters:
    """What a user gives: (type, dir, target) triples, folders and globs."""

    targets: Sequence[tuple[str, str | None, str | None]] = ()
    paths: Sequence[str] = ()
    globs: Sequence[str] = ()

    def __bool__(self) -> bool:
        return bool(self.targets or self.paths or self.globs)


def _match(filters: Filters, kind: Column, folder: Column, default: str) -> Column:
    """(hit none/all/some, targets): a filter for one target beats one for all."""
    if not filters:
        return F.struct(F.lit(default).alias("hit"), F.array().cast(_NONE).alias("targets"))
    everything, some = F.lit(False), []
    for t, d, target in filters.targets:
        test = (kind == t) & (folder == d if d else F.lit(True))
        if target:
            some.append(F.when(test, F.lit(target)))
        else:
            everything = everything | test
    for p in filters.paths:
        everything = everything | (folder == p) | F.startswith(folder, F.lit(p + "/"))
    for g in filters.globs:
        everything = everything | F.rlike(folder, F.lit(glob_regex(g)))
    named = F.filter(F.array(*some).cast(_NONE), lambda x: x.isNotNull())
    return F.struct(F.when(F.size(named) > 0, "some").when(everything, "all").otherwise("none").alias("hit"), named.alias("targets"))


def apply_filters(projects: DataFrame, include: Filters = Filters(), exclude: Filters = Filters()) -> DataFrame:
    """``projects`` (type, dir, targets array or null) that stay, with the targets that stay.

    Excluded wholly or not included: gone. Included in part: the named targets that there are. Excluded in part: the
    others. A project that has no targets stays whenever anything of it would; one whose targets all go is gone.
    """
    rows = projects.withColumn("_in", _match(include, F.col("type"), F.col("dir"), "all")).withColumn("_out", _match(exclude, F.col("type"), F.col("dir"), "none"))
    i, o, t = F.col("_in"), F.col("_out"), F.col("targets")
    left = F.array_except(i["targets"], o["targets"])  # a list of names without repeats
    gone = (o["hit"] == "all") | (i["hit"] == "none") | ((i["hit"] == "some") & (o["hit"] == "some") & (F.size(left) == 0))
    kept = F.when(i["hit"] == "some", F.array_intersect(t, F.when(o["hit"] == "some", left).otherwise(i["targets"]))).when(o["hit"] == "some", F.array_except(t, o["targets"])).otherwise(t)
    return rows.where(~gone).withColumn("targets", kept).where("targets IS NULL OR size(targets) > 0").drop("_in", "_out")


def allowed_tools(tools: DataFrame, include: Sequence[tuple[str, str | None, str | None]] = (), exclude: Sequence[tuple[str, str | None, str | None]] = ()) -> DataFrame:
    """``tools`` (type): those that filters name, all without any; exclusions count only if they name a type alone."""
    out = tools
    if include:
        out = out.where(F.col("type").isin(*{t for t, _, _ in include}))
    pure = {t for t, d, _ in exclude if d is None}
    return out.where(~F.col("type").isin(*pure)) if pure else out
