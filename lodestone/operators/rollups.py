"""Roll-ups, de-duplication and ordering of analysis results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.paths import parent
from lodestone.operators.numbering import numbered


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """(key, n): keys of more than one row."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def minimal_prefixes(paths: DataFrame, col: str = "path") -> DataFrame:
    """(prefix): parents of ``paths`` below no other of these parents."""
    folders = paths.select(parent(F.col(col)).alias("prefix")).distinct()
    up = folders.select("prefix", F.explode(_proper(F.col("prefix"))).alias("_up"))
    below = up.join(folders.select(F.col("prefix").alias("_up")), "_up", "left_semi").select("prefix").distinct()
    return folders.join(below, "prefix", "left_anti")


def _proper(folder: Column) -> Column:
    """Proper ancestors of a folder, each with a slash at its end."""
    s = F.split(F.regexp_replace(folder, "/$", ""), "/")
    n = F.size(s) - 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.array_join(F.slice(s, F.lit(1), i), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))


def folded_prefixes(sorted_paths: Column) -> Column:
    """Prefixes as a fold from the last path to the first finds them: one prefix is held, and a path outside it sets the next.

    It starts with the first path's parent and can give a prefix below another; :func:`minimal_prefixes` does not.
    """
    first = F.array(F.regexp_extract(sorted_paths[0], r"^(.*/)", 1))
    rest = F.reverse(F.slice(sorted_paths, F.lit(2), F.greatest(F.size(sorted_paths) - 1, F.lit(0))))
    step = lambda acc, p: F.when(F.startswith(p, acc[0]), acc).otherwise(F.concat(F.array(F.regexp_extract(p, r"^(.*/)", 1)), acc))
    return F.aggregate(rest, first, step)


def squash_layers(changes: DataFrame) -> DataFrame:
    """(image, path, seq): files that live after all layer changes.

    ``changes``: (image, path, seq, op insert or remove). The last insertion of a path counts; a later removal of the path
    or of a folder above it ends it. Removals are joined by each path's ancestors.
    """
    puts = changes.where("op = 'insert'").groupBy("image", "path").agg(F.max("seq").alias("seq"))
    cuts = changes.where("op = 'remove'").groupBy("image", F.col("path").alias("_up")).agg(F.max("seq").alias("_cut"))
    s = F.split("path", "/")
    ups = puts.select("image", "path", "seq", F.explode(F.transform(F.sequence(F.lit(1), F.size(s)), lambda i: F.array_join(F.slice(s, F.lit(1), i), "/"))).alias("_up"))
    dead = ups.join(cuts, ["image", "_up"]).where("_cut > seq").select("image", "path").distinct()
    return puts.join(dead, ["image", "path"], "left_anti")


def scan_counts(scans: DataFrame) -> DataFrame:
    """One row of counts over ``scans`` (status, warnings)."""
    return scans.agg(
        F.count("*").alias("projects"),
        F.count_if(F.col("status").startswith("skipped")).alias("skipped"),
        F.count_if(F.col("status") == "succeeded").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.coalesce(F.sum("warnings"), F.lit(0)).alias("warnings"),
    )


def scan_order(status: Column, warnings: Column) -> list[Column]:
    """Sort keys of scans: failures first, then successes by falling warnings, then what was skipped."""
    rank = F.when(status == "failed", 0).when(status == "succeeded", 1).when(status == "skipped by filter", 2).otherwise(3)
    return [rank, warnings.desc()]


def batches(rows: DataFrame, order: list[str], size: int = 1000) -> DataFrame:
    """``rows`` with batch: 0.. for each ``size`` rows in order, the last may be short."""
    out, _ = numbered(rows, order, "_no")
    return out.withColumn("batch", F.floor(F.col("_no") / size).cast("long")).drop("_no")


def shortest(rows: DataFrame, keys: list[str], col: str, order: str) -> DataFrame:
    """(keys..., col): each key's shortest value, the first by ``order`` on ties."""
    return rows.groupBy(*keys).agg(F.min_by(col, F.struct(F.length(col), order)).alias(col))


def combine_units(units: DataFrame) -> DataFrame:
    """(name, n, dir, files, data): units of one name as one.

    ``units``: (name, ord, dir, files array, data array). Several are merged into sorted sets; a lone unit keeps order and
    repeats; other fields come from the first.
    """
    out = units.groupBy("name").agg(
        F.count("*").alias("n"), F.min_by("dir", "ord").alias("dir"), F.min_by("files", "ord").alias("_f"), F.min_by("data", "ord").alias("_d"), F.collect_list("files").alias("_fs"), F.collect_list("data").alias("_ds")
    )
    both = lambda one, many: F.when(F.col("n") == 1, F.col(one)).otherwise(F.array_sort(F.array_distinct(F.flatten(F.col(many)))))
    return out.select("name", "n", "dir", both("_f", "_fs").alias("files"), both("_d", "_ds").alias("data"))


def match_units(matches: DataFrame) -> DataFrame:
    """(title, path, n, length): regex matches by title and path."""
    return matches.groupBy(F.col("name").alias("title"), "path").agg(F.count("*").alias("n"), F.sum(F.char_length("match")).alias("length"))


def new_issues(now: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """Issues that were not there before."""
    return now.join(before.select(*keys).distinct(), keys, "left_anti")


def first_success(results: DataFrame, key: str, order: str) -> DataFrame:
    """(key, value, tactic): the first tactic that succeeded for each key; null where all failed."""
    ok = F.when(F.col("status") == "succeeded", F.struct("value", "tactic"))
    return results.groupBy(key).agg(F.min_by(ok, F.when(F.col("status") == "succeeded", F.col(order))).alias("r")).select(key, "r.value", "r.tactic")
