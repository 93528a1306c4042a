"""Walks over a listing of files, as joins on folders. A listing has one row a file, with its path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.paths import basename, glob_regex


def folder(path: Column) -> Column:
    """The folder of a path; '' at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def folders(path: Column) -> Column:
    """All folders that a path lies in, the top folder '' first."""
    parts = F.filter(F.split(folder(path), "/"), lambda x: x != "")
    steps = F.sequence(F.lit(0), F.size(parts))
    return F.transform(steps, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def walk(files: DataFrame, skipped: DataFrame) -> DataFrame:
    """``files`` (path, ...) that a walk reaches which does not enter the folders in ``skipped`` (folder)."""
    places = files.select("path", F.explode(folders(F.col("path"))).alias("folder"))
    hidden = places.join(skipped.select("folder").distinct(), "folder", "left_semi").select("path").distinct()
    return files.join(hidden, "path", "left_anti")


def listed_folders(files: DataFrame) -> DataFrame:
    """(folder): every folder of a listing."""
    return files.select(F.explode(folders(F.col("path"))).alias("folder")).distinct()


def filtered_walk(files: DataFrame, allowed: Column) -> DataFrame:
    """``files`` below allowed folders only; ``allowed`` tests a column ``folder``."""
    return walk(files, listed_folders(files).where(~F.coalesce(allowed, F.lit(False)) & (F.col("folder") != "")))


def pruned_subtrees(files: DataFrame, allowed: Column) -> DataFrame:
    """(folder): topmost folders that are not allowed."""
    bad = listed_folders(files).where(~F.coalesce(allowed, F.lit(False)) & (F.col("folder") != ""))
    above = bad.select("folder", F.explode(folders(F.concat("folder", F.lit("/")))).alias("up")).where("up <> folder")
    inner = above.join(bad.select(F.col("folder").alias("up")), "up", "left_semi").select("folder").distinct()
    return bad.join(inner, "folder", "left_anti")


def collected(files: DataFrame, value: str) -> DataFrame:
    """(folder, values): the values of each folder's files in the order of their paths."""
    rows = files.groupBy(folder(F.col("path")).alias("folder")).agg(F.array_sort(F.collect_list(F.struct("path", F.col(value).alias("v")))).alias("x"))
    return rows.select("folder", F.transform("x", lambda x: x["v"]).alias("values"))


def nearest_above(places: DataFrame, files: DataFrame, name: str) -> DataFrame:
    """``places`` (folder) with found: the path of the file ``name`` in the folder or the nearest above it; null if there is none."""
    own = files.where(basename(F.col("path")) == name).select(folder(F.col("path")).alias("up"), F.col("path").alias("found"))
    ups = places.select("folder", F.explode(folders(F.concat("folder", F.lit("/")))).alias("up")).distinct()
    best = ups.join(own, "up").groupBy("folder").agg(F.max_by("found", F.length("up")).alias("found"))
    return places.join(best, "folder", "left")


def first_named(files: DataFrame, names: list[str]) -> DataFrame:
    """(folder, path): of each folder's files with one of ``names``, the first in the listing's order (ord)."""
    own = files.where(basename(F.col("path")).isin(names))
    return own.groupBy(folder(F.col("path")).alias("folder")).agg(F.min_by("path", "ord").alias("path"))


def matching(files: DataFrame, globs: list[str]) -> DataFrame:
    """``files`` whose name matches one of ``globs``."""
    return files.where(F.rlike(basename(F.col("path")), F.lit("|".join(glob_regex(g) for g in globs))))


def glob_below(base: Column, glob: Column) -> Column:
    """A glob below a folder, without ``./`` and doubled slashes."""
    joined = F.concat_ws("/", base, glob)
    return F.regexp_replace(F.regexp_replace(joined, r"(^|/)(\./)+", "$1"), "/{2,}", "/")


def working_command(runs: DataFrame) -> DataFrame:
    """(job, command, stdout) of the first candidate that worked, by ord.

    ``runs`` holds captured output: (job, ord, command, policy, exit_code, stdout). A run that failed counts as working
    under the policy ``always``, and under ``non-empty`` if it wrote something.
    """
    ok = (F.col("exit_code") == 0) | (F.col("policy") == "always") | ((F.col("policy") == "non-empty") & (F.length("stdout") > 0))
    best = runs.where(ok).groupBy("job").agg(F.min_by(F.struct("command", "stdout"), "ord").alias("b"))
    return best.select("job", "b.command", "b.stdout")


def last_commits(logs: DataFrame) -> DataFrame:
    """(repository, email, last): the latest date of each e-mail in logs of ``email|date`` lines; lines without a bar are left out."""
    line = logs.select("repository", F.explode(F.split("log", r"\r?\n")).alias("t")).where("instr(t, '|') > 0")
    rows = line.select("repository", F.substring_index("t", "|", 1).alias("email"), F.to_date(F.substring(F.trim(F.expr("substr(t, instr(t, '|') + 1)")), 1, 10)).alias("day"))
    return rows.groupBy("repository", "email").agg(F.max("day").alias("last"))
