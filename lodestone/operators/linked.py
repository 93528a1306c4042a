"""Dynamically linked files and the system packages that own them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.locators import linux_package
from lodestone.functions.paths import parent, resolve_link
from lodestone.operators.closure import lineage
from lodestone.plans.scratch import materialise


def linked_files(printed: DataFrame) -> DataFrame:
    """(file, path): the files that binaries are linked with, from what `ldd` printed for each (file, content).

    Lines of a name and a path count; the loader, the kernel's library and what was not found do not. Each path once.
    """
    line = printed.select("file", F.explode(F.split("content", r"\r?\n")).alias("t"))
    path = F.regexp_extract("t", r"^\s*\S+\s+=>\s+(/\S+)\s+\(0x[0-9a-fA-F]+\)\s*$", 1)
    return line.select("file", path.alias("path")).where("path <> ''").distinct()


def real_paths(paths: DataFrame, links: DataFrame) -> DataFrame:
    """(path, real): where each of ``paths`` (path) ends over symbolic ``links`` (path, target); null if they lead in a circle.

    A target is seen from its link's folder. Chains are followed by pointer jumping, in rounds of their length's logarithm.
    """
    to = F.concat(F.lit("/"), resolve_link(F.col("target"), parent(F.col("path"))))
    hops = materialise(links.where("path IS NOT NULL AND target IS NOT NULL").select(F.col("path").alias("node"), to.alias("to")).dropDuplicates(["node"]), "file-links")
    line = lineage(hops, paths.select(F.col("path").alias("node")).distinct())
    last = line.groupBy("node").agg(F.max_by("ancestor", "depth").alias("real"))
    ends = last.join(hops.select(F.col("node").alias("real"), F.lit(True).alias("goes_on")).distinct(), "real", "left")
    return ends.select(F.col("node").alias("path"), F.when(F.col("goes_on").isNull(), F.col("real")).alias("real"))


def owners(linked: DataFrame, links: DataFrame, owned: DataFrame, system: str, release: str) -> tuple[DataFrame, DataFrame]:
    """Dependencies (file, type, name, version) of ``linked`` (file, path), and (file, path) of what no package owns.

    ``owned``: (path, type, package, version, arch, epoch), the files of the packages of ``system`` at its ``release``, of
    type deb, rpm or apk. A file belongs to the package that lists its path, else to the one that lists the file that its
    links lead to. Only versions of rpm packages show an epoch.
    """
    real = real_paths(linked, links)
    facts = F.struct("type", "package", "version", "arch", F.when(F.col("type") == "rpm", F.col("epoch")).alias("epoch"))
    first = owned.groupBy("path").agg(F.min(facts).alias("o"))
    rows = linked.join(real, "path", "left").join(first.withColumnRenamed("o", "_own"), "path", "left")
    rows = rows.join(first.select(F.col("path").alias("real"), F.col("o").alias("_end")), "real", "left").select("file", "path", F.coalesce("_own", "_end").alias("o"))
    rows = materialise(rows, "file-owners")
    known = rows.where("o IS NOT NULL").select("file", "o.*").distinct()
    at = linux_package(F.col("package"), F.lit(system), F.lit(release), F.col("arch"), F.col("epoch"), F.col("version"), F.lit(None).cast("string"))
    return known.select("file", "type", at["project"].alias("name"), at["revision"].alias("version")), rows.where("o IS NULL").select("file", "path")
