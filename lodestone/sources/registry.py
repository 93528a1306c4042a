"""Which reader takes which file, and reading a whole listing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.scratch import materialise
from lodestone.sources import locks, manifests

# File names, or ends of paths, by which manifests are found, with the reader of each.
RULES: tuple[tuple[str, Callable[[DataFrame], DataFrame]], ...] = (
    (r"package-lock\.json", manifests.npm_lock),
    (r"package\.json", manifests.package_json),
    (r"yarn\.lock", manifests.yarn_v1),
    (r"pnpm-lock\.ya?ml", locks.pnpm_lock),
    (r"bun\.lock", locks.bun_lock),
    (r"requirements.*\.txt", manifests.requirements),
    (r"Pipfile\.lock", manifests.pipfile_lock),
    (r"poetry\.lock|uv\.lock|Cargo\.lock|pdm\.lock", manifests.toml_packages),
    (r"Gemfile\.lock", manifests.gemfile_lock),
    (r"go\.mod", manifests.go_mod),
    (r"Gopkg\.lock", locks.gopkg_lock),
    (r"glide\.lock", locks.glide_lock),
    (r"composer\.lock", manifests.composer_lock),
    (r"packages\.config", manifests.packages_config),
    (r"project\.assets\.json", locks.project_assets),
    (r"paket\.lock", locks.paket_lock),
    (r"pom\.xml", manifests.pom),
    (r"renv\.lock", manifests.renv_lock),
    (r"environment\.ya?ml", manifests.conda_environment),
    (r"Package\.resolved", manifests.swift_resolved),
    (r"Cartfile\.resolved", manifests.cartfile_resolved),
    (r"Podfile\.lock", locks.podfile_lock),
    (r"pubspec\.lock", locks.pubspec_lock),
    (r"META\.json|MYMETA\.json", locks.perl_meta),
    (r"[^/]+\.spec", locks.rpm_spec),
    (r"lib/apk/db/installed", manifests.apk_installed),
    (r"var/lib/dpkg/status|var/lib/dpkg/status\.d/[^/]*(?<!\.md5sums)", manifests.dpkg_status),
)


def discover(files: DataFrame) -> DataFrame:
    """``files`` (path, ...) that some rule names, with reader."""
    reader = F.lit(None).cast("string")
    for pattern, read in reversed(RULES):
        reader = F.when(F.rlike("path", F.lit(f"(?:^|/)(?:{pattern})$")), read.__name__).otherwise(reader)
    return files.withColumn("reader", reader).where("reader IS NOT NULL")


def _routed(files: DataFrame) -> DataFrame:
    """(file, content, reader): discovered files by the reader that their path and, for two kinds of locks, their content ask for."""
    found = discover(files).withColumnRenamed("path", "file")
    berry = (F.col("reader") == "yarn_v1") & F.contains("content", F.lit("__metadata:"))
    old = (F.col("reader") == "npm_lock") & ~F.rlike("content", F.lit(r'"lockfileVersion"\s*:\s*3\b')) & F.contains("content", F.lit('"dependencies"')) & ~F.contains("content", F.lit('"packages"'))
    return found.withColumn("reader", F.when(berry, "yarn_berry").when(old, "npm_v1").otherwise(F.col("reader")))


def read_all(files: DataFrame) -> DataFrame:
    """Dependencies of ``files`` (path, content), each by the reader that its path asks for: (reader, file, name, version, env, is_direct).

    Locks of yarn 2 are told from those of version 1, and npm locks that keep their packages as a tree from later ones,
    by their content; what is direct in such a tree is said by the package.json beside it. Files are routed once, into a
    table that lies in the order of readers, so that each reads its own part.
    """
    found = materialise(_routed(files).repartitionByRange(F.col("reader"), F.col("file")).sortWithinPartitions("reader"), "routed")
    mine = lambda name: found.where(F.col("reader") == name).select("file", "content")
    beside = F.regexp_replace("file", r"package\.json$", "package-lock.json")
    asked = manifests.package_json(mine("package_json")).select(beside.alias("file"), "name")
    out = locks.npm_v1(mine("npm_v1"), asked).select(F.lit("npm_v1").alias("reader"), "*")
    for read in dict.fromkeys([r for _, r in RULES] + [locks.yarn_berry]):
        out = out.unionByName(read(mine(read.__name__)).select(F.lit(read.__name__).alias("reader"), "*"))
    return out


def unread(files: DataFrame, rows: DataFrame) -> DataFrame:
    """(file, reader): discovered ``files`` of which ``rows``, as :func:`read_all` gives them, hold nothing: empty or broken."""
    return _routed(files).select("file", "reader").join(rows.select("file").distinct(), "file", "left_anti")
