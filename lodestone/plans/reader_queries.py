"""Manifest readers over files that are made from the test tables: one file for each supplier, its parts as packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.registry import Registry
from lodestone.sources import manifests
from lodestone.sources import registry as reading
from lodestone.sources.tables import table

registry = Registry()
query = registry.query

_PACKAGES = """pk AS (SELECT DISTINCT 'f' || l_suppkey AS file, 'p' || l_partkey AS name, '1.' || p_size AS version, 'p' || (l_partkey * 7 + 3) % 2000 AS dep, p_size % 3 = 0 AS dev FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def _packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, name, version, dep, dev): the parts of each supplier; dep is another part's name, in the file or not."""
    k = F.col("l_partkey")
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct().join(table(spark, sf_dir, "part"), k == F.col("p_partkey"))
    text = lambda c: c.cast("string")
    return rows.select(F.concat(F.lit("f"), text(F.col("l_suppkey"))).alias("file"), F.concat(F.lit("p"), text(k)).alias("name"), F.concat(F.lit("1."), text(F.col("p_size"))).alias("version"), F.concat(F.lit("p"), text((k * 7 + 3) % 2000)).alias("dep"), (F.col("p_size") % 3 == 0).alias("dev"))


def _files(rows: DataFrame, item: Column, before: str = "", between: str = "\n", after: str = "", only: Column | None = None) -> DataFrame:
    """(file, content): the items of each file's packages by name, joined."""
    rows = rows if only is None else rows.where(only)
    items = rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("name", item.alias("item")))).alias("x"))
    return items.select("file", F.concat(F.lit(before), F.array_join(F.transform("x", lambda x: x["item"]), between), F.lit(after)).alias("content"))


_ENV = "CASE WHEN dev THEN 'development' ELSE 'production' END"
_ALL = f"WITH {_PACKAGES} SELECT file, name, version, {{env}} AS env, {{direct}} AS is_direct FROM pk"
_EDGES = f"WITH {_PACKAGES} SELECT a.file, {{p}} || a.name AS src, {{p}} || a.dep AS dst FROM pk a JOIN pk b ON b.file = a.file AND b.name = a.dep"
_PLAIN = _ALL.format(env="'production'", direct="true")
_DEEP = _ALL.format(env="'production'", direct="false")


def _npm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _packages(spark, sf_dir)
    item = F.format_string('"node_modules/%s":{"version":"%s","dev":%s,"dependencies":{"%s":"*"}}', "name", "version", F.col("dev").cast("string"), "dep")
    direct = _files(rows, F.format_string('"%s":"*"', "name"), between=",", only=F.col("name").endswith("1")).withColumnRenamed("content", "d")
    body = _files(rows, item, between=",").join(direct, "file", "left")
    return body.select("file", F.concat(F.lit('{"lockfileVersion":3,"packages":{"":{"dependencies":{'), F.coalesce("d", F.lit("")), F.lit("}},"), "content", F.lit("}}")).alias("content"))


@query(_ALL.format(env=_ENV, direct="name LIKE '%1'"))
def reader_npm_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.npm_lock(_npm(spark, sf_dir))


@query(_EDGES.format(p="'node_modules/'"))
def reader_npm_lock_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.npm_lock_edges(_npm(spark, sf_dir))


@query(_ALL.format(env=_ENV, direct="true"))
def reader_package_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _packages(spark, sf_dir)
    part = lambda dev: _files(rows, F.format_string('"%s":"%s"', "name", "version"), between=",", only=F.col("dev") == dev)
    both = part(False).join(part(True).withColumnRenamed("content", "d"), "file", "full")
    text = F.concat(F.lit('{"dependencies":{'), F.coalesce("content", F.lit("")), F.lit('},"devDependencies":{'), F.coalesce("d", F.lit("")), F.lit("}}"))
    return manifests.package_json(both.select("file", text.alias("content")))


def _yarn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(_packages(spark, sf_dir), F.format_string('%s@^1:\n  version "%s"\n  dependencies:\n    %s "^1"', "name", "version", "dep"), "# yarn lockfile v1\n\n", "\n\n", "\n")


@query(_DEEP)
def reader_yarn_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.yarn_v1(_yarn(spark, sf_dir))


@query(_EDGES.format(p="''"))
def reader_yarn_v1_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.yarn_v1_edges(_yarn(spark, sf_dir))


@query(_PLAIN.replace("version, 'production'", "'==' || version AS version, 'production'"))
def reader_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.requirements(_files(_packages(spark, sf_dir), F.format_string("%s==%s  # pinned", "name", "version"), "-r other.txt\n# all\n", after="\ngit+https://x/y\n"))


@query(_ALL.format(env=_ENV, direct="false"))
def reader_pipfile_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _packages(spark, sf_dir)
    part = lambda dev: _files(rows, F.format_string('"%s":{"version":"==%s"}', "name", "version"), between=",", only=F.col("dev") == dev)
    both = part(False).join(part(True).withColumnRenamed("content", "d"), "file", "full")
    text = F.concat(F.lit('{"default":{'), F.coalesce("content", F.lit("")), F.lit('},"develop":{'), F.coalesce("d", F.lit("")), F.lit("}}"))
    return manifests.pipfile_lock(both.select("file", text.alias("content")))


def _toml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(_packages(spark, sf_dir), F.format_string('[[package]]\nname = "%s"\nversion = "%s"\ndependencies = [\n "%s",\n]\n', "name", "version", "dep"), "version = 3\n\n")


@query(_DEEP)
def reader_toml_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.toml_packages(_toml(spark, sf_dir))


@query(f"WITH {_PACKAGES} SELECT file, name AS src, dep AS dst FROM pk")
def reader_toml_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.toml_edges(_toml(spark, sf_dir))


def _gems(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _packages(spark, sf_dir)
    direct = _files(rows, F.format_string("  %s!", "name"), only=F.col("name").endswith("1")).withColumnRenamed("content", "d")
    specs = _files(rows, F.format_string("    %s (%s)\n      %s (>= 1)", "name", "version", "dep"), "GEM\n  remote: https://x/\n  specs:\n").join(direct, "file", "left")
    return specs.select("file", F.concat("content", F.lit("\n\nPLATFORMS\n  ruby\n\nDEPENDENCIES\n"), F.coalesce("d", F.lit("")), F.lit("\n")).alias("content"))


@query(_ALL.format(env="'production'", direct="name LIKE '%1'"))
def reader_gemfile_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.gemfile_lock(_gems(spark, sf_dir))


@query(f"WITH {_PACKAGES} SELECT file, name AS src, dep AS dst FROM pk")
def reader_gemfile_lock_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.gemfile_lock_edges(_gems(spark, sf_dir))


@query(f"""WITH {_PACKAGES} SELECT file, CASE WHEN name LIKE '%7' THEN 'fork/' || name ELSE 'x.org/' || name END AS name, CASE WHEN name LIKE '%7' THEN 'v9.0.0' ELSE 'v' || version || '.0' END AS version, 'production' AS env, true AS is_direct FROM pk WHERE name NOT LIKE '%8'""")
def reader_go_mod(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _packages(spark, sf_dir)
    need = F.concat(F.format_string("\tx.org/%s v%s.0", "name", "version"), F.when(F.col("dev"), " // indirect").otherwise(""))
    swap = _files(rows, F.when(F.col("name").endswith("7"), F.format_string("\tx.org/%s => fork/%s v9.0.0", "name", "name")).otherwise(F.format_string("\tx.org/%s => ../local", "name")), only=F.rlike("name", F.lit("[78]$"))).withColumnRenamed("content", "r")
    body = _files(rows, need, "module x\n\ngo 1.20\n\nrequire (\n", after="\n)\n").join(swap, "file", "left")
    return manifests.go_mod(body.select("file", F.concat("content", F.lit("\nreplace (\n"), F.coalesce("r", F.lit("")), F.lit("\n)\n")).alias("content")))


def _composer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _packages(spark, sf_dir)
    part = lambda dev: _files(rows, F.format_string('{"name":"%s","version":"%s","require":{"%s":"*"}}', "name", "version", "dep"), between=",", only=F.col("dev") == dev)
    both = part(False).join(part(True).withColumnRenamed("content", "d"), "file", "full")
    return both.select("file", F.concat(F.lit('{"packages":['), F.coalesce("content", F.lit("")), F.lit('],"packages-dev":['), F.coalesce("d", F.lit("")), F.lit("]}")).alias("content"))


@query(_ALL.format(env=_ENV, direct="true"))
def reader_composer_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.composer_lock(_composer(spark, sf_dir))


@query(f"WITH {_PACKAGES} SELECT file, name AS src, dep AS dst FROM pk")
def reader_composer_lock_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.composer_lock_edges(_composer(spark, sf_dir))


@query(_PLAIN)
def reader_packages_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.packages_config(_files(_packages(spark, sf_dir), F.format_string('<package id="%s" version="%s" />', "name", "version"), "<packages>", "", "</packages>"))


@query(f"""WITH {_PACKAGES} SELECT file, 'g:' || name AS name, CASE WHEN name LIKE '%2' THEN '7.7' WHEN name LIKE '%3' THEN 'PROPERTY NOT FOUND: no.such' ELSE version END AS version, CASE WHEN dev THEN 'testing' ELSE 'production' END AS env, true AS is_direct FROM pk""")
def reader_pom(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = F.when(F.col("name").endswith("2"), "${lib.version}").when(F.col("name").endswith("3"), "${no.such}").otherwise(F.col("version"))
    item = F.concat(F.lit("<dependency><groupId>g</groupId><artifactId>"), "name", F.lit("</artifactId><version>"), version, F.lit("</version>"), F.when(F.col("dev"), "<scope>test</scope>").otherwise(""), F.lit("</dependency>"))
    managed = "<dependencyManagement><dependencies><dependency><groupId>m</groupId><artifactId>m</artifactId></dependency></dependencies></dependencyManagement>"
    return manifests.pom(_files(_packages(spark, sf_dir), item, f"<project><properties><lib.version>7.7</lib.version></properties>{managed}<dependencies>\n", after="\n</dependencies></project>"))


@query(_DEEP)
def reader_renv_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.renv_lock(_files(_packages(spark, sf_dir), F.format_string('"%s":{"Package":"%s","Version":"%s","Source":"Repository"}', "name", "name", "version"), '{"Packages":{', ",", "}}"))


@query(_PLAIN)
def reader_conda_environment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.conda_environment(_files(_packages(spark, sf_dir), F.format_string("  - %s=%s", "name", "version"), "name: env\ndependencies:\n", after="\n  - pip:\nprefix: /x\n"))


@query(_DEEP)
def reader_swift_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.swift_resolved(_files(_packages(spark, sf_dir), F.format_string('{"location":"%s","state":{"version":"%s"}}', "name", "version"), '{"version":2,"pins":[', ",", "]}"))


@query(_PLAIN)
def reader_cartfile_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.cartfile_resolved(_files(_packages(spark, sf_dir), F.format_string('github "%s" "%s"', "name", "version")))


@query(_PLAIN.replace("version, 'production'", "'x86_64#' || version AS version, 'production'"))
def reader_apk_installed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.apk_installed(_files(_packages(spark, sf_dir), F.format_string("C:Q1\nP:%s\nV:%s\nA:x86_64\n", "name", "version"), after="\n\nP:broken\n"))


@query(_PLAIN.replace("version, 'production'", "'amd64#' || version AS version, 'production'"))
def reader_dpkg_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _files(_packages(spark, sf_dir), F.format_string("Package: %s\nStatus: ok\nArchitecture: amd64\nVersion: %s\nDescription: a\n b\n", "name", "version"))
    bad = good.select(F.concat(F.lit("bad"), "file").alias("file"), F.concat("content", F.lit("\n\nPackage: broken\n")).alias("content"))
    return manifests.dpkg_status(good.unionByName(bad))


@query(f"""WITH {_PACKAGES} SELECT 'requirements' AS reader, 'a/' || file || '/requirements-dev.txt' AS file, name, '==' || version AS version, 'production' AS env, true AS is_direct FROM pk
UNION ALL SELECT 'cartfile_resolved', file || '/Cartfile.resolved', name, version, 'production', true FROM pk""")
def reader_discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _packages(spark, sf_dir)
    named = lambda df, before, after: df.select(F.concat(F.lit(before), "file", F.lit(after)).alias("path"), "content")
    pins = _files(rows, F.format_string("%s==%s", "name", "version"))
    carts = _files(rows, F.format_string('github "%s" "%s"', "name", "version"))
    return reading.read_all(named(pins, "a/", "/requirements-dev.txt").unionByName(named(carts, "", "/Cartfile.resolved")).unionByName(named(pins, "", "/notes.md")))


@query("""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN lower(n_name) WHEN 1 THEN 'redhat' WHEN 2 THEN 'busybox' ELSE 'linux' END AS id, CASE n_nationkey % 4 WHEN 0 THEN n_regionkey::VARCHAR WHEN 1 THEN '7.' || n_regionkey WHEN 2 THEN '1.3' || n_regionkey END AS version FROM nation""")
def container_os_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, r = F.col("n_nationkey") % 4, F.col("n_regionkey").cast("string")
    release = F.when(m == 0, F.concat(F.lit('NAME=x\nID="'), F.lower("n_name"), F.lit('"\nVERSION_ID='), r, F.lit("\n")))
    cpe = F.when(m == 1, F.concat(F.lit("cpe:/o:vendor:redhat:7."), r, F.lit(":ga\n")))
    banner = F.when(m == 2, F.concat(F.lit("BusyBox v1.3"), r, F.lit(" (2020)")))
    return table(spark, sf_dir, "nation").select("n_nationkey", manifests.os_identity(release, cpe, banner).alias("o")).select("n_nationkey", "o.id", "o.version")
