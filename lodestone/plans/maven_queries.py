"""Maven projects made from the test tables: forty parts each are one repository, a tree of modules below its first part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.registry import Registry
from lodestone.sources import maven
from lodestone.sources.tables import table

registry = Registry()
query = registry.query

#: Module i hangs on module i / 2. Odd ones inherit group and version; every third sets ${v}, every fourth manages a library.
_NODES = "n AS (SELECT p_partkey AS k, p_partkey // 40 AS r, p_partkey % 40 AS i, CAST(p_size AS VARCHAR) AS size FROM part)"
_DEPS = f"""{_NODES}, line(k, a, d) AS (SELECT k, k, 0 FROM n UNION ALL SELECT k, (a // 40) * 40 + (a % 40) // 2, d + 1 FROM line WHERE a % 40 > 0),
raw AS (SELECT l.k, l.d, 'lib' || n.i % 5 AS lib, CASE WHEN n.i % 2 = 0 THEN '${{v}}' END AS version, CASE WHEN n.i % 7 = 0 THEN 'test' WHEN n.i % 7 = 1 THEN 'runtime' END AS scope FROM line l JOIN n ON n.k = l.a),
own AS (SELECT k, lib, arg_min(version, d) FILTER (version IS NOT NULL) AS version, arg_min(scope, d) FILTER (scope IS NOT NULL) AS scope FROM raw GROUP BY k, lib),
managed AS (SELECT l.k, 'lib' || (n.i // 4) % 5 AS lib, arg_min('m' || n.size, l.d) AS version FROM line l JOIN n ON n.k = l.a WHERE n.i % 4 = 0 GROUP BY 1, 2),
v AS (SELECT l.k, arg_min(n.size, l.d) AS v FROM line l JOIN n ON n.k = l.a WHERE n.i % 3 = 0 GROUP BY 1),
deps AS (SELECT own.k, own.k // 40 AS r, 'x:' || own.lib AS name, replace(coalesce(own.version, managed.version), '${{v}}', v.v) AS version, own.scope FROM own LEFT JOIN managed ON managed.k = own.k AND managed.lib = own.lib JOIN v ON v.k = own.k)"""
_PACKAGES = f"""{_DEPS}, packages AS (SELECT r, name, version, false AS is_direct, scope FROM deps UNION ALL SELECT r, 'g:m' || k, '1', i = 0, NULL FROM n),
whole AS (SELECT 'r' || r AS repo, 'm0/pom.xml' AS project, name, version, bool_or(is_direct) AS is_direct, CASE WHEN bool_or(scope = 'test') THEN 'testing' END AS env, coalesce(string_agg(DISTINCT scope, ',' ORDER BY scope), '') AS scopes FROM packages GROUP BY r, name, version)"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    i, text = k % 40, lambda c: c.cast("string")
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value if isinstance(value, Column) else F.lit(value), F.lit(f"</{name}>"))
    some = lambda test, value: F.when(test, value).otherwise("")
    name = lambda key: F.concat(F.lit("m"), text(key))
    up = k - i + F.floor(i / 2)
    where = F.concat(F.lit("../m"), text(F.floor(i / 2)))
    parent = some(i > 0, tag("parent", F.concat(tag("groupId", "g"), tag("artifactId", name(up)), tag("version", "1"), tag("relativePath", where))))
    own = some(i % 2 == 0, F.concat(tag("groupId", "g"), tag("version", "1")))
    lib = lambda n: F.concat(tag("groupId", "x"), tag("artifactId", F.concat(F.lit("lib"), text(n))))
    scope = F.when(i % 7 == 0, tag("scope", "test")).when(i % 7 == 1, tag("scope", "runtime")).otherwise("")
    needs = tag("dependencies", tag("dependency", F.concat(lib(i % 5), some(i % 2 == 0, tag("version", "${v}")), scope)))
    managed = some(i % 4 == 0, tag("dependencyManagement", tag("dependencies", tag("dependency", F.concat(lib(F.floor(i / 4) % 5), tag("version", F.concat(F.lit("m"), text(F.col("p_size")))))))))
    body = F.concat(F.lit('<?xml version="1.0"?>\n'), F.lit('<project xmlns="http://maven.apache.org/POM/4.0.0">'), parent, own, tag("artifactId", name(k)), some(i % 3 == 0, tag("properties", tag("v", text(F.col("p_size"))))), managed, needs, F.lit("</project>"))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("r"), text(F.floor(k / 40))).alias("repo"), F.concat(F.lit("m"), text(i), F.lit("/pom.xml")).alias("path"), body.alias("content"))


def _shown(packages: DataFrame) -> DataFrame:
    return packages.select("repo", "project", "name", "version", "is_direct", "env", F.array_join("scopes", ",").alias("scopes"))


@query(f"WITH RECURSIVE {_PACKAGES} SELECT * FROM whole")
def reader_maven_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(maven.graph(maven.closure(maven.project_files(_files(spark, sf_dir))))[0])


@query(f"""WITH RECURSIVE {_DEPS} SELECT DISTINCT 'r' || r AS repo, 'g:m' || k || '@1' AS src, name || coalesce('@' || version, '') AS dst FROM deps
UNION ALL SELECT 'r' || r, 'g:m' || (r * 40 + i // 2) || '@1', 'g:m' || k || '@1' FROM n WHERE i > 0""")
def reader_maven_project_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = maven.graph(maven.closure(maven.project_files(_files(spark, sf_dir))))[1]
    return edges.select("repo", *[F.concat_ws("@", f"{c}.name", f"{c}.version").alias(c) for c in ("src", "dst")])


@query(f"""WITH RECURSIVE {_PACKAGES}, kept AS (SELECT 'r' || r AS repo, name FROM deps WHERE k % 40 % 3 = 1 UNION SELECT 'r' || r, 'g:m' || k FROM n WHERE i % 3 = 1)
SELECT whole.* FROM whole JOIN kept USING (repo, name)""")
def reader_maven_submodules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = maven.closure(maven.project_files(_files(spark, sf_dir)))
    packages, edges = maven.graph(c)
    modules = maven.submodules(c)
    wanted = modules.where(F.regexp_extract("name", r"(\d+)$", 1).cast("long") % 40 % 3 == 1)
    return _shown(maven.only_submodules(packages, edges, modules, wanted)[0])
