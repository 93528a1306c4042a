"""Source units and graph documents of projects made from the test tables: forty parts each hang on each other as a tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import units
from lodestone.plans.registry import Registry
from lodestone.sources.tables import table

registry = Registry()
query = registry.query

_TYPES = ("gem", "nodejs", "conan", "pip", "subproject", "git")
_ROWS = f"""n AS (SELECT p_partkey AS k, p_partkey // 40 AS project, p_partkey % 40 AS i, p_size AS size, {list(_TYPES)}[p_partkey % 6 + 1] AS type, p_partkey % 7 AS e, p_partkey % 40 < 3 OR p_partkey % 11 = 0 AS is_direct FROM part),
v AS (SELECT *, type NOT IN ('conan', 'subproject') AND e <> 2 AND e <> 4 AS kept, CASE type WHEN 'nodejs' THEN 'npm' ELSE type END || '+p' || k || '$' || CASE WHEN e = 6 THEN '' ELSE '1.' || size END AS locator FROM n),
up(k, a) AS (SELECT k, project * 40 + i // 2 FROM n WHERE i > 0 UNION ALL SELECT up.k, v.project * 40 + v.i // 2 FROM up JOIN v ON v.k = up.a WHERE NOT v.kept AND v.i > 0)"""


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges: a part hangs on the one with half its place; every sixth type and every seventh environments take turns."""
    k = F.col("p_partkey")
    i, e, none = k % 40, k % 7, F.array().cast("array<string>")
    envs = F.when(e == 0, none).when(e == 1, F.array(F.lit("production"))).when(e == 2, F.array(F.lit("development"))).when(e == 3, F.array(F.lit("testing"), F.lit("other:x"))).when(e == 4, F.array(F.lit("testing"), F.lit("development"))).otherwise(F.array(F.lit("production"), F.lit("development")))
    leaf = F.struct(F.lit("EQUAL").alias("op"), F.concat(F.lit("1."), F.col("p_size").cast("string")).alias("value"))
    leaves = F.when(e == 6, F.array().cast("array<struct<op:string,value:string>>")).otherwise(F.array(leaf))
    rows = table(spark, sf_dir, "part").select(F.floor(k / 40).alias("project"), k.alias("node"), F.element_at(F.array(*map(F.lit, _TYPES)), (k % 6).cast("int") + 1).alias("type"), F.concat(F.lit("p"), k.cast("string")).alias("name"), leaves.alias("leaves"), envs.alias("environments"), ((i < 3) | (k % 11 == 0)).alias("is_direct"), i.alias("i"))
    edges = rows.where("i > 0").select("project", (F.col("project") * 40 + F.floor(F.col("i") / 2)).alias("src"), F.col("node").alias("dst"))
    return rows.drop("i"), edges


@query(f"WITH RECURSIVE {_ROWS} SELECT project, locator, is_direct FROM v WHERE kept")
def unit_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = units.source_units(*_tables(spark, sf_dir))
    direct = found.imports.withColumn("d", F.lit(True))
    return found.dependencies.join(direct, ["project", "locator"], "left").select("project", "locator", F.coalesce("d", F.lit(False)).alias("is_direct"))


@query(f"WITH RECURSIVE {_ROWS} SELECT v.project, w.locator, v.locator AS needs FROM up JOIN v ON v.k = up.k AND v.kept JOIN v w ON w.k = up.a AND w.kept")
def unit_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.source_units(*_tables(spark, sf_dir)).links


@query(f"""WITH RECURSIVE {_ROWS}, a AS (SELECT project, i // 2 AS src, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS c FROM n WHERE i > 0 GROUP BY ALL),
s AS (SELECT project, string_agg('[' || src || ',[' || c || ']]', ',' ORDER BY src) AS assocs FROM a GROUP BY project)
SELECT n.project, '{{"deps":[' || string_agg('{{"type":"' || type || '","name":"p' || k || '"}}', ',' ORDER BY k) || '],"assocs":[' || coalesce(any_value(s.assocs), '') || '],"direct":[' || coalesce(string_agg(CASE WHEN is_direct THEN CAST(i AS VARCHAR) END, ',' ORDER BY i), '') || ']}}' AS json
FROM n LEFT JOIN s ON s.project = n.project GROUP BY n.project""")
def project_graph_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, edges = _tables(spark, sf_dir)
    return units.graph_json(vertices.select("project", "node", F.struct("type", "name").alias("dep"), "is_direct"), edges)


@query(f"""WITH RECURSIVE {_ROWS}, links AS (SELECT DISTINCT v.project, w.locator, v.locator AS needs FROM up JOIN v ON v.k = up.k AND v.kept JOIN v w ON w.k = up.a AND w.kept),
d AS (SELECT v.project, v.locator, v.is_direct, coalesce((SELECT string_agg('"' || needs || '"', ',' ORDER BY needs) FROM links WHERE links.project = v.project AND links.locator = v.locator), '') AS imports FROM v WHERE kept)
SELECT project, '{{"Name":"dir' || project || '","Type":"mixed","Manifest":"dir' || project || '","Build":{{"Artifact":"default","Succeeded":true,"Imports":[' || coalesce(string_agg(CASE WHEN is_direct THEN '"' || locator || '"' END, ',' ORDER BY locator), '') || '],"Dependencies":['
|| string_agg('{{"locator":"' || locator || '","imports":[' || imports || '],"metadata":null}}', ',' ORDER BY locator) || ']}},"GraphBreadth":"complete","NoticeFiles":[],"OriginPaths":["lock' || project || '"]}}' AS json FROM d GROUP BY project""")
def unit_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, edges = _tables(spark, sf_dir)
    at = F.col("project").cast("string")
    projects = vertices.select("project").distinct().select("project", F.concat(F.lit("dir"), at).alias("name"), F.lit("mixed").alias("type"), F.lit("complete").alias("breadth"), F.array(F.concat(F.lit("lock"), at)).alias("paths"))
    return units.unit_documents(units.source_units(vertices, edges), projects)
