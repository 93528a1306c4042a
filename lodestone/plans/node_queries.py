"""npm locks and workspaces made from the test tables: a repository for each supplier, its parts as installed packages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.registry import Registry
from lodestone.sources import node
from lodestone.sources.tables import table

registry = Registry()
query = registry.query

#: Part k of repository r (forty parts each) is package c = k % 8, installed at three depths: below the root, in c + 1 there, and in c + 2 in that.
_ROWS = "n AS (SELECT p_partkey AS k, 'r' || p_partkey // 40 AS repo, p_partkey % 40 AS i, '1.' || p_size AS version, p_size % 3 = 0 AS dev FROM part)"
_PLACES = f"""{_ROWS}, pl AS (SELECT *, CASE WHEN i < 8 THEN 'node_modules/c' || i WHEN i < 16 AND i % 3 = 0 THEN 'node_modules/c' || (i + 1) % 8 || '/node_modules/c' || i % 8
WHEN i < 24 AND i % 5 = 0 THEN 'node_modules/c' || (i + 2) % 8 || '/node_modules/c' || (i + 1) % 8 || '/node_modules/c' || i % 8
WHEN i >= 32 THEN 'w' || i % 2 || '/node_modules/c' || i % 8 END AS place FROM n),
wants AS (SELECT repo, place, 'c' || (i + d) % 8 AS name FROM pl, (VALUES (1), (2), (3)) v(d) WHERE place IS NOT NULL),
found AS (SELECT w.repo, w.place AS src, arg_max(a.place, length(a.place)) AS dst FROM wants w JOIN pl a ON a.repo = w.repo AND ends_with(a.place, 'node_modules/' || w.name)
AND starts_with(w.place || '/', left(a.place, length(a.place) - length('node_modules/' || w.name))) GROUP BY w.repo, w.place, w.name),
asked AS (SELECT DISTINCT repo, '' AS place, 'c' || j AS name FROM n, (VALUES (0), (2), (5)) v(j) UNION SELECT DISTINCT repo, 'w' || j % 2, 'c' || j FROM n, (VALUES (1), (3), (4)) v(j)),
direct AS (SELECT DISTINCT q.repo, coalesce(b.place, a.place) AS place FROM asked q LEFT JOIN pl b ON q.place <> '' AND b.repo = q.repo AND b.place = q.place || '/node_modules/' || q.name LEFT JOIN pl a ON a.repo = q.repo AND a.place = 'node_modules/' || q.name)"""


def _locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, text = F.col("p_partkey") % 40, lambda c: c.cast("string")
    c = lambda d: F.concat(F.lit("node_modules/c"), text((i + d) % 8))
    place = (
        F.when(i < 8, c(0))
        .when((i < 16) & (i % 3 == 0), F.concat_ws("/", c(1), c(0)))
        .when((i < 24) & (i % 5 == 0), F.concat_ws("/", c(2), c(1), c(0)))
        .when(i >= 32, F.concat(F.lit("w"), text(i % 2), F.lit("/"), c(0)))
    )
    dev = F.when(F.col("p_size") % 3 == 0, "true").otherwise("false")
    needs = F.array_join(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda d: F.concat(F.lit('"c'), text((i + d) % 8), F.lit('":"*"'))), ",")
    item = F.format_string('"%s":{"version":"1.%s","dev":%s,"dependencies":{%s}}', place, text(F.col("p_size")), dev, needs)
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("r"), text(F.floor(F.col("p_partkey") / 40))).alias("repo"), F.when(place.isNotNull(), item).alias("item"))
    top = '"":{"dependencies":{"c0":"*"},"devDependencies":{"c2":"*"},"peerDependencies":{"c5":"*"}},"w0":{"dependencies":{"c4":"*"}},"w1":{"dependencies":{"c1":"*"},"optionalDependencies":{"c3":"*"}}'
    body = rows.groupBy("repo").agg(F.array_sort(F.collect_list("item")).alias("x"))
    return body.select("repo", F.concat(F.lit('{"lockfileVersion":3,"packages":{'), F.array_join(F.array_prepend("x", F.lit(top)), ","), F.lit("}}")).alias("content"))


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    locks = _locks(spark, sf_dir)
    file = lambda path, text: locks.select("repo", F.lit(path).alias("path"), text.alias("content"))
    out = file("package-lock.json", F.col("content"))
    for path, text in (("package.json", '{"name":"top","workspaces":["w*"]}'), ("w0/package.json", '{"name":"zero"}'), ("w1/package.json", '{"name":"one"}'), ("node_modules/c0/package.json", '{"name":"c0"}')):
        out = out.unionByName(file(path, F.lit(text)))
    return out


@query(f"""WITH {_PLACES} SELECT a.repo, a.place, 'c' || a.i % 8 AS name, a.version, CASE WHEN a.dev THEN 'development' ELSE 'production' END AS env, d.place IS NOT NULL AS is_direct FROM pl a LEFT JOIN direct d ON d.repo = a.repo AND d.place = a.place WHERE a.place IS NOT NULL""")
def reader_npm_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages, _ = node.npm_projects(_listing(spark, sf_dir))
    return packages.drop("root", "location")


@query(f"WITH {_PLACES} SELECT repo, src, dst FROM found")
def reader_npm_place_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return node.npm_projects(_listing(spark, sf_dir))[1].drop("root")


@query(f"""WITH RECURSIVE {_PLACES}, r(repo, place) AS (SELECT d.repo, d.place FROM direct d JOIN asked q ON q.repo = d.repo AND q.place = 'w1' AND (d.place = 'w1/node_modules/' || q.name OR d.place = 'node_modules/' || q.name AND NOT EXISTS (SELECT 1 FROM pl x WHERE x.repo = d.repo AND x.place = 'w1/node_modules/' || q.name))
UNION SELECT f.repo, f.dst FROM r JOIN found f ON f.repo = r.repo AND f.src = r.place) SELECT repo, place FROM r""")
def reader_npm_one_workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _listing(spark, sf_dir)
    chosen = files.select("repo", F.lit("package.json").alias("root"), F.lit("one").alias("name")).distinct()
    return node.npm_projects(files, chosen)[0].select("repo", "place")
