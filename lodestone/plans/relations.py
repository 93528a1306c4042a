"""Relations derived from the test tables: a layered graph, a cyclic graph, locators, paths, layers.

Each has a DataFrame form and the text of the same relation in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.graph import Graph
from lodestone.sources.tables import table


def key(kind: str, col: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(col).cast("string"))


def layered_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region -> nation -> customer -> order -> part."""
    t = lambda name: table(spark, sf_dir, name)
    return (
        t("nation").select(key("region", "n_regionkey").alias("src"), key("nation", "n_nationkey").alias("dst"))
        .unionByName(t("customer").select(key("nation", "c_nationkey").alias("src"), key("customer", "c_custkey").alias("dst")))
        .unionByName(t("orders").select(key("customer", "o_custkey").alias("src"), key("order", "o_orderkey").alias("dst")))
        .unionByName(t("lineitem").select(key("order", "l_orderkey").alias("src"), key("part", "l_partkey").alias("dst")))
    )


def layered(spark: SparkSession, sf_dir: str) -> Graph:
    """The layered graph; regions are direct, suppliers are vertices without edges."""
    regions = table(spark, sf_dir, "region").select(key("region", "r_regionkey").alias("node"))
    suppliers = table(spark, sf_dir, "supplier").select(key("supplier", "s_suppkey").alias("node"))
    return Graph.build(regions, layered_edges(spark, sf_dir), suppliers).saved()


LAYERED_SQL = """e(src, dst) AS MATERIALIZED (
  SELECT 'region:' || n_regionkey, 'nation:' || n_nationkey FROM nation
  UNION SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer
  UNION SELECT 'customer:' || o_custkey, 'order:' || o_orderkey FROM orders
  UNION SELECT 'order:' || l_orderkey, 'part:' || l_partkey FROM lineitem),
d(node) AS (SELECT 'region:' || r_regionkey FROM region),
v(node) AS MATERIALIZED (SELECT node FROM d UNION SELECT src FROM e UNION SELECT dst FROM e UNION SELECT 'supplier:' || s_suppkey FROM supplier)"""


def cyclic(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts p with edges to (7p + 3) mod n and (5p + 1) mod n; parts of size 1 are direct."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    n = parts.count()
    edges = parts.select(F.col("p_partkey").alias("src"), F.explode(F.array((F.col("p_partkey") * 7 + 3) % n, (F.col("p_partkey") * 5 + 1) % n)).alias("dst"))
    return Graph.build(parts.where("p_size = 1").select(F.col("p_partkey").alias("node")), edges).saved()


def third_of_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_size % 3 = 0").select(F.col("p_partkey").alias("node"))


CYCLIC_SQL = """e(src, dst) AS MATERIALIZED (
  SELECT p_partkey, (p_partkey * 7 + 3) % (SELECT count(*) FROM part) FROM part
  UNION SELECT p_partkey, (p_partkey * 5 + 1) % (SELECT count(*) FROM part) FROM part),
d(node) AS (SELECT p_partkey FROM part WHERE p_size = 1),
del(node) AS (SELECT p_partkey FROM part WHERE p_size % 3 = 0),
v(node) AS MATERIALIZED (SELECT node FROM d UNION SELECT src FROM e UNION SELECT dst FROM e)"""
