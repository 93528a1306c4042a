"""Graph queries over the derived relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import graph as g
from lodestone.plans.registry import Registry
from lodestone.plans.relations import CYCLIC_SQL, LAYERED_SQL, cyclic, key, layered, layered_edges, third_of_sizes
from lodestone.sources.tables import table

registry = Registry()
query = registry.query

_L, _C = f"WITH RECURSIVE {LAYERED_SQL}", f"WITH RECURSIVE {CYCLIC_SQL}"
_EDGES = f"{_L} SELECT src, dst FROM e"


@query(f"{_L} SELECT count(*) AS n FROM v")
def graph_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layered(spark, sf_dir).size()


@query(f"{_L} SELECT node FROM d")
def graph_direct_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layered(spark, sf_dir).directs()


@query(f"{_L} SELECT node, node IN (SELECT node FROM d) AS is_direct FROM v")
def graph_vertex_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layered(spark, sf_dir).vertices


@query(_EDGES)
def graph_edge_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layered(spark, sf_dir).edges


@query(f"{_L} SELECT v.node, coalesce(s, '') AS successors FROM v LEFT JOIN (SELECT src, string_agg(dst, ',' ORDER BY dst) AS s FROM e GROUP BY src) ON src = v.node")
def graph_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layered(spark, sf_dir).adjacency().withColumn("successors", F.array_join("successors", ","))


@query(f"{_L} SELECT node, node IN (SELECT dst FROM e) AS has_predecessors FROM v")
def graph_has_predecessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layered(spark, sf_dir).with_predecessors()


@query(f"""{_L}, p(src, dst) AS (SELECT DISTINCT 'order:' || l_orderkey, 'part:' || l_suppkey FROM lineitem)
SELECT p.src, p.dst, e.src IS NOT NULL AS found FROM p LEFT JOIN e ON e.src = p.src AND e.dst = p.dst""")
def graph_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = table(spark, sf_dir, "lineitem").select(key("order", "l_orderkey").alias("src"), key("part", "l_suppkey").alias("dst")).distinct()
    return layered(spark, sf_dir).contains_edges(probes)


@query(f"{_L} SELECT src, dst FROM e UNION SELECT 'supplier:' || l_suppkey, 'part:' || l_partkey FROM lineitem")
def graph_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    supply = table(spark, sf_dir, "lineitem").select(key("supplier", "l_suppkey").alias("src"), key("part", "l_partkey").alias("dst"))
    other = g.Graph.build(supply.select(F.col("src").alias("node")), supply)
    return layered(spark, sf_dir).overlay(other).edges


def _names(spark: SparkSession, sf_dir: str, graph: g.Graph) -> DataFrame:
    """Orders are named by their status, others keep their names."""
    status = table(spark, sf_dir, "orders").select(key("order", "o_orderkey").alias("node"), F.concat(F.lit("status:"), "o_orderstatus").alias("to"))
    return graph.vertices.select("node").join(status, "node", "left").select("node", F.coalesce("to", "node").alias("to"))


_NAMES = "m(node, t) AS (SELECT v.node, coalesce('status:' || o_orderstatus, v.node) FROM v LEFT JOIN orders ON v.node = 'order:' || o_orderkey)"


@query(f"{_L}, {_NAMES} SELECT DISTINCT a.t AS src, b.t AS dst FROM e JOIN m a ON a.node = src JOIN m b ON b.node = dst")
def graph_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = layered(spark, sf_dir)
    return graph.relabel(_names(spark, sf_dir, graph)).edges


@query(f"{_L}, {_NAMES} SELECT DISTINCT a.t AS src, b.t AS dst FROM e JOIN m a ON a.node = src JOIN m b ON b.node = dst")
def graph_traverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = layered(spark, sf_dir)
    return graph.traverse(_names(spark, sf_dir, graph).withColumn("problem", F.lit(None).cast("string")))[0].edges


@query(f"{_L} SELECT node, 'is open' AS problem FROM v JOIN orders ON node = 'order:' || o_orderkey WHERE o_orderstatus = 'O'")
def graph_traverse_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = layered(spark, sf_dir)
    is_open = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(key("order", "o_orderkey").alias("node"), F.lit("is open").alias("problem"))
    mapping = graph.vertices.select("node").join(is_open, "node", "left").select("node", F.col("node").alias("to"), "problem")
    return graph.traverse(mapping)[1]


@query(f"{_L}, gone AS (SELECT 'order:' || o_orderkey AS node FROM orders WHERE o_orderstatus = 'F') SELECT src, dst FROM e WHERE src NOT IN (SELECT node FROM gone) AND dst NOT IN (SELECT node FROM gone)")
def graph_induce(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = layered(spark, sf_dir)
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(key("order", "o_orderkey").alias("node"))
    return graph.induce(graph.vertices.join(gone, "node", "left_anti")).edges


@query(f"{_L}, {_NAMES} SELECT DISTINCT a.t AS src, b.t AS dst FROM e JOIN m a ON a.node = src JOIN m b ON b.node = dst WHERE a.t <> 'status:F' AND b.t <> 'status:F'")
def graph_induce_just(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = layered(spark, sf_dir)
    return graph.relabel(_names(spark, sf_dir, graph).withColumn("to", F.nullif("to", F.lit("status:F")))).edges


_HOP = "hop(u, v) AS (SELECT src, dst FROM e WHERE src NOT IN (SELECT node FROM del) UNION SELECT h.u, e.dst FROM hop h JOIN del ON del.node = h.v JOIN e ON e.src = h.v)"
_ROOTED = "up(node) AS (SELECT node FROM d UNION SELECT e.dst FROM up JOIN del ON del.node = up.node JOIN e ON e.src = up.node)"


@query(f"{_C}, {_HOP}, {_ROOTED} SELECT u AS src, v AS dst FROM hop WHERE v NOT IN (SELECT node FROM del) UNION ALL SELECT -1, node FROM up WHERE node NOT IN (SELECT node FROM del)")
def graph_shrink(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cyclic(spark, sf_dir).shrink(third_of_sizes(spark, sf_dir))
    return out.edges.unionByName(out.directs().select(F.lit(-1).cast("long").alias("src"), F.col("node").alias("dst")))


@query(f"{_C}, {_HOP} SELECT u AS src, v AS dst FROM hop WHERE v NOT IN (SELECT node FROM del) UNION ALL SELECT -1, node FROM d WHERE node NOT IN (SELECT node FROM del)")
def graph_shrink_no_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cyclic(spark, sf_dir).shrink(third_of_sizes(spark, sf_dir), promote=False)
    return out.edges.unionByName(out.directs().select(F.lit(-1).cast("long").alias("src"), F.col("node").alias("dst")))


@query(f"""{_C} SELECT src, dst FROM e WHERE src <> 3 AND dst <> 3
UNION SELECT a.src, b.dst FROM e a JOIN e b ON a.dst = 3 AND b.src = 3 WHERE a.src <> 3 AND b.dst <> 3""")
def graph_shrink_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cyclic(spark, sf_dir).shrink(spark.range(3, 4).toDF("node")).edges


@query(f"{_L} SELECT node, node LIKE 'nation:%' AS is_direct FROM v WHERE node NOT LIKE 'region:%'")
def graph_shrink_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layered(spark, sf_dir).shrink_roots().vertices


@query(f"{_L} SELECT node, node IN (SELECT dst FROM e WHERE src IN (SELECT node FROM d)) AS is_direct FROM v")
def graph_strip_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layered(spark, sf_dir).strip_root().vertices


@query(f"{_L} SELECT node, node LIKE 'region:%' OR node LIKE 'part:%' AS is_direct FROM v")
def graph_promote_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layered(spark, sf_dir).promote(F.col("node").startswith("part:")).vertices


@query(f"{_L}, r(node) AS (SELECT node FROM d UNION SELECT dst FROM r JOIN e ON src = r.node) SELECT v.node, v.node IN (SELECT node FROM d) AS is_direct FROM v JOIN r ON r.node = v.node")
def graph_prune_unreachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layered(spark, sf_dir).prune_unreachable().vertices


@query(f"{_C}, r(node) AS (SELECT node FROM d UNION SELECT dst FROM r JOIN e ON src = r.node) SELECT node FROM r")
def graph_reach_cyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cyclic(spark, sf_dir).prune_unreachable().vertices.select("node")


@query(f"{_L}, r(node) AS (SELECT 'nation:3' UNION SELECT dst FROM r JOIN e ON src = r.node) SELECT src, dst FROM e WHERE src IN (SELECT node FROM r)")
def graph_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layered(spark, sf_dir).subgraph(spark.createDataFrame([("nation:3",)], "node string")).edges


@query(f"""{_L}, r(target, node) AS (SELECT 'part:' || p_partkey, 'part:' || p_partkey FROM part WHERE p_size = 1 UNION SELECT target, src FROM r JOIN e ON dst = r.node)
SELECT target, node FROM r WHERE node IN (SELECT node FROM d)""")
def graph_roots_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "part").where("p_size = 1").select(key("part", "p_partkey").alias("node"))
    return layered(spark, sf_dir).roots_of(targets)


@query(f"{_L} SELECT node FROM v WHERE node NOT IN (SELECT dst FROM e)")
def graph_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layered(spark, sf_dir).sources()


@query(f"""{_L}, a(node) AS (SELECT 'customer:1' UNION SELECT dst FROM a JOIN e ON src = a.node), b(node) AS (SELECT 'customer:1' UNION SELECT src FROM b JOIN e ON dst = b.node)
SELECT node FROM a UNION SELECT node FROM b""")
def graph_bidirectional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layered(spark, sf_dir).related(spark.createDataFrame([("customer:1",)], "node string"))


@query(f"{_L}, r(source, node) AS (SELECT node, node FROM v WHERE node NOT IN (SELECT dst FROM e) UNION SELECT source, dst FROM r JOIN e ON src = r.node) SELECT source, node FROM r")
def graph_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layered(spark, sf_dir).split()


@query(f"{_C} SELECT node AS source, node FROM v WHERE false")
def graph_split_cyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cyclic(spark, sf_dir).split()


@query(f"""{_L}, r(label, node) AS (SELECT c_mktsegment, 'customer:' || c_custkey FROM customer UNION SELECT label, dst FROM r JOIN e ON src = r.node)
SELECT node, string_agg(label, ',' ORDER BY label) AS envs FROM r GROUP BY node""")
def graph_hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "customer").select(key("customer", "c_custkey").alias("node"), F.col("c_mktsegment").alias("label"))
    return layered(spark, sf_dir).hydrate(labels).groupBy("node").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("envs"))


@query("""SELECT 'part:' || p_partkey AS node, p_brand AS property,
CASE WHEN p_brand IN (SELECT p_brand FROM part WHERE p_size = 1) THEN 'base,small' ELSE 'base' END AS colors FROM part""")
def graph_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    rows = parts.select(key("part", "p_partkey").alias("node"), F.col("p_brand").alias("property"), F.array(F.lit("base")).alias("colors"))
    return g.color(rows, parts.where("p_size = 1").select(F.col("p_brand").alias("property")), "small").withColumn("colors", F.array_join("colors", ","))


@query(f"""{_C}, ok(node) AS (SELECT p_partkey FROM part WHERE p_size <= 25), r(origin, node) AS (
  SELECT d.node, e.dst FROM d JOIN e ON e.src = d.node JOIN ok ON ok.node = e.dst UNION SELECT r.origin, e.dst FROM r JOIN e ON e.src = r.node JOIN ok ON ok.node = e.dst)
SELECT origin, node FROM r WHERE origin <> node""")
def graph_conditional_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = cyclic(spark, sf_dir)
    return graph.conditional_reach(graph.directs(), table(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").alias("node")))


@query("""WITH RECURSIVE k(src, dst, kind) AS (SELECT DISTINCT 'customer:' || o_custkey, 'order:' || o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'dev' END FROM orders
  UNION SELECT DISTINCT 'order:' || l_orderkey, 'part:' || l_partkey, CASE WHEN l_returnflag = 'R' THEN 'build' END FROM lineitem),
p(node) AS (SELECT 'customer:' || c_custkey FROM customer UNION SELECT dst FROM p JOIN k ON src = p.node WHERE kind IS NULL),
q(node) AS (SELECT dst FROM k WHERE kind IS NOT NULL UNION SELECT dst FROM q JOIN k ON src = q.node)
SELECT coalesce(p.node, q.node) AS node, p.node IS NOT NULL AS production, q.node IS NOT NULL AS development FROM p FULL JOIN q ON p.node = q.node""")
def graph_edge_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(key("customer", "o_custkey").alias("src"), key("order", "o_orderkey").alias("dst"), F.when(F.col("o_orderstatus") == "O", "dev").alias("kind"))
    lines = table(spark, sf_dir, "lineitem").select(key("order", "l_orderkey").alias("src"), key("part", "l_partkey").alias("dst"), F.when(F.col("l_returnflag") == "R", "build").alias("kind"))
    return g.kinds_of_use(orders.unionByName(lines).distinct(), table(spark, sf_dir, "customer").select(key("customer", "c_custkey").alias("node")))


@query(f"""{_L}, mods(node) AS (SELECT node FROM v WHERE node LIKE 'region:%' OR node LIKE 'nation:%'), r(module, node) AS (
  SELECT mods.node, dst FROM mods JOIN e ON src = mods.node WHERE dst NOT IN (SELECT node FROM mods)
  UNION SELECT module, dst FROM r JOIN e ON src = r.node WHERE dst NOT IN (SELECT node FROM mods)) SELECT module, node FROM r""")
def graph_submodule_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = layered(spark, sf_dir)
    return g.owners(graph, graph.vertices.where("node LIKE 'region:%' OR node LIKE 'nation:%'").select("node"))


@query(f"""{_C.replace("p_size % 3 = 0", "p_size % 4 <> 1 OR p_size < 10")}, {_HOP} SELECT u AS src, v AS dst FROM hop WHERE v NOT IN (SELECT node FROM del)""")
def graph_scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    # scopes by size: mod 4 gives none, compile, test or both; small parts are provided as well
    size = F.col("p_size") % 4
    scopes = F.when(size == 0, F.array().cast("array<string>")).when(size == 1, F.array(F.lit("compile"))).when(size == 2, F.array(F.lit("test"))).otherwise(F.array(F.lit("compile"), F.lit("test")))
    scopes = F.when(F.col("p_size") < 10, F.concat(scopes, F.array(F.lit("provided")))).otherwise(scopes)
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), scopes.alias("scopes"))
    return g.scope_filter(cyclic(spark, sf_dir), rows, ["compile", "provided"], ["provided"]).edges


@query("SELECT 'part:' || p_partkey AS node, coalesce(string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag), '') AS labels FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey")
def graph_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "lineitem").groupBy(key("part", "l_partkey").alias("node")).agg(F.array_sort(F.collect_set("l_returnflag")).alias("labels"))
    parts = table(spark, sf_dir, "part").select(key("part", "p_partkey").alias("node"))
    return parts.join(labels, "node", "left").select("node", F.coalesce(F.array_join("labels", ","), F.lit("")).alias("labels"))


@query("SELECT o_custkey AS k, arg_max(o_orderkey, o_orderkey) AS v FROM orders GROUP BY o_custkey")
def graph_mapped_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.last_write(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), F.col("o_orderkey").alias("at")), "k", "at", "v")


@query(f"""{_L}, inside(node) AS (SELECT node FROM v WHERE node LIKE 'customer:%1' OR node LIKE 'nation:1%'),
r(node) AS (SELECT node FROM v WHERE node NOT IN (SELECT dst FROM e) UNION SELECT dst FROM r JOIN e ON src = r.node WHERE r.node NOT IN (SELECT node FROM inside))
SELECT node FROM r WHERE node IN (SELECT node FROM inside)""")
def graph_project_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = layered(spark, sf_dir)
    return g.project_roots(graph, graph.vertices.where("node LIKE 'customer:%1' OR node LIKE 'nation:1%'").select("node"))


@query(f"""{_L}, ids AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS id FROM v)
SELECT i.id, i.node, i.node IN (SELECT node FROM d) AS is_direct, coalesce(c, '') AS children FROM ids i
LEFT JOIN (SELECT a.id, string_agg(b.id, ',' ORDER BY b.id) AS c FROM e JOIN ids a ON a.node = src JOIN ids b ON b.node = dst GROUP BY a.id) x ON x.id = i.id""")
def graph_export_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, edges = layered(spark, sf_dir).refs()
    children = edges.groupBy(F.col("parent").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("child")), ",").alias("children"))
    return ids.join(children, "id", "left").select("id", "node", "is_direct", F.coalesce("children", F.lit("")).alias("children"))


@query("""SELECT p_partkey AS id, 0 AS part_no FROM part UNION ALL SELECT s_suppkey + (SELECT count(*) FROM part), 1 FROM supplier""")
def graph_concat_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, suppliers = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    n = parts.count()
    return parts.select(F.col("p_partkey").alias("id"), F.lit(0).alias("part_no")).unionByName(suppliers.select((F.col("s_suppkey") + n).alias("id"), F.lit(1).alias("part_no")))


@query(f"""{_L} SELECT '"' || src || '" -> "' || dst || '";' AS line FROM e""")
def graph_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layered(spark, sf_dir).dot()


@query(f"{_L} SELECT 'gomod' AS type, node FROM v UNION ALL SELECT 'maven', node FROM v WHERE node NOT LIKE 'supplier:%'")
def graph_prune_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = layered(spark, sf_dir)
    parts = [graph.prune_result(F.lit(t)).vertices.select(F.lit(t).alias("type"), "node") for t in ("gomod", "maven")]
    return parts[0].unionByName(parts[1])


@query("""WITH RECURSIVE u(node, depth) AS (SELECT 'nation:' || n_nationkey, 0 FROM nation WHERE n_regionkey = 2 UNION ALL
  SELECT x.dst, depth + 1 FROM u JOIN (SELECT 'nation:' || c_nationkey AS src, 'customer:' || c_custkey AS dst FROM customer UNION SELECT 'customer:' || o_custkey, 'order:' || o_orderkey FROM orders) x ON x.src = u.node WHERE depth < 2)
SELECT node, min(depth)::INT AS depth FROM u GROUP BY node""")
def graph_unfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a tree of known depth: one join for each level
    level = table(spark, sf_dir, "nation").where("n_regionkey = 2").select(key("nation", "n_nationkey").alias("node"))
    children = layered_edges(spark, sf_dir).where("src NOT LIKE 'order:%'").distinct()
    out = level.withColumn("depth", F.lit(0))
    for depth in (1, 2):
        level = level.join(children, F.col("node") == F.col("src")).select(F.col("dst").alias("node"))
        out = out.unionByName(level.withColumn("depth", F.lit(depth)))
    return out.groupBy("node").agg(F.min("depth").alias("depth"))
