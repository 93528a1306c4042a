"""Set operators, listings and dependencies as locators, over relations made from the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import dependencies
from lodestone.operators import listing, sets
from lodestone.operators.graph import Graph
from lodestone.plans.registry import Registry
from lodestone.plans.relations import layered_edges
from lodestone.sources.tables import table

registry = Registry()
query = registry.query

_KINDS = sorted(dependencies.FETCHERS)
_KIND_ROWS = "kinds(i, kind, fetcher, back) AS (VALUES " + ", ".join(
    f"({i}, '{k}', '{dependencies.FETCHERS[k]}', {'NULL' if k in ('conan', 'swift', 'unresolved-path') else repr(next(t for t, f in dependencies.FETCHERS.items() if f == dependencies.FETCHERS[k] and t not in dependencies.ONE_WAY))})" for i, k in enumerate(_KINDS)
) + ")"


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part")


def _text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


@query(f"""WITH {_KIND_ROWS} SELECT p_partkey, kind, fetcher, back, fetcher || '+' || p_name AS project_id, CASE WHEN p_partkey % 4 = 1 THEN NULL WHEN p_partkey % 4 = 2 THEN '2' ELSE p_size::VARCHAR END AS revision
FROM part JOIN kinds ON i = p_partkey % {len(_KINDS)}""")
def dependency_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    leaf = lambda op, value: F.struct(F.lit(op).alias("op"), value.alias("value"))
    size = _text("p_size")
    leaves = F.when(k == 0, F.array(leaf("EQUAL", size))).when(k == 1, F.array(leaf("URI", size))).when(k == 2, F.array(leaf("NOT", size), leaf("LESSTHAN", F.lit("2")))).otherwise(F.array(leaf("COMPATIBLE", size)))
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("p_partkey") % len(_KINDS)).cast("int") + 1)
    rows = _part(spark, sf_dir).select("p_partkey", kind.alias("kind"), dependencies.dependency_locator(kind, F.col("p_name"), leaves).alias("l"))
    return rows.select("p_partkey", "kind", "l.fetcher", dependencies.type_of(F.col("l.fetcher")).alias("back"), dependencies.project_id(F.col("l.fetcher"), F.col("l.project")).alias("project_id"), "l.revision")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'v' || p_size || '-size' WHEN 1 THEN 'x PROPERTY NOT FOUND: none' WHEN 2 THEN 'a self' ELSE 'deep ' || p_size END AS filled FROM part""")
def property_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, ("v${size}-${size}", "x ${none}", "${self}", "${one}"))), (F.col("p_partkey") % 4).cast("int") + 1)
    props = F.create_map(F.lit("size"), _text("p_size"), F.lit("self"), F.lit("a ${self}"), F.lit("one"), F.lit("${two}"), F.lit("two"), F.lit("deep ${size}"))
    return _part(spark, sf_dir).select("p_partkey", dependencies.interpolate(text, props).alias("filled"))


@query("""SELECT p_partkey, '1.' || p_size AS bare, CASE p_partkey % 3 WHEN 0 THEN 'default' WHEN 1 THEN 'react' END AS catalog,
CASE WHEN p_partkey % 2 = 0 THEN 'python_version=3.' || p_size || ';sys_platform=not (win32)' ELSE '' END AS tags FROM part""")
def version_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    version = F.concat(F.lit("1."), _text("p_size"), F.when(k % 2 == 0, "_peer@2").otherwise("(peer@2)(b@1)"))
    catalog = F.when(k % 3 == 0, "catalog:").when(k % 3 == 1, "catalog:react").otherwise("1.0")
    marker = F.when(k % 2 == 0, F.concat(F.lit("python_version >= '3."), _text("p_size"), F.lit("' and sys_platform not in \"win32\""))).otherwise("")
    tags = F.array_join(F.transform(dependencies.marker_tags(marker), lambda t: F.concat_ws("=", t["tag"], t["value"])), ";")
    return _part(spark, sf_dir).select("p_partkey", dependencies.bare_version(version).alias("bare"), dependencies.catalog_name(catalog).alias("catalog"), tags.alias("tags"))


@query("""SELECT c_nationkey, string_agg(c_mktsegment || '|' || c_custkey, '|' ORDER BY c_custkey DESC) AS labels FROM customer GROUP BY 1""")
def label_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_nationkey", F.array("c_mktsegment", _text("c_custkey")).alias("labels"), "c_custkey")
    return sets.grouped_lists(rows, "c_nationkey", "labels", "c_custkey").select("c_nationkey", F.array_join("labels", "|").alias("labels"))


@query("""WITH o AS (SELECT DISTINCT p_name AS name, p_brand AS version FROM part) SELECT name, version, count(*) OVER (PARTITION BY name) > 1 AS ambiguous FROM o""")
def vendored_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.checked_names(_part(spark, sf_dir).select(F.col("p_name").alias("name"), F.col("p_brand").alias("version")), "name")


@query("""SELECT DISTINCT l_orderkey AS unit, 'p' || l_partkey AS locator FROM lineitem UNION SELECT l_orderkey, 's' || l_suppkey FROM lineitem""")
def unit_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = F.concat(F.lit("p"), _text("l_partkey")), F.concat(F.lit("s"), _text("l_suppkey"))
    none = F.array().cast("array<string>")
    units = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("unit"), F.when(F.col("l_linenumber") % 2 == 0, F.array(one)).otherwise(none).alias("imports"), F.array(F.struct(one.alias("locator"), F.array(two, one).alias("imports"))).alias("deps"))
    return sets.unit_locators(units)


@query("""SELECT p_partkey, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN 'a,b,c' ELSE 'a,b' END AS files, p_brand || ',' || p_type || ',' || p_brand AS data FROM part""")
def license_units_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("a")))
    unit = lambda name, files, data: F.struct(name.alias("name"), files.alias("files"), data.alias("data"))
    both = sets.joined_units(unit(F.col("p_name"), F.array(F.lit("a"), F.lit("b")), F.array("p_brand", "p_type")), unit(F.lit("other"), two, F.array("p_brand")))
    rows = _part(spark, sf_dir).select("p_partkey", both.alias("u"))
    return rows.select("p_partkey", "u.name", F.array_join("u.files", ",").alias("files"), F.array_join("u.data", ",").alias("data"))


@query("""SELECT 0 AS part, s_name AS name, 'maven' AS type, NULL AS dir FROM supplier UNION ALL SELECT 1, n_name, NULL, '/src' FROM nation""")
def all_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.lit("maven").alias("type"))
    return sets.all_units(source, table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.lit("/src").alias("dir"))).select("part", "name", "type", "dir")


@query("""SELECT DISTINCT p_brand AS name, p_type AS pattern FROM part""")
def united_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = _part(spark, sf_dir).select(F.col("p_brand").alias("name"), F.col("p_type").alias("pattern"), "p_size")
    return sets.united_rules(rules.where("p_size < 30").drop("p_size"), rules.where("p_size > 20 OR p_size IS NULL").drop("p_size"))


@query("""SELECT o_custkey, count(*) FILTER (o_orderstatus <> 'F') AS succeeded, count(*) FILTER (o_orderstatus = 'F') AS warnings, count(*) FILTER (o_orderstatus <> 'F') = 0 AS fatal FROM orders GROUP BY 1""")
def combined_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.combined(table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderstatus") != "F").alias("ok"), "o_orderkey"), "o_custkey")[1]


@query("""SELECT l_partkey AS node, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS envs FROM lineitem GROUP BY 1""")
def united_environments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("node"), F.array("l_returnflag").alias("envs"))
    return sets.united_environments(rows).select("node", F.array_join("envs", ",").alias("envs"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'b,a' WHEN 1 THEN 'a,b,a' ELSE 'b' END AS left_over,
p_partkey % 4 = 0 AS vsi_only, p_size >= 25 AND p_size % 2 = 0 AS scanned FROM part""")
def filter_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, lit = F.col("p_partkey"), lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    gone = F.when(k % 3 == 0, lit("a")).when(k % 3 == 1, lit("z")).otherwise(lit("a", "a"))
    entry = lambda t, d: F.struct(F.lit(t).alias("type"), F.lit(d).cast("string").alias("dir"), F.lit(None).cast("string").alias("target"))
    includes = F.when(k % 4 == 0, F.array(entry("vsi", None))).when(k % 4 == 1, F.array(entry("vsi", "x"))).when(k % 4 == 2, F.array(entry("vsi", None), entry("npm", None))).otherwise(F.array(entry("npm", None)))
    path = F.concat(F.when(F.col("p_size") >= 25, "in/").otherwise("out/"), F.when(F.col("p_size") % 2 == 0, "a").otherwise("bad"))
    scanned = sets.binary_folder(path, lit("in/"), lit("in/bad", "out/bad"))
    return _part(spark, sf_dir).select("p_partkey", F.array_join(sets.without_first(lit("a", "b", "a"), gone), ",").alias("left_over"), sets.only_tool(includes, "vsi").alias("vsi_only"), scanned.alias("scanned"))


@query("""WITH c AS (SELECT n_nationkey, n_nationkey % 3 AS found, n_nationkey % 2 AS kept, CASE WHEN n_nationkey % 5 = 0 THEN 1 ELSE 0 END AS units, n_regionkey AS r FROM nation)
SELECT n_nationkey, CASE WHEN units > 0 AND r >= 2 THEN 'source and license units' WHEN units > 0 THEN 'source units' WHEN r < 2 AND found = 0 THEN 'none found' WHEN r < 2 AND kept = 0 THEN 'all filtered' WHEN r < 2 THEN 'source units'
WHEN found = 0 OR kept = 0 THEN 'license units' ELSE 'source and license units' END AS outcome FROM c""")
def result_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    none = F.array().cast("array<string>")
    licenses = F.when(r == 0, none).when(r == 1, F.array(F.lit(sets.NO_LICENSE))).otherwise(F.array(F.lit(sets.NO_LICENSE), F.lit("mit")))
    return table(spark, sf_dir, "nation").select("n_nationkey", sets.result_outcome(k % 3, k % 2, F.when(k % 5 == 0, 1).otherwise(0), licenses).alias("outcome"))


@query("""SELECT s_suppkey, 'docs/**,v' || s_suppkey || '/*,v' || s_suppkey || '/**' AS globs FROM supplier""")
def license_scan_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    vendored = F.array(F.concat(F.lit("v"), _text("s_suppkey")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(sets.license_scan_globs(F.array(F.lit("docs/**")), vendored), ",").alias("globs"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'a,c' WHEN o_orderstatus = 'F' THEN 'c' END AS names FROM orders""")
def matches_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    match = lambda n, t: F.struct(F.lit(n).alias("name"), F.lit(t).alias("scan_type"))
    matches = F.when(F.col("o_orderstatus") == "O", F.array(match("a", "x"), match("b", "y"), match("c", "x"))).when(F.col("o_orderstatus") == "F", F.array(match("c", "x"))).otherwise(F.array(match("b", "y")))
    names = F.array_join(F.transform(sets.of_scan_type(matches, "x"), lambda m: m["name"]), ",")
    return table(spark, sf_dir, "orders").select("o_orderkey", names.alias("names"))


@query("""SELECT DISTINCT CASE WHEN n_regionkey = 1 THEN 'base+r$1' ELSE 'region+' || n_regionkey || '$' END AS src, 'nation+' || n_nationkey || '$' AS dst FROM nation""")
def translated_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "nation").select(F.concat(F.lit("region:"), _text("n_regionkey")).alias("src"), F.concat(F.lit("nation:"), _text("n_nationkey")).alias("dst"))
    graph = Graph.build(edges.select(F.col("src").alias("node")), edges)
    locators = graph.vertices.select("node", F.substring_index("node", ":", 1).alias("fetcher"), F.substring_index("node", ":", -1).alias("project"), F.lit(None).cast("string").alias("revision"))
    aliases = spark.createDataFrame([("region", "1", None, "base", "r", "1", 0), ("nation", "3", "9", "base", "n", None, 1)], "fetcher string, project string, version string, base_fetcher string, base_project string, base_version string, ord int")
    return sets.translated(graph, locators, aliases).edges


@query("""SELECT p_partkey, upper(p_name) AS id, CASE WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR ELSE c.version END AS version FROM part LEFT JOIN (SELECT lower(p_name) AS n, max(p_brand) AS version FROM part WHERE p_size < 25 GROUP BY 1) c ON c.n = lower(p_name)""")
def central_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _part(spark, sf_dir)
    references = parts.select("p_partkey", F.upper("p_name").alias("id"), F.when(F.col("p_partkey") % 2 == 0, _text("p_size")).alias("version"))
    return sets.central_versions(references, parts.where("p_size < 25").select(F.col("p_name").alias("id"), F.col("p_brand").alias("version")))


@query("""SELECT o_custkey AS module, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS labels FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1
UNION ALL SELECT DISTINCT o_custkey, '' FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey)""")
def module_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("package"), F.col("l_returnflag").alias("label"))
    modules = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("package"), F.col("o_custkey").alias("module"))
    return sets.module_labels(packages, modules).select("module", F.array_join("labels", ",").alias("labels"))


@query("""SELECT DISTINCT n_name AS src, s_name AS dst FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_nationkey < 20""")
def edges_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").where("n_nationkey < 20").select((-F.col("n_nationkey") - 1).cast("long").alias("id"), F.col("n_name").alias("name"))
    suppliers = table(spark, sf_dir, "supplier")
    nodes = nations.unionByName(suppliers.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))
    return sets.edges_by_id(nodes, suppliers.select((-F.col("s_nationkey") - 1).cast("long").alias("from_id"), F.col("s_suppkey").alias("to_id")))


@query("""SELECT p_partkey AS path, CASE WHEN p_partkey % 3 = 0 AND p_size % 2 = 0 THEN 'path' ELSE 'upath' END AS type, CASE WHEN p_partkey % 3 = 0 AND p_size % 2 = 0 THEN p_name ELSE '0' END AS version, p_size % 2 = 0 AS publishable FROM part""")
def resolved_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _part(spark, sf_dir)
    deps = parts.select(F.col("p_partkey").alias("path"), F.lit("upath").alias("type"), F.lit("0").alias("version"), (F.col("p_size") % 2 == 0).alias("publishable"))
    return sets.resolved_paths(deps, parts.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("path"), F.lit("path").alias("new_type"), F.col("p_name").alias("new_version")))


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY n_name) - 1 AS id, n_name AS node FROM nation), b AS (SELECT row_number() OVER (ORDER BY r_name) - 1 AS id, r_name AS node FROM region),
n AS (SELECT id, node, true AS is_direct FROM a UNION ALL SELECT id + 25, node, node LIKE 'A%' FROM b) SELECT id, node, is_direct FROM n""")
def concat_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = Graph.build(table(spark, sf_dir, "nation").select(F.col("n_name").alias("node")), spark.createDataFrame([], "src string, dst string"))
    regions = table(spark, sf_dir, "region").select(F.col("r_name").alias("node"))
    two = Graph.build(regions.where("node LIKE 'A%'"), spark.createDataFrame([], "src string, dst string"), regions)
    return sets.concat_refs(one.refs(), two.refs())[0]


@query("""WITH RECURSIVE e(src, dst) AS (SELECT 'region:' || n_regionkey, 'nation:' || n_nationkey FROM nation UNION SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer),
r(node) AS (SELECT 'region:' || r_regionkey FROM region WHERE r_regionkey < 2 UNION SELECT dst FROM r JOIN e ON src = node)
SELECT node, node LIKE 'region:%' AS is_direct FROM r""")
def unfolded_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "region").where("r_regionkey < 2").select(F.concat(F.lit("region:"), _text("r_regionkey")).alias("node"))
    edges = layered_edges(spark, sf_dir).where("src LIKE 'region:%' OR src LIKE 'nation:%'")
    return sets.unfolded(seeds, edges.select(F.col("src").alias("node"), F.col("dst").alias("child"))).vertices


@query("""SELECT n_nationkey AS node, coalesce((SELECT string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) FROM customer WHERE c_nationkey = n_nationkey AND c_custkey % 2 = 0), '') AS labels FROM nation""")
def labelled_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_nationkey").alias("node"), F.col("c_mktsegment").alias("label"))
    return sets.labelled(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node")), labels).select("node", F.array_join("labels", ",").alias("labels"))


@query("""SELECT DISTINCT s_nationkey AS key FROM supplier WHERE s_nationkey >= 20""")
def unmapped_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"))
    return sets.mapped(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key")), mapping)[1]


# A listing: brand/type/size/name, words of a type as folders.


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", "p_brand", F.replace("p_type", F.lit(" "), F.lit("/")), F.concat(F.lit("s"), _text("p_size")), F.concat(F.lit("f"), _text("p_partkey"), F.lit(".txt")))
    return _part(spark, sf_dir).select(path.alias("path"), F.col("p_partkey").alias("ord"))


_LISTING = """li AS (SELECT p_brand || '/' || replace(p_type, ' ', '/') || '/s' || p_size || '/f' || p_partkey || '.txt' AS path, p_partkey AS ord, p_brand, p_type, p_size FROM part)"""


@query(f"WITH {_LISTING} SELECT path, ord FROM li WHERE p_size % 5 <> 0 AND p_brand NOT LIKE '%3'")
def listing_filtered_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.filtered_walk(_listing(spark, sf_dir), ~F.rlike("folder", F.lit(r"/s\d*[05]$|^[^/]*3$")))


@query(f"""WITH {_LISTING} SELECT DISTINCT p_brand AS folder FROM li WHERE p_brand LIKE '%3' UNION SELECT DISTINCT p_brand || '/' || replace(p_type, ' ', '/') || '/s' || p_size FROM li WHERE p_size % 5 = 0 AND p_brand NOT LIKE '%3'""")
def listing_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.pruned_subtrees(_listing(spark, sf_dir), ~F.rlike("folder", F.lit(r"/s\d*[05]$|^[^/]*3$")))


@query(f"""WITH {_LISTING} SELECT regexp_extract(path, '^(.*)/', 1) AS folder, string_agg(ord::VARCHAR, ',' ORDER BY path) AS ords FROM li GROUP BY 1""")
def listing_collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listing.collected(_listing(spark, sf_dir), "ord")
    return rows.select("folder", F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias("ords"))


@query(f"""WITH {_LISTING} SELECT DISTINCT regexp_extract(path, '^(.*)/', 1) AS folder, CASE WHEN p_brand LIKE '%1' THEN p_brand || '/mod.txt' ELSE 'mod.txt' END AS found FROM li""")
def listing_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _listing(spark, sf_dir).select("path")
    brands = _part(spark, sf_dir).select("p_brand").distinct().where("p_brand LIKE '%1'").select(F.concat("p_brand", F.lit("/mod.txt")).alias("path"))
    top = spark.range(1).select(F.lit("mod.txt").alias("path"))
    places = files.select(listing.folder(F.col("path")).alias("folder")).distinct()
    return listing.nearest_above(places, brands.unionByName(top), "mod.txt")


@query("""SELECT 'd' || c_nationkey AS folder, 'd' || c_nationkey || '/' || arg_min(CASE WHEN c_custkey % 3 = 0 THEN 'b.lock' ELSE 'a.lock' END, c_custkey) AS path FROM customer WHERE c_custkey % 3 < 2 GROUP BY c_nationkey""")
def listing_first_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 3
    name = F.when(k == 0, "b.lock").when(k == 1, "a.lock").otherwise("c.lock")
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("d"), _text("c_nationkey"), F.lit("/"), name).alias("path"), F.col("c_custkey").alias("ord"))
    return listing.first_named(rows, ["a.lock", "b.lock"])


@query(f"WITH {_LISTING} SELECT path, ord FROM li WHERE ord::VARCHAR LIKE '1%' OR ord::VARCHAR LIKE '%7'")
def listing_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.matching(_listing(spark, sf_dir), ["f1*.txt", "*7.txt"])


@query("""SELECT s_suppkey, 'a' || s_suppkey || '/b/**/x' AS glob FROM supplier""")
def globs_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.concat(F.lit("./a"), _text("s_suppkey"), F.lit("//"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", listing.glob_below(base, F.lit("./b//**/x")).alias("glob"))


@query("""SELECT o_custkey AS job, arg_min('c' || o_orderkey, o_orderkey) AS command, arg_min(CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'out' END, o_orderkey) AS stdout FROM orders WHERE NOT (o_orderstatus = 'P' AND o_orderkey % 3 <> 2) AND NOT (o_orderkey % 3 = 0 AND o_orderkey % 2 = 1) GROUP BY 1""")
def working_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    policy = F.when(k % 3 == 0, "never").when(k % 3 == 1, "non-empty").otherwise("always")
    failed = ((k % 3 == 0) & (k % 2 == 1)) | (F.col("o_orderstatus") == "P") | (k % 3 == 1)
    runs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job"), k.alias("ord"), F.concat(F.lit("c"), _text(k)).alias("command"), policy.alias("policy"), F.when(failed, 1).otherwise(0).alias("exit_code"), F.when(F.col("o_orderstatus") == "P", "").otherwise("out").alias("stdout"))
    return listing.working_command(runs)


@query("""SELECT 'r' || c_nationkey AS repository, 'u' || (o_custkey % 5) || '@x' AS email, max(o_orderdate::DATE) AS last FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2""")
def last_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    line = F.concat(F.lit("u"), _text(F.col("o_custkey") % 5), F.lit("@x|"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00Z"))
    logs = rows.groupBy("c_nationkey").agg(F.concat_ws("\n", F.collect_list(line), F.lit("no bar here")).alias("log"))
    return listing.last_commits(logs.select(F.concat(F.lit("r"), _text("c_nationkey")).alias("repository"), "log"))
