"""Scalar functions over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import content, locators, paths
from lodestone.plans.registry import Registry
from lodestone.sources.tables import table

registry = Registry()
query = registry.query


@query("""WITH r AS (SELECT p_partkey, lower(p_brand) || '+' || p_name || '$' || CASE WHEN p_size % 4 = 0 THEN '' ELSE p_size::VARCHAR END AS locator FROM part)
SELECT p_partkey, locator, split_part(locator, '+', 1) AS fetcher, split_part(split_part(locator, '+', 2), '$', 1) AS project, nullif(split_part(locator, '$', 2), '') AS revision FROM r""")
def locator_render_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    revision = F.when(F.col("p_size") % 4 != 0, F.col("p_size").cast("string"))
    rows = table(spark, sf_dir, "part").select("p_partkey", locators.render(F.lower("p_brand"), F.col("p_name"), revision).alias("locator"))
    return rows.withColumn("l", locators.parse(F.col("locator"))).select("p_partkey", "locator", "l.fetcher", "l.project", "l.revision")


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN (p_size + 1)::VARCHAR WHEN 2 THEN NULL ELSE (p_size + 2)::VARCHAR END AS revision FROM part""")
def constraint_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    leaf = lambda op, value: F.struct(F.lit(op).alias("op"), value.cast("string").alias("value"))
    one, uri, no = leaf("EQUAL", size), leaf("URI", size), leaf("NOT", size)
    leaves = F.when(size % 4 == 0, F.array(one)).when(size % 4 == 1, F.array(uri, leaf("GREATERTHAN", size + 1))).when(size % 4 == 2, F.array(no)).otherwise(F.array(no, uri, leaf("COMPATIBLE", size + 2), one))
    return table(spark, sf_dir, "part").select("p_partkey", locators.constraint_revision(leaves).alias("revision"))


@query("""SELECT c_custkey, split_part(t, '-', 1) AS first_before, substr(t, instr(t, '-') + 1) AS first_after, array_to_string(string_split(t, '-')[:-2], '-') AS last_before, split_part(t, '-', -1) AS last_after, CASE WHEN starts_with(t, 'Customer') THEN substr(t, 9) ELSE t END AS tail
FROM (SELECT c_custkey, c_name || '-' || c_mktsegment || '-' || c_nationkey AS t FROM customer)""")
def text_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("-", "c_name", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("t"))
    t = F.col("t")
    rows = rows.select("c_custkey", locators.break_first(t, "-").alias("f"), locators.break_last(t, "-").alias("l"), locators.drop_prefix(t, "Customer").alias("tail"))
    return rows.select("c_custkey", F.col("f.before").alias("first_before"), F.col("f.after").alias("first_after"), F.col("l.before").alias("last_before"), F.col("l.after").alias("last_after"), "tail")


@query("""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN lpad(p_partkey::VARCHAR, 12, '0') WHEN 1 THEN 'v1.2.' || p_size WHEN 2 THEN 'v1.0.0-rc.1' WHEN 3 THEN NULL ELSE 'main' END AS version FROM part""")
def go_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("p_size"), F.lpad(F.col("p_partkey").cast("string"), 12, "0")
    raw = F.when(n % 5 == 0, F.concat(F.lit("v0.0.0-20210101000000-"), k)).when(n % 5 == 1, F.concat(F.lit("v1.2."), n.cast("string"), F.lit("+incompatible"))).when(n % 5 == 2, "v1.0.0-rc.1").when(n % 5 == 3, "(devel)").otherwise("main")
    return table(spark, sf_dir, "part").select("p_partkey", locators.go_version(raw).alias("version"))


@query("""SELECT p_partkey, p_name || '#debian#' || p_size AS project, 'amd64#' || CASE WHEN p_size % 2 = 0 THEN p_size || ':' ELSE '' END || '1.' || p_partkey || CASE WHEN p_size % 3 = 0 THEN '-r' || p_size ELSE '' END AS revision FROM part""")
def linux_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    epoch, release = F.when(F.col("p_size") % 2 == 0, size), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("r"), size))
    version = F.concat(F.lit("1."), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", locators.linux_package(F.col("p_name"), F.lit("debian"), size, F.lit("amd64"), epoch, version, release).alias("l")).select("p_partkey", "l.project", "l.revision")


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'GREATEROREQUAL 1.' || p_size || '|LESSTHAN 2' WHEN 1 THEN 'EQUAL ' || p_size WHEN 2 THEN 'COMPATIBLE 1.4|NOT 1.4.' || p_size ELSE '' END AS constraints FROM part""")
def pip_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size").cast("string")
    m = F.col("p_size") % 4
    spec = F.when(m == 0, F.concat(F.lit(">=1."), n, F.lit(", <2"))).when(m == 1, F.concat(F.lit("=="), n)).when(m == 2, F.concat(F.lit("~=1.4,!=1.4."), n)).otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(locators.pip_constraints(spec), lambda c: F.concat_ws(" ", c["op"], c["value"])), "|").alias("constraints"))


@query("""SELECT p_partkey, CASE WHEN m = 3 THEN NULL ELSE p_brand END AS name, CASE m WHEN 0 THEN '>=' WHEN 1 THEN '=' END AS op, CASE m WHEN 0 THEN '1.' || p_size WHEN 1 THEN p_size::VARCHAR END AS value FROM (SELECT *, p_size % 4 AS m FROM part)""")
def rpm_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, m = F.col("p_size").cast("string"), F.col("p_size") % 4
    line = F.when(m == 0, F.concat(F.col("p_brand"), F.lit(" >= 1."), n)).when(m == 1, F.concat(F.lit("  "), F.col("p_brand"), F.lit(" = "), n)).when(m == 2, F.col("p_brand")).otherwise(F.concat(F.lit("%{name}"), F.col("p_brand")))
    return table(spark, sf_dir, "part").select("p_partkey", locators.rpm_requirement(line).alias("r")).select("p_partkey", "r.name", "r.op", "r.value")


@query("""SELECT p_partkey, '1.' || p_size AS version, replace(p_name, ' ', ':') || CASE WHEN instr(p_name, ' ') = 0 THEN ':' || p_name ELSE '' END AS clojure, CASE WHEN p_size % 2 = 0 THEN 'net4' || CASE WHEN p_size % 10 = 0 THEN '' ELSE (p_size % 10)::VARCHAR END ELSE 'netstandard2' END AS framework FROM part""")
def version_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size").cast("string")
    version = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("1."), n, F.lit("_react@17"))).otherwise(F.concat(F.lit("1."), n, F.lit("(react@17)(x@1)")))
    framework = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("net4."), (F.col("p_size") % 10).cast("string"))).otherwise(".NETStandard,Version=v2.0")
    return table(spark, sf_dir, "part").select(
        "p_partkey", locators.without_peer_suffix(version).alias("version"), locators.clojure_name(F.replace("p_name", F.lit(" "), F.lit("/"))).alias("clojure"), locators.framework_name(framework).alias("framework")
    )


@query("""SELECT p_partkey, p_brand AS name, '1.' || p_size AS version, CASE WHEN p_size % 2 = 0 THEN 'registry+https://x/index' ELSE 'git+https://x/y' END AS source FROM part""")
def cargo_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.concat(F.lit("1."), F.col("p_size").cast("string"))
    package = F.when(F.col("p_size") % 2 == 0, F.concat(F.replace("p_brand", F.lit(" "), F.lit("")), F.lit(" "), n, F.lit(" (registry+https://x/index)"))).otherwise(F.concat(F.lit("git+https://x/y#"), F.col("p_brand"), F.lit("@"), n))
    # a brand holds the mark that parts source and name in the new form, so it travels without
    clean = F.replace(package, F.lit("Brand#"), F.lit("Brand."))
    rows = table(spark, sf_dir, "part").select("p_partkey", locators.cargo_package(clean).alias("c"))
    return rows.select("p_partkey", F.replace("c.name", F.lit("Brand."), F.lit("Brand#")).alias("name"), "c.version", "c.source")


@query("""SELECT p_partkey, p_size || '?package_id=' || p_partkey || '&arch=x86_64&os=' || p_type AS version FROM part""")
def settings_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = F.create_map(F.lit("os"), F.col("p_type"), F.lit("arch"), F.lit("x86_64"))
    return table(spark, sf_dir, "part").select("p_partkey", locators.settings_version(F.col("p_size").cast("string"), F.col("p_partkey").cast("string"), settings).alias("version"))


@query("""SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value, CASE WHEN event_id % 7 = 0 THEN 1 ELSE 2 END AS n FROM events""")
def ndjson_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_id") % 7 == 0, F.col("props")).otherwise(F.concat_ws("\n", "props", "props"))
    rows = table(spark, sf_dir, "events").select("event_id", content.ndjson(text, "map<string,string>").alias("r"))
    return rows.select("event_id", F.lit("k").alias("key"), F.col("r")[0]["k"].alias("value"), F.size("r").alias("n"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE 'Priority' END AS key, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE o_orderpriority || CASE WHEN o_orderkey % 3 = 1 THEN ': x' ELSE '' END END AS value FROM orders""")
def key_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("o_orderkey") % 3
    line = F.when(m == 0, F.concat(F.lit("Priority : "), "o_orderpriority")).when(m == 1, F.concat(F.lit(" Priority:"), "o_orderpriority", F.lit(": x "))).otherwise("Priority:  ")
    return table(spark, sf_dir, "orders").select("o_orderkey", locators.key_value(line).alias("kv")).select("o_orderkey", "kv.key", "kv.value")


_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*/?([^?#]*?)/?([?#].*)?$', 1)"


@query(f"""SELECT page_id, array_to_string(s[:i], '/') AS parent, array_to_string(s[:i + 1], '/') AS child FROM (SELECT page_id, s, unnest(range(1, len(s))) AS i FROM (SELECT page_id, list_filter(string_split({_PATH}, '/'), lambda x: x <> '') AS s FROM pages))""")
def path_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(paths.ancestor_pairs(paths.url_path(F.col("url")))).alias("p"))
    return rows.select("page_id", "p.parent", "p.child")


@query(f"""SELECT page_id, replace(p, '/', '_') AS flat, 'a.zip!_virtual_!/' || p AS virtual, md5(p) AS md5, substr(sha256(p), 1, 12) AS short, length('url-private+7/' || url || '$' || page_id) <= 60 AS fits FROM (SELECT page_id, url, {_PATH} AS p FROM pages)""")
def path_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", "url", paths.url_path(F.col("url")).alias("p"))
    p = F.col("p")
    return rows.select(
        "page_id", paths.flat_path(p).alias("flat"), paths.virtual_path(F.lit("a.zip"), p).alias("virtual"), F.md5(p).alias("md5"), content.short_fingerprint(F.sha2(p, 256)).alias("short"),
        locators.locator_fits(F.col("url"), F.col("page_id").cast("string"), 7, 60).alias("fits"),
    )


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'usr/lib/x' || p_size WHEN 1 THEN 'usr/share/x' || p_size WHEN 2 THEN 'opt/x' || p_size ELSE 'x' || p_size END AS resolved FROM part""")
def link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, m = F.concat(F.lit("x"), F.col("p_size").cast("string")), F.col("p_size") % 4
    target = F.when(m == 0, n).when(m == 1, F.concat(F.lit("../share/./"), n)).when(m == 2, F.concat(F.lit("/opt/"), n)).otherwise(F.concat(F.lit("../../../../"), n))
    return table(spark, sf_dir, "part").select("p_partkey", paths.resolve_link(target, F.lit("usr/lib")).alias("resolved"))


@query("SELECT doc_id, contains(left(text, 8000), chr(0)) AS is_binary FROM documents WHERE text IS NOT NULL")
def binary_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", content.has_zero(F.col("text")).alias("is_binary"))
