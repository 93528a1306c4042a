"""Filters, joins, roll-ups, content scans and sinks over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import content, locators, paths
from lodestone.functions.phrases import phrase_matches
from lodestone.operators import joins, rollups, targets
from lodestone.operators.graph import Graph
from lodestone.plans.registry import Registry
from lodestone.plans.relations import LAYERED_SQL, key, layered
from lodestone.sources.tables import table

registry = Registry()
query = registry.query

# Paths of pages: the URL without host, query and fragment.
_PATHS = "pp AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*/?([^?#]*?)/?([?#].*)?$', 1) AS path FROM pages)"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", paths.url_path(F.col("url")).alias("path"))


@query(f"""WITH {_PATHS} SELECT page_id, path,
  (path = 'fr' OR path LIKE 'fr/%' OR starts_with('fr/', path || '/') OR regexp_matches(path, '^en/8[^/]*$') OR starts_with('en/', path || '/') OR regexp_matches(path, '^en/8[^/]*/'))
  AND NOT (path = 'fr/825' OR path LIKE 'fr/825/%' OR regexp_matches(path, '^(.*/)?[^/]*\\.html$')) AS allowed FROM pp""")
def filter_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = paths.path_allowed(F.col("path"), ["fr", "en/8*"], ["fr/825", "**/*.html"])
    return _paths(spark, sf_dir).withColumn("allowed", allowed)


@query(f"""WITH {_PATHS} SELECT page_id, path, regexp_matches(path, '^en/[^/]*$') AS one, regexp_matches(path, '^(.*/)?9[^/]*$') AS deep, regexp_matches(path, '^de(/.*)?$') AS below FROM pp""")
def filter_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = {n: F.rlike("path", F.lit(paths.glob_regex(g))) for n, g in (("one", "en/*"), ("deep", "**/9*"), ("below", "de/**"))}
    return _paths(spark, sf_dir).withColumns(tests)


# Folders of parts: type, brand and size as path.
_DIRS = "lower(p_type) || '/' || lower(p_brand) || '/' || CASE WHEN p_size % 5 = 0 THEN 'mytest/' WHEN p_size % 7 = 0 THEN 'docs/x/' ELSE 'src/' END || p_partkey"


def _dirs() -> F.Column:
    low = F.when(F.col("p_size") % 5 == 0, "mytest/").when(F.col("p_size") % 7 == 0, "docs/x/").otherwise("src/")
    return F.concat(F.lower("p_type"), F.lit("/"), F.lower("p_brand"), F.lit("/"), low, F.col("p_partkey"))


@query(f"SELECT p_partkey, {_DIRS} AS dir, p_size % 5 = 0 OR p_size % 7 = 0 AS non_production FROM part")
def filter_default_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", _dirs().alias("dir"))
    return rows.withColumn("non_production", paths.non_production(F.col("dir"), base="economy/"))


_PROJECTS = """pr AS (SELECT s_suppkey, lower(n_name) AS type, 'd' || s_suppkey % 10 AS dir, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE list_filter(['api', 'app', 'lib', 'test'], lambda x: len(x) = 3 OR s_suppkey % 4 = 1) END AS targets
  FROM supplier JOIN nation ON n_nationkey = s_nationkey)"""


def _projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    everything, three = F.array(*map(F.lit, ("api", "app", "lib", "test"))), F.array(*map(F.lit, ("api", "app", "lib")))
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    found = F.when(k % 4 == 0, None).when(k % 4 == 1, everything).otherwise(three)
    return rows.select("s_suppkey", F.lower("n_name").alias("type"), F.concat(F.lit("d"), (k % 10).cast("string")).alias("dir"), found.alias("targets"))


@query(f"""WITH {_PROJECTS}, m AS (SELECT *, CASE WHEN dir = 'd1' THEN ['app', 'test'] WHEN dir IN ('d2', 'd3', 'd4', 'd5') THEN [] END AS inc,
  CASE WHEN dir = 'd5' THEN ['none'] WHEN dir IN ('d1', 'd3') THEN ['app'] ELSE [] END AS exc FROM pr),
k AS (SELECT s_suppkey, type, dir, CASE WHEN targets IS NULL THEN NULL WHEN inc = [] THEN list_filter(targets, lambda x: NOT list_contains(exc, x)) ELSE list_filter(targets, lambda x: list_contains(inc, x) AND NOT list_contains(exc, x)) END AS t
  FROM m WHERE inc IS NOT NULL AND exc <> ['none'])
SELECT s_suppkey, type, dir, array_to_string(t, ',') AS targets FROM k WHERE t IS NULL OR len(t) > 0""")
def filter_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _projects(spark, sf_dir)
    kinds = [r[0] for r in table(spark, sf_dir, "nation").select(F.lower("n_name")).distinct().collect()]  # a fixed dimension of types
    include = targets.Filters(targets=[(t, "d1", x) for t in kinds for x in ("app", "test")], paths=["d2", "d3", "d4"], globs=["d5*"])
    exclude = targets.Filters(targets=[(t, d, "app") for t in kinds for d in ("d1", "d3")], paths=["d5"])
    return targets.apply_filters(rows, include, exclude).withColumn("targets", F.array_join("targets", ","))


@query("""SELECT text, CASE WHEN ok THEN nullif(regexp_extract(text, p, 1), '') END AS type, CASE WHEN ok THEN nullif(regexp_extract(text, p, 2), '') END AS dir, CASE WHEN ok THEN nullif(regexp_extract(text, p, 3), '') END AS target
FROM (SELECT text, p, regexp_matches(text, p) AS ok FROM (SELECT DISTINCT replace(c_name, '#', '') || CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '@a/b' ELSE '@a:x:y' END AS text, '^([A-Za-z0-9]+)(?:@([^:]+)(?::(.+))?)?$' AS p FROM customer))""")
def filter_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.when(F.col("c_custkey") % 3 == 0, "").when(F.col("c_custkey") % 3 == 1, "@a/b").otherwise("@a:x:y")
    rows = table(spark, sf_dir, "customer").select(F.concat(F.replace("c_name", F.lit("#"), F.lit("")), tail).alias("text")).distinct()
    return rows.withColumn("f", targets.parse_filter(F.col("text"))).select("text", "f.type", "f.dir", "f.target")


@query("SELECT lower(n_name) AS type FROM nation WHERE n_regionkey <> 1 AND n_nationkey <> 3 AND n_nationkey < 20")
def filter_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation")
    names = {r.n_nationkey: (r.n_name.lower(), r.n_regionkey) for r in rows.collect()}  # 25 rows by definition
    include = [(n, "some/dir", None) for k, (n, _) in names.items() if k < 20] + [("nosuchtool", None, None)]
    exclude = [(n, None, None) for k, (n, r) in names.items() if r == 1 or k == 3] + [(n, "some/dir", None) for n, _ in names.values()]
    return targets.allowed_tools(rows.select(F.lower("n_name").alias("type")), include, exclude)


@query("""SELECT p_partkey, p_size % 3 = 0 OR p_size % 3 = 1 OR p_size % 5 = 0 AS publishable, p_type <> 'SMALL' AS supported FROM part""")
def filter_publishable(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    env = F.when(size % 3 == 0, F.array().cast("array<string>")).when(size % 3 == 1, F.array(F.lit("development"), F.lit("production"))).otherwise(F.array(F.lit("testing")))
    env = F.when(size % 5 == 0, F.array_append(env, F.lit("other:ci"))).otherwise(env)
    kind = F.when(F.col("p_type") == "SMALL", "conan").otherwise("maven")
    return table(spark, sf_dir, "part").select("p_partkey", locators.publishable(env).alias("publishable"), locators.supported(kind).alias("supported"))


@query("""WITH c AS (SELECT count(*) AS found, count(*) FILTER (s_acctbal >= 0) AS kept FROM supplier)
SELECT CASE WHEN found = 0 THEN 'none found' WHEN kept = 0 THEN 'all filtered' ELSE 'scan' END AS outcome, found, kept FROM c""")
def filter_result_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "supplier").agg(F.count("*").alias("found"), F.count_if(F.col("s_acctbal") >= 0).alias("kept"))
    return counts.withColumn("outcome", F.when(F.col("found") == 0, "none found").when(F.col("kept") == 0, "all filtered").otherwise("scan"))


# Locators of parts: brand, name and size; aliases by brand and name.
_LOC = "lo AS (SELECT p_partkey, lower(p_brand) AS fetcher, p_name AS project, p_size::VARCHAR AS revision FROM part)"


def _locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.lower("p_brand").alias("fetcher"), F.col("p_name").alias("project"), F.col("p_size").cast("string").alias("revision"))


@query(f"""WITH {_LOC}, al AS (SELECT fetcher, project, CASE WHEN p_partkey % 2 = 0 THEN revision END AS version, 'base' AS bf, project || '-base' AS bp, CASE WHEN p_partkey % 3 = 0 THEN '9' END AS bv, p_partkey AS ord FROM lo WHERE p_partkey < 300),
la AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY fetcher, project ORDER BY ord DESC) = 1)
SELECT p_partkey, CASE WHEN hit THEN bf ELSE fetcher END AS fetcher, CASE WHEN hit THEN bp ELSE project END AS project, CASE WHEN hit THEN coalesce(bv, revision) ELSE revision END AS revision
FROM (SELECT lo.*, bf, bp, bv, la.ord IS NOT NULL AND (version IS NULL OR version = lo.revision) AS hit FROM lo LEFT JOIN la ON la.fetcher = lo.fetcher AND la.project = lo.project)""")
def fork_alias_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _locators(spark, sf_dir)
    k = F.col("p_partkey")
    aliases = rows.where("p_partkey < 300").select(
        "fetcher", "project", F.when(k % 2 == 0, F.col("revision")).alias("version"), F.lit("base").alias("base_fetcher"), F.concat("project", F.lit("-base")).alias("base_project"), F.when(k % 3 == 0, "9").alias("base_version"), k.alias("ord")
    )
    return joins.translate(rows, aliases).select("p_partkey", "fetcher", "project", "revision")


@query("""WITH u AS (SELECT l_orderkey AS unit, 'part:' || l_partkey AS locator, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS own FROM lineitem GROUP BY ALL)
SELECT unit, locator, CASE WHEN p_size < 10 THEN 'alias-' || p_brand || ',' || own ELSE own END AS labels FROM u JOIN part ON locator = 'part:' || p_partkey""")
def label_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("unit"), key("part", "l_partkey").alias("locator")).agg(F.array_sort(F.collect_set("l_returnflag")).alias("labels"))
    aliases = table(spark, sf_dir, "part").where("p_size < 10").select(key("part", "p_partkey").alias("locator"), F.array(F.concat(F.lit("alias-"), "p_brand")).alias("labels"))
    return joins.merge_labels(units, aliases).withColumn("labels", F.array_join("labels", ","))


@query("SELECT c_custkey AS k, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'known' ELSE 'needs scan' END AS status FROM customer")
def needs_scan_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, new = joins.split_known(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k")
    return known.withColumn("status", F.lit("known")).unionByName(new.withColumn("status", F.lit("needs scan")))


@query("""WITH n AS (SELECT l_orderkey AS o, l_partkey AS p, min(l_suppkey) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL), g AS (SELECT l_partkey AS p, min(l_suppkey) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL)
SELECT DISTINCT l_orderkey AS o, l_partkey AS p, coalesce(n.v, g.v, -1) AS version FROM lineitem LEFT JOIN n ON n.o = l_orderkey AND n.p = l_partkey LEFT JOIN g ON g.p = l_partkey""")
def version_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("v"), "l_returnflag")
    nested = lines.where("l_returnflag = 'R'").groupBy("o", "p").agg(F.min("v").alias("version"))
    whole = lines.where("l_returnflag = 'A'").groupBy("p").agg(F.min("v").alias("version"))
    return joins.first_of(lines.select("o", "p").distinct(), [(nested, ["o", "p"]), (whole, ["p"])], "version", F.lit(-1).cast("long"))


@query("""SELECT r.name, coalesce(e.k, c.k) AS k FROM (SELECT DISTINCT upper(replace(p_name, ' ', CASE p_partkey % 2 WHEN 0 THEN '_' ELSE '.' END)) AS name FROM part UNION SELECT DISTINCT replace(p_name, ' ', '-') FROM part) r
LEFT JOIN (SELECT replace(p_name, ' ', '-') AS name, min(p_partkey) AS k FROM part GROUP BY 1) e ON e.name = r.name
LEFT JOIN (SELECT replace(p_name, ' ', '-') AS name, min(p_partkey) AS k FROM part GROUP BY 1) c ON c.name = lower(regexp_replace(r.name, '[._]', '-', 'g'))""")
def name_canonical_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    mark = F.when(F.col("p_partkey") % 2 == 0, "_").otherwise(".")
    plain = F.replace("p_name", F.lit(" "), F.lit("-"))
    names = parts.select(F.upper(F.replace("p_name", F.lit(" "), mark)).alias("name")).union(parts.select(plain.alias("name"))).distinct()
    known = parts.groupBy(plain.alias("name")).agg(F.min("p_partkey").alias("k"))
    rows = names.withColumn("canonical", locators.canonical_name(F.col("name")))
    return joins.first_of(rows, [(known, ["name"]), (known.withColumnRenamed("name", "canonical"), ["canonical"])], "k", F.lit(None).cast("long")).select("name", "k")


@query("""WITH m AS (SELECT DISTINCT lower(p_type) || '/' || p_size AS dir FROM part)
SELECT root, dir FROM (SELECT 'small/1' AS root, '^small/[^/]*$' AS yes, '^small/2[^/]*$' AS no UNION ALL SELECT 'economy', '^(.*/)?7$', '^$') CROSS JOIN m WHERE regexp_matches(dir, yes) AND NOT regexp_matches(dir, no) AND dir <> root""")
def workspace_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    folders = table(spark, sf_dir, "part").select(F.concat(F.lower("p_type"), F.lit("/"), "p_size").alias("dir")).distinct()
    given = [("small/1", "small/*", False), ("small/1", "small/2*", True), ("economy", "**/7", False)]
    return joins.members(folders, spark.createDataFrame([(r, paths.glob_regex(g), n) for r, g, n in given], "root string, regex string, negated boolean"))


@query("""SELECT coalesce(np, p) AS package, coalesce(nv, v) AS version, count(*) AS n FROM (SELECT p_name AS p, p_size::VARCHAR AS v FROM part)
LEFT JOIN (SELECT p_name AS x, CASE WHEN k % 3 = 0 THEN p_name || '/fork' END AS np, CASE WHEN k % 3 = 0 THEN 'v' || k END AS nv, k % 3 = 1 AS loc FROM (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY 1)) ON x = p
WHERE NOT loc GROUP BY ALL""")
def replace_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    k = F.col("k")
    replaces = parts.groupBy(F.col("p_name").alias("package")).agg(F.min("p_partkey").alias("k")).select(
        "package", F.when(k % 3 == 0, F.concat("package", F.lit("/fork"))).alias("new_package"), F.when(k % 3 == 0, F.concat(F.lit("v"), k.cast("string"))).alias("new_version"), (k % 3 == 1).alias("is_local")
    )
    return joins.replaced(parts.select(F.col("p_name").alias("package"), F.col("p_size").cast("string").alias("version")), replaces).groupBy("package", "version").agg(F.count("*").alias("n"))


@query(f"""WITH {_PATHS}, u AS (SELECT DISTINCT path FROM pp), rules AS (SELECT 'fr' AS prefix, 'french' AS rule UNION ALL SELECT 'en/8', 'eight' UNION ALL SELECT 'en/825/x', 'deep' UNION ALL SELECT 'fr/825', 'late')
SELECT path, prefix, rule FROM u LEFT JOIN (SELECT p.path AS x, prefix, rule FROM u p JOIN rules ON p.path = prefix OR starts_with(p.path, prefix || '/') QUALIFY row_number() OVER (PARTITION BY p.path ORDER BY length(prefix), prefix) = 1) ON x = path""")
def rule_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("fr", "french"), ("en/8", "eight"), ("en/825/x", "deep"), ("fr/825", "late")], "prefix string, rule string")
    return joins.owning_rule(_paths(spark, sf_dir).select("path").distinct(), rules)


@query("""WITH l AS (SELECT p_partkey AS node, p_partkey AS ancestor, 0 AS depth FROM part UNION ALL SELECT p_partkey, p_partkey // 10, 1 FROM part UNION ALL SELECT p_partkey, p_partkey // 100, 2 FROM part),
pr AS (SELECT p_partkey AS node, 'color' AS k, split_part(p_name, ' ', 1) AS v FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 'brand', p_brand FROM part WHERE p_partkey < 20)
SELECT l.node, k AS key, arg_min(v, depth) AS value FROM l JOIN pr ON pr.node = l.ancestor GROUP BY ALL""")
def parent_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    up = lambda by, depth: p.select(k.alias("node"), F.floor(k / by).cast("long").alias("ancestor"), F.lit(depth).alias("depth"))
    lineage = up(1, 0).union(up(10, 1)).union(up(100, 2))
    own = p.where(k % 3 == 0).select(k.alias("node"), F.lit("color").alias("key"), F.substring_index("p_name", " ", 1).alias("value")).union(p.where("p_partkey < 20").select(k, F.lit("brand"), "p_brand"))
    return joins.overlay_parents(own, lineage)


@query("SELECT md5(text) AS key, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def fingerprint_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.duplicates(table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.md5("text").alias("key")), "key")


@query(f"""WITH {_PATHS}, f AS (SELECT DISTINCT regexp_extract(path, '^(.*/)', 1) AS prefix FROM pp) SELECT prefix FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.prefix <> f.prefix AND g.prefix <> '' AND starts_with(f.prefix, g.prefix))""")
def minimal_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.minimal_prefixes(_paths(spark, sf_dir))


_LAYER = """ch AS (SELECT conv_id AS image, turn AS seq, CASE role WHEN 'user' THEN 'a/' || turn % 3 || '/f' ELSE CASE turn % 3 WHEN 1 THEN 'a/1' ELSE 'a/0/f' END END AS path, CASE role WHEN 'user' THEN 'insert' ELSE 'remove' END AS op FROM conversations WHERE role <> 'system')"""


@query(f"""WITH {_LAYER}, i AS (SELECT image, path, max(seq) AS seq FROM ch WHERE op = 'insert' GROUP BY ALL)
SELECT image, path, seq FROM i WHERE NOT EXISTS (SELECT 1 FROM ch c WHERE c.op = 'remove' AND c.image = i.image AND c.seq > i.seq AND (c.path = i.path OR starts_with(i.path, c.path || '/')))""")
def layer_squash(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn")
    put = F.col("role") == "user"
    path = F.when(put, F.concat(F.lit("a/"), (turn % 3).cast("string"), F.lit("/f"))).when(turn % 3 == 1, "a/1").otherwise("a/0/f")
    changes = table(spark, sf_dir, "conversations").where("role <> 'system'").select(F.col("conv_id").alias("image"), path.alias("path"), turn.alias("seq"), F.when(put, "insert").otherwise("remove").alias("op"))
    return rollups.squash_layers(changes)


_SCANS = "sc AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'skipped by filter' WHEN 'signup' THEN 'skipped by default' ELSE 'succeeded' END AS status, json_extract(props, '$.k')::BIGINT % 5 AS warnings FROM events)"


def _scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "error", "failed").when(kind == "view", "skipped by filter").when(kind == "signup", "skipped by default").otherwise("succeeded")
    return table(spark, sf_dir, "events").select("event_id", status.alias("status"), (F.get_json_object("props", "$.k").cast("long") % 5).alias("warnings"))


@query(f"""WITH {_SCANS} SELECT count(*) AS projects, count(*) FILTER (status LIKE 'skipped%') AS skipped, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'failed') AS failed, sum(warnings)::BIGINT AS warnings FROM sc""")
def scan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.scan_counts(_scans(spark, sf_dir))


@query(f"""WITH {_SCANS} SELECT event_id, row_number() OVER (ORDER BY CASE status WHEN 'failed' THEN 0 WHEN 'succeeded' THEN 1 WHEN 'skipped by filter' THEN 2 ELSE 3 END, warnings DESC, event_id) - 1 AS place FROM sc""")
def scan_ordering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.operators.numbering import numbered

    rank, _ = rollups.scan_order(F.col("status"), F.col("warnings"))
    rows = _scans(spark, sf_dir).select("event_id", rank.alias("rank"), (-F.col("warnings")).alias("fewer"))
    return numbered(rows, ["rank", "fewer", "event_id"], "place")[0].select("event_id", "place")


@query("SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 1000 AS batch FROM events")
def batch_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.batches(table(spark, sf_dir, "events").select("event_id"), ["event_id"])


@query("SELECT p_brand, arg_min(p_name, (length(p_name), p_partkey)) AS p_name FROM part GROUP BY p_brand")
def shortest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.shortest(table(spark, sf_dir, "part"), ["p_brand"], "p_name", "p_partkey")


@query("""WITH u AS (SELECT p_name || p_brand AS name, p_partkey AS ord, p_type AS dir, [p_type, p_brand, p_type] AS files FROM part)
SELECT name, count(*) AS n, arg_min(dir, ord) AS dir, CASE WHEN count(*) = 1 THEN array_to_string(arg_min(files, ord), ',') ELSE array_to_string(list_sort(list_distinct(flatten(list(files)))), ',') END AS files FROM u GROUP BY name""")
def license_units_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    units = table(spark, sf_dir, "part").select(F.concat("p_name", "p_brand").alias("name"), F.col("p_partkey").alias("ord"), F.col("p_type").alias("dir"), F.array("p_type", "p_brand", "p_type").alias("files"), none.alias("data"))
    return rollups.combine_units(units).select("name", "n", "dir", F.array_join("files", ",").alias("files"))


@query("SELECT o_custkey AS k, 'late' AS kind, count(*) AS n FROM orders o WHERE o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_orderstatus = 'O' AND p.o_custkey = o.o_custkey) GROUP BY ALL")
def issue_diff_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    now = orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"), F.lit("late").alias("kind"))
    before = orders.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k"))
    return rollups.new_issues(now, before, ["k"]).groupBy("k", "kind").agg(F.count("*").alias("n"))


@query("""SELECT l_partkey AS k, arg_min(l_suppkey, (l_linenumber, l_orderkey)) FILTER (l_returnflag <> 'R') AS value, min((l_linenumber, l_orderkey)) FILTER (l_returnflag <> 'R') IS NOT NULL AS found FROM lineitem GROUP BY 1""")
def first_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    tried = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), F.when(F.col("l_returnflag") == "R", "failed").otherwise("succeeded").alias("status"), F.col("l_suppkey").alias("value"), F.lit("t").alias("tactic"), F.struct("l_linenumber", "l_orderkey").alias("at"))
    return rollups.first_success(tried, "k", "at").select("k", "value", F.col("tactic").isNotNull().alias("found"))


# Content scans

_PATTERNS = {"license": r"[Ll]icen[sc]ed? under [^\n.]{1,60}", "released": r"Released under the [A-Z]+ License", "email": r"[a-z0-9._]+@[a-z0-9-]+\.[a-z]+"}
_MATCHES = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS name, unnest(regexp_extract_all(text, '{p}')) AS match FROM documents" for n, p in _PATTERNS.items())


@query(f"SELECT doc_id, name, match, count(*) AS n FROM ({_MATCHES}) GROUP BY ALL")
def keyword_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = content.keyword_matches(table(spark, sf_dir, "documents"), _PATTERNS, "doc_id")
    return found.groupBy(F.col("path").alias("doc_id"), "name", "match").agg(F.count("*").alias("n"))


@query(f"SELECT name AS title, doc_id AS path, count(*) AS n, sum(length(match))::BIGINT AS length FROM ({_MATCHES}) GROUP BY ALL")
def license_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.match_units(content.keyword_matches(table(spark, sf_dir, "documents"), _PATTERNS, "doc_id"))


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(f"""WITH p AS (SELECT 'i' || item_id AS name, ' ' || array_to_string(list_filter(regexp_split_to_array({_LOW}, '[^a-z0-9]+'), lambda w: w <> '')[2:6], ' ') || ' ' AS phrase FROM benchmark),
t AS (SELECT doc_id, ' ' || array_to_string(list_filter(regexp_split_to_array({_LOW}, '[^a-z0-9]+'), lambda w: w <> ''), ' ') || ' ' AS t FROM documents),
f AS (SELECT doc_id, name, left(t, instr(t, phrase)::INT) AS head FROM t JOIN p ON length(trim(phrase)) > 0 AND contains(t, phrase))
SELECT doc_id, name, length(head) - length(replace(head, ' ', '')) - 1 AS first_word FROM f""")
def phrases_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five words of each benchmark item, where they first stand in a document."""
    low = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    some = F.slice(F.filter(F.split(low, "[^a-z0-9]+"), lambda w: w != ""), 2, 5)
    phrases = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("i"), F.col("item_id").cast("string")).alias("name"), F.array_join(some, " ").alias("phrase"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    found = phrase_matches(docs, phrases).groupBy("path", "name").agg(F.min("start_word").alias("first_word"))
    return found.select(F.col("path").cast("long").alias("doc_id"), "name", "first_word")


@query()
def keyword_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.keyword_positions(table(spark, sf_dir, "documents"), _PATTERNS, "doc_id")


@query("""WITH t AS (SELECT doc_id, CASE WHEN ends_with(replace(text, chr(13) || chr(10), chr(10)), chr(13)) THEN left(replace(text, chr(13) || chr(10), chr(10)), length(replace(text, chr(13) || chr(10), chr(10))) - 1) ELSE replace(text, chr(13) || chr(10), chr(10)) END AS t FROM documents)
SELECT doc_id, sha256(CASE WHEN t = '' OR ends_with(t, chr(10)) THEN t ELSE t || chr(10) END) AS sha256 FROM t""")
def fingerprint_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", content.raw_fingerprint(F.col("text")).alias("sha256"))


@query()
def fingerprint_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", content.code_fingerprint(F.col("text")).alias("sha256"))


_GRAMS = r"list_transform(range(1, greatest(len({w}) - 6, 1)), lambda i: array_to_string({w}[i:i + 7], ' '))"
_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


@query(f"""WITH b AS (SELECT DISTINCT unnest({_GRAMS.format(w="w")}) AS s FROM (SELECT {_WORDS} AS w FROM benchmark)), d AS (SELECT doc_id, unnest({_GRAMS.format(w="w")}) AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents))
SELECT count(*) AS processed, count(DISTINCT d.s) AS distinct_snippets, count(b.s) AS matched, count(*) - count(b.s) AS unmatched, count(DISTINCT b.s) AS matched_snippets, count(DISTINCT CASE WHEN b.s IS NOT NULL THEN doc_id END) AS documents FROM d LEFT JOIN b ON b.s = d.s""")
def snippet_match_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "benchmark").select(F.explode(content.shingles(F.col("text"), 8)).alias("s")).distinct().select(F.xxhash64("s").alias("h"), F.lit(True).alias("hit"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(content.shingles(F.col("text"), 8)).alias("s")).select("doc_id", F.xxhash64("s").alias("h"))
    counts = rows.join(known, "h", "left").groupBy("h", "hit").agg(F.count("*").alias("n"))
    hit = F.col("hit").isNotNull()
    zero = F.lit(0).cast("long")
    stats = counts.select(F.col("n").alias("processed"), F.lit(1).cast("long").alias("distinct_snippets"), F.when(hit, F.col("n")).otherwise(zero).alias("matched"), F.when(hit, zero).otherwise(F.col("n")).alias("unmatched"), hit.cast("long").alias("matched_snippets"), zero.alias("documents"))
    docs = rows.join(known, "h", "left_semi").select("doc_id").distinct().select(*[zero.alias(c) for c in stats.columns[:-1]], F.lit(1).cast("long").alias("documents"))
    return stats.unionByName(docs).agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in stats.columns])


@query("""SELECT c_custkey AS project, CASE WHEN c_nationkey % 3 <> 0 THEN 'unsupported type' WHEN c_acctbal < 0 THEN 'partial graph' ELSE 'eligible' END AS reason FROM customer""")
def reachability_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("c_nationkey") % 3 == 0, "maven").otherwise("npm")
    breadth = F.when(F.col("c_acctbal") < 0, "partial").otherwise("complete")
    reason = F.when(~kind.isin("maven", "gradle"), "unsupported type").when(breadth != "complete", "partial graph").otherwise("eligible")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project"), reason.alias("reason"))


# Sinks


def _units(graph: Graph) -> DataFrame:
    """(node, is_direct, imports): reachable dependencies with their children as locators."""
    children = graph.adjacency()
    return graph.vertices.join(children, "node").select("node", "is_direct", F.array_join("successors", ",").alias("imports"))


@query(f"""WITH RECURSIVE {LAYERED_SQL}, r(node) AS (SELECT node FROM d UNION SELECT dst FROM r JOIN e ON src = r.node),
loc AS (SELECT node, split_part(node, ':', 1) || '+' || split_part(node, ':', 2) || '$' AS l FROM r)
SELECT a.l AS locator, a.node IN (SELECT node FROM d) AS is_direct, coalesce(string_agg(b.l, ',' ORDER BY b.l), '') AS imports FROM loc a LEFT JOIN e ON e.src = a.node LEFT JOIN loc b ON b.node = e.dst GROUP BY a.l, a.node""")
def source_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = layered(spark, sf_dir).prune_unreachable()
    name = locators.render(F.substring_index("node", ":", 1), F.substring_index("node", ":", -1), F.lit(None).cast("string"))
    named = graph.relabel(graph.vertices.select("node", name.alias("to"))).saved()
    return _units(named).withColumnRenamed("node", "locator")


@query("""SELECT n_name AS project, count(DISTINCT c_custkey) AS direct_deps, count(DISTINCT o_orderkey) AS deep_deps, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS licenses
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name""")
def attribution_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    deep = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    direct = table(spark, sf_dir, "customer").join(deep, "c_custkey", "left").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("c"), F.sum(F.coalesce("n", F.lit(0))).alias("o"), F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("licenses"))
    return table(spark, sf_dir, "nation").join(direct, "n_nationkey", "left").select(F.col("n_name").alias("project"), F.coalesce("c", F.lit(0)).alias("direct_deps"), F.coalesce("o", F.lit(0)).alias("deep_deps"), "licenses")


@query("SELECT 'd' || s_suppkey % 10 AS dir, lower(n_name) AS type, count(*) AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL")
def target_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _projects(spark, sf_dir).groupBy("dir", "type").agg(F.count("*").alias("n"))


@query(f"""WITH {_SCANS} SELECT status, count(*) AS n, count(*) || ' ' || status || ', ' || sum(warnings) || ' warnings' AS line FROM sc GROUP BY status""")
def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _scans(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"), F.sum("warnings").alias("w"))
    return counts.select("status", "n", F.format_string("%d %s, %d warnings", "n", "status", "w").alias("line"))


@query("""SELECT lower(n_name) AS type, 'd' || s_suppkey % 10 AS dir, '{"type":"' || lower(n_name) || '","path":"d' || s_suppkey % 10 || '","id":' || s_suppkey || '}' AS json FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def json_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _projects(spark, sf_dir).select("type", "dir", F.to_json(F.struct("type", F.col("dir").alias("path"), F.col("s_suppkey").alias("id"))).alias("json"))
