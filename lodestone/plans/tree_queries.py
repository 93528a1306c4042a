"""Printed trees and bracketed sources made from the test tables: forty parts each are one file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import linked
from lodestone.plans.registry import Registry
from lodestone.sources import brackets, declared, gobinary, locks, rpm, trees
from lodestone.sources.tables import table

registry = Registry()
query = registry.query

#: Depths of eight lines that follow each other.
DEPTHS = (0, 1, 2, 2, 1, 2, 3, 1)
_ROWS = f"""n AS (SELECT p_partkey AS k, 'f' || p_partkey // 40 AS file, p_partkey % 40 AS i, p_size AS size, {list(DEPTHS)}[p_partkey % 8 + 1] AS depth FROM part),
t AS (SELECT a.*, (SELECT max(b.k) FROM n b WHERE b.file = a.file AND b.k < a.k AND b.i // 8 = a.i // 8 AND b.depth = a.depth - 1) AS up FROM n a)"""


def _printed(spark: SparkSession, sf_dir: str, line: Column, before: str = "", after: str = "") -> DataFrame:
    """(file, content): ``line`` of each part, from k, i, size and depth."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k.alias("k"), (k % 40).alias("i"), F.col("p_size").alias("size"), F.element_at(F.array(*map(F.lit, DEPTHS)), (k % 8).cast("int") + 1).alias("depth"))
    rows = rows.withColumn("line", line).groupBy(F.concat(F.lit("f"), F.floor(F.col("k") / 40).cast("string")).alias("file")).agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("x"))
    return rows.select("file", F.concat(F.lit(before), F.array_join(F.transform("x", lambda x: x["line"]), "\n"), F.lit(after)).alias("content"))


def _sbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.when(F.col("depth") == 0, "").otherwise(F.concat(F.lit("  "), F.expr("repeat('| ', depth - 1)"), F.lit("+-")))
    line = F.concat(F.lit("[info] "), mark, F.format_string("g:p%s:1.%s", "k", "size"), F.when(F.col("size") % 5 == 0, F.format_string(" (evicted by: 2.%s)", "size")).otherwise(""), F.when(F.col("k") % 8 == 6, "\n[info]   | ").otherwise(""))
    return _printed(spark, sf_dir, line, "[info] welcome\n", "\n[success] done")


@query(f"""WITH {_ROWS} SELECT file, 'g:p' || k AS name, CASE WHEN size % 5 = 0 THEN '2.' ELSE '1.' END || size AS version, 'production' AS env, depth = 1 AS is_direct FROM t WHERE i BETWEEN 1 AND 7""")
def reader_sbt_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _sbt(spark, sf_dir)
    first = table(spark, sf_dir, "part").where("p_partkey % 40 = 0")
    size = F.col("p_size").cast("string")
    own = first.select(F.concat(F.lit("f"), F.floor(F.col("p_partkey") / 40).cast("string")).alias("file"), F.concat(F.lit("g:p"), F.col("p_partkey").cast("string")).alias("name"), F.concat(F.when(F.col("p_size") % 5 == 0, "2.").otherwise("1."), size).alias("version"))
    return trees.sbt(files, own)[0]


@query(f"""WITH {_ROWS} SELECT a.file, 'g:p' || a.k AS item, 'g:p' || b.k AS parent FROM t a LEFT JOIN t b ON b.k = a.up""")
def reader_sbt_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.sbt_tree(_sbt(spark, sf_dir)).select("file", F.col("item.name").alias("item"), F.col("parent.name").alias("parent"))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    scm = F.when(F.col("k") % 7 == 3, F.format_string("https://h/p%s - 1.%s", "k", "size")).when(F.col("k") % 11 == 5, "/some/dir").otherwise("Hex package")
    line = F.concat(F.expr("repeat('|   ', depth)"), F.format_string("|-- p%s ~> 1.%s (%s)", "k", "size", scm))
    entry = F.when(F.col("k") % 3 > 0, F.concat(F.format_string("* p%s", "k"), F.when(F.col("k") % 3 == 1, F.format_string(" 3.%s", "size")).otherwise(""), F.format_string(" (%s) (mix)", scm), F.when(F.col("k") % 2 == 0, F.format_string("\n  locked at 4.%s (p) x", "size")).otherwise(""), F.lit("\n  ok"))).otherwise("* gone")
    return _printed(spark, sf_dir, line, "app\n"), _printed(spark, sf_dir, entry)


_MIX = f"""{_ROWS}, s AS (SELECT *, CASE WHEN k % 7 = 3 THEN 'git' WHEN k % 11 = 5 THEN 'other' ELSE 'hex' END AS type FROM t),
r(k, out) AS (SELECT k, type = 'other' FROM s WHERE depth = 0 UNION ALL SELECT s.k, r.out OR s.type = 'other' FROM s JOIN r ON s.up = r.k),
m AS (SELECT s.*, CASE WHEN type = 'git' THEN 'https://h/p' || k ELSE 'p' || k END AS name, CASE WHEN k % 3 = 1 THEN '3.' || size WHEN k % 3 = 2 AND k % 2 = 0 THEN '4.' || size WHEN type = 'git' THEN '1.' || size ELSE '~> 1.' || size END AS version FROM s JOIN r USING (k) WHERE NOT out)"""


@query(f"WITH RECURSIVE {_MIX} SELECT file, name, version, type, depth = 0 AS is_direct FROM m")
def reader_mix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.mix(*_mix(spark, sf_dir))[0]


@query(f"WITH RECURSIVE {_MIX} SELECT a.file, b.name AS src, a.name AS dst FROM m a JOIN m b ON b.k = a.up")
def reader_mix_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.mix(*_mix(spark, sf_dir))[1]


def _rebar(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    where = F.when(F.col("k") % 7 == 3, F.format_string("https://github.com/p%s", "k")).otherwise("hex package")
    line = F.concat(F.lit("   "), F.expr("repeat('│  ', depth)"), F.format_string("├─ p%s─1.%s (%s)", "k", "size", where))
    alias = F.when(F.col("k") % 3 == 0, F.format_string('{p%s, "1", {pkg, real%s}}', "k", "k")).otherwise(F.format_string("p%s", "k"))
    configs = _printed(spark, sf_dir, F.concat(alias, F.lit(",")), "{deps, [\n", " last]}.\n")
    return _printed(spark, sf_dir, line, "===> Verifying\n"), configs


_REBAR = f"{_ROWS}, m AS (SELECT *, CASE WHEN k % 7 = 3 THEN 'https://github.com/p' || k WHEN depth = 0 AND k % 3 = 0 THEN 'real' || k ELSE 'p' || k END AS name FROM t)"


@query(f"WITH {_REBAR} SELECT file, name, '1.' || size AS version, CASE WHEN k % 7 = 3 THEN 'git' ELSE 'hex' END AS type, depth = 0 AS is_direct FROM m")
def reader_rebar_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.rebar3(*_rebar(spark, sf_dir))[0]


@query(f"WITH {_REBAR} SELECT a.file, b.name AS src, a.name AS dst FROM m a JOIN m b ON b.k = a.up")
def reader_rebar_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.rebar3(*_rebar(spark, sf_dir))[1]


def _setup(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.when(F.col("k") % 3 == 0, F.format_string("'p%s[a, b] >= 1.%s, < 9',  # ] one", "k", "size")).when(F.col("k") % 3 == 1, F.format_string('"p%s",', "k")).otherwise(F.format_string('"p%s @ https://h/%s ; os_name == \'a\'",', "k", "size"))
    return _printed(spark, sf_dir, item, "setup(\n    author='[',\n    name = 'app', packages=[x(1), {2: 3}],\n    install_requires=[\n", "\n    ],\n)\n")


@query(f"""WITH {_ROWS} SELECT file, 'p' || k AS name, CASE k % 3 WHEN 0 THEN '>=1.' || size || ',<9' WHEN 2 THEN 'https://h/' || size END AS version, 'production' AS env, true AS is_direct FROM n""")
def reader_setup_py(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brackets.setup([brackets.setup_py(_setup(spark, sf_dir))])[0]


_INSTALLED = f"""{_ROWS}, e AS (SELECT a.file, a.k AS src, b.k AS dst FROM n a JOIN n b ON b.file = a.file AND b.i IN (2 * a.i + 1, 2 * a.i + 2) AND a.i % 5 <> 4)"""


@query(f"""WITH RECURSIVE {_INSTALLED}, r(file, k, d) AS (SELECT file, dst, 1 FROM e WHERE src % 40 = 0 UNION ALL SELECT e.file, e.dst, r.d + 1 FROM r JOIN e ON e.src = r.k)
SELECT r.file, 'p' || r.k AS name, '==1.' || n.size AS version, 'production' AS env, bool_or(r.d = 1) AS is_direct FROM r JOIN n ON n.k = r.k GROUP BY ALL""")
def reader_setup_installed(spark: SparkSession, sf_dir: str) -> DataFrame:
    needs = F.array_join(F.transform(F.array(2 * F.col("i") + 1, 2 * F.col("i") + 2), lambda j: F.concat(F.lit("P"), (F.col("k") - F.col("i") + j).cast("string"))), ", ")
    block = F.format_string("Name: p%s\nVersion: 1.%s\nRequires: %s\n---", "k", "size", F.when(F.col("i") % 5 == 4, "").otherwise(needs))
    shown = locks.pip_show(_printed(spark, sf_dir, block))
    files = _printed(spark, sf_dir, F.when(F.col("i") == 0, F.format_string("setup(name='P%s', install_requires=['unused'])", "k")).otherwise("#"))
    return brackets.setup([brackets.setup_py(files)], shown)[0]


def _lein(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = F.when(F.col("k") % 3 == 0, ' :scope "test"').when(F.col("k") % 5 == 0, ' :exclusions [[a/b "9"]] :scope "provided"').otherwise("")
    key = F.format_string('[%s "1.%s"%s]', F.when(F.col("k") % 4 == 1, F.format_string("p%s", "k")).otherwise(F.format_string("g/p%s", "k")), "size", scope)
    line = F.when(F.col("i") % 8 == 0, F.concat(F.when(F.col("i") == 0, "").otherwise("}, ; next }\n"), key, F.lit(" {"))).otherwise(F.concat(F.lit(" "), key, F.lit(" nil")))
    return _printed(spark, sf_dir, line, "{", "}}\n")


_NAME = "CASE WHEN {k} % 4 = 1 THEN 'p' || {k} ELSE 'g' END || ':p' || {k}"


@query(f"""WITH {_ROWS} SELECT file, {_NAME.format(k="k")} AS name, '1.' || size AS version, CASE WHEN k % 3 = 0 THEN 'testing' WHEN k % 5 = 0 THEN 'provided' END AS env, i % 8 = 0 AS is_direct FROM n""")
def reader_lein_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brackets.lein_tree(_lein(spark, sf_dir))[0]


@query(f"""WITH {_ROWS} SELECT file, {_NAME.format(k="(k - k % 8)")} AS src, {_NAME.format(k="k")} AS dst FROM n WHERE i % 8 > 0""")
def reader_lein_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brackets.lein_tree(_lein(spark, sf_dir))[1].select("file", F.col("src.name").alias("src"), F.col("dst.name").alias("dst"))


def _number(n: Column) -> Column:
    """Four bytes, the first the highest."""
    return F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0"))


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, package, blob): a package header for each part, in the older form without a region; every ninth one is broken."""
    k, nul = F.col("p_partkey"), F.lit(b"\0")
    texts = [(1000, F.concat(F.lit("pkg"), k.cast("string"))), (1001, F.concat(F.lit("1."), F.col("p_size").cast("string"))), (1002, F.lit("7.el9")), (1022, F.when(k % 2 == 0, "x86_64").otherwise("noarch"))]
    data, index, at = F.unhex(F.lit("")), [], F.lit(0)
    epoch = k % 3 == 0
    for tag, text in texts:
        kind = F.when((k % 9 == 4) & F.lit(tag == 1022), 11).otherwise(6)
        index += [_number(F.lit(tag)), _number(kind), _number(at), _number(F.lit(1))]
        data, at = F.concat(data, F.encode(text, "UTF-8"), nul), at + F.length(text) + 1
    pad = F.pmod(-at, F.lit(4))
    index += [F.when(epoch, F.concat(_number(F.lit(1003)), _number(F.lit(4)), _number(at + pad), _number(F.lit(1)))).otherwise(F.unhex(F.lit("")))]
    data = F.when(epoch, F.concat(data, F.substring(F.lit(b"\0\0\0\0"), F.lit(1), pad), _number(k % 5))).otherwise(data)
    blob = F.concat(_number(F.when(epoch, 5).otherwise(4)), _number(F.length(data)), *index, data)
    return table(spark, sf_dir, "part").select(F.concat(F.lit("f"), F.floor(k / 40).cast("string")).alias("file"), (k % 40 + 1).alias("package"), blob.alias("blob"))


@query(f"""WITH {_ROWS} SELECT file, 'pkg' || k || '#sles#15.3' AS name, CASE WHEN k % 2 = 0 THEN 'x86_64' ELSE 'noarch' END || '#' || CASE WHEN k % 3 = 0 THEN k % 5 || ':' ELSE '' END || '1.' || size || '-7.el9' AS version,
'production' AS env, true AS is_direct FROM n WHERE k % 9 <> 4""")
def reader_rpm_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    blobs = _headers(spark, sf_dir)
    return rpm.packages(blobs, blobs.select("file", F.lit("sles").alias("id"), F.lit("15.3").alias("release")).distinct())[0]


@query(f"WITH {_ROWS} SELECT file, i + 1 AS package, 'unknown type' AS problem FROM n WHERE k % 9 = 4")
def reader_rpm_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpm.headers(_headers(spark, sf_dir))[1]


def _varint(n: Column) -> Column:
    """A number below 2^21, seven bits a byte from the lowest."""
    byte = lambda v: F.unhex(F.lpad(F.hex(v.cast("long")), 2, "0"))
    low, mid, high = n % 128, F.floor(n / 128) % 128, F.floor(n / 16384)
    return F.when(n < 128, byte(low)).when(n < 16384, F.concat(byte(low + 128), byte(mid))).otherwise(F.concat(byte(low + 128), byte(mid + 128), byte(high)))


def _binaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, content): a binary for each forty parts that names them as modules, its mark at one of many places."""
    line = F.concat(F.format_string("dep\tm/p%s\tv1.%s.0\th1:x=", "k", "size"), F.when(F.col("k") % 5 == 0, F.format_string("\n=>\tr/p%s\tv0.0.0-20220715151400-c0bba94a%s\t", "k", F.lpad(F.col("size").cast("string"), 4, "0"))).otherwise(""))
    text = _printed(spark, sf_dir, line, "path\tapp\nmod\tapp\t(devel)\t\n", "\nbuild\tx=y\n")
    blob = lambda b: F.lit(b)
    info = F.concat(blob(b"\xaa" * 16), F.encode("content", "UTF-8"), blob(b"\xbb" * 16))
    room = (F.regexp_extract("file", r"(\d+)", 1).cast("int") % 400) * 16 + 48
    body = F.concat(blob(b"\x7fELF"), F.expr("unhex(repeat('00', 12))"), F.unhex(F.call_function("repeat", F.lit("00"), room)), blob(b"\xff Go buildinf:\x08\x02"), F.expr("unhex(repeat('00', 16))"), _varint(F.lit(6)), blob(b"go1.22"), _varint(F.length(info)), info)
    return text.select("file", F.concat(body, F.expr("unhex(repeat('00', 4096))")).alias("content"))


@query(f"""WITH {_ROWS} SELECT file, i + 1 AS nth, 'go' AS fetcher, CASE WHEN k % 5 = 0 THEN 'r/p' ELSE 'm/p' END || k AS project, CASE WHEN k % 5 = 0 THEN 'c0bba94a' || lpad(CAST(size AS VARCHAR), 4, '0') ELSE 'v1.' || size || '.0' END AS revision FROM n""")
def reader_go_binaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gobinary.units(*gobinary.build_info(gobinary.chunked(_binaries(spark, sf_dir), 2048)))


def _declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    entry = (
        F.when(k % 5 == 0, F.format_string("- {type: pypi, name: p%s, version: 1.%s0}", k, "size"))
        .when(k % 5 == 1, F.format_string("- {type: rpm-generic, name: p%s, version: 1.%s, epoch: 3, arch: noarch, os: Fedora, osVersion: 40}", k, "size"))
        .when(k % 5 == 2, F.format_string("- {type: %s, name: p%s}", F.when(k % 2 == 0, "cocoapods").otherwise("what"), k))
        .when(k % 5 == 3, F.format_string("- {type: apk, name: p%s, os: alpine, osVersion: 3, arch: %s}", k, F.when(k % 2 == 0, "x86_64").otherwise('""')))
        .otherwise(F.format_string("- {type: gem, name: p%s, url: u}", k))
    )
    return _printed(spark, sf_dir, entry, "version: 1\nlocator-dependencies:\n- npm+left-pad$1.0\n- {locator: git+g/r}\nreferenced-dependencies:\n", "\n")


@query(f"""WITH {_ROWS} SELECT file, CASE k % 5 WHEN 0 THEN 'pip' WHEN 1 THEN 'rpm-generic' WHEN 2 THEN 'pod' ELSE 'apk' END AS fetcher, 'p' || k || CASE k % 5 WHEN 1 THEN '#Fedora#40' WHEN 3 THEN '#alpine#3' ELSE '' END AS project,
CASE k % 5 WHEN 0 THEN '1.' || size || '0' WHEN 1 THEN 'noarch#3:1.' || size WHEN 3 THEN 'x86_64#' END AS revision FROM n WHERE k % 5 < 2 OR k % 5 < 4 AND k % 2 = 0
UNION ALL SELECT DISTINCT file, 'npm', 'left-pad', '1.0' FROM n UNION ALL SELECT DISTINCT file, 'git', 'g/r', NULL FROM n""")
def reader_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return declared.declared(_declared(spark, sf_dir)).imports.drop("list", "at")


@query(f"""WITH {_ROWS} SELECT file, i AS at, CASE k % 5 WHEN 2 THEN 'dep type: what not supported' WHEN 3 THEN 'arch is required' ELSE 'url is not allowed here' END AS problem FROM n WHERE k % 5 = 4 OR k % 5 IN (2, 3) AND k % 2 = 1""")
def reader_declared_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return declared.declared(_declared(spark, sf_dir)).problems.drop("list")


def _linked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What binaries are linked with, links of links, and the packages' files: every fourth part is owned as it is, others at the end of their links."""
    line = F.when(F.col("k") % 10 == 9, F.lit("\tlost.so => not found")).otherwise(F.format_string("\tlib%s.so => /lib/l%s.so (0x00007f)", "k", "k"))
    printed = _printed(spark, sf_dir, line, "\tlinux-vdso.so.1 =>  (0x00007f)\n")
    k = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("size"))
    hop = lambda a, b, only: k.where(only).select(F.format_string(f"/lib/{a}%s.so", "k").alias("path"), F.format_string(b, "k").alias("target"))
    links = hop("l", "m%s.so", "k % 4 > 0").unionByName(hop("m", "../usr/n%s.so", "k % 4 > 1")).unionByName(k.where("k % 4 = 3").select(F.format_string("/usr/n%s.so", "k").alias("path"), F.format_string("/lib/l%s.so", "k").alias("target")))
    end = F.when(F.col("k") % 4 == 0, F.format_string("/lib/l%s.so", "k")).when(F.col("k") % 4 == 1, F.format_string("/lib/m%s.so", "k")).otherwise(F.format_string("/usr/n%s.so", "k"))
    owned = k.where("k % 3 > 0").select(end.alias("path"), F.when(F.col("k") % 3 == 1, "deb").otherwise("rpm").alias("type"), F.format_string("pkg%s", "k").alias("package"), F.format_string("1.%s", "size").alias("version"), F.lit("amd64").alias("arch"), F.lit("2").alias("epoch"))
    return printed, links, owned


@query(f"""WITH {_ROWS} SELECT file, CASE k % 3 WHEN 1 THEN 'deb' ELSE 'rpm' END AS type, 'pkg' || k || '#os#9' AS name, CASE k % 3 WHEN 1 THEN 'amd64#' ELSE 'amd64#2:' END || '1.' || size AS version FROM n WHERE k % 10 < 9 AND k % 3 > 0 AND k % 4 < 3""")
def linked_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    printed, links, owned = _linked(spark, sf_dir)
    return linked.owners(linked.linked_files(printed), links, owned, "os", "9")[0]


@query(f"WITH {_ROWS} SELECT file, '/lib/l' || k || '.so' AS path FROM n WHERE k % 10 < 9 AND (k % 3 = 0 OR k % 4 = 3)")
def linked_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    printed, links, owned = _linked(spark, sf_dir)
    return linked.owners(linked.linked_files(printed), links, owned, "os", "9")[1]
