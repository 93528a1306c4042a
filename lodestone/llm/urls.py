"""URL filters: allow and block entries over hosts with their subdomains and paths, the most specific entry wins.

Entries stand in a trie whose edges are host labels from the last to the first and then whole path segments. A URL
walks down it once, so its cost is its own length, whatever the number of entries. An entry fits a URL if the URL's
host is the entry's host or below it and the URL's path starts with the entry's path, as a string: `/en/` fits
`/en/1` and not `/en`, `/en` fits `/english` too. Of the entries that fit, the one with the most host labels wins,
then the one with the longest path, and block wins over allow where both have the same host and path.

The trie is broadcast while there are at most ``limit`` entries; more are joined by equality on the hosts and the
beginnings of paths that a URL could match.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.rows import packed
from lodestone.plans.scratch import discard, materialise


class Entry(NamedTuple):
    host: str
    path: str
    verdict: str


#: Entries that a trie is broadcast for; each takes some hundred bytes in a worker.
LIMIT = 200_000
VERDICT = "rule string, verdict string"
_LABEL, _PATH, _ENDS = 0, 1, 2


def entries(spark: SparkSession, rules: Iterable[Entry]) -> DataFrame:
    """(host, path, verdict) of ``rules``."""
    return spark.createDataFrame([tuple(r) for r in rules], "host string, path string, verdict string")


def host_of(url: Column) -> Column:
    """What stands after the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty for null or without `://`."""
    found = F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit(""))
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty for null or without `://`."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _cut(path: str) -> tuple[list[str], str]:
    """A path's whole segments, each ended by a slash, and what is left."""
    *whole, rest = path.split("/")
    return whole, rest


def trie(rules: Iterable[Entry]) -> tuple:
    """A node is (nodes by host label, nodes by path segment, [(rest, rule, verdict)] from the longest rest to the shortest)."""
    root: tuple = ({}, {}, [])
    for host, path, verdict in rules:
        node = root
        for label in reversed(host.split(".")):
            node = node[_LABEL].setdefault(label, ({}, {}, []))
        whole, rest = _cut(path)
        for segment in whole:
            node = node[_PATH].setdefault(segment, ({}, {}, []))
        node[_ENDS].append((rest, host + path, verdict))
    todo = [root]
    while todo:
        node = todo.pop()
        node[_ENDS].sort(key=lambda e: (-len(e[0]), e[0], e[2] != "block"))
        todo += [*node[_LABEL].values(), *node[_PATH].values()]
    return root


def longest(root: tuple, host: str, path: str) -> tuple[str, str] | None:
    """(rule, verdict) of the entry that wins, or none."""
    hosts, node = [], root
    for label in reversed(host.split(".")):
        node = node[_LABEL].get(label)
        if node is None:
            break
        hosts.append(node)
    whole, rest = _cut(path)
    for node in reversed(hosts):
        nodes = [node]
        for segment in whole:
            node = node[_PATH].get(segment)
            if node is None:
                break
            nodes.append(node)
        for depth in range(len(nodes) - 1, -1, -1):
            left = whole[depth] if depth < len(whole) else rest
            for begin, rule, verdict in nodes[depth][_ENDS]:
                if left.startswith(begin):
                    return rule, verdict
    return None


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", limit: int = LIMIT) -> DataFrame:
    """(row, host, path, rule, verdict): every row of ``urls`` as a struct, beside what ``rules`` (host, path, verdict) say of it.

    ``rule`` is the winner's host and path, null where none fits; ``verdict`` is then ``default``. A null URL and one
    without `://` have an empty host and path, which entries of an empty host alone could fit. Entries' hosts are taken
    as written, in lower case; entries with a null or with another verdict than allow or block are not taken, repeated
    ones count once. Repeated rows are each judged, an empty table gives an empty result, other columns stay in ``row``.
    """
    rules = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IN ('allow', 'block')")
    rows = packed(urls, host=host_of(F.col(url)), path=path_of(F.col(url)))
    few = rules.limit(limit + 1).collect()  # bounded by the limit
    if len(few) > limit:
        return _joined(rows, rules, default)
    shared = urls.sparkSession.sparkContext.broadcast(trie(Entry(*r) for r in dict.fromkeys(few)))

    @F.pandas_udf(VERDICT)
    def walk(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        found = [longest(shared.value, h, p) or (None, default) for h, p in zip(host, path, strict=True)]
        return pd.DataFrame(found, columns=["rule", "verdict"], dtype="object")

    return rows.withColumn("_v", walk("host", "path")).select("row", "host", "path", "_v.rule", "_v.verdict")


def _joined(rows: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """As :func:`judge`, by joins: for more entries than a trie is broadcast for.

    A different (host, path) is looked up once, by its host and the hosts above it and by the beginnings of its path
    that end after a slash or as many characters after one as some entry has there, no longer than the longest entry.
    """
    rules = rules.select("host", "path", "verdict").distinct()
    tail = F.length(F.substring_index("path", "/", -1))
    lengths = [r[0] for r in rules.select(tail.alias("n")).distinct().collect()]  # no more than the longest path has characters
    deepest, longest_path = rules.agg(F.max(F.size(F.split("host", r"\."))), F.max(F.length("path"))).first()
    asked = materialise(rows.select("host", "path").distinct(), "urls")
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deepest))), lambda i: F.concat_ws(".", F.slice(labels, F.size(labels) - i + 1, i)))
    begin = F.substring("path", 1, longest_path)
    slashes = F.concat(F.array(F.lit(0)), F.filter(F.sequence(F.lit(1), F.length(begin) + 1), lambda i: F.substring(begin, i, F.lit(1)) == "/"))
    ends = F.flatten(F.transform(slashes, lambda s: F.transform(F.array(*[F.lit(n) for n in lengths]), lambda n: s + n)))
    ends = F.array_distinct(F.filter(ends, lambda n: n <= F.length(begin)))
    begins = F.transform(ends, lambda n: F.substring(begin, F.lit(1), n))
    keys = asked.select("host", "path", F.explode(above).alias("_h"), begins.alias("_b")).select("host", "path", "_h", F.explode("_b").alias("_p"))
    rules = rules.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "verdict")
    rank = F.struct(F.size(F.split("_h", r"\.")).alias("labels"), F.length("_p").alias("n"), (F.col("verdict") == "block").alias("block"), F.concat("_h", "_p").alias("rule"), F.col("verdict").alias("verdict"))
    won = keys.join(rules, ["_h", "_p"]).groupBy("host", "path").agg(F.max(rank).alias("_v")).select("host", "path", "_v.rule", "_v.verdict")
    won = materialise(won, "url-verdicts")
    discard(asked)
    return rows.join(won, ["host", "path"], "left").select("row", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def keep(urls: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """The rows of ``urls`` that are allowed, with all their columns."""
    return judge(urls, rules, default, url).where("verdict = 'allow'").select("row.*")


#: The entries of the query.
ENTRIES = (
    Entry("net", "/", "block"),
    Entry("example.net", "/en/", "allow"),
    Entry("example.com", "/de/", "block"),
    Entry("org", "/fr/", "allow"),
)


def oracle(rules: Iterable[Entry] = ENTRIES, default: str = "allow") -> str:
    """The query's SQL: entries are tried from the most specific to the least."""
    order = sorted(rules, key=lambda e: (-e.host.count("."), -len(e.path), e.verdict != "block"))
    fits = [(f"(host = '{e.host}' OR ends_with(host, '.{e.host}')) AND starts_with(path, '{e.path}')", e) for e in order]
    case = lambda what, other: "CASE " + " ".join(f"WHEN {test} THEN '{what(e)}'" for test, e in fits) + f" ELSE {other} END"
    return f"""WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
SELECT page_id, host, path, {case(lambda e: e.host + e.path, "NULL")} AS rule, {case(lambda e: e.verdict, f"'{default}'")} AS verdict FROM u"""
