"""URL filters against a plain loop over all entries."""

from __future__ import annotations

import random

from lodestone.llm import urls
from lodestone.llm.urls import Entry

RULES = [
    Entry("net", "/", "block"), Entry("example.net", "/en/", "allow"), Entry("example.com", "/de/", "block"), Entry("org", "/fr/", "allow"),
    Entry("a.example.net", "/en/x", "block"), Entry("example.net", "/en/xy", "block"), Entry("example.net", "", "block"), Entry("example.net", "", "allow"),
    Entry("com", "/d", "allow"), Entry("com", "/de/1/", "allow"), Entry("com", "/de/", "block"), Entry("x.com", "/", "allow"),
]


def plain(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [e for e in rules if (host == e.host or host.endswith("." + e.host)) and path.startswith(e.path)]
    best = max(fits, key=lambda e: (e.host.count("."), len(e.path), e.verdict == "block"), default=None)
    return host, path, best and best.host + best.path, best.verdict if best else "allow"


def made(n):
    rng = random.Random(12)
    hosts = ["example.net", "a.example.net", "b.a.example.net", "net", "notexample.net", "Example.COM", "x.com", "org", "W.org", "com", "localhost", "example.net:80", "ÄX.net", ""]
    paths = ["", "/", "/en", "/en/", "/en/x", "/en/xyz/1", "/de/", "/de/1", "/de/1/2", "/fr/", "//en/", "/d", "/english", "/en/x?q=/de/", "#/en/", "?a://b/en/", "/en/\nx"]
    odd = [None, "", "no scheme/en/", "://", "http://", "http:///en/", "x" * 50_000, "http://net/" + "en/" * 20_000, "a://b://example.net/en/"]
    return odd + [rng.choice(["http", "https", "ftp"]) + "://" + rng.choice(hosts) + rng.choice(paths) for _ in range(n)]


def judged(spark, found, rules, **more):
    rows = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(found)], "page_id long, url string, host string, verdict string")
    got = urls.judge(rows, urls.entries(spark, rules), **more).select("row.page_id", "row.verdict", "host", "path", "rule", "verdict").collect()
    assert {r[1] for r in got} <= {"p"}  # the rows' own columns stay theirs
    return {r[0]: tuple(r[2:]) for r in got}


def test_trie_and_joins_match_all_entries(spark):
    found = made(500)
    want = {i: plain(u, RULES) for i, u in enumerate(found)}
    assert judged(spark, found, RULES) == want
    assert judged(spark, found, RULES, limit=3) == want
    assert {v[3] for v in want.values()} == {"allow", "block"}


def test_many_entries_by_joins(spark):
    rng = random.Random(5)
    rules = [Entry(rng.choice(["a.b", "b", "c.b", "d"]), "/" + "/".join(rng.choice(["", "u", "uv", "w"]) for _ in range(rng.randrange(4))), rng.choice(["allow", "block"])) for _ in range(60)]
    found = ["http://" + rng.choice(["a.b", "z.a.b", "b", "d", "e"]) + "/" + "/".join(rng.choice(["", "u", "uv", "uvw", "w"]) for _ in range(rng.randrange(5))) for _ in range(300)]
    want = {i: plain(u, rules) for i, u in enumerate(found)}
    assert judged(spark, found, rules) == judged(spark, found, rules, limit=10) == want


def test_odd_rules_and_rows(spark):
    schema = "host string, path string, verdict string"
    odd = spark.createDataFrame([(None, "/", "block"), ("net", None, "block"), ("net", "/", "maybe"), ("net", "/a", None), ("net", "/b", "block"), ("net", "/b", "block")], schema)
    rows = spark.createDataFrame([("http://x.net/b",), ("http://x.net/a",), (None,), ("http://x.net/b",)], "url string")
    got = sorted((r[0] or "", r[1] or "", r[2]) for r in urls.judge(rows, odd, default="block").select("row.url", "rule", "verdict").collect())
    assert got == [("", "", "block"), ("http://x.net/a", "", "block"), ("http://x.net/b", "net/b", "block"), ("http://x.net/b", "net/b", "block")]
    assert urls.judge(rows.limit(0), odd).count() == 0
    assert urls.judge(rows, odd.limit(0)).where("verdict = 'allow' AND rule IS NULL").count() == 4
    assert sorted(r[0] or "" for r in urls.keep(rows, odd).collect()) == ["", "http://x.net/a"]
