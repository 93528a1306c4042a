"""Phrases against a plain search, and the licence scan of a tree with archives."""

from __future__ import annotations

import io
import random
import re
import tarfile
import zipfile

import pytest

from lodestone.functions import content, phrases

FOUND = "path string, text string"


def plain(texts, known):
    out = []
    for path, text in texts:
        spots = [(m[0].lower(), m.start(), m.end()) for m in re.finditer("[A-Za-z0-9]+", text or "")]
        for name, phrase in known:
            want = [w.lower() for w in re.findall("[A-Za-z0-9]+", phrase or "")]
            for i in range(len(spots) - len(want) + 1):
                if want and name is not None and [w for w, _, _ in spots[i : i + len(want)]] == want:
                    a, b = spots[i][1], spots[i + len(want) - 1][2]
                    out.append((path, name, i, i + len(want), text[:a].count("\n") + 1, text[:b].count("\n") + 1, text[a:b]))
    return sorted(out)


@pytest.mark.parametrize("limit", [phrases.LIMIT, 60, 1])
def test_matches(spark, limit):
    rng = random.Random(limit)
    texts = [(f"p{i}", "".join(rng.choice(["a", "b", "AB", "c1", "ä", "İ", "x"]) + rng.choice([" ", "\n", ", ", "-", "\r\n", "  "]) for _ in range(rng.randrange(40)))) for i in range(40)]
    texts += [("null", None), ("empty", ""), ("same", "a b a b a"), ("same", "a b a b a")]
    known = [("one", "a"), ("two", "A, b"), ("two", "a b a"), ("other", "a-b"), ("long", "a b a b x c1 ab"), ("ab", "ab"), ("none", "..."), ("null", None), (None, "b"), ("one", "a"), ("end", "b a")]
    got = phrases.phrase_matches(spark.createDataFrame(texts, FOUND), spark.createDataFrame(known, "name string, phrase string"), limit)
    assert sorted(tuple(r) for r in got.collect()) == plain(texts, dict.fromkeys(known))
    assert phrases.phrase_matches(spark.createDataFrame(texts, FOUND), spark.createDataFrame([], "name string, phrase string")).count() == 0


def test_license_scan(spark):
    def packed(**files):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, data in files.items():
                z.writestr(name, data)
        return out.getvalue()

    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w:gz") as t:
        for name, data in (("LICENSE", b"Permission is\n * hereby GRANTED\n"), ("in.zip", packed(COPYING="all rights, reserved. All rights reserved"))):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    files = {"a.txt": b"permission is hereby granted", "bin": b"\0permission is hereby granted", "lib.tar.gz": tar.getvalue(), "bad.zip": b"PK no", "config.yml": b"permission is hereby granted", "bad.txt": b"\xff permission is hereby granted"}
    known = spark.createDataFrame([("MIT", "Permission is hereby granted"), ("ARR", "All rights reserved")], "name string, phrase string")
    units, problems = phrases.license_scan(spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary"), known, "config.yml")
    got = {(r.title, r.path.replace("!_virtual_!", "!")): r.n for r in units.collect()}
    assert {k: v for k, v in got.items() if k[0] == "MIT"}.keys() == {("MIT", p) for p in {k[1] for k in got if k[0] == "MIT"}}
    assert got[("MIT", "a.txt")] == got[("MIT", "bad.txt")] == 1 and len(got) == 4 and sum(n for (t, _), n in got.items() if t == "ARR") == 2
    assert {r.path for r in problems.collect()} == {"bad.zip"}


def test_keywords_in_one_pass(spark):
    files = spark.createDataFrame([("a", "x1 y2 x3"), ("b", None), ("conf", "x9")], FOUND)
    found = content.keyword_matches(files, {"x": r"x\d", "y": r"y\d"}, skip="conf")
    assert {tuple(r) for r in found.collect()} == {("a", "x", 0, "x1"), ("a", "x", 1, "x3"), ("a", "y", 0, "y2")}
    assert found._jdf.queryExecution().executedPlan().toString().count("Scan") == 1
