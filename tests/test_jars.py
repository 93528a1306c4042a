"""JARs made in memory."""

from __future__ import annotations

import hashlib
import io
import zipfile

from lodestone.sources import jars


def packed(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


def pom(artifact, version="1.0", licenses=""):
    return f"<project><groupId>g</groupId><artifactId>{artifact}</artifactId><version>{version}</version><licenses>{licenses}</licenses></project>"


ZERO = {"zero": b"\0" * 9}
DEEP = packed({"META-INF/MANIFEST.MF": "Bundle-SymbolicName: deep;1\r\nImplementation-Title: other\r\nImplementation-Version: 7\r\nBad line\r\n: x\r\n", **ZERO})
MID = packed({"lib/deep.jar": DEEP, "also/deep.jar": DEEP, "META-INF/maven/a/pom.xml": pom("far"), "META-INF/m/pom.xml": pom("near", "2.0", "<license><name>MIT</name></license><license><url>u</url></license><license><name>ISC</name></license>"), **ZERO})
TOP = packed({"mid.jar": MID, "x/pom.xml": pom("outside"), "META-INF/MANIFEST.MF": "Implementation-Title: top\nImplementation-Version:  3 \n", "dir.jar/": "", **ZERO})
BROKEN_POM = packed({"META-INF/m/pom.xml": "<project>", "META-INF/MANIFEST.MF": "Implementation-Title: fallback\nImplementation-Version: 4\n", **ZERO})
NOTHING = packed({"META-INF/MANIFEST.MF": "Implementation-Title: no version\n", **ZERO})


def table(spark, files, schema="path string, content binary"):
    return spark.createDataFrame([(*k, bytearray(v)) if isinstance(k, tuple) else (k, bytearray(v)) for k, v in files.items()], schema)


def test_jars_within_jars(spark):
    files = {("one", "app/top.jar"): TOP, ("two", "copy.jar"): TOP, ("two", "mid.jar"): MID, ("two", "bad.jar"): b"PK no zip", ("two", "top.zip"): TOP}
    got = {(r.layer, r.path): r.hash for r in jars.discovered(table(spark, files, "layer string, path string, content binary")).collect()}
    name = lambda b: hashlib.sha256(b).hexdigest()
    assert got == {
        ("one", "app/top.jar"): name(TOP), ("one", "app/top.jar/mid.jar"): name(MID), ("one", "app/top.jar/mid.jar/lib/deep.jar"): name(DEEP), ("one", "app/top.jar/mid.jar/also/deep.jar"): name(DEEP),
        ("two", "copy.jar"): name(TOP), ("two", "copy.jar/mid.jar"): name(MID), ("two", "copy.jar/mid.jar/lib/deep.jar"): name(DEEP), ("two", "copy.jar/mid.jar/also/deep.jar"): name(DEEP),
        ("two", "mid.jar"): name(MID), ("two", "mid.jar/lib/deep.jar"): name(DEEP), ("two", "mid.jar/also/deep.jar"): name(DEEP), ("two", "bad.jar"): name(b"PK no zip"),
    }
    holds, _, problems = jars.opened(table(spark, {k[1]: v for k, v in files.items()}))
    assert holds.count() == 3 and {r.hash for r in problems.collect()} == {name(b"PK no zip")}  # each opened once


def test_unknown_binaries(spark):
    files = {"top.jar": TOP, "mid.aar": MID, "deep.jar": DEEP, "fall.jar": BROKEN_POM, "none.jar": NOTHING, "mid.zip": MID, "tool": b"\x7fELF\0\0", "bad.jar": b"PK\0", "text.jar": b"plain", "a.txt": b"words"}
    got = {r.path: (r.version, r.license, r.description) for r in jars.unknown_binaries(table(spark, files)).collect()}
    plain = lambda b: (hashlib.sha256(b).hexdigest()[:12], "", "Binary discovered in source tree")
    assert got == {
        "top.jar": ("3", "", "top"), "mid.aar": ("2.0", "MIT\nISC", "g:near"), "deep.jar": ("7", "", "deep;1"), "fall.jar": ("4", "", "fallback"), "none.jar": plain(NOTHING), "mid.zip": plain(MID), "tool": plain(b"\x7fELF\0\0"), "bad.jar": plain(b"PK\0"),
    }
