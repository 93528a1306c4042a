"""Go build information, in binaries built here."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.sources import gobinary

MODINFO = "path\texample.com/app\nmod\texample.com/app\t(devel)\t\ndep\tgithub.com/google/uuid\tv1.6.0\th1:abc=\ndep\tgolang.org/x/sys\tv0.0.0-20220715151400-c0bba94af5f8\th1:def=\n"
REPLACED = "mod\texample.com/tool\tv1.2.3\t\n=>\tlost\tv9\ndep\tgithub.com/old/lib\tv1.0.0\th1:x=\n=>\tgithub.com/new/lib\tv2.0.0+incompatible\th1:y=\nbuild\t-a=b\ndep\tgithub.com/other\tv3.0.0\r\ndep\tgithub.com/other\tv3.0.0\ndep\tbare\ndep\n"


def number(n):
    out = b""
    while True:
        n, low = n >> 7, n & 127
        out += bytes([low | (128 if n else 0)])
        if not n:
            return out


def binary(at=64, flags=2, go="go1.25.6", text=MODINFO, size=6000, head=b"\x7fELF", wrap=True):
    info = (b"\xaa" * 16 + text.encode() + b"\xbb" * 16) if wrap else text.encode()
    body = head + b"\0" * (at - 4) + b"\xff Go buildinf:\x08" + bytes([flags]) + b"\0" * 16 + number(len(go)) + go.encode() + number(len(info)) + info
    return body + b"\0" * (size - len(body))


FILES = {
    "plain": binary(), "replaced": binary(128, text=REPLACED), "mach": binary(head=b"\xcf\xfa\xed\xfe"), "pe": binary(head=b"MZ\x90\0"), "edge": binary(240), "late": binary(512 + 256 - 16), "long": binary(text=MODINFO + "".join(f"dep\tm/{i}\tv0.{i}.0\n" for i in range(2000)), size=0),
    "unaligned": binary(65), "twice": binary(80, flags=0)[:4000] + binary(64)[4:], "old": binary(flags=0), "small": binary(size=0)[:4000], "text": b"#!/b" + binary()[4:], "nogo": binary(go=""), "nomod": binary(text="", wrap=False), "short": binary(text=MODINFO, wrap=False),
    "cut": binary(5900, size=0)[:6040], "toolong": binary(64, size=6000)[:96] + b"\xff\xff\xff\xff\x7f" + b"\0" * 6000, "endless": binary()[:96] + b"\xff" * 20 + b"\0" * 6000, "none": b"\x7fELF" + b"\0" * 6000, "end": b"\x7fELF" + b"\0" * 5996 + b"\xff Go buildinf:\x08\2",
}


@pytest.mark.parametrize("size", [64, 256, 1 << 18])
def test_build_info(spark, size):
    table = spark.createDataFrame([(k, bytearray(v)) for k, v in FILES.items()], "file string, content binary")
    info, modules = gobinary.build_info(gobinary.chunked(table, size))
    got = {r.file: (r.go, tuple(r.main) if r.main else None) for r in info.collect()}
    app = ("go1.25.6", ("example.com/app", "(devel)"))
    assert got == {"plain": app, "mach": app, "pe": app, "edge": app, "late": app, "long": app, "replaced": ("go1.25.6", ("example.com/tool", "v1.2.3")), "nomod": ("go1.25.6", None), "short": ("go1.25.6", None)}
    mods = {}
    for r in sorted(modules.collect(), key=lambda r: r.nth):
        mods.setdefault(r.file, []).append((r.path, r.version))
    two = [("github.com/google/uuid", "v1.6.0"), ("golang.org/x/sys", "v0.0.0-20220715151400-c0bba94af5f8")]
    assert all(mods[f] == two for f in ("plain", "mach", "pe", "edge", "late")) and len(mods["long"]) == 2002
    assert mods["replaced"] == [("github.com/new/lib", "v2.0.0+incompatible"), ("github.com/other", "v3.0.0"), ("github.com/other", "v3.0.0"), ("bare", "")]
    if size == 256:
        rows = {}
        for r in sorted(gobinary.units(info, modules).collect(), key=lambda r: r.nth):
            rows.setdefault(r.file, []).append((r.project, r.revision))
        assert rows["plain"] == [("github.com/google/uuid", "v1.6.0"), ("golang.org/x/sys", "c0bba94af5f8")]
        assert rows["replaced"] == [("github.com/new/lib", "v2.0.0"), ("github.com/other", "v3.0.0"), ("example.com/tool", "v1.2.3")]
        assert "nomod" not in rows


def test_numbers(spark):
    values = [0, 1, 127, 128, 300, 1 << 14, (1 << 21) - 1, 1 << 40, (1 << 63) - 1]
    rows = spark.createDataFrame([(v, bytearray(number(v) + b"x")) for v in values], "v long, b binary").select("v", F.length("b").alias("n"), gobinary.varint(F.col("b")).alias("r")).collect()
    assert all((r.r.value, r.r.used) == (r.v, r.n - 1) for r in rows)
    bad = spark.createDataFrame([(bytearray(b),) for b in (b"", b"\x80", b"\xff" * 12)], "b binary")
    assert bad.where(gobinary.varint(F.col("b")).isNotNull()).count() == 0
