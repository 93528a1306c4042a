"""Archives and container images made in memory."""

from __future__ import annotations

import gzip
import io
import json
import tarfile
import zipfile

from lodestone.sources import archives, images
from lodestone.sources.registry import read_all


def tar(files, links=()):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, data in files:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
        for name, target in links:
            info = tarfile.TarInfo(name)
            info.type, info.linkname = tarfile.SYMTYPE, target
            t.addfile(info)
    return out.getvalue()


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files:
            z.writestr(name, data)
    return out.getvalue()


def test_archives_within_archives(spark):
    inner = zipped([("requirements.txt", b"flask==2.0\n")])
    rows = [("x/a.tar.gz", gzip.compress(tar([("d/lib.jar", inner), ("e.txt", b"e")], [("l", "e.txt")]))), ("x/plain.txt", b"p"), ("x/bad.zip", b"PK nothing"), ("x/none.tar", None)]
    files = spark.createDataFrame(rows, "path string, content binary")
    got = {r.path: (bytes(r.content) if r.content is not None else None, r.problem) for r in archives.expand(files).collect()}
    jar = "x/a.tar.gz!_virtual_!/d/lib.jar"
    assert got["x/plain.txt"] == (b"p", None) and got[f"{jar}!_virtual_!/requirements.txt"] == (b"flask==2.0\n", None)
    assert got["x/a.tar.gz!_virtual_!/e.txt"][0] == b"e" and got["x/bad.zip"][1] == "BadZipFile" and got["x/none.tar"][1] is not None
    assert len(got) == 7
    text = archives.expand(files).where("problem IS NULL").selectExpr("path", "CAST(content AS STRING) AS content")
    assert [(r.name, r.version) for r in read_all(text.where("path LIKE '%requirements.txt'")).collect()] == [("flask", "==2.0")]


def test_binary_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.bin").write_bytes(b"\0x")
    assert [bytes(r.content) for r in archives.binary_files(spark, str(tmp_path), "*.bin").collect()] == [b"\0x"]


def test_image_layers(spark):
    base = tar([("./d/x", b"1"), ("d/y", b"2"), ("etc/os-release", b"ID=a")])
    upper = gzip.compress(tar([(".wh.d", b""), ("d/z", b"3"), ("e/.wh..wh..opq", b"")], [("l", "d/z")]))
    image = tar([("1/layer.tar", base), ("2/layer.tar", upper), ("manifest.json", json.dumps([{"Config": "c", "Layers": ["1/layer.tar", "3/layer.tar"]}]).encode())], [("3/layer.tar", "../2/layer.tar")])
    frame = spark.createDataFrame([("i", image), ("broken", b"x"), ("null", None)], "path string, content binary")
    rows = images.changes(frame)
    assert [(r.layer, r.op, r.path) for r in rows.orderBy("seq").collect()] == [(0, "insert", "d/x"), (0, "insert", "d/y"), (0, "insert", "etc/os-release"), (1, "remove", "d"), (1, "insert", "d/z"), (1, "insert", "l")]
    assert {(r.part, r.path) for r in images.two_layers(rows).collect()} == {("base", "d/x"), ("base", "d/y"), ("base", "etc/os-release"), ("other", "d/z"), ("other", "l")}
    assert {r.path for r in images.squash_layers(rows).collect()} == {"etc/os-release", "d/z", "l"}
