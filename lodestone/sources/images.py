"""Container images: layers as rows of changes."""

from __future__ import annotations

import io
import json
import posixpath
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.rollups import squash_layers
from lodestone.sources.archives import decompressed

WHITEOUT = ".wh."
CHANGES = "image string, layer int, seq long, op string, path string, size long"


def changes_of(data: bytes) -> Iterator[tuple[int, int, str, str, int]]:
    """(layer, seq, op, path, size) of an image archive, layers in the order of its manifest.

    Files and links are insertions, whiteouts removals; opaque whiteouts and folders are left out.
    """
    with tarfile.open(fileobj=io.BytesIO(data)) as image:
        entries = {m.name: m for m in image.getmembers()}

        def read(name: str) -> bytes:
            entry = entries[name]
            while entry.issym() or entry.islnk():
                entry = entries[posixpath.normpath(posixpath.join(posixpath.dirname(entry.name), entry.linkname)) if entry.issym() else entry.linkname]
            return image.extractfile(entry).read()

        seq = 0
        for layer, name in enumerate(json.loads(read("manifest.json"))[0]["Layers"]):
            with tarfile.open(fileobj=io.BytesIO(decompressed(read(name)))) as tar:
                for m in tar:
                    path = m.name.removeprefix("./")
                    base = posixpath.basename(path)
                    if base.startswith(WHITEOUT + WHITEOUT) or not base:
                        continue
                    if base.startswith(WHITEOUT):
                        yield layer, seq, "remove", path.replace(WHITEOUT, ""), 0
                    elif m.isfile() or m.issym() or m.islnk():
                        yield layer, seq, "insert", path, m.size
                    else:
                        continue
                    seq += 1


def changes(images: DataFrame) -> DataFrame:
    """Changes of ``images`` (path, content); an archive that can't be read gives none. A task holds one image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = [(path.as_py(), *c) for c in changes_of(data.as_py() or b"")]
                except (tarfile.TarError, KeyError, ValueError, EOFError, OSError):
                    rows = []
                if rows:
                    kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["image", "layer", "seq", "op", "path", "size"])

    return images.select("path", "content").mapInArrow(run, CHANGES)


def two_layers(rows: DataFrame) -> DataFrame:
    """(image, part, path, seq): the files of the base layer alone, and of all other layers squashed."""
    part = rows.withColumn("part", F.when(F.col("layer") == 0, "base").otherwise("other"))
    squashed = squash_layers(part.withColumn("image", F.struct("image", "part")))
    return squashed.select("image.image", "image.part", "path", "seq")
