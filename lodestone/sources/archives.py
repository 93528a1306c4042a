"""Members of archives, archives within archives included, as rows."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.paths import virtual_path
from lodestone.plans.scratch import materialise

# Suffixes of archives and how each is opened.
SUFFIXES = {
    ".tar": "r:", ".tar.gz": "r:gz", ".tgz": "r:gz", ".taz": "r:gz", ".tar.xz": "r:xz", ".txz": "r:xz", ".tar.bz2": "r:bz2", ".tbz": "r:bz2", ".tbz2": "r:bz2", ".tz2": "r:bz2",
    ".zip": "zip", ".jar": "zip", ".aar": "zip",
}
#: Archives within archives that are followed.
DEPTH = 100
_BROKEN = (tarfile.TarError, zipfile.BadZipFile, gzip.BadGzipFile, lzma.LZMAError, EOFError, OSError, RuntimeError, NotImplementedError, ValueError)


def binary_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, content) of every file below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder).select("path", "content")


def members(name: str, data: bytes) -> Iterator[tuple[str, bytes]]:
    """(name, content) of the plain files of one archive; links and folders are left out."""
    kind = next((SUFFIXES[s] for s in sorted(SUFFIXES, key=len, reverse=True) if name.lower().endswith(s)), None)
    if kind == "zip":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for entry in z.infolist():
                if not entry.is_dir():
                    yield entry.filename, z.read(entry)
    elif kind:
        with tarfile.open(fileobj=io.BytesIO(data), mode=kind) as t:
            for entry in t:
                if entry.isfile():
                    yield entry.name, t.extractfile(entry).read()


def _is_archive(path: str = "path") -> F.Column:
    pattern = "|".join(s.replace(".", r"\.") for s in SUFFIXES)
    return F.rlike(F.lower(path), F.lit(f"(?:{pattern})$"))


def expand(files: DataFrame, marker: str = "!_virtual_!") -> DataFrame:
    """(path, content, problem): ``files`` (path, content) and, level by level, what archives among them hold.

    A member's path is its archive's and a marker and its own. An archive that can't be read stays one row with a
    problem. A task holds one archive at a time and hands its members on one by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"], strict=True):
                archive, problem = path.as_py(), None
                try:
                    for name, content in members(archive, data.as_py() or b""):
                        yield pa.RecordBatch.from_pydict({"archive": [archive], "member": [name], "content": pa.array([content], pa.binary()), "problem": pa.array([None], pa.string())})
                except _BROKEN as e:
                    problem = type(e).__name__
                if problem:
                    yield pa.RecordBatch.from_pydict({"archive": [archive], "member": pa.array([None], pa.string()), "content": pa.array([None], pa.binary()), "problem": [problem]})

    level = files.select("path", "content")
    out = level.withColumn("problem", F.lit(None).cast("string"))
    for _ in range(DEPTH):
        inner = materialise(level.where(_is_archive()).mapInArrow(run, "archive string, member string, content binary, problem string"), "archive-members")
        if inner.isEmpty():
            break
        found = inner.select(F.coalesce(virtual_path(F.col("archive"), F.col("member"), marker), F.col("archive")).alias("path"), "content", "problem")
        out = out.unionByName(found)
        level = found.where("problem IS NULL").select("path", "content")
    broken = out.where("problem IS NOT NULL").select("path", F.col("problem").alias("why")).distinct()
    whole = out.where("problem IS NULL").join(broken, "path", "left")
    return whole.select("path", "content", F.col("why").alias("problem"))


def decompressed(data: bytes) -> bytes:
    """A layer's tar, plain or compressed."""
    for magic, opened in ((b"\x1f\x8b", gzip.decompress), (b"BZh", bz2.decompress), (b"\xfd7zXZ", lzma.decompress)):
        if data.startswith(magic):
            return opened(data)
    return data
