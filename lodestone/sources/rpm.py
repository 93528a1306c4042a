"""Package databases of RPM: package headers, and the NDB and SQLite files that hold them.

Headers are big-endian records; they are decoded with column functions over a binary column, every offset checked
against the length first. A header or a file that is broken gives a problem row and leaves its neighbours alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.manifests import _rows

# Tags, types and limits of the header format.
NAME, VERSION, RELEASE, EPOCH, ARCHITECTURE = 1000, 1001, 1002, 1003, 1022
REGIONS = (61, 62, 63)
INT32, STRING, BINARY, TEXTS = 4, 6, 7, (6, 8, 9)
SIZES = {0: 0, 1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1}
ENTRY, REGION, MOST = 16, 16, 256 * 1024 * 1024


def _big(data: Column, at: Column | int, signed: bool = True) -> Column:
    """The four bytes at ``at`` as a number, the first byte first; null beyond the end."""
    at = F.lit(at) if isinstance(at, int) else at
    n = F.conv(F.hex(F.substring(data, at + 1, F.lit(4))), 16, 10).cast("long")
    n = F.when((at >= 0) & (at + 4 <= F.length(data)), n)
    return F.when(n >= 1 << 31, n - (1 << 32)).otherwise(n) if signed else n


def _little(data: Column, at: Column | int) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    turned = F.concat(*[F.hex(F.substring(data, at + i, F.lit(1))) for i in (4, 3, 2, 1)])
    return F.when(at + 4 <= F.length(data), F.conv(turned, 16, 10).cast("long"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def headers(blobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keys..., name, version, release, epoch, arch) of package headers, and (keys..., problem) of broken ones.

    ``blobs``: a binary ``blob`` and any key columns. Of entries of one tag the first counts, those of the region before
    the others. A field that a header lacks is null.
    """
    keys = [c for c in blobs.columns if c != "blob"]
    b = F.col("blob")
    rows = blobs.withColumns({"_n": _big(b, 0), "_len": _big(b, 4)}).withColumn("_start", 8 + F.col("_n") * ENTRY)
    early = F.when(F.col("_len").isNull(), "header is cut off").when(F.col("_n") < 1, "no entries").when((F.col("_len") < 0) | (F.col("_start") + F.col("_len") >= MOST), "header too large").when(F.col("_start") > F.length("blob"), "entries are cut off")
    rows = rows.withColumn("problem", early)

    def entry(i: Column) -> Column:
        at = i * ENTRY + 8
        return F.struct(i.alias("i"), _big(b, at).alias("tag"), _big(b, at + 4, False).alias("type"), _big(b, at + 8).alias("offset"), _big(b, at + 12, False).alias("count"))

    none = F.array().cast("array<struct<i:bigint,tag:bigint,type:bigint,offset:bigint,count:bigint>>")
    rows = rows.withColumn("_e", F.when(F.col("problem").isNull(), F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1), entry)).otherwise(none))
    first = F.get("_e", F.lit(0))
    region = first["tag"].isin(*REGIONS)
    trailer = _big(b, F.col("_start") + first["offset"] + 8)
    worse = (
        F.when(F.exists("_e", lambda e: e["type"] > 9), "unknown type")
        .when(region & ((first["type"] != BINARY) | (first["count"] != REGION)), "invalid region tag")
        .when(region & ((first["offset"] + REGION < 0) | (first["offset"] + REGION > F.col("_len"))), "invalid region offset")
        .when(region & trailer.isNull(), "region is cut off")
    )
    rows = rows.withColumn("problem", F.coalesce("problem", worse))
    inside = F.when(~region, F.col("_n")).when(first["offset"] == 0, F.col("_n")).otherwise(F.floor(-trailer / ENTRY))
    rows = rows.withColumns({"_region": region, "_inside": F.when(F.col("problem").isNull(), F.greatest(F.least(inside, F.col("_n")), F.lit(0)))})
    # Lists as they are walked: the region without its first entry, then those behind it. A text is as long as the way to the next entry of its list.
    kept = F.filter("_e", lambda e: ~F.col("_region") | (e["i"] > 0) & (e["i"] < F.col("_inside")) | (e["i"] >= F.col("_inside")))
    begin, end = F.col("_start"), F.col("_start") + F.col("_len")

    def measured(e: Column) -> Column:
        nxt = F.get("_e", (e["i"] + 1).cast("int"))["offset"]
        last = (e["i"] + 1 == F.col("_n")) | (e["i"] + 1 == F.col("_inside"))
        many = F.when(e["type"] == STRING, F.lit(1)).otherwise(F.least(e["count"], F.lit(1 << 30)).cast("int"))
        cut = lambda text, n: F.call_function("substring_index", text, F.lit("\0"), n)
        ended = _let(
            F.decode(F.substring(b, begin + e["offset"] + 1, F.greatest(F.col("_len") - e["offset"], F.lit(0))), "ISO-8859-1"),
            lambda text: _let(F.length(cut(text, many)), lambda n: F.when(n < F.length(text), n + 1).when(F.contains(text, F.lit("\0")), F.length(text) - F.length(cut(text, F.lit(-1))))),
        )
        ended = F.when((e["type"] != STRING) | (e["count"] == 1), ended)
        size = F.lit(None).cast("long")
        for kind, width in SIZES.items():
            size = F.when(e["type"] == kind, e["count"] * width).otherwise(size)
        fixed = F.when(e["offset"] + size <= F.col("_len"), size)
        long = F.when(e["type"].isin(*TEXTS), F.when(last, ended.cast("long")).otherwise(nxt - e["offset"])).otherwise(fixed)
        long = F.when((e["offset"] >= 0) & (e["offset"] < F.col("_len")), long)
        return F.struct(e["tag"].alias("tag"), e["type"].alias("type"), e["offset"].alias("offset"), long.alias("long"))

    rows = rows.withColumn("_v", F.when(F.col("problem").isNull(), F.transform(kept, measured)))

    def add(total: Column, v: Column) -> Column:
        step = F.when(v["type"].isin(3, 4, 5), F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in ((3, 2), (4, 4), (5, 8)) for x in pair]), v["type"])).otherwise(F.lit(1).cast("long"))
        return total + F.pmod(-total, step) + v["long"]

    total = F.aggregate("_v", F.lit(0).cast("long"), add) + REGION
    whole = F.when(F.exists("_v", lambda v: v["long"].isNull() | (v["long"] < 0)), "invalid data").when(F.col("_region") & (total != F.col("_len")), "lengths do not add up")

    def field(tag: int) -> Column:
        return F.get(F.filter("_v", lambda v: v["tag"] == tag), F.lit(0))

    wrong = F.when(F.coalesce(*[F.when(field(t)["type"] != STRING, True) for t in (NAME, VERSION, RELEASE, ARCHITECTURE)], F.when(field(EPOCH)["type"] != INT32, True), F.lit(False)), "a field of another type")
    data = lambda tag: _let(field(tag), lambda v: F.substring(b, begin + v["offset"] + 1, v["long"]))
    text = lambda tag: F.rtrim(F.try_validate_utf8(data(tag).cast("string")), F.lit("\0"))
    found = F.struct(F.coalesce("problem", whole, wrong).alias("problem"), text(NAME).alias("name"), text(VERSION).alias("version"), text(RELEASE).alias("release"), _let(field(EPOCH), lambda v: _big(b, begin + v["offset"])).alias("epoch"), text(ARCHITECTURE).alias("arch"))
    # Out of an array, so that a condition on the problem is not worked out anew for each step before it.
    rows = rows.select(*keys, F.explode(F.array(found)).alias("r"))
    return rows.where("r.problem IS NULL").select(*keys, "r.name", "r.version", "r.release", "r.epoch", "r.arch"), rows.where("r.problem IS NOT NULL").select(*keys, "r.problem")


def ndb_blobs(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, package, blob): the header blobs of NDB files (file, content binary), and (file, problem) of broken files.

    A file is a head, slots of 16 bytes that say where packages lie, and blocks in rows of 16 bytes.
    """
    c = F.col("content")
    pages = _little(c, 12)
    count = pages * 256 - 2
    head = F.when((F.length("content") < 32) | (F.substring(c, 1, 8) != F.lit(b"RpmP\0\0\0\0")), "no database of this kind").when((count < 0) | (32 + count * 16 > F.length("content")), "slots are cut off")
    rows = files.select("file", "content", head.alias("problem"))
    slot = lambda i: F.struct(F.substring(c, i * 16 + 33, F.lit(4)).alias("magic"), _little(c, i * 16 + 36).alias("package"), _little(c, i * 16 + 40).alias("row"), _little(c, i * 16 + 44).alias("rows"))
    rows = rows.withColumn("_s", F.when(F.col("problem").isNull(), F.transform(F.sequence(F.lit(0).cast("long"), count - 1), slot)))
    used = F.filter("_s", lambda s: s["package"] != 0)

    def block(s: Column) -> Column:
        at, size = s["row"] * 16, s["rows"] * 16
        length = _little(c, at + 12)
        fits = (at + size <= F.length("content")) & (F.substring(c, at + 1, F.lit(4)) == F.lit(b"BlbS")) & (_little(c, at + 4) == s["package"]) & (length >= 16) & (length + 12 <= size) & (F.substring(c, at + size - 3, F.lit(4)) == F.lit(b"BlbE"))
        return F.struct(s["package"].alias("package"), F.when(fits, F.substring(c, at + 17, length - 16)).alias("blob"))

    rows = rows.select("file", F.coalesce("problem", F.when(F.exists("_s", lambda s: s["magic"] != F.lit(b"Slot")), "a slot is broken")).alias("problem"), F.transform(used, block).alias("_b"))
    each = rows.where("problem IS NULL").select("file", F.explode("_b").alias("b")).select("file", "b.package", "b.blob")
    lost = each.where("blob IS NULL").select("file", F.concat(F.lit("the block of package "), "package", F.lit(" is broken")).alias("problem"))
    return each.where("blob IS NOT NULL"), rows.where("problem IS NOT NULL").select("file", "problem").unionByName(lost)


_SQLITE = pa.schema({"file": pa.string(), "package": pa.int64(), "blob": pa.binary(), "problem": pa.string()})


def sqlite_blobs(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As :func:`ndb_blobs`, of SQLite files: the table Packages (hnum, blob). Blobs leave a task one file at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sqlite3

        for batch in batches:
            for file, content in zip(batch["file"].to_pylist(), batch["content"], strict=True):
                raw = content.as_py() or b""
                if not raw.startswith(b"SQLite format 3\0"):
                    found = [(file, None, None, "no database of this kind")]
                else:
                    db = sqlite3.connect(":memory:")
                    try:
                        db.deserialize(raw)
                        found = [(file, i, blob, None) for i, blob in db.execute("SELECT hnum, blob FROM Packages ORDER BY hnum")]
                    except sqlite3.Error as e:
                        found = [(file, None, None, str(e))]
                    finally:
                        db.close()
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], f.type) for i, f in enumerate(_SQLITE)], schema=_SQLITE)

    rows = files.select("file", "content").mapInArrow(run, "file string, package long, blob binary, problem string")
    return rows.where("problem IS NULL").select("file", "package", "blob"), rows.where("problem IS NOT NULL").select("file", "problem")


def packages(blobs: DataFrame, systems: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dependencies of databases whose ``blobs`` (file, package, blob) are given, and (file, package, problem).

    ``systems`` (file, id, release): the operating system of each file. A name is package#id#release, a version
    architecture#epoch:version-release, without the epoch where there is none. All are direct. A header without name,
    version, release or architecture, as keys have it, is no package and no problem.
    """
    good, problems = headers(blobs)
    rows = good.where("name IS NOT NULL AND version IS NOT NULL AND release IS NOT NULL AND arch IS NOT NULL").join(systems.select("file", F.col("id").alias("_os"), F.col("release").alias("_at")), "file")
    epoch = F.when(F.col("epoch").isNull(), "").otherwise(F.concat(F.col("epoch").cast("string"), F.lit(":")))
    return _rows(rows, F.concat_ws("#", "name", "_os", "_at"), F.concat("arch", F.lit("#"), epoch, "version", F.lit("-"), "release")), problems
