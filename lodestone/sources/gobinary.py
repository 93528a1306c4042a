"""Build information in Go binaries: the modules that are linked into each.

A binary is read as rows of chunks, so that no task needs a whole one: each chunk is searched together with the first
bytes of the next for the mark, which lies on a multiple of 16, and then only the chunks that hold what follows the
mark are brought together. The lengths that lead there are numbers of seven bits a byte.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.locators import go_version
from lodestone.plans.scratch import discard, materialise

# The mark, its place, and what begins a file that may hold one (ELF, Mach-O of one or more machines, PE).
MARK = r"\xFF Go buildinf:"
ALIGN, HEADER, INLINE, LEAST, LONGEST = 16, 32, 2, 4096, 16 * 1024 * 1024
BINARIES = ("7F454C46", "FEEDFACE", "FEEDFACF", "CEFAEDFE", "CFFAEDFE", "CAFEBABE", "CAFEBABF", "BEBAFECA", "BFBAFECA")
#: Bytes of a chunk; a multiple of ALIGN.
CHUNK = 1 << 18


def chunked(files: DataFrame, size: int = CHUNK) -> DataFrame:
    """(file, at, data): contents (file, content binary) of what may be Go binaries, in chunks; files under 4096 bytes are left out."""
    head = F.hex(F.substring("content", 1, 4))
    rows = files.where((F.length("content") >= LEAST) & (head.isin(*BINARIES) | F.startswith(head, F.lit("4D5A"))))
    starts = F.sequence(F.lit(0).cast("long"), F.length("content").cast("long") - 1, F.lit(size).cast("long"))
    return rows.select("file", F.explode(F.transform(starts, lambda s: F.struct(s.alias("at"), F.substring(F.col("content"), s.cast("int") + 1, F.lit(size)).alias("data")))).alias("c")).select("file", "c.*")


def marks(chunks: DataFrame) -> DataFrame:
    """(file, at): where the first mark of each file lies that has room for its header."""
    order = Window.partitionBy("file").orderBy("at")
    begins = chunks.select("file", "at", F.substring("data", 1, HEADER).alias("begin"))
    rows = chunks.join(begins.withColumn("next", F.lead("begin").over(order)).select("file", "at", "next"), ["file", "at"])
    whole = F.concat("data", F.coalesce("next", F.unhex(F.lit(""))))
    rows = rows.select("file", "at", F.length("data").alias("own"), F.length(whole).alias("long"), F.decode(whole, "ISO-8859-1").alias("text")).where(F.contains("text", F.lit(" Go buildinf:")))
    pattern = rf"(?s)^((?:.{{{ALIGN}}})*?){MARK}"
    rows = rows.where(F.rlike("text", F.lit(pattern))).withColumn("place", F.length(F.regexp_extract("text", pattern, 1)))
    return rows.where((F.col("place") < F.col("own")) & (F.col("place") + HEADER <= F.col("long"))).groupBy("file").agg(F.min(F.col("at") + F.col("place")).alias("at"))


def _spans(chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (file, begin, end, ...) with data: the bytes of the file there, fewer at its end."""
    rows = asked.join(chunks.withColumnRenamed("at", "_at"), "file").where((F.col("_at") < F.col("end")) & (F.col("_at") + F.length("data") > F.col("begin")))
    parts = rows.groupBy(*asked.columns).agg(F.array_sort(F.collect_list(F.struct("_at", "data"))).alias("_p"))  # no more than was asked for
    first = F.get("_p", F.lit(0))["_at"]
    whole = F.aggregate("_p", F.unhex(F.lit("")), lambda all_, p: F.concat(all_, p["data"]))
    return parts.select(*asked.columns, F.substring(whole, (F.col("begin") - first + 1).cast("int"), (F.col("end") - F.col("begin")).cast("int")).alias("data"))


def varint(data: Column) -> Column:
    """A struct of the number that ``data`` begins with, seven bits a byte from the lowest, and of how many bytes it takes; null if it does not end in ten bytes or in the data, or passes 63 bits."""
    byte = lambda i: F.conv(F.hex(F.substring(data, i + 1, F.lit(1))), 16, 10).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("value"), F.lit(0).alias("used"), F.lit(False).alias("done"))

    def step(acc: Column, i: Column) -> Column:
        value = acc["value"].bitwiseOR(F.call_function("shiftleft", byte(i).bitwiseAND(F.lit(127).cast("long")), i * 7))
        return F.when(acc["done"] | (i >= F.length(data)), acc).otherwise(F.struct(value.alias("value"), (i + 1).alias("used"), (byte(i) < 128).alias("done")))

    end = F.aggregate(F.sequence(F.lit(0), F.lit(8)), start, step)
    return F.when(end["done"], F.struct(end["value"].alias("value"), end["used"].alias("used")))


def build_info(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, go, main struct of path and version) of Go binaries, and (file, nth, path, version) of the modules in them.

    Only information that stands in the binary itself counts, as tools have written it since version 1.18; the first mark
    of a file decides. A replacement takes the place of the module that it follows. A file whose lengths lead beyond its
    end or 16 MiB, or whose tool's version is empty, has none.
    """
    chunks = materialise(chunks.select("file", "at", "data"), "binary-chunks")
    hits = marks(chunks).select("file", F.col("at").alias("begin"), (F.col("at") + HEADER + 10).alias("end"))
    head = _spans(chunks, hits).where(F.conv(F.hex(F.substring("data", 16, 1)), 16, 10).cast("int").bitwiseAND(F.lit(INLINE)) != 0)
    n = lambda at: varint(F.substring(F.col("data"), at + 1, F.lit(10)))
    head = head.select("file", F.col("begin").alias("_b"), n(F.lit(HEADER)).alias("v")).where(f"v IS NOT NULL AND v.value <= {LONGEST}")
    first = head.select("file", (F.col("_b") + HEADER + F.col("v.used")).alias("begin"), (F.col("_b") + HEADER + F.col("v.used") + F.col("v.value") + 10).alias("end"), F.col("v.value").alias("long"))
    named = materialise(_spans(chunks, first).where("length(data) >= long"), "go-versions")
    text = lambda data: F.call_function("make_valid_utf8", data.cast("string"))
    size = named.select("file", (F.col("begin") + F.col("long")).alias("_b"), text(F.substring(F.col("data"), F.lit(1), F.col("long").cast("int"))).alias("go"), n(F.col("long").cast("int")).alias("v")).where(f"go <> '' AND v IS NOT NULL AND v.value <= {LONGEST}")
    second = size.select("file", (F.col("_b") + F.col("v.used")).alias("begin"), (F.col("_b") + F.col("v.used") + F.col("v.value")).alias("end"), "go")
    listed = second.where("begin = end").select("file", "go", F.lit(None).cast("binary").alias("data")).unionByName(_spans(chunks, second.where("begin < end")).where("length(data) = end - begin").select("file", "go", "data"))
    long = F.length("data")
    inner = F.when((long >= 33) & (F.substring(F.col("data"), long - 16, F.lit(1)) == F.lit(b"\n")), F.substring(F.col("data"), F.lit(17), long - 32))
    listed = materialise(listed.select("file", "go", text(inner).alias("text")), "go-modules")
    discard(chunks)
    discard(named)
    fields = F.split("line", "\t")
    lines = listed.select("file", F.posexplode(F.split("text", r"\r?\n")).alias("at", "line")).where(F.size(fields) >= 2)
    lines = lines.select("file", "at", fields[0].alias("kind"), F.struct(fields[1].alias("path"), F.coalesce(F.get(fields, F.lit(2)), F.lit("")).alias("version")).alias("m"))
    main = lines.where("kind = 'mod'").groupBy("file").agg(F.max_by("m", "at").alias("main"))
    nth = F.sum(F.when(F.col("kind") == "dep", 1).otherwise(0)).over(Window.partitionBy("file").orderBy("at"))
    deps = lines.where("kind IN ('dep', '=>')").withColumn("nth", nth).where("nth > 0").groupBy("file", "nth").agg(F.max_by("m", "at").alias("m"))
    return listed.select("file", "go").join(main, "file", "left"), deps.select("file", "nth", "m.path", "m.version")


def units(info: DataFrame, modules: DataFrame) -> DataFrame:
    """(file, nth, fetcher, project, revision): the locators of each binary's modules, its main module last, each once.

    A version of a commit becomes the commit, one of a release loses what follows a plus. Modules without a version, and
    those built from a folder, have none; a binary without locators has no rows.
    """
    rows = modules.select("file", "nth", "path", "version").unionByName(info.where("main IS NOT NULL").select("file", F.lit(1 << 30).cast("long").alias("nth"), "main.path", "main.version"))
    rows = rows.where("version <> '' AND version <> '(devel)'").select("file", "nth", F.col("path").alias("project"), go_version(F.col("version")).alias("revision"))
    once = rows.groupBy("file", "project", "revision").agg(F.min("nth").alias("nth"))
    return once.select("file", F.row_number().over(Window.partitionBy("file").orderBy("nth")).alias("nth"), F.lit("go").alias("fetcher"), "project", "revision")
