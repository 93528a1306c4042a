"""JARs: those within others, and what binaries in a tree are.

Archives are told apart by the hash of their content and opened once, however many layers, folders or archives hold the
same one: a round opens what the round before found for the first time, so there are as many rounds as archives lie in
each other. Where they lie is worked out afterwards from the pairs of hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.content import is_binary
from lodestone.plans.scratch import materialise
from lodestone.sources import maven
from lodestone.sources.archives import _BROKEN, members

#: Members of one archive that are kept: archives, poms and the manifest.
_KEPT = "hash string, member string, kind string, content binary, problem string"
_SCHEMA = pa.schema({"hash": pa.string(), "member": pa.string(), "kind": pa.string(), "content": pa.binary(), "problem": pa.string()})
MANIFEST = "META-INF/MANIFEST.MF"


def _kind(name: str) -> str | None:
    if name.endswith(".jar"):
        return "jar"
    if name == MANIFEST:
        return "manifest"
    return "pom" if name.startswith("META-INF/") and name.rpartition("/")[2] == "pom.xml" else None


def _opened(archives: DataFrame) -> DataFrame:
    """What archives (hash, content) hold; one that cannot be read gives a row with a problem. A task holds one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(batch["hash"].to_pylist(), batch["content"], strict=True):
                try:
                    for name, content in members("x.jar", data.as_py() or b""):
                        if kind := _kind(name):
                            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((key, name, kind, content, None), _SCHEMA, strict=True)], schema=_SCHEMA)
                except _BROKEN as e:
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((key, None, None, None, type(e).__name__), _SCHEMA, strict=True)], schema=_SCHEMA)

    return archives.mapInArrow(run, _KEPT)


def opened(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hash, member, inner) of archives in archives, (hash, member, kind, content) of their poms and manifests, and (hash, problem).

    ``files`` (path, content binary) are archives of the zip kind; a hash is the SHA-256 of the content.
    """
    new = files.select(F.sha2("content", 256).alias("hash"), "content").where("content IS NOT NULL").dropDuplicates(["hash"])
    rounds = []
    while True:
        found = materialise(_opened(new), "jar-members").withColumn("inner", F.when(F.col("kind") == "jar", F.sha2("content", 256)))
        rounds.append(found)
        seen = new.select("hash") if len(rounds) == 1 else seen.unionByName(new.select("hash"))  # noqa: F821
        new = found.where("inner IS NOT NULL").select(F.col("inner").alias("hash"), "content").dropDuplicates(["hash"]).join(seen, "hash", "left_anti")
        new = materialise(new, "jars-within")
        if new.isEmpty():
            break
    every = rounds[0]
    for r in rounds[1:]:
        every = every.unionByName(r)
    return every.where("inner IS NOT NULL").select("hash", "member", "inner"), every.where("kind IN ('pom', 'manifest')").select("hash", "member", "kind", "content"), every.where("problem IS NOT NULL").select("hash", "problem")


def discovered(files: DataFrame) -> DataFrame:
    """(layer, path, hash): every `.jar` of ``files`` (layer, path, content) and, below its path, every one within it."""
    jars = files.where("path LIKE '%.jar' AND content IS NOT NULL").select("layer", "path", F.sha2("content", 256).alias("hash"), "content")
    holds, _, _ = opened(jars.select("path", "content"))
    level = materialise(jars.drop("content"), "jars")
    out = level
    while True:
        inner = level.join(holds, "hash").select("layer", F.concat("path", F.lit("/"), "member").alias("path"), F.col("inner").alias("hash"))
        level = materialise(inner, "jars")
        if level.isEmpty():
            return out
        out = out.unionByName(level)


def _text(content: str) -> Column:
    return F.call_function("make_valid_utf8", F.col(content).cast("string"))


def metadata(files: DataFrame) -> DataFrame:
    """(hash, name, version, license) of archives that say what they are.

    The pom with the shortest path below META-INF decides, if it has group, artifact and version: name is group:artifact,
    licences are named line by line. Otherwise the manifest does, by its bundle's name or its title, and its version.
    """
    _, found, _ = opened(files)
    chosen = found.where("kind = 'pom'").groupBy("hash").agg(F.min_by("content", F.struct(F.length("member"), "member")).alias("content"))
    poms = maven._read(chosen.select(F.col("hash").alias("repo"), F.lit("pom.xml").alias("path"), _text("content").alias("content"))).where("node.group IS NOT NULL AND node.version IS NOT NULL")
    names = F.array_join(F.filter(F.transform("licenses", lambda x: x["name"]), lambda n: n.isNotNull()), "\n")
    poms = poms.select(F.col("repo").alias("hash"), F.struct(F.concat("node.group", F.lit(":"), "node.artifact").alias("name"), F.col("node.version").alias("version"), names.alias("license")).alias("p"))
    pairs = F.transform(F.split(_text("content"), r"\r?\n"), lambda t: F.struct(F.trim(F.call_function("substring_index", t, F.lit(":"), F.lit(1))).alias("k"), F.trim(F.substring(t, F.instr(t, ":") + 1, F.length(t))).alias("v"), (F.instr(t, ":") > 1).alias("ok")))
    value = lambda k: F.get(F.reverse(F.filter(pairs, lambda x: x["ok"] & (x["k"] == k))), F.lit(0))["v"]
    manifests = found.where("kind = 'manifest'").select("hash", F.struct(F.coalesce(value("Bundle-SymbolicName"), value("Implementation-Title")).alias("name"), value("Implementation-Version").alias("version"), F.lit("").alias("license")).alias("m")).where("m.name IS NOT NULL AND m.version IS NOT NULL")
    return poms.join(manifests.dropDuplicates(["hash"]), "hash", "full").select("hash", F.coalesce("p", "m").alias("r")).select("hash", "r.*")


def unknown_binaries(files: DataFrame) -> DataFrame:
    """(path, version, license, description): binary files of a tree (path, content) as dependencies of their own.

    A `.jar` or `.aar` that says what it is has its version, licence and name; others have the first twelve digits of
    their SHA-256 as version.
    """
    rows = materialise(files.where(is_binary(F.col("content"))).select("path", "content", F.sha2("content", 256).alias("hash")), "binaries")
    known = metadata(rows.where(F.rlike("path", F.lit(r"\.(jar|aar)$"))).select("path", "content")).withColumnRenamed("name", "_name")
    rows = rows.select("path", "hash", F.rlike("path", F.lit(r"\.(jar|aar)$")).alias("_jar")).join(known, "hash", "left")
    told = F.col("_jar") & F.col("_name").isNotNull()
    return rows.select("path", F.when(told, F.col("version")).otherwise(F.left("hash", F.lit(12))).alias("version"), F.when(told, F.col("license")).otherwise("").alias("license"), F.when(told, F.col("_name")).otherwise("Binary discovered in source tree").alias("description"))
