"""SimHash near-duplicates of whole documents.

Fingerprints are made in Arrow batches (one text at a time, so memory is bounded by the longest text).
Everything after works on distinct fingerprints, so copies cost nothing: the 64 bits are cut into six
blocks, two fingerprints at most three bits apart agree on three blocks at least, and each choice of three
blocks is one join key. A key held by two fingerprints is tested in place; a key held by more is cut into
bounded chunks, each pair of chunks is searched by itself and yields a spanning forest of its links, never
all of its pairs. No key is capped. Links become groups by connected components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.components import connected_components
from lodestone.operators.rows import without
from lodestone.plans.scratch import discard, materialise

SEED = 42
#: Widths of the blocks, low bits first.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Most fingerprints of one key that a task compares with each other or with another chunk.
CHUNK = 4096
#: Shingles whose bits are counted at once.
_STEP = 1 << 18


def simhash64(text: str | None, size: int = 3) -> int:
    """SimHash of word shingles, unsigned; 0 for a null text or one without words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(shingles), _STEP):
        part = shingles[at : at + _STEP]
        h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in part), np.uint64, len(part))
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << int(i) for i in np.flatnonzero(2 * ones > len(shingles))))


def fingerprint(text: Column, size: int = 3) -> Column:
    """The SimHash of a text column as a signed long."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((simhash64(t, size) for t in texts), np.uint64, len(texts)).view(np.int64))

    return run(text)


def spanning_links(prints: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph that joins fingerprints at most ``max_bits`` apart."""
    todo, links = np.unique(prints.view(np.uint64)), []  # of signed numbers numpy would count the bits of the absolute value
    while todo.size > 1:
        queue, todo = [todo[0]], todo[1:]
        while queue and todo.size:
            v = queue.pop()
            near = np.bitwise_count(todo ^ v) <= max_bits
            if near.any():
                got = todo[near]
                links += [(v, g) for g in got]
                queue += list(got)
                todo = todo[~near]
    return links


def _keys(fp: str, max_bits: int) -> Column:
    at, masks = 0, []
    for width in BLOCKS:
        masks.append(((1 << width) - 1) << at)
        at += width
    out = []
    for n, kept in enumerate(combinations(range(len(BLOCKS)), len(BLOCKS) - max_bits)):
        mask = sum(masks[i] for i in kept)
        mask -= (mask >> 63) << 64
        out.append(F.struct(F.lit(n).cast("byte").alias("t"), F.col(fp).bitwiseAND(F.lit(mask).cast("long")).alias("key")))
    return F.array(*out)


def near_links(prints: DataFrame, fp: str = "fp", max_bits: int = 3, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links whose connected components are those of all pairs at most ``max_bits`` bits apart.

    ``prints`` holds each fingerprint once. Exact for every key size.
    """
    if not 0 <= max_bits < len(BLOCKS):
        raise ValueError(f"max_bits must be below {len(BLOCKS)}")
    rows = prints.select(F.col(fp).alias("fp")).select("fp", F.explode(_keys("fp", max_bits)).alias("k")).select("k.t", "k.key", "fp")
    shared = rows.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    shared = materialise(shared, "simhash-keys")
    pairs = shared.where("n = 2").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).select("a", "b")
    large = (
        rows.join(shared.where("n > 2").select("t", "key", "n"), ["t", "key"])
        .withColumn("c", F.ceil(F.col("n") / chunk))
        .withColumn("i", F.pmod(F.xxhash64("fp"), "c"))
        .withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1)))
        .groupBy("t", "key", F.least("i", "o").alias("i"), F.greatest("i", "o").alias("j"))
        .agg(F.collect_list("fp").alias("prints"))
        .select("prints")
    )

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            links = [x for p in batch["prints"] for x in spanning_links(np.array(p, np.int64), max_bits)]
            yield pd.DataFrame(np.array(links, np.uint64).view(np.int64).reshape(-1, 2), columns=["a", "b"])

    links = materialise(pairs.unionByName(large.mapInPandas(search, "a long, b long")), "simhash-links")
    discard(shared)
    return links


def _rooted(docs: DataFrame, id_col: str, text_col: str, size: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, fp) of every row and (fp, root): the fingerprint that names the group of each fingerprint."""
    prints = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), fingerprint(F.col(text_col), size).alias("fp"))
    prints = materialise(prints, "simhash")
    distinct = prints.select("fp").distinct()
    near = connected_components(near_links(distinct, "fp", max_bits))
    named = distinct.join(near.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("root"))
    return prints, named


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, max_bits: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    component_id is the smallest id reachable over links of at most ``max_bits`` differing bits. Null and
    empty texts have fingerprint zero and link like any other; a null id keeps its row and counts for no
    minimum (a group of null ids only has a null component); repeated rows are kept; an empty table gives
    an empty result; other columns are ignored.
    """
    prints, named = _rooted(docs, id_col, text_col, size, max_bits)
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    named = materialise(named.join(firsts, "fp"), "simhash-named")
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return (
        prints.join(named.join(smallest, "root").select("fp", "component_id"), "fp")
        .select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, max_bits: int = 3) -> DataFrame:
    """``docs`` with one document of each group, columns as they are.

    The one with the smallest id stays, of several texts with that id the one with the smallest hash. Rows are told
    apart by (id, hash of the text), so an id that stands beside two texts loses only the one that has a near copy.
    Null ids come last: they stay only where their group has no other. Exactly repeated rows share one fate.
    Null and empty texts are near copies of each other; an empty table gives an empty result.
    """
    prints, named = _rooted(docs, id_col, text_col, size, max_bits)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    rows = prints.join(named, "fp").select("root", place.alias("place")).distinct()
    rows = materialise(rows, "simhash-rows")
    first = rows.groupBy("root").agg(F.min("place").alias("stays"))
    gone = rows.join(first, "root").where("NOT place <=> stays").select("place.doc_id", "place.text_key")
    gone = materialise(gone, "simhash-gone")
    for t in (prints, rows):
        discard(t)
    return without(docs, gone, doc_id=F.col(id_col), text_key=F.xxhash64(text_col))
