"""Shards and slots from a Feistel permutation of global row numbers.

Rows are numbered 0..N-1 in the order of (id, checksum, size). A keyed Feistel network permutes the smallest
range of 2^b numbers that holds N; numbers that leave 0..N-1 are permuted again until they fall inside (cycle
walking), which makes a permutation of 0..N-1. Permuted number p lies in shard p mod S at slot p div S, so both
can be worked out from the row number alone, row counts differ by at most one and slots have no gap.

Only (id, size, checksum) is sorted, never the text; the number of a row is the offset of its range partition
plus its place in it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.numbering import numbered
from lodestone.plans.scratch import materialise

ROUND_KEYS = (1540483477, 305419896, 88172645, 1013904223)
PRIME = 2147483647
#: Applications of the network in one pass of the walk; rows that still lie outside go on in another pass.
STEPS = 32


def widths(n: int) -> tuple[int, int]:
    """Bits of the left and the right half for ``n`` rows."""
    bits = max(2, (max(n, 1) - 1).bit_length())
    return bits // 2, bits - bits // 2


def _mix(x: Column, key: int, bits: int) -> Column:
    t = (x * F.lit(48271).cast("long") + F.lit(key).cast("long")) % PRIME
    t = (t * t + F.lit(key % 65521).cast("long")) % PRIME
    return F.shiftright(t, 5).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def feistel(x: Column, n: int, seed: int = 0) -> Column:
    """One pass of the network over 0..2^b-1, 2^b the least power of two that holds ``n``.

    The two halves are a struct in a one-element array, so that each round works them out once.
    """
    low, high = widths(n)
    pair = F.struct(F.shiftrightunsigned(x, high).alias("l"), x.bitwiseAND(F.lit((1 << high) - 1).cast("long")).alias("r"))
    cell, a, b = F.array(pair), low, high  # a, b: widths of left and right
    for key in ROUND_KEYS:
        cell = F.transform(cell, _round((key + seed * 7919) % PRIME, a))
        a, b = b, a
    return F.transform(cell, lambda s: F.shiftleft(s["l"], b).bitwiseOR(s["r"]))[0]


def _round(key: int, bits: int) -> Callable[[Column], Column]:
    return lambda s: F.struct(s["r"].alias("l"), s["l"].bitwiseXOR(_mix(s["r"], key, bits)).alias("r"))


def _walk(x: Column, n: int, seed: int, least: int) -> Column:
    """``x`` permuted ``least`` times and then on until it is below ``n``, STEPS times at most."""
    steps = F.sequence(F.lit(1), F.lit(STEPS))
    return F.aggregate(steps, x, lambda acc, i: F.when((i > least) & (acc < n), acc).otherwise(feistel(acc, n, seed)))


def shard(docs: DataFrame, shards: int = 24, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, row_no) for every row.

    size: UTF-8 bytes of the text plus 8; a null text has no bytes and the checksum of none. Null ids are
    numbered first, repeated rows get numbers of their own, an empty table gives an empty result, other columns
    are ignored. law is `rows`: counts differ by at most one, so grown_shard is null.
    """
    body = F.coalesce(F.encode(F.col(text_col), "UTF-8"), F.lit(b""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    rows, n = numbered(rows, ["doc_id", "text_crc32", "size"])
    rows = rows.withColumn("_p", _walk(F.col("row_no"), n, seed, 1))
    while n and (left := rows.where(F.col("_p") >= n).limit(1).count()):  # 2^-STEPS of the rows
        rows = materialise(rows.withColumn("_p", F.when(F.col("_p") >= n, _walk(F.col("_p"), n, seed, 0)).otherwise(F.col("_p"))), "walked")
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("_p") % shards).cast("int").alias("shard"), F.floor(F.col("_p") / shards).cast("long").alias("slot"),
        F.lit(None).cast(T.IntegerType()).alias("grown_shard"), "row_no",
    )
