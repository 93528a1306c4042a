"""Dense row numbers without gathering rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.plans.scratch import materialise

_LOW = (1 << 33) - 1


def numbered(rows: DataFrame, order: list[str], name: str = "row_no") -> tuple[DataFrame, int]:
    """``rows`` with a number 0..N-1 in the given order, nulls first, and N.

    Rows are range-partitioned and sorted; a row's number is the offset of its partition plus its place in it, so
    one task sees a partition at most. Equal rows get neighbouring numbers in any order.
    """
    keys = [F.col(c).asc_nulls_first() for c in order]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = materialise(placed.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit(_LOW).cast("long")))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    out = placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_off") + F.col("_at"))
    return out.drop("_part", "_at", "_off"), total
