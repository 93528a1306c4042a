"""Joins on keys of rows that leave the rows' own columns alone, whatever their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def packed(rows: DataFrame, **keys: Column) -> DataFrame:
    """(row, keys...): every row as one struct, beside keys made from its columns."""
    own = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.select(own.alias("row"), *[v.alias(k) for k, v in keys.items()])


def without(rows: DataFrame, gone: DataFrame, **keys: Column) -> DataFrame:
    """``rows`` whose keys are not in ``gone`` (its columns are the keys' names); nulls match nulls."""
    left, right = packed(rows, **keys), gone.select(*keys).distinct()
    on = [left[k].eqNullSafe(right[k]) for k in keys]
    return left.join(right, on, "left_anti").select("row.*")


def matched(rows: DataFrame, facts: DataFrame, how: str = "left", **keys: Column) -> DataFrame:
    """(row, other columns of ``facts``): each row beside the facts on its keys; nulls match nulls."""
    left = packed(rows, **keys)
    on = [left[k].eqNullSafe(facts[k]) for k in keys]
    return left.join(facts, on, how).select(left["row"], *[facts[c] for c in facts.columns if c not in keys])
