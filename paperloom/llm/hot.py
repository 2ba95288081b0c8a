"""Joins on keys of which one may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 0.001


def join_hot(rows: DataFrame, values: DataFrame, key: str, keep: bool = False, share: float = HOT_SHARE) -> DataFrame:
    """``rows`` with the columns of ``values``, which has one row per key; with ``keep`` rows without one stay, with nulls.

    Keys that hold more than ``share`` of the rows are at most ``1 / share``; their values are broadcast, so their rows stay where they
    are. Rows without a key are not moved either. All others are joined by the planner's choice.
    """
    sizes = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_all"))
    hot = sizes.join(F.broadcast(total)).where(F.col("_n") > F.greatest(F.col("_all") * share, F.lit(1))).select(key)
    known = hot.join(values, key, "left" if keep else "inner")
    few = rows.join(F.broadcast(hot), key, "left_anti").where(F.col(key).isNotNull()).join(values, key, "left" if keep else "inner")
    out = rows.join(F.broadcast(known), key).unionByName(few)
    if keep:
        added = [F.lit(None).cast(values.schema[c].dataType).alias(c) for c in values.columns if c != key]
        out = out.unionByName(rows.where(F.col(key).isNull()).select("*", *added))
    return out
