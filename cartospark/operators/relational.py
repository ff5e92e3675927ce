"""Relational helpers round spatial tables: as-of joins, sessions, ranked neighbours of a group, set operations on cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: str, on: str, order: str | None = None, prefix: str = "r_", tolerance: Column | None = None) -> DataFrame:
    """Every left row with the last right row of its key at or before its time (`on`); the right's columns get the prefix, null where there's none.

    One shuffle by key and one running window, without a join: rows of both sides are sorted together, right rows first.
    order breaks ties among right rows of one time, the largest last.  tolerance: the longest interval allowed.
    """
    own = [c for c in right.columns if c != by]
    tie = F.col(order) if order else F.lit(0)
    r = right.select(F.col(by).alias("__by"), F.col(on).alias("__on"), tie.cast("long").alias("__tie"), F.struct(*own).alias("__right"), F.lit(None).cast(left.schema).alias("__left"))
    l = left.select(F.col(by).alias("__by"), F.col(on).alias("__on"), F.lit(None).cast("long").alias("__tie"), F.lit(None).cast(r.schema["__right"].dataType).alias("__right"), F.struct(*left.columns).alias("__left"))
    window = Window.partitionBy("__by").orderBy(F.col("__on"), F.col("__left").isNotNull(), "__tie").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("__on").isNotNull(), F.col("__right")), ignorenulls=True).over(window)
    both = l.unionByName(r).withColumn("__last", last).where("__left is not null")
    if tolerance is not None:
        both = both.withColumn("__last", F.when(F.col("__on") - F.col("__last")[on] <= tolerance, F.col("__last")))
    return both.select("__left.*", *[F.col("__last")[c].alias(prefix + c) for c in own])


def sessions(df: DataFrame, by: str, time: str, gap: str, *aggregates: Column) -> DataFrame:
    """(by, start, end, aggregates): rows of a key that follow each other within the gap, batch or stream."""
    out = df.groupBy(by, F.session_window(time, gap).alias("__s")).agg(*aggregates)
    return out.select(by, F.col("__s.start").alias("start"), F.col("__s.end").alias("end"), *[c for c in out.columns if c not in (by, "__s")])


def top_by_group(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group in the order, numbered; every task keeps k rows of a group before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def grouped_totals(df: DataFrame, keys: list[str], how: str, *aggregates: Column) -> DataFrame:
    """rollup, cube or plain groups of the keys."""
    if how not in ("rollup", "cube", "groupBy"):
        raise ValueError("how: rollup, cube or groupBy")
    return getattr(df, how)(*keys).agg(*aggregates)
