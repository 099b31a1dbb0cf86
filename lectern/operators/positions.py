"""Ranks within groups of any size.

A window over a group sorts the whole group in one task.  Here a group may hold
a third of all rows, so the rows are range-partitioned by (group, order), each
range is counted by itself, and the counts of the ranges before it are added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import cut, parallelism


def cumulative(df: DataFrame, keys: list[str], order: list[str], count: str) -> DataFrame:
    """Add ``below`` and ``total`` to rows that are unique by ``keys + order``.

    ``below`` sums ``count`` over the rows of the same group that come strictly
    before in ascending ``order``; ``total`` sums it over the group.  No task
    ever holds more of a group than one range of the range partitioning.
    """
    names = df.columns
    ranged = _ranged(df, keys, order)
    within = Window.partitionBy("_range", *keys)
    before = within.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_local", F.coalesce(F.sum(count).over(before), F.lit(0)))
    # At most one row per (group, range): a few for almost every group, `parts` at most.
    sums = ranged.groupBy("_range", *keys).agg(F.sum(count).alias("_sum"))
    ranges = Window.partitionBy(*keys)
    earlier = ranges.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "_range",
        *keys,
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_sum").over(ranges).alias("total"),
    )
    joined = local.join(offsets, ["_range", *keys])
    return joined.select(*names, (F.col("_local") + F.col("_offset")).cast("long").alias("below"), F.col("total").cast("long").alias("total"))


def _ranged(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` in ranges of (keys, order), written, with the number of the range."""
    parts = parallelism(df.sparkSession)
    return cut(df.repartitionByRange(parts, *[F.col(c) for c in (*keys, *order)]).withColumn("_range", F.spark_partition_id()))


def reached(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, ranged: DataFrame | None = None) -> DataFrame:
    """Add ``out``: the greatest ``value`` of the rows of the same group that come strictly before in ascending ``order`` (null for the first).

    ``order`` must be unique within a group.  As in ``cumulative`` no task
    holds more of a group than one range.
    """
    rows = _ranged(df, keys, order) if ranged is None else ranged
    within = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_local", F.max(value).over(within))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy("_range", *keys).agg(F.max(value).alias("_top")).select("_range", *keys, F.max("_top").over(earlier).alias("_before")).where("_before IS NOT NULL")
    joined = local.join(tops, ["_range", *keys], "left").withColumn(out, F.greatest("_local", "_before"))
    return joined.select(*(df.columns if ranged is None else rows.columns), out)


def islands(df: DataFrame, keys: list[str], order: list[str], start: str, end: str) -> DataFrame:
    """Add ``_island``: the number of the run of touching or overlapping spans of a group that a row belongs to.

    ``order`` begins with ``start`` and must be unique within a group, which
    may be of any size: runs are counted by range, as in ``cumulative``.
    """
    rows = reached(df, keys, order, end, "_reach", _ranged(df, keys, order))
    marked = rows.withColumn("_new", F.when(F.col(start) <= F.col("_reach"), 0).otherwise(1))
    within = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = marked.withColumn("_local", F.sum("_new").over(within))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = marked.groupBy("_range", *keys).agg(F.sum("_new").alias("_sum")).select("_range", *keys, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    joined = local.join(sums, ["_range", *keys])
    return joined.select(*df.columns, (F.col("_local") + F.col("_offset")).alias("_island"))


def following(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: ``value`` of the next row of the same group in ascending ``order`` (null for the last).

    ``order`` must be unique within a group.  As in ``cumulative`` no task holds
    more of a group than one range; the last row of a range takes the first
    value of the group's next range.
    """
    names = df.columns
    ranged = _ranged(df, keys, order)
    within = Window.partitionBy("_range", *keys).orderBy(*order)
    local = ranged.withColumn("_next", F.lead(F.struct(F.col(value).alias("_v"))).over(within))
    first = ranged.groupBy("_range", *keys).agg(F.min(F.struct(*order, F.col(value).alias("_v"))).alias("_first"))
    ranges = Window.partitionBy(*keys).orderBy("_range")
    after = first.select("_range", *keys, F.lead("_first").over(ranges).alias("_after")).where("_after IS NOT NULL")
    joined = local.join(after, ["_range", *keys], "left")
    return joined.select(*names, F.coalesce(F.col("_next._v"), F.when(F.col("_next").isNull(), F.col("_after._v"))).alias(out))
