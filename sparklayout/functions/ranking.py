"""Exact global row numbers without a one-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparklayout.sources.work import materialize

_IN_PARTITION = (1 << 33) - 1


def global_rank(df: DataFrame, order: list[str | Column], name: str = "rank") -> DataFrame:
    """Number the rows 0, 1, 2, ... in ``order`` over the whole input.

    Rows are range-partitioned by ``order`` and sorted inside each partition; the partitions' row
    counts (one row a partition) give each partition's first number. ``order`` has to tell all rows
    apart for the numbers to be the same in every run.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = materialize(
        df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_at", F.monotonically_increasing_id()),
        "rank",
    )
    part = F.shiftright("_at", 33)
    totals = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(_IN_PARTITION))
        .drop("_part", "_start", "_at")
    )


def rank_within(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "rank") -> DataFrame:
    """Number the rows of each key 0, 1, 2, ... in ``order``: :func:`global_rank` less the key's least number.
    However many rows a key has, they are numbered by many tasks."""
    ranked = global_rank(df, [*keys, *order], name)
    if not keys:
        return ranked
    first = ranked.groupBy(*keys).agg(F.min(name).alias("_least"))
    return ranked.join(first, keys).withColumn(name, F.col(name) - F.col("_least")).drop("_least").select(*df.columns, name)


def running_sum(df: DataFrame, keys: list[str], order: list[str | Column], value: str, name: str) -> DataFrame:
    """``name``: the sum of ``value`` (never negative) over the rows of the same key that stand before in ``order``.

    Sums are taken within ranges of the sorted rows and then over the ranges (one row each), so a key with most of the rows
    is summed by many tasks.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in [*keys, *order]]
    sorted_rows = df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(sorted_rows, "sums").withColumn("_part", F.shiftright("_at", 33))
    before = (Window.unboundedPreceding, -1)
    totals = placed.groupBy("_part").agg(F.sum(value).alias("_n"))
    starts = totals.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(*before)), F.lit(0)).alias("_start"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(*before)), F.lit(0))
    summed = placed.withColumn("_in", inside).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_in"))
    first = summed.groupBy(*keys).agg(F.min(name).alias("_least"))
    return summed.join(first, keys).withColumn(name, F.col(name) - F.col("_least")).select(*df.columns, name)
