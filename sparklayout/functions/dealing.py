"""Work dealt to as many tasks as its rows need.

Adaptive execution puts exchanged parts together by their bytes, which are those of compressed rows, and never makes more of them
than the session asks for; regular rows take ten times as much memory, and more the larger the input is. So rows are counted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

#: Rows that one task works on at most, more or less.
ROWS_PER_TASK = 250_000
#: Tasks that rows are dealt to at most. To more of them (spark.shuffle.sort.bypassMergeThreshold) a map task holds all its rows in memory
#: until it has read its part of the files, which has millions of regular rows.
MOST_TASKS = 200
#: Rows up to which plain exchanges do.
FEW_ROWS = 1_000_000
#: Keys of a join are counted by so many hashes.
KEY_HASHES = 4096


def tasks(n: int) -> int:
    return min(n // ROWS_PER_TASK + 1, MOST_TASKS)


def dealt(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    """About ``n`` rows dealt ``by`` columns; few stay as they are."""
    return rows if n <= FEW_ROWS else rows.repartition(tasks(n), *by)


def grouped(rows: DataFrame, by: list[str], n: int) -> GroupedData:
    """About ``n`` rows grouped ``by`` columns."""
    return dealt(rows, by, n).groupBy(*by)


def hashed(on: list[str]) -> Column:
    """The hash that keys are counted by."""
    return F.pmod(F.xxhash64(*on), F.lit(KEY_HASHES))


def crowded(on: list[str], *sides: DataFrame, many: int = 2 * ROWS_PER_TASK) -> tuple[int, list[int]]:
    """The number of rows, and the hashes of keys that too many of them (``many`` and four times the mean) have for one task."""
    keys = reduce(DataFrame.unionByName, (side.select(hashed(on).alias("_hash")) for side in sides))
    found = keys.groupBy("_hash").agg(F.count("*").alias("n")).collect()
    n = sum(r["n"] for r in found)
    return n, [r["_hash"] for r in found if r["n"] > many + 4 * n // KEY_HASHES]


def join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", n: int | None = None) -> DataFrame:
    """A join on equal columns (inner, or left_semi with nothing but these columns on the right), never by a broadcast. ``n``: the rows of
    both sides are no more, if that is known.

    Many rows are counted by hashes of their keys. Crowded ones (a cell of the grid that a whole layer shares) go by plain exchanges,
    which adaptive execution splits within a key; all others are dealt to as many tasks as the rows need. The optimizer would take a
    semi join below the dealing of its left side, so that is a join with distinct keys. No key may be a literal on a side: the optimizer
    takes it out of the join but not out of the dealing, and both sides are exchanged twice.
    """
    once = lambda side: side.distinct() if how == "left_semi" else side
    plain = lambda a, b: a.join(once(b).hint("merge"), on)
    if n is not None and n <= FEW_ROWS:
        return plain(left, right)
    rows, hashes = crowded(on, left, right)
    if rows <= FEW_ROWS:
        return plain(left, right)
    apart = hashed(on).isin(hashes)
    parts = max(tasks(rows), int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # Spark would exchange fewer once more
    even = lambda side: (side.where(~apart) if hashes else side).repartition(parts, *on)
    out = plain(even(left), even(right))
    return out.unionByName(plain(left.where(apart), right.where(apart))) if hashes else out
