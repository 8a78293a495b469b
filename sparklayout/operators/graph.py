"""Connected components as a loop of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklayout.sources.work import counted, materialize, scratch


#: Edges that one task of a round takes at least, and tasks of a round at least.
EDGES_PER_TASK, TASKS = 200_000, 8


def _mixed(v: Column) -> Column:
    """Another number for each vertex, no two alike (three shifts, each of which can be undone): so the order of vertices, which
    decides whom a vertex joins, is a new one in each round, and a chain in the order of its numbers is no worse than others."""
    v = v.bitwiseXOR(F.shiftleft(v, 13))
    v = v.bitwiseXOR(F.shiftrightunsigned(v, 7))
    return v.bitwiseXOR(F.shiftleft(v, 17))


def _contracted(edges: DataFrame, keys: list[str], tasks: int) -> tuple[DataFrame, DataFrame, int]:
    """One round: where each vertex goes (keys, u, to), and the edges (keys, u, v) that are left between these, with their number.

    A vertex joins the least of itself and its neighbours in the round's order. The least comes from a partial aggregate and is joined
    back, so that no vertex's neighbours are gathered in one row. ``tasks`` suits the number of edges: few edges are not worth a
    task for each shuffle partition.
    """
    mixed = edges.select(*keys, "u", "v", _mixed(F.col("u")).alias("_u"), _mixed(F.col("v")).alias("_v"))
    both = mixed.select(*keys, "u", F.least("_u", "_v").alias("to")).unionByName(mixed.select(*keys, F.col("v").alias("u"), F.least("_u", "_v").alias("to")))
    goes = materialize(both.groupBy(*keys, "u").agg(F.min("to").alias("to")).coalesce(tasks), "cc-to")
    up = edges.join(goes, [*keys, "u"]).select(*keys, F.col("to").alias("u"), "v")
    ends = up.join(goes.toDF(*keys, "v", "to"), [*keys, "v"]).select(*keys, F.greatest("u", "to").alias("u"), F.least("u", "to").alias("v"))
    left, n = counted(ends.where("u > v").distinct().coalesce(tasks), "cc")
    return goes, left, n


def connected_components(
    vertices: DataFrame,
    edges: DataFrame,
    vertex: str = "vertex",
    src: str = "src",
    dst: str = "dst",
    keys: list[str] | None = None,
    label: str = "component",
) -> DataFrame:
    """Label every vertex (a whole number) with the least vertex that edges lead to, itself included.

    ``keys`` (such as file_id) keep graphs apart. Vertices without edges keep their own id; edges whose ends are not among
    ``vertices`` still connect. Each round contracts the graph: neighbours become one vertex, and only edges between different
    ones go on, so what is done is gone and the rounds together work through a few times the edges. Then it is told backwards where
    the vertices of each round have gone to in the end. Rounds are written to the shared folder.
    """
    keys = keys or []
    on = [*keys, "u"]
    with scratch(edges.sparkSession) as keep:
        ends = [F.col(c).cast("long") for c in (src, dst)]
        pairs = edges.where(F.col(src) != F.col(dst)).select(*keys, F.greatest(*ends).alias("u"), F.least(*ends).alias("v"))
        now, left = counted(pairs.distinct(), "cc")
        rounds: list[DataFrame] = []
        while left:
            goes, now, left = _contracted(now, keys, max(TASKS, left // EDGES_PER_TASK))
            rounds.append(goes)
        found = None
        while rounds:
            goes = rounds.pop()
            if found is not None:
                later = found.toDF(*keys, "to", "_end")
                goes = goes.join(later, [*keys, "to"], "left").select(*on, F.coalesce("_end", "to").alias("to"))
            found = materialize(goes, "cc-end")
        if found is not None:
            least = found.groupBy(*keys, "to").agg(F.min("u").alias("_least"))
            found = keep(found.join(least, [*keys, "to"]).select(*keys, F.col("u").alias(vertex), "_least"), "components")
    every = vertices.select(*keys, vertex).distinct()
    if found is None:
        return every.withColumn(label, F.col(vertex))
    return every.join(found, [*keys, vertex], "left").select(*keys, vertex, F.coalesce("_least", vertex).alias(label))
