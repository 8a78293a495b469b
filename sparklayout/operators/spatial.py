"""Spatial joins as one equi-join on grid cells whose width and height suit the rectangles.

Along each axis a rectangle has a level: the least L whose cells (16^L long) are no shorter than it. A pair meets in
cells that have, along each axis, the greater of its two levels; there each of the two covers at most two cells an
axis. Which side's level that is, along x and along y, makes four cases, and the case is part of the key: one side
stands at its own level, the other is raised to those levels that occur on the other side. A row is placed for those cases
only in which its shape can meet a shape of the other side. So in a cell stand only
rectangles that belong together at this level: small ones meet small ones in small cells, and a strap of a whole
chip meets what lies along it in long, flat cells, while those small rectangles don't meet each other there. A pair
that shares several cells is kept in one of them, so nothing has to be made distinct. Rows are dealt to as many tasks
as they need; crowded cells (one that a wide rectangle shares with a whole layer) go by plain exchanges, which adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sparklayout.functions import dealing, layers
from sparklayout.functions import geometry as g
from sparklayout.functions.geometry import Box
from sparklayout.sources.work import materialize

GROWTH = 16
PREDICATES: dict[str, Callable[[Box, Box], Column]] = {
    "touches": g.touches,
    "overlaps": g.overlaps,
    "contains": g.contains,
}


def _level(low: Column, high: Column) -> Column:
    extent = F.greatest(high - low, F.lit(1)).cast("double")
    return F.ceil(F.log(extent) / F.log(F.lit(float(GROWTH)))).cast("int")


#: Levels that a 64-bit extent can have.
_MOST = 17


#: Rows up to which a side is sent to all tasks. It goes by rows: sizes in bytes are guessed from compressed files, and not even that after explode.
BROADCAST_ROWS = 20_000


def leveled(rects: DataFrame, tag: str = "rects") -> DataFrame:
    """``rects`` as a table that knows the levels of its rectangles and their number: the job that writes it takes them along, so
    spatial joins of it need none of their own for that."""
    seen, box = Observation(), Box.of()
    x, y = _level(box.x1, box.x2), _level(box.y1, box.y2)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), y)
    masks = [F.coalesce(F.bit_or(F.when(x == i, bit)), F.lit(0)).cast("long").alias(f"x{i}") for i in range(_MOST)]
    table = materialize(rects.observe(seen, *masks, F.count(F.lit(1)).alias("n")), tag)
    found = seen.get
    table.rect_levels = {(i, j) for i in range(_MOST) for j in range(_MOST) if found[f"x{i}"] >> j & 1}
    table.rect_rows = found["n"]
    return table


def like(rows: DataFrame, source: DataFrame) -> DataFrame:
    """``rows``, a selection of ``source``'s, with what is known of the levels and the number of those."""
    for what in ("rect_levels", "rect_rows"):
        if hasattr(source, what):
            setattr(rows, what, getattr(source, what))
    return rows


def both(rows: DataFrame, *sources: DataFrame) -> DataFrame:
    """``rows``, made of rows of all ``sources``, with what is known of them if all of these know."""
    if all(hasattr(s, "rect_levels") and hasattr(s, "rect_rows") for s in sources):
        rows.rect_levels = set().union(*(s.rect_levels for s in sources))
        rows.rect_rows = sum(s.rect_rows for s in sources)
    return rows


def _known(*sides: DataFrame) -> None:
    """Gives each side the (x level, y level) that occur on it, some dozens at most; one job for those that don't know (:func:`leveled`)."""
    box = Box.of()
    levels = (_level(box.x1, box.x2).alias("x"), _level(box.y1, box.y2).alias("y"))
    unknown = {k: side for k, side in enumerate(sides) if not hasattr(side, "rect_levels")}
    asked = [side.select(F.lit(k).alias("side"), *levels) for k, side in unknown.items()]
    found = reduce(DataFrame.unionByName, asked).groupBy("side", "x", "y").agg(F.count("*").alias("n")).collect() if asked else []
    for k, side in unknown.items():
        mine = [r for r in found if r["side"] == k]
        side.rect_levels, side.rect_rows = {(r["x"], r["y"]) for r in mine}, sum(r["n"] for r in mine)


def _below(p: tuple, q: tuple) -> bool:
    return p[0] <= q[0] and p[1] <= q[1]


def _places(own: set, others: set, cases: tuple[int, ...], first: bool) -> dict[tuple, list[int]]:
    """For each shape of a side the (case, x level, y level) at which it can meet a shape of the other side, as one number each.

    Case 0: the first side's levels are no less along both axes; 1: the second side's, and one is greater; 2: the first side's is
    greater along x, less along y; 3: the other way round. What has the greater level stands at its own, the other is raised to it.
    """
    met: dict[tuple, set] = {shape: set() for shape in own}
    for p in own:
        for q in others:
            a, b = (p, q) if first else (q, p)
            case = 0 if _below(b, a) else 1 if _below(a, b) else 2 if a[0] > b[0] else 3
            if case in cases:
                met[p].add((case * _MOST + max(a[0], b[0])) * _MOST + max(a[1], b[1]))
    return {shape: sorted(found) for shape, found in met.items() if found}


def _binned(side: DataFrame, suffix: str, keys: list[str], others: set, cases: tuple[int, ...], first: bool, corner: bool = False) -> DataFrame:
    """Every row once for each case, level and cell in which it can meet rows of the other side; ``corner``: only in the cell of
    its lower corner."""
    box = Box.of(suffix)
    named = side.select(*keys, *(F.col(c).alias(f"{c}{suffix}") for c in side.columns if c not in keys))
    places = _places(side.rect_levels, others, cases, first)
    if not places:
        return named.limit(0).withColumns({"_place": F.lit(0), "_bx": F.lit(0).cast("long"), "_by": F.lit(0).cast("long")})
    of_shape = F.create_map(*(c for (x, y), at in sorted(places.items()) for c in (F.lit(x * _MOST + y), F.array(*map(F.lit, at)))))
    shape = _level(box.x1, box.x2) * _MOST + _level(box.y1, box.y2)
    placed = named.withColumn("_place", F.explode(F.element_at(of_shape, shape)))
    for cell, low, high, level in (("_bx", box.x1, box.x2, _across()), ("_by", box.y1, box.y2, _along())):
        at = lambda c, level=level: F.floor(c / _wide(level))
        placed = placed.withColumn(cell, at(low) if corner else F.explode(F.sequence(at(low), at(high))))
    return placed


def _wide(level: Column) -> Column:
    return F.pow(F.lit(float(GROWTH)), level)


def _across() -> Column:
    return F.expr(f"_place div {_MOST} % {_MOST}")


def _along() -> Column:
    return F.expr(f"_place % {_MOST}")


_CELL = ["_bx", "_by", "_place"]
_EACH_ORDER, _ONE_ORDER, _GREATER_FIRST = (0, 1, 2, 3), (0, 2), (0,)


def _whole(side: DataFrame) -> DataFrame:
    return like(side.where(" and ".join(f"{c} is not null" for c in ("x1", "y1", "x2", "y2"))), side)


def candidates(a: DataFrame, b: DataFrame, keys: list[str] | None = None, cases: tuple[int, ...] = _EACH_ORDER, corner: bool = False) -> DataFrame:
    """The pairs that share a cell, once for each cell that they share.

    Neither side is broadcast by a guess of its bytes: regular rectangles take next to nothing in a file.
    """
    keys = keys or []
    self_join = a is b
    a = _whole(a)
    b = a if self_join else _whole(b)
    _known(*((a,) if self_join else (a, b)))
    left, right = _binned(a, "_a", keys, b.rect_levels, cases, True), _binned(b, "_b", keys, a.rect_levels, cases, False, corner)
    n_a, n_b = (getattr(side, "rect_rows", None) for side in (a, b))
    on = [*_CELL, *keys]
    if n_b is not None and n_b <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), on)
    if n_a is not None and n_a <= BROADCAST_ROWS:
        return F.broadcast(left).join(right, on)
    return dealing.join(left, right, on, n=(n_a or 0) + (n_b or 0))


def _once() -> Column:
    """Of the cells that a pair shares, whether this is the one of the lower corner of what they share."""
    a, b = Box.of("_a"), Box.of("_b")
    of = lambda c, d, level: F.floor(F.greatest(c, d) / _wide(level))
    return (F.col("_bx") == of(a.x1, b.x1, _across())) & (F.col("_by") == of(a.y1, b.y1, _along()))


def spatial_join(a: DataFrame, b: DataFrame, predicate: str = "touches", keys: list[str] | None = None) -> DataFrame:
    """All pairs with equal ``keys`` for which ``predicate`` (touches, overlaps, contains) holds.

    Both sides have x1, y1, x2, y2 and other columns; in the result those of ``a`` end in ``_a``, those of
    ``b`` in ``_b``, and the keys keep their names. Rectangles with a null side match nothing. What contains another has no
    less a level along either axis, and stands in the cell of the other's lower corner.
    """
    keys = keys or []
    holds = PREDICATES[predicate](Box.of("_a"), Box.of("_b"))
    if predicate == "contains":
        found = candidates(a, b, keys, _GREATER_FIRST, corner=True).where(holds)
    else:
        found = candidates(a, b, keys).where(_once() & holds)
    return found.select(*keys, *(c for c in found.columns if c not in (*keys, *_CELL)))


def spatial_self_join(rects: DataFrame, keys: list[str], id_col: str = "rect_id") -> DataFrame:
    """Unordered pairs of touching rectangles with equal ``keys``, each once; columns as of :func:`spatial_join`, with the
    lesser id in ``_a``. Half of the cases are enough for that: the other half has the same pairs the other way round."""
    a, b = Box.of("_a"), Box.of("_b")
    levels = lambda box: F.struct(_level(box.x1, box.x2), _level(box.y1, box.y2))
    id_a, id_b = F.col(f"{id_col}_a"), F.col(f"{id_col}_b")
    found = candidates(rects, rects, keys, _ONE_ORDER).where(_once() & g.touches(a, b) & (id_a != id_b))
    found = found.where((id_a < id_b) | (levels(a) != levels(b)))
    own = [c for c in rects.columns if c not in keys]
    pick = lambda c, x, y: F.when(id_a < id_b, F.col(f"{c}_{x}")).otherwise(F.col(f"{c}_{y}")).alias(f"{c}_{x}")
    return found.select(*keys, *(pick(c, "a", "b") for c in own), *(pick(c, "b", "a") for c in own))


def touch_self_join(rects: DataFrame, keys: list[str], id_col: str = "rect_id") -> DataFrame:
    """keys, a, b: unordered pairs (a < b) of touching rectangles with equal keys."""
    side = like(rects.select(*keys, id_col, "x1", "y1", "x2", "y2"), rects)
    pairs = spatial_self_join(side, keys, id_col)
    return pairs.select(*keys, F.col(f"{id_col}_a").alias("a"), F.col(f"{id_col}_b").alias("b"))


#: Layers that conduct to each other where they touch: neighbours from POLY to MET5, and contacts on terminals.
LAYER_PAIRS = [(x, x + 1) for x in range(layers.POLY, layers.MET5)] + [
    (layers.N_TERM, layers.LICON),
    (layers.P_TERM, layers.LICON),
]


def interlayer_touch(rects: DataFrame, keys: list[str], id_col: str = "rect_id") -> DataFrame:
    """keys, layer_a, layer_b, a, b: touching rectangles on two layers that conduct to each other."""
    pairs = rects.sparkSession.createDataFrame([(i, *p) for i, p in enumerate(LAYER_PAIRS)], "_pair int, low long, high long")
    side = rects.select(*keys, id_col, F.col("layer").cast("long").alias("layer"), "x1", "y1", "x2", "y2")
    low = side.join(F.broadcast(pairs.select("_pair", F.col("low").alias("layer"))), "layer")
    high = side.join(F.broadcast(pairs.select("_pair", F.col("high").alias("layer"))), "layer")
    found = spatial_join(like(low, rects), like(high, rects), "touches", [*keys, "_pair"])
    return found.select(*keys, "layer_a", "layer_b", F.col(f"{id_col}_a").alias("a"), F.col(f"{id_col}_b").alias("b"))


def window_query(rects: DataFrame, boxes: DataFrame, id_col: str = "rect_id", box_col: str = "box_id") -> DataFrame:
    """box_id, rect_id for every rectangle that meets a query box, edges included."""
    found = spatial_join(like(boxes.select(box_col, "x1", "y1", "x2", "y2"), boxes), like(rects.select(id_col, "x1", "y1", "x2", "y2"), rects))
    return found.select(F.col(f"{box_col}_a").alias(box_col), F.col(f"{id_col}_b").alias(id_col))


def labels_to_rects(labels: DataFrame, rects: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label_id, rect_id: for each label point the least rectangle that it touches (null if none)."""
    points = labels.select(*keys, "label_id", *(F.col(c).alias(n) for c, n in (("x", "x1"), ("y", "y1"), ("x", "x2"), ("y", "y2"))))
    points.rect_levels = {(0, 0)}
    hits = spatial_join(points, like(rects.select(*keys, "rect_id", "x1", "y1", "x2", "y2"), rects), "touches", keys)
    least = hits.groupBy(*keys, F.col("label_id_a").alias("label_id")).agg(F.min("rect_id_b").alias("rect_id"))
    return labels.select(*keys, "label_id").join(least, [*keys, "label_id"], "left")


def unmatched_labels(labels: DataFrame, rects: DataFrame, keys: list[str]) -> DataFrame:
    """The labels that touch no rectangle."""
    found = labels_to_rects(labels, rects, keys).where("rect_id is not null")
    return labels.join(found, [*keys, "label_id"], "left_anti")


def overlaps_any(rects: DataFrame, wells: DataFrame, keys: list[str], id_col: str = "rect_id") -> DataFrame:
    """The rectangles whose inside meets any well (left semi)."""
    hits = spatial_join(like(rects.select(*keys, id_col, "x1", "y1", "x2", "y2"), rects), like(wells.select(*keys, "x1", "y1", "x2", "y2"), wells), "overlaps", keys)
    return rects.join(hits.select(*keys, F.col(f"{id_col}_a").alias(id_col)).distinct(), [*keys, id_col], "left_semi")
