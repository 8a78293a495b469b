"""Rectangles as Column expressions. A rectangle is four integer columns x1, y1, x2, y2."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    """Four columns of one rectangle."""

    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @classmethod
    def of(cls, suffix: str = "", prefix: str = "") -> Box:
        """The columns named x1..y2 with something before or after."""
        return cls(*(F.col(f"{prefix}{c}{suffix}") for c in ("x1", "y1", "x2", "y2")))

    def named(self, suffix: str = "") -> list[Column]:
        return [c.alias(f"{n}{suffix}") for c, n in zip(self, ("x1", "y1", "x2", "y2"), strict=True)]


def overlaps(a: Box, b: Box) -> Column:
    """The insides meet."""
    return (a.x1 < b.x2) & (b.x1 < a.x2) & (a.y1 < b.y2) & (b.y1 < a.y2)


def touches(a: Box, b: Box) -> Column:
    """They meet at least in an edge or corner."""
    return (a.x1 <= b.x2) & (b.x1 <= a.x2) & (a.y1 <= b.y2) & (b.y1 <= a.y2)


def contains(a: Box, b: Box) -> Column:
    """``b`` is inside ``a`` or on its edge."""
    return (a.x1 <= b.x1) & (a.y1 <= b.y1) & (a.x2 >= b.x2) & (a.y2 >= b.y2)


def area(a: Box) -> Column:
    """As a 64-bit product."""
    return (a.x2 - a.x1).cast("long") * (a.y2 - a.y1).cast("long")


def union_box(a: Box, b: Box) -> Box:
    return Box(F.least(a.x1, b.x1), F.least(a.y1, b.y1), F.greatest(a.x2, b.x2), F.greatest(a.y2, b.y2))


def intersect_box(a: Box, b: Box) -> Box:
    """Null where the insides don't meet."""
    inner = (F.greatest(a.x1, b.x1), F.greatest(a.y1, b.y1), F.least(a.x2, b.x2), F.least(a.y2, b.y2))
    return Box(*(F.when(overlaps(a, b), c) for c in inner))


def as_struct(a: Box) -> Column:
    return F.struct(*a.named())


def of_struct(s: Column) -> Box:
    return Box(s["x1"], s["y1"], s["x2"], s["y2"])


def subtract(a: Box, b: Box) -> Column:
    """``a`` without ``b`` as an array of at most four structs: full-width strips below and above, then the
    parts left and right of ``b``. Just ``a`` where the insides don't meet."""
    low, high = F.greatest(a.y1, b.y1), F.least(a.y2, b.y2)
    pieces = F.array(
        as_struct(Box(a.x1, a.y1, a.x2, b.y1)),
        as_struct(Box(a.x1, b.y2, a.x2, a.y2)),
        as_struct(Box(a.x1, low, b.x1, high)),
        as_struct(Box(b.x2, low, a.x2, high)),
    )
    rest = F.filter(pieces, lambda s: (s["x1"] < s["x2"]) & (s["y1"] < s["y2"]))
    return F.when(overlaps(a, b), rest).otherwise(F.array(as_struct(a)))


class Affine(NamedTuple):
    """Integer 2x3 matrix columns: x' = m00 x + m01 y + tx, y' = m10 x + m11 y + ty."""

    m00: Column
    m01: Column
    tx: Column
    m10: Column
    m11: Column
    ty: Column


    @classmethod
    def of(cls, suffix: str = "") -> Affine:
        return cls(*(F.col(f"{n}{suffix}") for n in ("m00", "m01", "tx", "m10", "m11", "ty")))

    def named(self, suffix: str = "") -> list[Column]:
        return [c.alias(f"{n}{suffix}") for c, n in zip(self, ("m00", "m01", "tx", "m10", "m11", "ty"), strict=True)]


def transform(a: Box, m: Affine) -> Box:
    """Move both corners and sort them again."""
    xs = [m.m00 * x + m.m01 * y + m.tx for x, y in ((a.x1, a.y1), (a.x2, a.y2))]
    ys = [m.m10 * x + m.m11 * y + m.ty for x, y in ((a.x1, a.y1), (a.x2, a.y2))]
    return Box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def compose(p: Affine, c: Affine) -> Affine:
    """First ``c``, then ``p``."""
    return Affine(
        p.m00 * c.m00 + p.m01 * c.m10,
        p.m00 * c.m01 + p.m01 * c.m11,
        p.m00 * c.tx + p.m01 * c.ty + p.tx,
        p.m10 * c.m00 + p.m11 * c.m10,
        p.m10 * c.m01 + p.m11 * c.m11,
        p.m10 * c.tx + p.m11 * c.ty + p.ty,
    )
