"""Placed cells: reference matrices, the hierarchy walk and flattening."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparklayout.functions import geometry as g
from sparklayout.functions import layers, names
from sparklayout.functions.geometry import Affine, Box
from sparklayout.functions.ranking import running_sum
from sparklayout.operators.spatial import leveled, like, spatial_join, spatial_self_join
from sparklayout.sources.work import counted, materialize

TOLERANCE = 1e-4
QUARTER = 1.5707963267948966


def _whole(c: Column) -> Column:
    return F.abs(c - F.round(c)) < TOLERANCE


def with_support(refs: DataFrame) -> DataFrame:
    """refs with ``supported``: whole quarter turns, whole magnification, whole origin (within 1e-4)."""
    ok = _whole(F.col("rotation") / QUARTER) & _whole(F.col("mag")) & _whole(F.col("ox")) & _whole(F.col("oy"))
    return refs.withColumn("supported", ok)


def ref_matrix(refs: DataFrame) -> DataFrame:
    """refs (rotation, mag, x_reflection, ox, oy) with the integer matrix m00 m01 tx m10 m11 ty instead.

    A reflection flips the second column.
    """
    quad = F.pmod(F.round(F.col("rotation") / QUARTER).cast("int"), F.lit(4))
    mag = F.round("mag").cast("long")
    cos = F.when(quad == 0, 1).when(quad == 2, -1).otherwise(0).cast("long") * mag
    sin = F.when(quad == 1, 1).when(quad == 3, -1).otherwise(0).cast("long") * mag
    matrix = Affine(
        cos,
        F.when(F.col("x_reflection"), sin).otherwise(-sin),
        F.round("ox").cast("long"),
        sin,
        F.when(F.col("x_reflection"), -cos).otherwise(cos),
        F.round("oy").cast("long"),
    )
    return refs.select(*(c for c in refs.columns if c not in ("rotation", "mag", "x_reflection", "ox", "oy")), *matrix.named())


def subtree_sizes(refs: DataFrame, cells: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """keys, cell, size (placements below it, itself included), height: of every cell of ``refs`` and ``cells``.

    Works on definitions, from cells that place nothing upwards, a round for each level: so a whole layout's flat size is known
    before anything is expanded, and cells that place each other in a circle are found (ValueError) at once.
    """
    keys = keys or []
    one, zero = F.lit(1).cast("long").alias("size"), F.lit(0).alias("height")
    every = refs.select(*keys, F.col("parent").alias("cell")).unionByName(refs.select(*keys, F.col("child").alias("cell")))
    every = every if cells is None else every.unionByName(cells.select(*keys, "cell"))
    open_, left = counted(refs.groupBy(*keys, "parent", "child").agg(F.count("*").alias("times")), "placements")
    parents = open_.select(*keys, F.col("parent").alias("cell"))
    known = materialize(every.distinct().join(parents, [*keys, "cell"], "left_anti").select(*keys, "cell", one, zero), "sizes")
    while left:
        below = open_.join(known.withColumnRenamed("cell", "child"), [*keys, "child"], "left")
        sums = below.groupBy(*keys, F.col("parent").alias("cell")).agg(
            (F.sum(F.col("times") * F.col("size")) + 1).alias("size"),
            (F.max("height") + 1).alias("height"),
            F.count_if(F.col("size").isNull()).alias("_open"),
        )
        new, n = counted(sums.where("_open = 0").drop("_open"), "sizes")
        if not n:
            some = ", ".join(r[0] for r in open_.select("parent").distinct().orderBy("parent").limit(5).collect())
            raise ValueError(f"cells place each other in a circle, among them or below: {some}")
        known = known.unionByName(new)
        open_, left = counted(open_.join(new.withColumnRenamed("cell", "parent").select(*keys, "parent"), [*keys, "parent"], "left_anti"), "placements")
    return known


def root_cells(refs: DataFrame, cells: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """keys, cell: all cells that are placed nowhere. Of ``cells`` if given, lone ones too, else of those that place others."""
    keys = keys or []
    placed = refs.select(*keys, F.col("child").alias("cell")).distinct()
    every = cells.select(*keys, "cell") if cells is not None else refs.select(*keys, F.col("parent").alias("cell"))
    return every.distinct().join(placed, [*keys, "cell"], "left_anti")


def top_cells(
    refs: DataFrame, sizes: DataFrame, cells: DataFrame | None = None, name: str | None = None, keys: list[str] | None = None
) -> DataFrame:
    """keys, cell: the one cell of each file that a layout is walked from.

    That is the :func:`root_cells` one with the most placements below it (``sizes``: see :func:`subtree_sizes`), the least by name
    on ties. ``name``: the cell of that name (in ``cells``: cell, name) instead, in files that have one. What other roots hold is
    no part of the layout: :func:`unused_roots`.
    """
    keys = keys or []
    best = F.min(F.struct((-F.col("size")).alias("size"), "cell")).alias("_best")
    largest = lambda rows: rows.join(sizes, [*keys, "cell"]).withColumn("_one", F.lit(0)).groupBy(*keys, "_one").agg(best).select(*keys, "_best.cell")
    found = largest(root_cells(refs, cells, keys))
    if name is None or cells is None:
        return found
    chosen = largest(cells.where(F.col("name") == name).select(*keys, "cell"))
    zero = lambda rows: rows.withColumn("_one", F.lit(0))
    rest = zero(found).join(zero(chosen).select(*keys, "_one").distinct(), [*keys, "_one"], "left_anti").drop("_one")
    return chosen.unionByName(rest)


def unused_roots(refs: DataFrame, sizes: DataFrame, top: DataFrame, cells: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """keys, cell, size: roots beside the one that is walked."""
    keys = keys or []
    return root_cells(refs, cells, keys).join(top, [*keys, "cell"], "left_anti").join(sizes.drop("height"), [*keys, "cell"])


def place_instances(refs: DataFrame, top: DataFrame, sizes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, inst_id, cell, depth, matrix: all placements below the top cell of each file, itself included.

    ``refs`` have the columns of :func:`ref_matrix`, ``sizes`` are theirs; unsupported ones are to be left out before. Numbers are
    those of a depth-first walk in the order of ref_idx: a placement's is its parent's, plus one, plus the sizes
    of its earlier siblings. So each level is one join with the definitions, and nothing is sorted but these.
    """
    keys = keys or []
    below = refs.join(sizes.select(*keys, F.col("cell").alias("child"), "size"), [*keys, "child"])
    step = materialize(running_sum(below, [*keys, "parent"], ["ref_idx", "child"], "size", "_before"), "steps")
    step = step.select(*keys, F.col("parent").alias("cell"), "child", "_before", *Affine.of().named("_c"))
    unit = {"m00": 1, "m01": 0, "tx": 0, "m10": 0, "m11": 1, "ty": 0}
    first = F.lit(0).cast("long").alias("inst_id")
    found = [top.select(*keys, first, "cell", F.lit(0).alias("depth"), *(F.lit(v).cast("long").alias(k) for k, v in unit.items()))]
    height = top.join(sizes, [*keys, "cell"]).agg(F.max("height")).first()[0] or 0
    for depth in range(1, height + 1):
        joined = found[-1].select(*keys, "cell", "inst_id", *Affine.of().named("_p")).join(step, [*keys, "cell"])
        moved = g.compose(Affine.of("_p"), Affine.of("_c")).named()
        inst = (F.col("inst_id") + 1 + F.col("_before")).alias("inst_id")
        found.append(materialize(joined.select(*keys, inst, F.col("child").alias("cell"), F.lit(depth).alias("depth"), *moved), "level"))
    return reduce(DataFrame.unionByName, found)


def flatten_rects(instances: DataFrame, cell_rects: DataFrame, fillers: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, inst_id, cell, rect_id, layer, wire, x1..y2 in top coordinates: every placement with every rectangle of
    its cell, without ``fillers`` (see :func:`names.filler_cells`) and without wells and diffusion."""
    keys = keys or []
    solid = cell_rects.where(~F.col("layer").isin(layers.NWELL, layers.DIFF))
    placed = instances.join(fillers.select(*keys, "cell"), [*keys, "cell"], "left_anti").join(solid, [*keys, "cell"])
    return placed.select(*keys, "inst_id", "cell", "rect_id", "layer", "wire", *g.transform(Box.of(), Affine.of()).named())


def cell_bbox(rects: DataFrame, key: str = "cell", keys: list[str] | None = None) -> DataFrame:
    """keys, cell, layer (null for the whole cell), x1..y2 and n: both grains by grouping sets."""
    by = [*(keys or []), key]
    limits = (F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count("*").alias("n"))
    columns = [F.col(c) for c in [*by, "layer"]]
    return rects.groupingSets([columns, columns[:-1]], *columns).agg(*limits).where(F.col(key).isNotNull())


def instance_boxes(instances: DataFrame, cell_rects: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, inst_id, cell, layer, x1..y2: each placement's bounding box on each layer, moved to the top."""
    keys = keys or []
    boxes = cell_bbox(cell_rects, "cell", keys).where("layer is not null")
    return instances.join(boxes, [*keys, "cell"]).select(*keys, "inst_id", "cell", "layer", *g.transform(Box.of(), Affine.of()).named())


def instance_pairs(boxes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, layer, a, b (a < b): placements whose boxes touch on a layer from the terminals up."""
    keys = keys or []
    side = like(boxes.where(F.col("layer") >= layers.N_TERM).select(*keys, "layer", "inst_id", "x1", "y1", "x2", "y2"), boxes)
    pairs = spatial_self_join(side, [*keys, "layer"], "inst_id")
    return pairs.select(*keys, "layer", F.col("inst_id_a").alias("a"), F.col("inst_id_b").alias("b"))


_TURNS = ("m00", "m01", "m10", "m11")


def relative_placements(pairs: DataFrame, instances: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """pairs with cell_a, cell_b, the matrices of both as seen from a (m00_a .. ty_b), and ``rel``, which tells them apart.

    Pairs that are moved or, where a isn't magnified, turned or mirrored copies of each other have the same ``rel``.
    """
    keys = keys or []
    side = lambda x: instances.select(*keys, F.col("inst_id").alias(x), F.col("cell").alias(f"cell_{x}"), *Affine.of().named(f"_{x}"))
    both = pairs.join(side("a"), [*keys, "a"]).join(side("b"), [*keys, "b"])
    a, b = Affine.of("_a"), Affine.of("_b")
    dx, dy = b.tx - a.tx, b.ty - a.ty
    plain = a.m00 * a.m00 + a.m10 * a.m10 == 1  # then turning back is the transposed matrix
    back = Affine(a.m00, a.m10, F.lit(0), a.m01, a.m11, F.lit(0))
    turned = g.compose(back, Affine(b.m00, b.m01, dx, b.m10, b.m11, dy))
    zero, unit = F.lit(0).cast("long"), (1, 0, 0, 1)
    columns = {f"{n}_a": F.when(plain, F.lit(u).cast("long")).otherwise(F.col(f"{n}_a")) for n, u in zip(_TURNS, unit, strict=True)}
    columns |= {"tx_a": zero, "ty_a": zero}
    as_is = Affine(b.m00, b.m01, dx, b.m10, b.m11, dy)
    columns |= {f"{n}_b": F.when(plain, x).otherwise(y) for n, x, y in zip(Affine._fields, turned, as_is, strict=True)}
    seen = both.withColumns(columns)
    return seen.withColumn("rel", F.concat_ws(" ", *(f"{n}_{x}" for x in "ab" for n in Affine._fields)))


def _meeting(rels: DataFrame, rects: DataFrame, x: str, keys: list[str]) -> DataFrame:
    """_rel, wire, x1..y2 in the pair's frame: rectangles of side ``x`` that reach where both boxes meet."""
    m = Affine.of(f"_{x}")
    scale = m.m00 * m.m00 + m.m10 * m.m10
    # the region in the cell's own frame, rounded outwards where it is magnified
    xs = [(m.m00 * (F.col(p) - m.tx) + m.m10 * (F.col(q) - m.ty)) / scale for p, q in (("rx1", "ry1"), ("rx2", "ry2"))]
    ys = [(m.m01 * (F.col(p) - m.tx) + m.m11 * (F.col(q) - m.ty)) / scale for p, q in (("rx1", "ry1"), ("rx2", "ry2"))]
    low, high = (lambda *c: F.floor(F.least(*c))), (lambda *c: F.ceil(F.greatest(*c)))
    own = Box(low(*xs), low(*ys), high(*xs), high(*ys)).named()
    regions = rels.select(*keys, "layer", "_rel", F.col(f"cell_{x}").alias("cell"), *m.named(), *own)
    sides = like(rects.select(*keys, "layer", "cell", "wire", "x1", "y1", "x2", "y2"), rects)
    hits = spatial_join(regions, sides, "touches", [*keys, "cell", "layer"])
    moved = g.transform(Box.of("_b"), Affine.of("_a")).named()
    return leveled(hits.select(F.col("_rel_a").alias("_rel"), F.col("wire_b").alias("wire"), *moved).distinct(), "meeting")


def cross_instance_edges(instances: DataFrame, cell_rects: DataFrame, fillers: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, a_inst, a_wire, b_inst, b_wire: wires of different placements with touching rectangles on one layer.

    Placements whose boxes touch are brought down to their :func:`relative_placements`: a dictionary of (cell, cell, how they lie
    to each other), for which rectangles are compared once however often it occurs, and only those that
    reach where both boxes meet: so a top cell that overlaps everything costs what lies under each placement. The
    dictionary's wires are then joined back to the pairs.
    """
    keys = keys or []
    solid = cell_rects.where((F.col("layer") >= layers.N_TERM) & F.col("wire").isNotNull())
    solid = leveled(solid.select(*keys, "cell", "layer", "wire", "x1", "y1", "x2", "y2"), "solid")
    placed = instances.join(fillers.select(*keys, "cell"), [*keys, "cell"], "left_anti")
    boxes = leveled(instance_boxes(placed, solid, keys), "boxes")
    uses = materialize(relative_placements(instance_pairs(boxes, keys), instances, keys), "uses")
    named = [*keys, "layer", "cell_a", "cell_b", "rel"]
    rels = uses.select(*named, *(f"{n}_{x}" for x in "ab" for n in Affine._fields)).distinct()
    box = cell_bbox(solid, "cell", keys).where("layer is not null").drop("n")
    for x in "ab":
        moved = g.transform(Box.of(), Affine.of(f"_{x}")).named(f"_{x}")
        rels = rels.join(box.withColumnRenamed("cell", f"cell_{x}"), [*keys, f"cell_{x}", "layer"]).select(*rels.columns, *moved)
    a, b = Box.of("_a"), Box.of("_b")
    region = {"rx1": F.greatest(a.x1, b.x1), "ry1": F.greatest(a.y1, b.y1), "rx2": F.least(a.x2, b.x2), "ry2": F.least(a.y2, b.y2)}
    # a number for each, so that the dictionary's long names are exchanged once
    rels = materialize(rels.withColumns(region).withColumn("_rel", F.monotonically_increasing_id()), "relative")
    met = spatial_join(_meeting(rels, solid, "a", keys), _meeting(rels, solid, "b", keys), "touches", ["_rel"])
    wires = met.select("_rel", F.col("wire_a").alias("a_wire"), F.col("wire_b").alias("b_wire")).distinct()
    numbered = uses.select(*named, F.col("a").alias("a_inst"), F.col("b").alias("b_inst")).join(rels.select(*named, "_rel"), named)
    found = numbered.select(*keys, "a_inst", "b_inst", "_rel").join(wires, "_rel")
    return found.select(*keys, "a_inst", "a_wire", "b_inst", "b_wire").distinct()


def cell_outline_rects(
    instances: DataFrame, cell_rects: DataFrame, cells: DataFrame, fillers: DataFrame, outputs: DataFrame, keys: list[str] | None = None
) -> DataFrame:
    """keys, inst_id, layer (CELLS), x1..y2, wire: the outline of each standard cell that is no filler, with its
    least output wire (null if it has none). ``outputs``: cell, wire."""
    keys = keys or []
    on = [*keys, "cell"]
    wanted = cells.where(names.is_standard_cell(F.col("name"))).select(*on).join(fillers.select(*on), on, "left_anti")
    boxes = cell_rects.groupBy(*on).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    least = outputs.groupBy(*on).agg(F.min("wire").alias("wire"))
    placed = instances.join(wanted, on).join(boxes, on).join(least, on, "left")
    return placed.select(*keys, "inst_id", F.lit(layers.CELLS).cast("long").alias("layer"), *g.transform(Box.of(), Affine.of()).named(), "wire")


def number_segments(instances: DataFrame, wire_counts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, inst_id, first: each placement's first segment number, the running sum of wire counts by inst_id.

    Sums are taken within ranges of inst_id and then over the ranges (one row each).
    """
    keys = keys or []
    rows = instances.select(*keys, "inst_id", "cell").join(wire_counts, [*keys, "cell"])
    rows = rows.select(*keys, "inst_id", "n_wires", F.expr("inst_id div 4096").alias("_range"))
    inside = Window.partitionBy(*keys, "_range").orderBy("inst_id").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_range").agg(F.sum("n_wires").alias("_n"))
    totals = totals.select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    summed = rows.withColumn("_in", F.coalesce(F.sum("n_wires").over(inside), F.lit(0)))
    return summed.join(totals, [*keys, "_range"]).select(*keys, "inst_id", (F.col("_start") + F.col("_in")).alias("first"))


def lookup_nets(flat: DataFrame, segments: DataFrame, nets: DataFrame, trees: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """flat rectangles with net and tree: local wire -> segment -> net -> tree, -1 where any is missing.

    Trees are joined to the nets' segments first, so the flat rectangles are never dealt out by net: a rail has most
    of them.
    """
    keys = keys or []
    known = nets.select(*keys, "segment", "net").join(trees.select(*keys, "net", "tree"), [*keys, "net"], "left")
    found = flat.join(segments, [*keys, "inst_id"], "left").withColumn("segment", F.col("first") + F.col("wire"))
    found = found.join(known, [*keys, "segment"], "left")
    return found.withColumns({"net": F.coalesce("net", F.lit(-1)), "tree": F.coalesce("tree", F.lit(-1))}).drop("first", "segment")


def wire_nets(instances: DataFrame, cell_rects: DataFrame, fillers: DataFrame, segments: DataFrame, nets: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, inst_id, cell, matrix, wire and what ``nets`` (segment, net, ...) has: a row for each wire that a placement's flat rectangles
    have. These are many times as many; so nets are looked up for wires, and rectangles follow (:func:`flatten_wired`)."""
    keys = keys or []
    solid = cell_rects.where(~F.col("layer").isin(layers.NWELL, layers.DIFF) & F.col("wire").isNotNull())
    wires = solid.select(*keys, "cell", "wire").distinct()
    placed = instances.join(fillers.select(*keys, "cell"), [*keys, "cell"], "left_anti").join(segments, [*keys, "inst_id"]).join(wires, [*keys, "cell"])
    placed = placed.select(*keys, "inst_id", "cell", *Affine.of().named(), "wire", (F.col("first") + F.col("wire")).alias("segment"))
    return placed.join(nets, [*keys, "segment"]).drop("segment")


def flatten_wired(wired: DataFrame, cell_rects: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The columns of :func:`flatten_rects`, net and tree for all rectangles with a wire; ``wired``: see :func:`wire_nets`."""
    keys = keys or []
    solid = cell_rects.where(~F.col("layer").isin(layers.NWELL, layers.DIFF))
    placed = wired.join(solid, [*keys, "cell", "wire"])
    return placed.select(*keys, "inst_id", "cell", "rect_id", "layer", "wire", *g.transform(Box.of(), Affine.of()).named(), "net", "tree")


def net_to_instances(flat: DataFrame, net: int, labels: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """keys, inst_id, wires and, with ``labels`` (cell, text, wire), labels: placements on a net with their local wires
    and the names that their cells give these, joined by commas; empty where there is no name."""
    keys = keys or []
    rows = flat.where(F.col("net") == net).select(*keys, "inst_id", "cell", "wire").distinct()
    joined = lambda c, by: F.array_join(F.sort_array(F.collect_set(c)), by)
    if labels is None:
        return rows.groupBy(*keys, "inst_id").agg(joined(F.col("wire").cast("string"), ",").alias("wires"))
    rows = rows.join(labels.select(*keys, "cell", "text", "wire"), [*keys, "cell", "wire"], "left")
    return rows.groupBy(*keys, "inst_id").agg(joined(F.col("wire").cast("string"), ",").alias("wires"), joined("text", ", ").alias("labels"))
