"""Statistics and reports over flat rectangles, nets and projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparklayout.functions import dealing, layers
from sparklayout.functions import geometry as g
from sparklayout.functions.geometry import Box
from sparklayout.operators.netlist import inverter_pairs
from sparklayout.sources.work import counted, materialize

_BOUNDS = (("x1", F.min), ("y1", F.min), ("x2", F.max), ("y2", F.max))


def _bounds() -> list[Column]:
    return [f(c).alias(c) for c, f in _BOUNDS]


def net_stats(flat: DataFrame, key: str = "net", keys: list[str] | None = None) -> DataFrame:
    """keys, net, area (overlaps count twice), x1..y2, n; rectangles without a net (-1 or null) don't count."""
    rows = flat.where(F.col(key) >= 0).groupBy(*(keys or []), key)
    return rows.agg(F.sum(g.area(Box.of())).alias("area"), *_bounds(), F.count("*").alias("n"))


def tree_stats(flat: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, tree, area, n_nets."""
    n_nets = F.count_distinct(F.when(F.col("net") >= 0, F.col("net"))).alias("n_nets")
    return flat.where("tree >= 0").groupBy(*(keys or []), "tree").agg(F.sum(g.area(Box.of())).alias("area"), n_nets)


def tree_nets(flat: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, tree, net: the set of nets of each tree, a row for each."""
    return flat.where("tree >= 0 and net >= 0").select(*(keys or []), "tree", "net").distinct()


def extent(flat: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, x1..y2: the bounding box of everything."""
    return flat.groupBy(*(keys or [])).agg(*_bounds())


def visible_rects(
    flat: DataFrame, mode: str = "standard", z_min: int = 0, z_max: int = 99, solo: int | None = None, show_power: bool = True
) -> DataFrame:
    """What a viewer would draw. Mode ``cells`` drops layers 1 to 9, any other the outlines. Layers whose place
    among the present ones by height is outside z_min..z_max go; terminals (3, 4) don't count and follow
    layer 5. A solo layer hides the others, where 3 to 5 act as one. Rails hidden: nets 0 and 1 stay on
    exempt layers only."""
    specs = F.broadcast(layers.layer_specs(flat.sparkSession))
    present = flat.select(F.col("layer").cast("long").alias("layer")).distinct().join(specs, "layer")
    placed = layers_by_z(present.where(~F.col("layer").isin(3, 4)))
    active = F.col("layer").between(3, 5)
    spot = placed.select(F.col("layer").alias("_like"), "pos")
    like = F.when(active, 5).otherwise(F.col("layer"))
    ranks = present.withColumn("_like", like).join(spot, "_like", "left").select("layer", "pos", "exempt")
    rows = flat.join(F.broadcast(ranks), "layer")
    rows = rows.where(~F.col("layer").between(1, 9) if mode == "cells" else F.col("layer") != layers.CELLS)
    if solo is not None:
        rows = rows.where(active if 3 <= solo <= 5 else F.col("layer") == solo)
    else:
        rows = rows.where(F.coalesce(F.col("pos").between(z_min, z_max), F.lit(False)))
    if not show_power:
        rows = rows.where(F.col("exempt") | ~F.col("net").isin(0, 1))
    return rows.drop("pos", "exempt")


def layers_by_z(present: DataFrame, flipped: bool = False) -> DataFrame:
    """present layers (at most twenty rows) with pos, their place by height; ties by number."""
    order = [F.col("z_rank"), F.col("layer")]
    if flipped:
        order = [c.desc() for c in order]
    return present.withColumn("pos", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))


#: Parts in which rectangles are first added up where an instance has very many of them.
SPREAD = 16


def netlist_summary(flat: DataFrame) -> DataFrame:
    """file_id, layer (null: all), rects, instances, wires (greatest net + 1, at least 2).

    Rows are counted as they are written, and dealt by instance to as many tasks as that takes. If a crowded instance is among them (a top
    cell with most of a file's rectangles), they are added up in parts before. An instance counts for its file in the first of its
    layers, so nothing has to be made distinct over all.
    """
    ids = ["file_id", "inst_id"]
    rows, n = counted(flat.where("file_id is not null").select(*ids, "layer", "net"), "flat-ids")
    rows = rows.withColumn("rects", F.lit(1).cast("long"))
    adds = [F.sum("rects").alias("rects"), F.max("net").alias("net")]
    if n > dealing.FEW_ROWS and dealing.crowded(ids, rows)[1]:
        parts = rows.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)))
        rows = dealing.grouped(parts, [*ids, "layer", "_part"], n).agg(*adds).drop("_part")
    each = dealing.dealt(rows, ids, n).groupBy(*ids, "layer").agg(*adds)
    known = F.col("inst_id").isNotNull()
    first = known & (F.row_number().over(Window.partitionBy(*ids).orderBy("layer")) == 1)
    each = each.select("file_id", "layer", "rects", "net", known.cast("long").alias("_here"), first.cast("long").alias("_first"))
    of_all = each.groupingSets([["file_id", "layer"], ["file_id"]], "file_id", "layer").agg(
        F.sum("rects").alias("rects"), F.sum("_here").alias("_here"), F.sum("_first").alias("_first"), F.greatest(F.max("net") + 1, F.lit(2)).alias("wires"), F.grouping("layer").alias("_all")
    )
    return of_all.select("file_id", "layer", "rects", F.when(F.col("_all") == 1, F.col("_first")).otherwise(F.col("_here")).alias("instances"), "wires")


def netlist_totals(segments: DataFrame, fets: DataFrame, keys: list[str]) -> DataFrame:
    """keys, segments, wires (greatest net + 1, at least 2), fets, inverters. ``segments``: keys, segment, net; ``fets``:
    keys, gate, term0, term1, type."""
    of_nets = segments.groupBy(*keys).agg(F.count("*").alias("segments"), F.greatest(F.max("net") + 1, F.lit(2)).alias("wires"))
    of_fets = fets.groupBy(*keys).agg(F.count("*").alias("fets"))
    of_pairs = inverter_pairs(fets, keys).groupBy(*keys).agg(F.count("*").alias("inverters"))
    return of_nets.join(of_fets, keys, "left").join(of_pairs, keys, "left").na.fill(0, ["fets", "inverters"])


def big_cells(rects: DataFrame, fets: DataFrame, least: int = 1000) -> DataFrame:
    """cell, rects, wires, fets of cells with more than ``least`` rectangles."""
    sizes = rects.groupBy("cell").agg(F.count("*").alias("rects"), F.count_distinct("wire").alias("wires")).where(F.col("rects") > least)
    return sizes.join(fets.groupBy("cell").agg(F.count("*").alias("fets")), "cell", "left").na.fill(0, ["fets"])


def cell_output_wires(fets: DataFrame, labels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, net: labelled nets that are a terminal of both a P and an N device."""
    keys = keys or []
    ends = fets.select(*keys, F.explode(F.array("term0", "term1")).alias("net"), "type")
    both = ends.groupBy(*keys, "net").agg(F.max(F.col("type") == 0).alias("_p"), F.max(F.col("type") == 1).alias("_n")).where("_p and _n")
    return both.join(labels.select(*keys, "net"), [*keys, "net"], "left_semi").select(*keys, "net")


def bus_values(bits: DataFrame, keys: list[str], ports: tuple[str, ...] = ("ui_in", "uo_out", "uio_in", "uio_out", "uo", "ui", "uio")) -> DataFrame:
    """keys, base, width, value, hex: buses of up to 63 bits from (keys, base, bit, value); missing bits are 0
    and ports have at least eight."""
    one = bits.where("bit between 0 and 62").groupBy(*keys, "base", "bit").agg(F.max("value").alias("value"))
    whole = one.groupBy(*keys, "base").agg(
        (F.max("bit") + 1).alias("width"), F.sum(F.expr("shiftleft(cast(value % 2 as bigint), cast(bit as int))")).alias("value")
    )
    text = F.hex("value")
    return whole.select(
        *keys, "base",
        F.greatest("width", F.when(F.lower("base").isin(*ports), 8).otherwise(0)).alias("width"), "value",
        F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text).alias("hex"),
    )


def status_counts(shuttles: DataFrame, projects: DataFrame) -> DataFrame:
    """pdk, status, shuttle_id (null: subtotals), projects."""
    joined = shuttles.join(projects.select(F.col("shuttle_id").alias("id"), "macro"), "id", "left")
    return joined.rollup("pdk", "status", "id").agg(F.count("macro").alias("projects")).withColumnRenamed("id", "shuttle_id")


def top_trees(stats: DataFrame, names: DataFrame, text: str = "", n: int = 1000, keys: list[str] | None = None) -> DataFrame:
    """keys, tree, area, label: the n largest trees (of each file) whose label holds ``text`` in any case; ties by tree."""
    keys = keys or []
    named = stats.join(names.select(*keys, F.col("net").alias("tree"), "name"), [*keys, "tree"], "left")
    label = F.concat(F.when(F.col("name").isNotNull(), F.concat("name", F.lit(" (Tree "), F.col("tree").cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("Tree "), F.col("tree").cast("string"))), F.lit(" (Area: "), F.col("area").cast("string"), F.lit(")"))
    rows = named.select(*keys, "tree", "area", label.alias("label")).where(F.lower("label").contains(text.lower()))
    if not keys:
        return rows.orderBy(F.desc("area"), "tree").limit(n)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("area"), "tree"))
    return rows.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def trees_to_nets(flat: DataFrame, trees: list[int]) -> DataFrame:
    """net: the nets of the chosen trees."""
    chosen = flat.sparkSession.createDataFrame([(t,) for t in trees], "tree long")
    return flat.join(F.broadcast(chosen), "tree", "left_semi").where("net >= 0").select("net").distinct()


def unique_sorted(fets: DataFrame) -> DataFrame:
    """Distinct devices in the order gate, term1, term0, type."""
    return fets.select("gate", "term0", "term1", "type").distinct().orderBy("gate", "term1", "term0", "type")


def latest_shuttles(shuttles: DataFrame) -> DataFrame:
    """Shuttles, the last listed first."""
    return shuttles.orderBy(F.desc("pos"))


#: Rows that one task compares at most, more or less: sizes in bytes of what is exchanged are those of compressed rows, tasks
#: that are dealt by them need far more memory.
ROWS_PER_TASK = 250_000


def layer_set_ops(before: DataFrame, after: DataFrame) -> DataFrame:
    """All rows of either side with ``change``: added, removed or kept. Rows are sets.

    One grouping tells all three. The rows are counted as they are written, and dealt to as many tasks as that takes.
    """
    columns = before.columns
    side = lambda rows, old: rows.select(*columns, F.lit(old).alias("_old"), F.lit(not old).alias("_new"))
    both, n = counted(side(before, True).unionByName(side(after, False)), "sides")
    dealt = both.repartition(n // ROWS_PER_TASK + 1, *columns)
    found = dealt.groupBy(*columns).agg(F.max("_old").alias("_old"), F.max("_new").alias("_new"))
    change = F.when(F.col("_old") & F.col("_new"), "kept").when(F.col("_old"), "removed").otherwise("added")
    return found.select(*columns, change.alias("change"))


#: Edge of a tile whose digest is compared.
TILE = 4096


def _digests(rects: DataFrame, side: str) -> DataFrame:
    """layer, tile, n and an order-free digest of each tile's rows: sums, which tasks add up for themselves first."""
    total = F.sum(F.xxhash64(*rects.columns).cast("decimal(38,0)"))
    return _tiled(rects).groupBy("layer", "_tx", "_ty").agg(F.count("*").alias(f"n_{side}"), total.alias(f"sum_{side}"))


def _tiled(rects: DataFrame) -> DataFrame:
    return rects.withColumns({"_tx": F.floor(F.col("x1") / TILE), "_ty": F.floor(F.col("y1") / TILE)})


def changed_tiles(before: DataFrame, after: DataFrame) -> DataFrame:
    """layer, _tx, _ty: tiles whose rows differ between two extractions (equal columns, x1, y1 and layer among them)."""
    both = _digests(before, "a").join(_digests(after.select(before.columns), "b"), ["layer", "_tx", "_ty"], "full")
    return both.where("not (n_a <=> n_b and sum_a <=> sum_b)").select("layer", "_tx", "_ty")


def layout_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that only one of two extractions has, with ``change``: added or removed. Rows are sets.

    Tiles are compared by digests first, so of an unchanged tile nothing but these is exchanged; only rows of tiles that
    differ are compared one by one.
    """
    after = after.select(before.columns)
    tiles = materialize(changed_tiles(before, after), "tiles")
    rows = lambda side: _tiled(side).join(tiles, ["layer", "_tx", "_ty"], "left_semi").select(before.columns)
    return layer_set_ops(rows(before), rows(after)).where("change <> 'kept'")
