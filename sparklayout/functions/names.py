"""Predicates and parsing of cell, label and pin names as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names with a meaning.
GROUND = ("VGND", "VSS", "vssd1")
POWER = ("VPWR", "VDPWR", "VDD", "vccd1")
STANDARD_PREFIXES = ("sg13g2_", "sky130_", "gf180mcu_")
FILLER_PARTS = ("__fill", "__decap", "__tap", "__endcap")
POWER_STYLE = r"(?i)^(v(dd|ss|pwr|gnd)|vccd|vssd)\d*$"
IMPORTANT = r"(?i)^(?:[iu]o(_in|_out)?|uio(_in|_out)?|clk|ena|rst_?n?|[a-z]{1,2})$"
IMPORTANT_PREFIX = r"(?i)^(?:io|ui|uo|uio)_"
PORT = r"(?i)^(ui_in|uo_out|uio_in|uio_out)(?:\[(\d+)\])?$"
BUS = r"^(.+)\[(\d+)\]$"

#: The greatest id, and how many ids one row of an expanded range has.
ID_MOST, ID_STEP = (1 << 63) - 1, 1 << 16


def is_filler(name: Column) -> Column:
    own = F.startswith(name, F.lit("sg13g2_")) & (name.contains("_fill_") | name.contains("_decap_"))
    for part in FILLER_PARTS:
        own = own | name.contains(part)
    return own


def filler_cells(cells: DataFrame, refs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Cells with a filler's name that place no other cell."""
    keys = keys or []
    return cells.where(is_filler(F.col("name"))).join(refs.select(*keys, F.col("parent").alias("cell")), [*keys, "cell"], "left_anti")


def is_standard_cell(name: Column) -> Column:
    out = F.lit(False)
    for prefix in STANDARD_PREFIXES:
        out = out | F.startswith(name, F.lit(prefix))
    return out


def is_ground(label: Column) -> Column:
    return label.isin(*GROUND)


def is_power(label: Column) -> Column:
    return label.isin(*POWER)


def is_important_signal(name: Column) -> Column:
    return name.rlike(IMPORTANT) | name.rlike(IMPORTANT_PREFIX)


def net_display_names(labels: DataFrame, order: str = "name", keys: list[str] | None = None) -> DataFrame:
    """keys, net, name: the last power-style name by ``order`` if there is one, else the first name."""
    keys = keys or []
    power = F.col("name").rlike(POWER_STYLE)
    nets = labels.groupBy(*keys, "net").agg(
        F.max_by("name", F.when(power, F.col(order))).alias("_power"), F.min_by("name", order).alias("_first")
    )
    return nets.select(*keys, "net", F.coalesce("_power", "_first").alias("name"))


def parse_bus(labels: DataFrame) -> DataFrame:
    """net, name, base, bit of names like base[bit]; rails by name and nets 0 and 1 are left out."""
    rows = labels.where(~F.upper("name").isin("VDD", "VSS") & (F.col("net") > 1) & F.col("name").rlike(BUS))
    return rows.select(
        "net", "name", F.regexp_extract("name", BUS, 1).alias("base"), F.regexp_extract("name", BUS, 2).cast("long").alias("bit")
    )


def port_pins(labels: DataFrame) -> DataFrame:
    """pin (lower case, with its index), net: the last net by number for each port pin, and the clock."""
    base, index = F.lower(F.regexp_extract("name", PORT, 1)), F.regexp_extract("name", PORT, 2)
    pin = F.when(F.lower("name") == "clk", "clk").when(base != "", F.concat(base, F.when(index != "", F.concat(F.lit("["), index, F.lit("]"))).otherwise("")))
    return labels.withColumn("pin", pin).where("pin is not null").groupBy("pin").agg(F.max("net").alias("net"))


def parse_id_ranges(texts: DataFrame, key: str = "text_id") -> DataFrame:
    """text_id, low, high: what a text like ``1, 2, 5-10`` names, as ranges that neither overlap nor touch; ranges may be reversed,
    junk is ignored, and so is what lies beyond the greatest id. A range is one row, however long."""
    part = texts.select(key, F.explode(F.split("text", r"[,\s]+")).alias("part"))
    number = lambda p: F.coalesce(F.nullif(F.regexp_extract("part", p, 1), F.lit("")).try_cast("decimal(38,0)"), F.when(F.col("part").rlike(p), F.lit(10).cast("decimal(38,0)") * ID_MOST))
    dashed = F.col("part").contains("-")
    ends = part.select(key, number(r"^(\d+)").alias("a"), number(r"^\d+-(\d+)").alias("b"), dashed.alias("dashed"))
    ends = ends.where("a is not null and (not dashed or b is not null)").withColumn("b", F.coalesce("b", "a"))
    ends = ends.where(F.least("a", "b") <= ID_MOST)
    most = F.least(F.greatest("a", "b"), F.lit(ID_MOST - 1).cast("decimal(38,0)") + 1)
    ranges = ends.select(key, F.least("a", "b").cast("long").alias("low"), most.cast("long").alias("high"))
    # 5 and 6 touch: each range reaches to the number after it while they are merged
    line = Window.partitionBy(key).orderBy("low")
    before = F.max("high").over(line.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(before.isNull() | (F.col("low") - 1 > before), F.col("low"))
    merged = ranges.withColumn("_starts", starts).withColumn("_island", F.max("_starts").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return merged.groupBy(key, F.col("_island").alias("low")).agg(F.max("high").alias("high"))


def parse_id_list(texts: DataFrame, key: str = "text_id") -> DataFrame:
    """text_id, id: the distinct numbers of :func:`parse_id_ranges`, a step of a range at a time. To select known ids, however long
    the ranges are, use :func:`ids_in_ranges`."""
    steps = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(high - low) div {ID_STEP}"))).alias("_step")
    rows = parse_id_ranges(texts, key).select(key, "low", "high", steps).withColumn("low", F.col("low") + F.col("_step") * ID_STEP)
    upto = F.when(F.col("high") - F.col("low") >= ID_STEP, F.col("low") + (ID_STEP - 1)).otherwise(F.col("high"))
    return rows.select(key, F.explode(F.sequence("low", upto)).alias("id"))


def ids_in_ranges(ids: DataFrame, ranges: DataFrame, key: str = "text_id", id_col: str = "net") -> DataFrame:
    """text_id, net: the ``ids`` that lie in a text's ranges. A range, as far as there are ids, is cut into blocks of 1, 2, 4 ... numbers,
    two of a size at most; each id stands in one block of every size. So equal blocks are all that has to be found, no
    pair is looked at in vain, and no range is expanded but into some dozens of blocks."""
    low, high = ids.where(F.col(id_col) >= 0).agg(F.min(id_col), F.max(id_col)).first()
    if low is None:
        return ranges.select(key, F.lit(None).cast("long").alias(id_col)).limit(0)
    met = ranges.where((F.col("high") >= low) & (F.col("low") <= high))
    met = met.select(key, F.greatest("low", F.lit(low)).alias("low"), F.least("high", F.lit(high)).alias("high"))
    top = min(high.bit_length(), 62)
    # the blocks of 2^k numbers that lie within a range are a, .., z; all but its first and last one are in larger blocks
    rest = lambda c: f"({c} & (shiftleft(1L, k) - 1L))"
    of_size = f"""transform(sequence(0, {top}), k -> named_struct('k', k, 'a', shiftright(low, k) + if({rest("low")} = 0, 0, 1),
        'z', shiftright(high, k) - if({rest("high")} = shiftleft(1L, k) - 1L, 0, 1)))"""
    first = f"if(e.a <= e.z and (e.a % 2 = 1 or e.k = {top}), e.a, null)"
    last = f"if(e.a <= e.z and if(e.k = {top}, e.z > e.a, e.z % 2 = 0), e.z, null)"
    blocks = F.expr(f"flatten(transform({of_size}, e -> array(struct(e.k as _size, {first} as _block), struct(e.k as _size, {last} as _block))))")
    placed = met.select(key, F.inline(F.filter(blocks, lambda b: b["_block"].isNotNull())))
    sizes = F.posexplode(F.expr(f"transform(sequence(0, {top}), k -> shiftright({id_col}, k))")).alias("_size", "_block")
    known = ids.where(F.col(id_col) >= 0).select(F.col(id_col).cast("long").alias(id_col)).distinct().select(id_col, sizes)
    return placed.join(known.hint("merge"), ["_size", "_block"]).select(key, id_col)


def natural_order(labels: DataFrame) -> DataFrame:
    """Labels with pos: case-insensitive, with the bus index as a number; ties by name and net. The rank is
    within each file; a file has few labels."""
    base = F.lower(F.regexp_replace("name", r"\[\d+\]$", ""))
    bit = F.coalesce(F.regexp_extract("name", BUS, 2).try_cast("long"), F.lit(-1))
    by = Window.partitionBy("file_id").orderBy(base, bit, F.col("name"), F.col("net"))
    return labels.withColumn("pos", F.row_number().over(by).cast("long"))
