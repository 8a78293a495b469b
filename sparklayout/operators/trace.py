"""Decoding of sampled signals: edges, raster frames, serial bytes, bus transactions, activity.

Samples have (stream_id, tick, ...). A stream's order is its ticks; streams (and wires) are worked on apart. One stream may be
almost all there is, so none is one sort: its ticks are cut into runs, and each run is summed up as what it makes of the state
at its start, whatever that is. These summaries, one row a run, are composed in the order of runs, which gives every run its
state, and then all runs are decoded side by side. Results don't depend on the length of runs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparklayout.sources.work import materialize

#: Largest raster, and the least width and height that are reported.
MAX_WIDTH, MAX_HEIGHT, WIDTH, HEIGHT = 1440, 720, 720, 480
#: Ticks from the start edge to the middle of the start bit, and of one bit.
HALF_BIT, BIT = 116, 233
_BEFORE = (Window.unboundedPreceding, -1)


def _last_before(rows: DataFrame, keys: list[str], column: str) -> Column:
    """The value of ``column`` in the row before, within runs; null in a run's first row."""
    return F.lag(column).over(Window.partitionBy(*keys, "_run").orderBy("tick"))


def _with_previous(rows: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """rows (with _run, a table) and the value of ``column`` in the row before, across runs; null in the first of all."""
    on = [*keys, "_run"]
    runs = rows.groupBy(*on).agg(F.max_by(column, "tick").alias("_end"))
    carried = runs.select(*on, F.lag("_end").over(Window.partitionBy(*keys).orderBy("_run")).alias("_entry"))
    first = F.row_number().over(Window.partitionBy(*on).orderBy("tick")) == 1
    inside = _last_before(rows, keys, column)
    found = rows.withColumns({name: inside, "_first": first}).join(carried, on)
    return found.withColumn(name, F.when(F.col("_first"), F.col("_entry")).otherwise(F.col(name))).drop("_entry", "_first")


def _runs_of(samples: DataFrame, columns: list[str]) -> DataFrame:
    return materialize(_by_runs(samples.select(*columns)), "runs")


def _changes(samples: DataFrame) -> DataFrame:
    """stream_id, wire, tick, ts (if there is one), value, _changed: whether a wire, which starts at 0, has another value than before."""
    columns = ["stream_id", "wire", "tick", "value", *(["ts"] if "ts" in samples.columns else [])]
    rows = _with_previous(_runs_of(samples, columns), ["stream_id", "wire"], "value", "_was")
    return rows.select(*columns, (F.col("value") != F.coalesce("_was", F.lit(0))).alias("_changed"))


def edges(samples: DataFrame) -> DataFrame:
    """stream_id, wire, tick, edge (rising or falling): changes of a wire, which starts at 0."""
    edge = F.when(F.col("value") == 1, "rising").otherwise("falling").alias("edge")
    return _changes(samples).where("_changed").select("stream_id", "wire", "tick", edge)


def latest_state(samples: DataFrame) -> DataFrame:
    """stream_id, wire, value, tick: the last value of each wire."""
    return samples.groupBy("stream_id", "wire").agg(F.max_by("value", "tick").alias("value"), F.max("tick").alias("tick"))


#: Ticks of a run, and of a run of a serial line (at least BYTE), for which every state at its start is followed.
RUN_TICKS, SERIAL_TICKS = 65_536, 1 << 20


def _by_runs(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_run", F.expr(f"tick div {RUN_TICKS}"))


def _scanned(ticks: DataFrame) -> DataFrame:
    """ticks with frame, x, y of the pixel at each tick, and h and v, whether a sync rises at it.

    Within a run all is known but whether a sync rises at its first tick, and what was before: that is composed from the runs.
    """
    key = ["stream_id", "_run"]
    line = Window.partitionBy(*key).orderBy("tick")
    before = line.rowsBetween(*_BEFORE)
    rises = lambda c: F.coalesce((F.col(c) == 1) & (F.lag(c).over(line) == 0), F.lit(False))
    rows = _by_runs(ticks).withColumns({"_k": F.row_number().over(line), "h": rises("hsync"), "v": rises("vsync")})
    count = lambda c: F.coalesce(F.sum(F.col(c).cast("long")).over(before), F.lit(0))
    rows = rows.withColumns({"_lines": count("h"), "_frames": count("v"), "_at": F.max(F.when(F.col("h"), F.col("_k"))).over(before)})
    # lines up to the latest vsync and with its tick
    upto = F.when(F.col("v"), F.col("_lines") + F.col("h").cast("long"))
    rows = materialize(rows.withColumns({"_upto": F.max(upto).over(before), "_upto_here": upto}), "scan")

    first = lambda c: F.max(F.when(F.col("_k") == 1, F.col(c)))
    runs = rows.groupBy(*key).agg(
        F.count("*").alias("n"),
        F.count_if("h").alias("lines"),
        F.count_if("v").alias("frames"),
        F.max(F.when(F.col("h"), F.col("_k"))).alias("at"),
        F.max("_upto_here").alias("upto"),
        *(first(c).alias(f"{c}_in") for c in ("hsync", "vsync")),
        *(F.max_by(c, "tick").alias(f"{c}_out") for c in ("hsync", "vsync")),
    )
    order = Window.partitionBy("stream_id").orderBy("_run")
    earlier = order.rowsBetween(*_BEFORE)
    enters = lambda c: ((F.col(f"{c}_in") == 1) & (F.coalesce(F.lag(f"{c}_out").over(order), F.lit(0)) == 0)).cast("long")
    runs = runs.withColumns({"h0": enters("hsync"), "v0": enters("vsync")})
    total = lambda *c: F.coalesce(F.sum(sum(map(F.col, c), F.lit(0))).over(earlier), F.lit(0))
    runs = runs.withColumns({"n_in": total("n"), "lines_in": total("lines", "h0"), "frames_in": total("frames", "v0")})
    at = F.col("n_in") + F.coalesce("at", F.when(F.col("h0") == 1, 1))
    last_upto = F.col("lines_in") + F.col("h0") + F.coalesce("upto", F.when(F.col("v0") == 1, 0))
    runs = runs.withColumns({"at_out": at, "upto_out": last_upto})
    carried = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(earlier), F.lit(0))
    runs = runs.select(*key, "h0", "v0", "n_in", "lines_in", "frames_in", carried("at_out").alias("at_in"), carried("upto_out").alias("upto_in"))

    rows = rows.join(runs, key)
    later = (F.col("_k") > 1).cast("long")
    h0, v0 = F.col("h0") * later, F.col("v0") * later
    lines = F.col("lines_in") + h0 + F.col("_lines")
    last = F.coalesce(F.col("n_in") + F.col("_at"), F.when(h0 == 1, F.col("n_in") + 1), F.col("at_in"))
    upto = F.coalesce(F.col("lines_in") + F.col("h0") + F.col("_upto"), F.when(v0 == 1, F.col("lines_in") + F.col("h0")), F.col("upto_in"))
    starts = F.col("_k") == 1
    return rows.select(
        *ticks.columns,
        (F.col("h") | (starts & (F.col("h0") == 1))).alias("h"),
        (F.col("v") | (starts & (F.col("v0") == 1))).alias("v"),
        (F.col("frames_in") + v0 + F.col("_frames")).alias("frame"),
        (F.col("n_in") + F.col("_k") - last - 1).cast("long").alias("x"),
        (lines - upto).alias("y"),
    )


def raster_scan(ticks: DataFrame, bits: list[str]) -> DataFrame:
    """stream_id, frame, y, x, r, g, b. ``bits``: columns of the high bits of r, g, b, then the low ones.

    One pixel a tick, stored before the place moves on; a rising hsync begins the next line, a rising vsync
    the next frame. Pixels outside the largest raster go; the last write of a place in a frame stays.
    """
    colour = [((2 * F.col(bits[i]) + F.col(bits[i + 3])) * 85).alias(c) for i, c in enumerate("rgb")]
    pixels = _scanned(ticks).where((F.col("x") < MAX_WIDTH) & (F.col("y") < MAX_HEIGHT))
    last = pixels.groupBy("stream_id", "frame", "y", "x").agg(F.max_by(F.struct(*colour), "tick").alias("p"))
    return last.select("stream_id", "frame", "y", "x", "p.*")


def raster_size(ticks: DataFrame) -> DataFrame:
    """stream_id, width, height. Both rules look at how far the line has come: the width when an hsync rises,
    the height (0 then if an hsync rises too) when a vsync does."""
    far = F.col("x") + 1
    return _scanned(ticks).groupBy("stream_id").agg(
        F.least(F.greatest(F.max(F.when(F.col("h"), far)), F.lit(WIDTH)), F.lit(MAX_WIDTH)).cast("long").alias("width"),
        F.least(F.greatest(F.max(F.when(F.col("v"), F.when(F.col("h"), 0).otherwise(far))), F.lit(HEIGHT)), F.lit(MAX_HEIGHT)).cast("long").alias("height"),
    )


#: Ticks from a byte's start edge to the first one at which the next may start.
BYTE = HALF_BIT + 9 * BIT + 1


def serial_bytes(ticks: np.ndarray, levels: np.ndarray, idle_from: int, known_to: int | None, until: int | None = None) -> tuple[list[tuple[int, int]], int]:
    """Bytes (start tick, byte) of a line that keeps each level until the next, and the tick from which it
    is idle again. ``known_to``: stop at what later levels could still change; None: the last level stays. ``until``: leave
    what starts there or later."""
    at = lambda t: levels[np.searchsorted(ticks, t, "right") - 1]
    found: list[tuple[int, int]] = []
    zeros = ticks[levels == 0]
    end_of_all = known_to if known_to is not None else np.iinfo(np.int64).max
    while True:
        start = idle_from
        if not len(ticks) or start < ticks[0] or at(start) != 0:
            later = zeros[np.searchsorted(zeros, idle_from) :]
            if not len(later):
                return found, idle_from if until is None else max(idle_from, until)
            start = int(later[0])
        if until is not None and start >= until:
            return found, max(idle_from, until)
        # bytes that lie within one stretch of 0 have no stop bit; a line that stays at 0 has no more bytes
        change = np.searchsorted(ticks, start, "right")
        if change == len(ticks) and until is None:
            return found, start
        skip = (min(int(ticks[change]) if change < len(ticks) else end_of_all, end_of_all if until is None else until) - start - 1) // BYTE
        if skip > 0:
            idle_from = start + skip * BYTE
            continue
        middle = start + HALF_BIT
        end = middle + 9 * BIT
        if known_to is not None and known_to < end:
            return found, idle_from
        if at(middle) != 0:
            idle_from = middle + 1
            continue
        if at(end) == 1:
            found.append((start, sum(int(at(middle + BIT * (k + 1))) << k for k in range(8))))
        idle_from = end + 1


def serial_exits(ticks: np.ndarray, levels: np.ndarray, start: int, until: int) -> np.ndarray:
    """For each state that a run can begin with (idle from start, start + 1, ..): from where on the line is idle when ``until`` is
    reached. All states are followed side by side; those that meet go on as one."""
    place = np.arange(start, start + BYTE, dtype=np.int64)
    of_state = np.arange(BYTE)
    zeros = ticks[levels == 0]
    at = lambda t: np.where(t >= ticks[0], levels[np.maximum(np.searchsorted(ticks, t, "right") - 1, 0)], 1)
    far = np.iinfo(np.int64).max // 2
    while True:
        later = np.append(zeros, far)[np.searchsorted(zeros, place)]
        begin = np.where(at(place) == 0, place, later)
        done = begin >= until
        if done.all():
            return np.maximum(place, until)[of_state]
        stretch = np.append(ticks, far)[np.searchsorted(ticks, begin, "right")]
        skip = np.maximum((np.minimum(stretch, until) - begin - 1) // BYTE, 0)
        step = np.where(skip > 0, skip * BYTE, np.where(at(begin + HALF_BIT) != 0, HALF_BIT + 1, BYTE))
        place, again = np.unique(np.where(done, np.maximum(place, until), begin + step), return_inverse=True)
        of_state = again[of_state]


def serial_decode(levels: DataFrame) -> DataFrame:
    """stream_id, tick (of the start edge), byte from (stream_id, tick, tx) level changes.

    A byte belongs to the run of ticks where it starts; a run also gets the levels of a byte's length beyond its end, and the level
    that it begins with. What a run does to the state (from where on the line is idle) is found for every state, and these
    functions are composed, a row a run. So a line that is never idle is decoded by many tasks.
    """
    key = ["stream_id", "_run"]
    run = lambda t: F.floor(t / F.lit(SERIAL_TICKS)).cast("long")
    rows = materialize(levels.select("stream_id", "tick", "tx", run(F.col("tick")).alias("_run")), "levels")
    runs = rows.groupBy(*key).agg(F.max_by(F.struct("tick", "tx"), "tick").alias("end"), F.min("tick").alias("low"))
    order = Window.partitionBy("stream_id").orderBy("_run")
    begins = F.when(F.lag("_run").over(order).isNull(), F.col("low")).otherwise(F.col("_run") * SERIAL_TICKS)
    runs = runs.withColumns({"_next": F.lead("_run").over(order), "begins": begins})
    runs = materialize(
        runs.select(*key, "begins", (F.col("_next") * SERIAL_TICKS).alias("until"), "_next", F.lag("end").over(order).alias("entry"), F.lag("_run").over(order).alias("_prev"), "end"),
        "runs",
    )
    # levels just after a run's end are looked at by it too: those of the next run that has any, and the level at its start
    ahead = rows.where(F.col("tick") < F.col("_run") * SERIAL_TICKS + BYTE).join(runs.where("_prev is not null").select(*key, "_prev"), key)
    entry = runs.where("entry is not null").select("stream_id", "entry.tick", "entry.tx", "_run")
    dealt = rows.unionByName(ahead.select("stream_id", "tick", "tx", F.col("_prev").alias("_run"))).unionByName(entry)
    limits = F.struct("begins", "until").alias("limits")
    dealt = dealt.join(runs.select(*key, limits), key).select(*key, "tick", "tx", "limits.*")

    def arrays(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, int, int | None]:
        group = group.sort_values("tick")
        until = group["until"].iloc[0]
        return group["tick"].to_numpy(), group["tx"].to_numpy(), int(group["begins"].iloc[0]), None if pd.isna(until) else int(until)

    def sum_up(group: pd.DataFrame) -> pd.DataFrame:
        ticks, tx, begins, until = arrays(group)
        exits = serial_exits(ticks, tx, begins, until)
        first = np.flatnonzero(np.diff(exits, prepend=exits[0] - 1))
        return pd.DataFrame({"stream_id": [group["stream_id"].iloc[0]], "_run": [group["_run"].iloc[0]], "froms": [first + begins], "exits": [exits[first]]})

    def compose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_run")
        state, states = int(group["begins"].iloc[0]), []
        for froms, exits in zip(group["froms"], group["exits"], strict=True):
            states.append(state)
            if froms is not None:
                state = int(exits[np.searchsorted(froms, state, "right") - 1])
        return pd.DataFrame({"stream_id": group["stream_id"], "_run": group["_run"], "state": states})

    def decode(group: pd.DataFrame) -> pd.DataFrame:
        ticks, tx, _, until = arrays(group)
        found, _ = serial_bytes(ticks, tx, int(group["state"].iloc[0]), None, until)
        return pd.DataFrame({"stream_id": group["stream_id"].iloc[0], "tick": [t for t, _ in found], "byte": [b for _, b in found]})

    sums = dealt.where("until is not null").groupBy(*key).applyInPandas(sum_up, "stream_id long, _run long, froms array<long>, exits array<long>")
    states = runs.select(*key, "begins").join(sums, key, "left").groupBy("stream_id").applyInPandas(compose, "stream_id long, _run long, state long")
    return dealt.join(materialize(states, "states"), key).groupBy(*key).applyInPandas(decode, "stream_id long, tick long, byte long")


#: Bits that a transaction shows: a command, an address and eight bytes of data.
SPI_BITS = 96
_DEVICES = ("flash", "psram_a", "psram_b")
_SPI_WORD = ("present", *_DEVICES, "high", "low", "mosi", "miso")


def spi_transactions(samples: DataFrame) -> DataFrame:
    """stream_id, tick (of the deselect), device, op, address, n_bytes, data (hex of at most eight bytes).

    From (stream_id, tick, cs, ram_a, ram_b, sclk, mosi, miso). A select is active at 0, the first of the
    three counts. Bits come at a rising clock, the highest first: a command, a 24-bit address, then data
    from mosi (write, 2) or miso (read, 3 and 11). Other commands and transfers that don't end give nothing.
    """
    pieces = _spi_pieces(samples)
    columns = ["stream_id", "end_tick", "device", "n", "out_bits", "in_bits"]
    # most sessions begin and end within a run; the others' pieces are laid end to end
    bits = F.sort_array(F.collect_list(F.when(F.length("out_bits") > 0, F.struct("_run", "out_bits", "in_bits"))))
    across = pieces.where("not closed").groupBy("stream_id", "session").agg(F.max("end_tick").alias("end_tick"), F.max("device").alias("device"), F.sum("n").alias("n"), bits.alias("_bits"))
    across = across.select(*columns[:4], *(F.array_join(F.col(f"_bits.{c}"), "").alias(c) for c in columns[4:]))
    whole = pieces.where("closed").select(*columns).unionByName(across).withColumnRenamed("end_tick", "tick")
    number = lambda c, at, size: F.conv(F.substring(c, at, size), 2, 10).cast("long")
    ended = whole.where("tick is not null and n >= 8").withColumn("command", number("out_bits", 1, 8)).where("command in (2, 3, 11)")
    write = F.col("command") == 2
    n_bytes = F.greatest(F.expr("n div 8") - 4, F.lit(0).cast("long"))
    shown = F.least(n_bytes, F.lit((SPI_BITS - 32) // 8)).cast("int")
    data = F.substring(F.when(write, F.col("out_bits")).otherwise(F.col("in_bits")), F.lit(33), 8 * shown)
    pairs = F.regexp_replace(F.lpad(F.lower(F.conv(data, 2, 16)), 2 * shown, "0"), "(..)(?!$)", "$1 ")
    return ended.select(
        "stream_id",
        "tick",
        _device_name().alias("device"),
        F.when(write, "write").otherwise("read").alias("op"),
        F.when(F.col("n") >= 32, number("out_bits", 9, 24)).alias("address"),
        n_bytes.alias("n_bytes"),
        F.when(shown > 0, pairs).otherwise("").alias("data"),
    )


def _spi_words(samples: DataFrame) -> DataFrame:
    """stream_id, _run, word and, for each of _SPI_WORD, a number whose bit k tells of the sample at tick 64 * word + k. So samples
    are added up before they are exchanged."""
    selects = [F.coalesce(F.col(c) == 0, F.lit(False)) for c in ("cs", "ram_a", "ram_b")]
    holds = [F.lit(True), selects[0], ~selects[0] & selects[1], ~selects[0] & ~selects[1] & selects[2], F.col("sclk") == 1, F.col("sclk") == 0, F.col("mosi") == 1, F.col("miso") == 1]
    bit = F.expr("shiftleft(1L, cast(tick & 63 as int))")
    masks = [F.bit_or(F.when(c, bit).otherwise(F.lit(0).cast("long"))).alias(n) for c, n in zip(holds, _SPI_WORD, strict=True)]
    words = samples.where("tick is not null").groupBy("stream_id", F.expr("shiftright(tick, 6)").alias("word")).agg(*masks)
    return words.withColumn("_run", F.floor(F.col("word") / F.lit(RUN_TICKS)).cast("long"))


def _spi_parts(group: pa.Table, limit: int) -> pa.Table:
    """What a run holds of sessions: a row for each stretch of one device or none, with its bits but for the first sample's, and on
    that of the first stretch what the runs before and after need to know."""
    group = group.sort_by("word")
    column = lambda c: group.column(c).to_numpy()
    bits = {c: np.unpackbits(column(c).astype("<i8").view(np.uint8), bitorder="little") for c in _SPI_WORD}
    at = np.flatnonzero(bits["present"])
    ticks = column("word")[at >> 6] * 64 + (at & 63)
    device = sum(bits[c][at].astype(np.int64) * k for k, c in enumerate(_DEVICES, 1))
    high, low = bits["high"][at] == 1, bits["low"][at] == 1
    starts = np.flatnonzero(np.diff(device, prepend=device[0]))
    begins = np.append(0, starts)
    rises = 1 + np.flatnonzero((device[1:] > 0) & high[1:] & low[:-1])
    n_bits = np.bincount(np.searchsorted(begins, rises, "right") - 1, minlength=len(begins))
    shown = [slice(lo, lo + min(n, limit)) for lo, n in zip((np.cumsum(n_bits) - n_bits).tolist(), n_bits.tolist(), strict=True)]
    text = {name: (bits[c][at[rises]] + ord("0")).tobytes().decode("ascii") for c, name in (("mosi", "out_bits"), ("miso", "in_bits"))}
    size = len(begins)
    found = {c: pa.repeat(pa.scalar(group.column(c)[0].as_py(), pa.int64()), size) for c in ("stream_id", "_run")}
    found |= {"part": pa.array(np.arange(size)), "device": pa.array(device[begins]), "n": pa.array(n_bits)}
    found |= {name: pa.array([t[x] for x in shown], pa.string()) for name, t in text.items()}
    found["end_tick"] = pa.array([*ticks[starts].tolist(), None], pa.int64())
    of_run = (ticks[0], high[0], bits["mosi"][at[0]], bits["miso"][at[0]], device[-1], low[-1], len(starts), n_bits[-1])
    return pa.table(found | {c: pa.array([int(v), *[None] * (size - 1)], pa.int64()) for c, v in zip(_SPI_RUN, of_run, strict=True)})


_SPI_RUN = ("tick", "high", "mosi", "miso", "last_device", "last_low", "parts", "last_bits")


def _spi_bits(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bits (stream_id, session, device, n: its number within the session, mosi, miso), and the ticks (stream_id, session,
    end_tick) at which sessions end."""
    pieces = materialize(_spi_pieces(samples, np.iinfo(np.int32).max), "spi-pieces")
    chars = F.arrays_zip(F.split("out_bits", "").alias("mosi"), F.split("in_bits", "").alias("miso"))
    bits = pieces.where("length(out_bits) > 0").select("stream_id", "session", _device_name().alias("device"), "start", F.posexplode(chars).alias("pos", "bit"))
    bits = bits.select("stream_id", "session", "device", (F.col("start") + F.col("pos")).alias("n"), *(F.col(f"bit.{c}").cast("long").alias(c) for c in ("mosi", "miso")))
    return bits, pieces.where("end_tick is not null").select("stream_id", "session", "end_tick")


def _device_name() -> Column:
    return F.get(F.array(F.lit(None), *map(F.lit, _DEVICES)), F.col("device").cast("int"))


def _spi_pieces(samples: DataFrame, limit: int = SPI_BITS) -> DataFrame:
    """stream_id, session, _run, device (1 to 3), start (bits of the session in earlier runs), n, out_bits, in_bits (of the session's first
    ``limit`` bits, as text), end_tick (where the session ends, on one row of each; also of those without a device),
    closed (whether the session begins and ends in this run).

    In a run all is known but whether its first sample changes the device and its clock rises there, which session it begins in
    and how many bits that has had: these come from composing the runs.
    """
    key = ["stream_id", "_run"]
    schema = f"stream_id long, _run long, part long, device long, n long, out_bits string, in_bits string, end_tick long, {', '.join(f'{c} long' for c in _SPI_RUN)}"
    rows = materialize(_spi_words(samples).withColumn("stream_id", F.col("stream_id").cast("long")).groupBy(*key).applyInArrow(lambda group: _spi_parts(group, limit), schema), "spi")

    order = Window.partitionBy("stream_id").orderBy("_run")
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    runs = rows.where("part = 0").withColumns({"_device": F.coalesce(F.lag("last_device").over(order), F.lit(0)), "_low": F.coalesce(F.lag("last_low").over(order), F.lit(1))})
    runs = runs.withColumns({"change0": (F.col("device") != F.col("_device")).cast("long"), "bit0": F.expr("cast(device > 0 and high = 1 and _low = 1 as long)")})
    # bits of a run's last session, which goes on from the run before unless something has changed
    fresh = (F.col("parts") > 0) | (F.col("change0") == 1)
    added = F.col("last_bits") + F.when(F.col("parts") > 0, 0).otherwise(F.col("bit0"))
    runs = runs.withColumns({"added": added, "chain": F.sum(fresh.cast("long")).over(upto(order))})
    so_far = F.sum("added").over(upto(Window.partitionBy("stream_id", "chain").orderBy("_run")))
    runs = runs.withColumns({"bits_out": so_far, "sessions": F.coalesce(F.sum(F.col("parts") + F.col("change0")).over(order.rowsBetween(*_BEFORE)), F.lit(0))})
    bits_in = F.when(F.col("change0") == 1, 0).otherwise(F.coalesce(F.lag("bits_out").over(order), F.lit(0)))
    runs = materialize(runs.select(*key, "change0", "bit0", "sessions", bits_in.alias("bits_in"), *(F.col(c).alias(f"_{c}") for c in ("tick", "mosi", "miso"))), "spi-runs")

    first = F.col("part") == 0
    had = F.when(first, F.col("bits_in")).otherwise(0)
    own = F.when(first & (F.col("bit0") == 1), 1).otherwise(0)
    shown = lambda c, b: F.when(had >= limit, "").otherwise(F.substring(F.concat(F.when(own == 1, F.col(b).cast("string")).otherwise(""), c), F.lit(1), (F.lit(limit) - had).cast("int")))
    session = F.col("sessions") + F.col("change0")
    found = rows.drop(*_SPI_RUN).join(runs, key).select(
        "stream_id", (session + F.col("part")).alias("session"), "_run", "device", had.cast("long").alias("start"), (F.col("n") + own).alias("n"),
        shown("out_bits", "_mosi").alias("out_bits"), shown("in_bits", "_miso").alias("in_bits"), "end_tick",
        (~first & F.col("end_tick").isNotNull()).alias("closed"),
    )
    none = F.lit(None).cast("string")
    ends = runs.where("change0 = 1").select("stream_id", (session - 1).alias("session"), "_run", F.lit(0).cast("long").alias("device"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n"), none.alias("out_bits"), none.alias("in_bits"), F.col("_tick").alias("end_tick"), F.lit(False).alias("closed"))
    return found.unionByName(ends)


def _timed(samples: DataFrame) -> DataFrame:
    return _changes(samples).withColumn("ts", F.col("ts").cast("timestamp"))


def signal_activity(samples: DataFrame, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """stream_id, wire, start (epoch seconds), toggles, last_value by tumbling or sliding window."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    grouped = _timed(samples).groupBy("stream_id", "wire", window.alias("w")).agg(
        F.sum(F.col("_changed").cast("long")).alias("toggles"), F.max_by("value", "tick").alias("last_value")
    )
    return grouped.select("stream_id", "wire", F.unix_timestamp("w.start").alias("start"), "toggles", "last_value")


def bursts(samples: DataFrame, gap: str = "5 minutes") -> DataFrame:
    """stream_id, wire, start, changes: runs of changes that a quiet gap ends."""
    changed = _timed(samples).where("_changed")
    runs = changed.groupBy("stream_id", "wire", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("changes"))
    return runs.select("stream_id", "wire", F.unix_micros("w.start").alias("start"), "changes")
