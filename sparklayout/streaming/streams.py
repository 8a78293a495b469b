"""Structured Streaming forms of the trace operators.

State is dropped by a watermark on ``ts``; rows later than it are dropped. Edges and serial bytes depend on the order of
samples, so rows are held until the watermark has passed them, however the micro-batches shuffled them: what comes out is the
batch operator's result over all rows that weren't too late. Event-time timers release them and drop what a quiet line leaves.
Each function takes and returns a streaming DataFrame; :func:`run_available` drives one to the end of the files that are there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from sparklayout.operators.trace import serial_bytes
from sparklayout.sources.work import new_path

SAMPLES = "stream_id long, tick long, ts timestamp, wire long, value long"


def read_sample_stream(spark: SparkSession, folder: str, schema: str = SAMPLES, files: int = 1) -> DataFrame:
    """Samples appended as Parquet files, ``files`` of them in a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


#: State is kept on disk beside the executors and checkpointed as changes; stateful processors need it.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_available(stream: DataFrame, mode: str = "append", progress: list | None = None) -> DataFrame:
    """Process all that is there, write it as Parquet with a checkpoint in the shared folder, and read it. ``progress``: gets what
    Spark tells of each micro-batch."""
    spark = stream.sparkSession
    out, state = new_path(spark, "stream-out"), new_path(spark, "stream-state")
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:  # a query takes the setting along when it starts
        query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start(out)
    finally:
        spark.conf.unset(STORE[0]) if before is None else spark.conf.set(STORE[0], before)
    query.awaitTermination()
    if progress is not None:
        progress += query.recentProgress
    return spark.read.schema(stream.schema).parquet(out)


#: Rows that are held in one entry of the state at most.
HELD_ROWS = 4096


class _Held(StatefulProcessor):
    """Rows of a key are held until the watermark has passed them and then go to :meth:`settle` in their order. Where more than
    ``quiet`` milliseconds lie between two of them, and when the watermark has passed the last by as much, :meth:`end` is called
    and the key begins anew, without state. Rows are held by columns, HELD_ROWS in an entry of the state, and worked on by columns."""

    #: The column beside tick and ts, the state that is kept, and the columns that come out after the key's.
    value, kept, out = "value", "value long", ("tick",)

    def __init__(self, quiet: int):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms array<long>, tick array<long>, value array<long>")
        self.state = handle.getValueState("state", self.kept)
        self.last = handle.getValueState("last", "ms long")

    def settle(self, state: tuple | None, ticks: np.ndarray, values: np.ndarray) -> tuple[list[tuple], tuple]:
        """Results (tuples of ``out``'s columns) of rows after ``state``, and the state after them."""
        raise NotImplementedError

    def end(self, state: tuple) -> list[tuple]:
        """Results that only now are sure, since nothing more comes."""
        return []

    @staticmethod
    def _entries(rows: np.ndarray) -> list[tuple]:
        """rows (ms, tick, value) as entries of the state."""
        return [tuple(c.tolist() for c in rows[:, k : k + HELD_ROWS]) for k in range(0, rows.shape[1], HELD_ROWS)]

    def _due(self, now: int) -> list[tuple]:
        held = list(self.waiting.get()) if self.waiting.exists() else []
        rows = np.concatenate([np.array(list(x), np.int64) for x in held], axis=1) if held else np.empty((3, 0), np.int64)
        rows = rows[:, np.lexsort(rows[::-1])]
        n = int(np.searchsorted(rows[0], now, "right"))
        due, later = rows[:, :n], rows[:, n:]
        found: list[tuple] = []
        if n:
            ms, ticks, values = due
            state, last = (tuple(self.state.get()), self.last.get()[0]) if self.last.exists() else (None, int(ms[0]))
            starts = [0, *(1 + np.flatnonzero(np.diff(ms) > self.quiet)).tolist(), n]
            for lo, hi in zip(starts, starts[1:], strict=False):
                if state and ms[lo] - last > self.quiet:
                    found += self.end(state)
                    state = None
                more, state = self.settle(state, ticks[lo:hi], values[lo:hi])
                found += more
                last = int(ms[hi - 1])
            self.state.update(state)
            self.last.update((last,))
            self.waiting.put(self._entries(later)) if later.size else self.waiting.clear()
        if later.size:
            self.handle.registerTimer(int(later[0, 0]))
        elif self.last.exists():
            over = self.last.get()[0] + self.quiet
            if over < now:
                found += self.end(tuple(self.state.get()))
                self.state.clear()
                self.last.clear()
            else:
                self.handle.registerTimer(over + 1)
        return found

    def _frame(self, key: tuple, found: list[tuple]) -> pd.DataFrame:
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [[] for _ in self.out]
        n = len(columns[0])
        return pd.DataFrame({k: [v] * n for k, v in zip(self.keys, key, strict=True)} | {c: pd.Series(v, dtype=object) for c, v in zip(self.out, columns, strict=True)})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        for part in rows:  # Spark itself drops only what an earlier micro-batch's watermark had passed
            ms = part["ts"].astype("datetime64[us, UTC]" if part["ts"].dt.tz is not None else "datetime64[us]").astype("int64") // 1000
            found = np.stack([c.to_numpy(np.int64) for c in (ms, part["tick"], part[self.value])])
            in_time = found[:, found[0] > now]
            if in_time.size:
                self.waiting.appendList(self._entries(in_time))
        yield self._frame(key, self._due(now))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._frame(key, self._due(timerValues.getCurrentWatermarkInMs()))

    def close(self) -> None:
        pass


class _Edges(_Held):
    keys, out = ("stream_id", "wire"), ("tick", "edge")

    def settle(self, state: tuple | None, ticks: np.ndarray, values: np.ndarray) -> tuple[list[tuple], tuple]:
        changed = np.diff(values, prepend=state[0] if state else 0) != 0
        edge = np.where(values[changed] == 1, "rising", "falling").astype(object)
        return [(ticks[changed], edge)], (int(values[-1]),)


class _Bytes(_Held):
    """The state: from which tick the line is idle, and the levels since then, at most one unfinished byte's worth."""

    keys, out, value, kept = ("stream_id",), ("tick", "byte"), "tx", "idle long, ticks array<long>, levels array<long>"

    def settle(self, state: tuple | None, ticks: np.ndarray, values: np.ndarray) -> tuple[list[tuple], tuple]:
        idle, *before = state or (ticks[0], [], [])
        ticks, levels = (np.concatenate([np.array(old, np.int64), new]) for old, new in zip(before, (ticks, values), strict=True))
        found, idle = serial_bytes(ticks, levels, int(idle), int(ticks[-1]))
        keep = max(0, int(np.searchsorted(ticks, idle, "right")) - 1)
        return _columns(found), (int(idle), ticks[keep:].tolist(), levels[keep:].tolist())

    def end(self, state: tuple) -> list[tuple]:
        idle, ticks, levels = state
        return _columns(serial_bytes(np.array(ticks, np.int64), np.array(levels, np.int64), int(idle), None)[0])


def _columns(rows: list[tuple]) -> list[tuple]:
    return [tuple(np.array(c) for c in zip(*rows, strict=True))] if rows else []


def _processed(rows: DataFrame, processor: _Held, delay: str, schema: str) -> DataFrame:
    columns = [*processor.keys, "tick", "ts", processor.value]
    grouped = rows.select(*columns).withWatermark("ts", delay).groupBy(*processor.keys)
    return grouped.transformWithStateInPandas(processor, schema, "append", "eventTime")


#: Milliseconds of event time after which a line without samples is forgotten.
QUIET = 24 * 3_600_000


def stream_edges(samples: DataFrame, delay: str = "1 hour", quiet: int = QUIET) -> DataFrame:
    """stream_id, wire, tick, edge: changes of each wire, emitted when the watermark has passed them.

    Samples may come in any order within ``delay``. A wire without samples for ``quiet`` milliseconds is forgotten and then
    starts at 0 again.
    """
    return _processed(samples, _Edges(quiet), delay, "stream_id long, wire long, tick long, edge string")


def stream_activity(samples: DataFrame, size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """stream_id, wire, start, samples, high: counts by tumbling window, each emitted once the watermark has
    passed its end."""
    grouped = samples.withWatermark("ts", delay).groupBy("stream_id", "wire", F.window("ts", size).alias("w"))
    return grouped.agg(F.count("*").alias("samples"), F.sum("value").alias("high")).select(
        "stream_id", "wire", F.unix_timestamp("w.start").alias("start"), "samples", "high"
    )


def stream_bursts(samples: DataFrame, gap: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """stream_id, wire, start, samples: sessions of samples, emitted once the watermark has passed their end."""
    grouped = samples.withWatermark("ts", delay).groupBy("stream_id", "wire", F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.count("*").alias("samples")).select("stream_id", "wire", F.unix_micros("w.start").alias("start"), "samples")


def stream_serial(levels: DataFrame, delay: str = "1 hour", quiet: int = QUIET) -> DataFrame:
    """stream_id, tick, byte: serial bytes of levels (stream_id, tick, ts, tx) as soon as settled levels decide them.

    Levels may come in any order within ``delay``. A byte whose stop bit may still change waits for a later level, or until
    ``quiet`` milliseconds are over: then it is decoded as if the level stayed, and the line is forgotten.
    """
    return _processed(levels, _Bytes(quiet), delay, "stream_id long, tick long, byte long")
