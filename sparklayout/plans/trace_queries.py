"""Registered queries: signal traces in batch and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparklayout.operators import trace
from sparklayout.registry import query
from sparklayout.sources.fixtures import duck, view
from sparklayout.sources.work import new_path
from sparklayout.streaming import streams

_WAS = "c as (select *, lag(value, 1, 0) over (partition by stream_id, wire order by tick) as was from samples)"
_EDGES = f"with {_WAS} select stream_id, wire, tick, case when value = 1 then 'rising' else 'falling' end as edge from c where value <> was"


@query("t1_edges", duck(_EDGES))
def t1(spark, sf):
    return trace.edges(view(spark, sf, "samples"))


@query("t2_latest_state", duck("select stream_id, wire, arg_max(value, tick) as value, max(tick) as tick from samples group by stream_id, wire"))
def t2(spark, sf):
    return trace.latest_state(view(spark, sf, "samples"))


_SCAN = """r as (select *, hsync = 1 and lag(hsync, 1, 0) over (order by tick) = 0 as h, vsync = 1 and lag(vsync, 1, 0) over (order by tick) = 0 as v from raster_ticks),
  ev as (select tick, h, v, row_number() over (order by tick) as n from r),
  hs as (select n from ev where h), vs as (select n from ev where v),
  px as (select r.tick, r.rgb, ev.n, r.h, r.v, (select count(*) from vs where vs.n < ev.n) as frame, ev.n - coalesce((select max(hs.n) from hs where hs.n < ev.n), 0) - 1 as x,
    (select count(*) from hs where hs.n < ev.n and hs.n > coalesce((select max(vs.n) from vs where vs.n < ev.n), 0)) as y from r join ev using (tick))"""


def _ticks(spark, sf):
    bit = lambda k: F.expr(f"(rgb div {2**k}) % 2")
    ticks = view(spark, sf, "raster_ticks")
    return ticks.withColumns({f"bit{k}": bit(k) for k in range(6)})


@query(
    "t3_raster_scan",
    duck(f"""with {_SCAN}, k as (select *, row_number() over (partition by frame, y, x order by tick desc) as nth from px where x < 1440 and y < 720)
      select 0::bigint as stream_id, frame, y, x, (2 * (rgb % 2) + rgb // 8 % 2) * 85 as r, (2 * (rgb // 2 % 2) + rgb // 16 % 2) * 85 as g, (2 * (rgb // 4 % 2) + rgb // 32 % 2) * 85 as b from k where nth = 1"""),
)
def t3(spark, sf):
    return trace.raster_scan(_ticks(spark, sf), [f"bit{k}" for k in range(6)])


@query(
    "t4_raster_size",
    duck(f"""with {_SCAN} select 0::bigint as stream_id, least(greatest(max(x + 1) filter (h), 720), 1440)::bigint as width,
      least(greatest(max(case when h then 0 else x + 1 end) filter (v), 480), 720)::bigint as height from px"""),
)
def t4(spark, sf):
    return trace.raster_size(_ticks(spark, sf))


@query("t5_serial_decode", duck("select stream_id, 100 + k * 2500 as tick, byte from serial_bytes"))
def t5(spark, sf):
    return trace.serial_decode(view(spark, sf, "serial_levels"))


@query(
    "t6_spi_transactions",
    duck("""select x.stream_id, x.xfer * 1000 + 999 as tick, case device when 0 then 'flash' when 1 then 'psram_a' else 'psram_b' end as device,
        case command when 2 then 'write' else 'read' end as op, address, nbytes as n_bytes,
        string_agg(lpad(printf('%x', (x.xfer + j * 37) % 256), 2, '0'), ' ' order by j) as data
      from spi_xfers x, (select unnest(range(8)) as j) where j < nbytes group by all"""),
)
def t6(spark, sf):
    return trace.spi_transactions(view(spark, sf, "spi_samples"))


@query(
    "t7_signal_activity",
    duck(f"""with {_WAS} select stream_id, wire, epoch(date_trunc('hour', ts))::bigint as start, count(*) filter (value <> was) as toggles, arg_max(value, tick) as last_value
      from c group by stream_id, wire, date_trunc('hour', ts)"""),
)
def t7(spark, sf):
    return trace.signal_activity(view(spark, sf, "samples"))


@query(
    "t7_sliding_activity",
    duck(f"""with {_WAS} select stream_id, wire, epoch(date_trunc('hour', ts) - k * interval 1 hour)::bigint as start, count(*) filter (value <> was) as toggles, arg_max(value, tick) as last_value
      from c, (select unnest(range(2)) as k) group by stream_id, wire, date_trunc('hour', ts) - k * interval 1 hour"""),
)
def t7_sliding(spark, sf):
    return trace.signal_activity(view(spark, sf, "samples"), "2 hours", "1 hour")


@query(
    "t8_bursts",
    duck(f"""with {_WAS}, d as (select *, lag(ts) over (partition by stream_id, wire order by ts) as prev from c where value <> was),
      s as (select *, sum(case when prev is null or ts - prev > interval 6 hours then 1 else 0 end) over (partition by stream_id, wire order by ts) as run from d)
      select stream_id, wire, epoch_us(min(ts)) as start, count(*) as changes from s group by stream_id, wire, run"""),
)
def t8(spark, sf):
    return trace.bursts(view(spark, sf, "samples"), "6 hours")


def _sample_stream(spark, sf, files=3):
    """The samples as files that arrive in time order, and a stream over them."""
    path = new_path(spark, "samples")
    samples = view(spark, sf, "samples").withColumn("ts", F.col("ts").cast("timestamp"))
    samples.select("stream_id", "tick", "ts", "wire", "value").repartitionByRange(files, "tick").sortWithinPartitions("tick").write.parquet(path)
    return streams.read_sample_stream(spark, path, files=files)


@query("s8_sample_stream", duck("select stream_id, wire, count(*) as n, sum(value)::bigint as high from samples group by stream_id, wire"))
def s8(spark, sf):
    got = streams.run_available(_sample_stream(spark, sf, 4).select("stream_id", "wire", "value"))
    return got.groupBy("stream_id", "wire").agg(F.count("*").alias("n"), F.sum("value").alias("high"))


def _arriving(spark, parts):
    """A stream that gets each of ``parts`` (rows with ts) as a micro-batch, and last a heartbeat of a stream of its own, a year
    later, which lets the watermark pass everything."""
    path = new_path(spark, "arriving")
    fields = parts[0].schema
    beat = {"stream_id": F.lit(-1), "ts": F.col("ts") + F.expr("interval 365 days")}
    last = parts[0].orderBy(F.desc("ts")).limit(1).select(*(beat.get(c, F.col(c) if c == "tick" else F.lit(0)).cast(fields[c].dataType).alias(c) for c in fields.names))
    for part in (*parts, last):  # files are taken in the order of their writing
        part.coalesce(1).write.mode("append").parquet(path)
    return streams.read_sample_stream(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields))


def _timed_samples(spark, sf):
    return view(spark, sf, "samples").select("stream_id", "tick", F.col("ts").cast("timestamp").alias("ts"), "wire", "value")


@query("t9_stream_edges", duck(_EDGES))
def t9(spark, sf):
    """Every third sample comes a micro-batch late, but within the delay."""
    samples = _timed_samples(spark, sf)
    parts = [samples.where("tick % 3 <> 0"), samples.where("tick % 3 = 0")]
    return streams.run_available(streams.stream_edges(_arriving(spark, parts), "60 days", 400 * 86_400_000))


@query(
    "t9_late_edges",
    duck("""with k as (select * from samples where tick % 20 <> 7 or ts > (select max(ts) from samples where tick % 20 <> 7) - interval 10 days),
      c as (select *, lag(value) over w as was, lag(ts) over w as before from k window w as (partition by stream_id, wire order by tick))
      select stream_id, wire, tick, case when value = 1 then 'rising' else 'falling' end as edge from c
      where value <> case when before >= ts - interval 2 hours then was else 0 end"""),
)
def t9_late(spark, sf):
    """Every twentieth sample comes a micro-batch late: those of the last ten days are taken into the order, the others are
    dropped. A wire without samples for two hours starts anew."""
    samples = _timed_samples(spark, sf)
    parts = [samples.where("tick % 20 <> 7"), samples.where("tick % 20 = 7")]
    return streams.run_available(streams.stream_edges(_arriving(spark, parts), "10 days", 2 * 3_600_000))


@query(
    "t10_stream_activity",
    duck("""select stream_id, wire, epoch(date_trunc('hour', ts))::bigint as start, count(*) as samples, sum(value)::bigint as high from samples
      where date_trunc('hour', ts) + interval 1 hour <= (select max(ts) from samples) - interval 10 minutes group by stream_id, wire, date_trunc('hour', ts)"""),
)
def t10(spark, sf):
    return streams.run_available(streams.stream_activity(_sample_stream(spark, sf)))


@query(
    "t10_stream_bursts",
    duck("""with d as (select *, lag(ts) over (partition by stream_id, wire order by ts) as prev from samples),
      s as (select *, sum(case when prev is null or ts - prev > interval 6 hours then 1 else 0 end) over (partition by stream_id, wire order by ts) as run from d),
      r as (select stream_id, wire, epoch_us(min(ts)) as start, count(*) as samples, max(ts) + interval 6 hours as ends from s group by stream_id, wire, run)
      select stream_id, wire, start, samples from r where ends <= (select max(ts) from samples) - interval 10 minutes"""),
)
def t10_bursts(spark, sf):
    return streams.run_available(streams.stream_bursts(_sample_stream(spark, sf), "6 hours"))


@query("t11_stream_serial", duck("select stream_id, 100 + k * 2500 as tick, byte from serial_bytes"))
def t11(spark, sf):
    """The levels in three micro-batches whose ticks are mixed, a tick being a second."""
    levels = view(spark, sf, "serial_levels").withColumn("ts", F.timestamp_seconds("tick")).select("stream_id", "tick", "ts", "tx")
    parts = [levels.where(f"tick % 3 = {k}") for k in (2, 0, 1)]
    return streams.run_available(streams.stream_serial(_arriving(spark, parts), "3 hours"))
