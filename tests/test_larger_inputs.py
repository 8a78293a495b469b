"""Operators that were mended for larger inputs: what they give, and that they don't do what made them slow."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from sparklayout.functions import dealing
from sparklayout.functions import layers as L
from sparklayout.operators import analytics, devices, hierarchy, shapes, spatial, trace
from sparklayout.plans import extract, extract_queries, netlist_queries
from sparklayout.sources import work
from sparklayout.sources.fixtures import view
from sparklayout.streaming import streams

from test_layouts import INVERTER, NAMES, labels_of, rects_of, rows


def test_parts_of_an_extraction_are_made_when_asked_for(spark, monkeypatch, tmp_path):
    """Warnings need neither devices nor flat rectangles; flat rectangles with nets are those of the joins by placement and segment."""
    made = []
    write = work.new_path
    monkeypatch.setattr(work, "new_path", lambda session, tag: made.append(tag) or write(session, tag))
    top = [(L.LI1, 80, 38, 245, 44), (L.LI1, 0, -10, 230, -5), (L.LI1, 0, 95, 230, 100), (3, 0, 0, 10, 10)]
    refs = spark.createDataFrame(
        [(0, "top", k, "inv", 0.0, 1.0, k == 1, 200.0 * k, 90.0 * (k == 1)) for k in range(3)],
        "file_id long, parent string, ref_idx long, child string, rotation double, mag double, x_reflection boolean, ox double, oy double",
    )
    cells = spark.createDataFrame([(0, "top", "my_top"), (0, "inv", "sky130_fd_sc_hd__inv_1")], "file_id long, cell string, name string")
    labels = labels_of(spark, {"inv": NAMES, "top": [("VGND", L.LI1, 100, -7), ("VPWR", L.LI1, 100, 97)]})
    out = extract.extract_layout(rects_of(spark, {"inv": INVERTER, "top": top}), labels, refs, cells)
    extract.store_layout(out, str(tmp_path), ["warnings"])
    assert not {"flat", "fets", "trees", "merged"} & set(made[made.index("instances") :]), made
    flat = hierarchy.flatten_rects(out.instances, out._cell_rects, out._fillers, ["file_id"])
    looked_up = hierarchy.lookup_nets(flat, out._firsts, out.nets, out._trees, ["file_id"])
    columns = sorted(out["flat"].columns)
    assert sorted(looked_up.columns) == columns and rows(out["flat"], *columns) == rows(looked_up, *columns)
    assert out["flat"].where("wire is null and net = -1").count() == 1
    wires = [*extract.KEYS, "inst_id", "wire", "net"]
    assert rows(out["wire_nets"], *wires) == rows(looked_up.where("net >= 0").select(*wires).distinct(), *wires)


def test_bus_samples_are_added_up_before_they_are_exchanged(spark, tmp_path):
    """A long write and a read over many runs, with gaps; rows that are exchanged are words of 64 ticks, not samples."""
    sent = {0: (2, bytes([2, 0x12, 0x34, 0x56, *range(200)])), 2: (11, bytes([11, 0, 0, 9, 1, 0x80]))}
    samples, tick = [], -5000
    for device, (command, data) in sent.items():
        select = [int(d != device) for d in range(3)]
        for k, byte in enumerate(data):
            for i in range(8):
                bit = byte >> (7 - i) & 1
                for clock in (0, 1):
                    samples.append((7, tick, *select, clock, bit if k < 4 or command == 2 else 0, bit if k >= 4 and command != 2 else 1))
                    tick += 1 if k % 3 else 90
        samples.append((7, tick, 1, 1, 1, 0, 0, 1))
        tick += 3
    bus = spark.createDataFrame(samples, "stream_id long, tick long, cs long, ram_a long, ram_b long, sclk long, mosi long, miso long").coalesce(1)
    text = " ".join(f"{b:02x}" for b in range(8))
    for n in (1, 5, 1 << 16):
        with_runs = trace.RUN_TICKS
        trace.RUN_TICKS = n
        try:
            found = rows(trace.spi_transactions(bus), "device", "op", "address", "n_bytes", "data")
        finally:
            trace.RUN_TICKS = with_runs
        assert found == [("flash", "write", 0x123456, 200, text), ("psram_b", "read", 9, 2, "01 80")], n
    words = trace._spi_words(bus.where("tick > 0"))
    assert words.count() == bus.where("tick > 0").select(F.expr("shiftright(tick, 6)")).distinct().count()


def test_a_channel_meets_wells_and_terminals_in_one_join(spark):
    """One channel each: in a well, beside it (its edge only touches), with one wire on both sides, and without any terminal."""
    cells = {
        "p": [(L.DIFF, 0, 0, 100, 20), (L.POLY, 40, -5, 50, 25), (L.NWELL, -5, -5, 105, 25)],
        "n": [(L.DIFF, 0, 0, 100, 20), (L.POLY, 40, -5, 50, 25), (L.NWELL, 50, -5, 105, 25)],
        "one": [(L.DIFF, 0, 0, 100, 20), (L.POLY, 40, -5, 50, 25)],
        "bare": [(L.DIFF, 0, 0, 100, 20), (L.POLY, 40, -5, 50, 25)],
    }
    rects = spatial.leveled(rects_of(spark, cells).selectExpr("cell", "layer", "row_number() over (partition by cell order by layer desc) as rect_id", "x1", "y1", "x2", "y2", "7L as wire"))
    sides = [("p", L.P_TERM, 3, 4), ("p", L.N_TERM, 5, 6), ("n", L.N_TERM, 9, 8), ("n", L.P_TERM, 1, 1), ("one", L.N_TERM, 2, 2)]
    terms = [(c, layer, w, x, 0, y, 20) for c, layer, *ws in sides for w, x, y in zip(ws, (0, 50), (40, 100), strict=True)]
    terminals = spatial.leveled(spark.createDataFrame(terms, "cell string, layer long, wire long, x1 long, y1 long, x2 long, y2 long"))
    found = devices.channel_devices(rects, terminals, ["cell"])
    got = [tuple(r) for r in found.select("cell", "gate", "type", "n_terms", "term0", "term1").orderBy("cell").collect()]
    assert got == [("bare", 7, 1, 0, None, None), ("n", 7, 1, 2, 8, 9), ("one", 7, 1, 1, 2, 2), ("p", 7, 0, 2, 3, 4)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len([x for x in plan.splitlines() if "Join" in x]) == 1, plan


def test_held_rows_are_entries_of_many():
    """State is kept by columns, a few thousand rows in an entry, in their order."""
    held = np.arange(3 * 10_000).reshape(3, 10_000)
    entries = streams._Held._entries(held)
    assert len(entries) == 3 and max(len(e[0]) for e in entries) == streams.HELD_ROWS
    assert (np.concatenate([np.array(e) for e in entries], axis=1) == held).all()


def test_joins_are_dealt_by_counted_rows_but_for_crowded_keys(spark, monkeypatch):
    """As many tasks as the rows need, each with few of them; a key with most of the rows goes by a plain exchange. Null keys meet nothing."""
    left = spark.range(6000).selectExpr("if(id % 3 = 0, 7, if(id % 50 = 1, null, id)) as k", "id as a")
    right = spark.range(900).selectExpr("id % 300 + 5 as k", "id as b")
    keys = right.select("k")
    plain = [rows(dealing.join(left, right, ["k"], n=6900), "a", "b"), rows(dealing.join(left, keys, ["k"], "left_semi"), "a")]
    monkeypatch.setattr(dealing, "FEW_ROWS", 1000)
    monkeypatch.setattr(dealing, "ROWS_PER_TASK", 100)
    pairs, some = dealing.join(left, right, ["k"], n=6900), dealing.join(left, keys, ["k"], "left_semi")
    assert [rows(pairs, "a", "b"), rows(some, "a")] == plain
    for found in (pairs, some):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(k" in plan and ", 70), REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" in plan and "Union" in plan and "LeftSemi" not in plan
        assert max(r["count"] for r in found.where("k <> 7").groupBy(F.spark_partition_id()).count().collect()) <= 100
    even = dealing.join(left.where("a % 3 > 0"), right, ["k"])
    assert "Union" not in even._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(dealing, "ROWS_PER_TASK", 5)  # more parts than that are not written without holding rows
    assert ", 200), REPARTITION_BY_NUM" in dealing.join(left, right, ["k"])._jdf.queryExecution().executedPlan().toString()


def test_terminals_of_many_devices_are_gathered_in_one_dealt_grouping(spark, monkeypatch):
    """With and without wells, without gates in the cell, with gates elsewhere in it; tasks follow the rows, results don't."""
    monkeypatch.setattr(dealing, "FEW_ROWS", 100)
    monkeypatch.setattr(dealing, "ROWS_PER_TASK", 50)
    monkeypatch.setattr(spatial, "BROADCAST_ROWS", 10)
    cells = {f"c{k}": [(L.DIFF, 0, 0, 100, 20), (L.POLY, 40, -5, 50, 25), (L.POLY, 40, -5, 50, 25), (L.DIFF, 0, 50, 100, 60), (L.NWELL, *((-5, -5, 105, 25), (100, 0, 200, 20))[k % 2])] for k in range(100)}
    cells |= {"bare": [(L.DIFF, 0, 0, 9, 9), (L.NWELL, 0, 0, 9, 9)]}
    numbered = rects_of(spark, cells).selectExpr("cell", "layer", "row_number() over (partition by cell order by layer, y1) as rect_id", "x1", "y1", "x2", "y2", "7L as wire")
    found = devices.derive_terminals(spatial.leveled(numbered), ["cell"])
    assert found.rdd.getNumPartitions() >= 10
    kind = lambda k: L.N_TERM if k % 2 else L.P_TERM
    want = [(f"c{k}", layer, x1, y1, x2, y2) for k in range(100) for layer, x1, y1, x2, y2 in ((kind(k), 0, 0, 40, 20), (kind(k), 50, 0, 100, 20), (L.N_TERM, 0, 50, 100, 60))]
    assert rows(found, "cell", "layer", "x1", "y1", "x2", "y2") == sorted(want)


def test_summaries_of_files_are_added_up_in_dealt_tasks(spark, monkeypatch):
    """Instances over several layers and files, null ids, layers and nets; with and without an instance that has most of the rows."""
    def data(n_top):
        each = [(k % 3 if k % 97 else None, k % 5 if k % 31 else None, k // 7 if k % 11 else None, k % 400 - 1 if k % 13 else None) for k in range(3000)]
        return each + [(1, k % 4, 5, k) for k in range(n_top)] + [(8, 2, None, None), (9, 3, 1, -1), (9, 4, 1, -1)]

    def want(made):
        out = []
        for f in {r[0] for r in made} - {None}:
            for layer in [("all",), *((x,) for x in {r[1] for r in made if r[0] == f})]:
                own = [r for r in made if r[0] == f and (layer == ("all",) or r[1] == layer[0])]
                wires = max([2, *(r[3] + 1 for r in own if r[3] is not None)])
                out.append((f, None if layer == ("all",) else layer[0], len(own), len({r[2] for r in own} - {None}), wires))
        return sorted(out, key=str)

    kept, spread = dealing.grouped, []
    for n_top, few in ((0, 1_000_000), (0, 1000), (4000, 1000)):
        monkeypatch.setattr(dealing, "FEW_ROWS", few)
        monkeypatch.setattr(dealing, "ROWS_PER_TASK", 300)
        monkeypatch.setattr(dealing, "grouped", lambda rows, by, n: spread.append(by) or kept(rows, by, n))
        made = data(n_top)
        found = analytics.netlist_summary(spark.createDataFrame(made, "file_id long, layer long, inst_id long, net long"))
        assert sorted((tuple(r) for r in found.select("file_id", "layer", "rects", "instances", "wires").collect()), key=str) == want(made)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert ("REPARTITION_BY_NUM" in plan) == (few == 1000) and plan.count("Expand") == 1
        assert bool(spread) == (n_top > 0)


def test_keys_with_few_rectangles_meet_no_join(spark, monkeypatch):
    """Nets have a few rectangles on a layer each; all of them were exchanged three times and met in one spatial join."""
    rng = random.Random(3)
    boxes = set()
    for key, n in ((0, 400), *((k, 6) for k in range(1, 80))):
        for _ in range(n):
            x, y = rng.randrange(0, 60, 5), rng.randrange(0, 60, 5)
            boxes.add((key, x, y, x + rng.choice((5, 10, 30)), y + rng.choice((5, 10, 30))))
    df = spark.createDataFrame(sorted(boxes), "net long, x1 long, y1 long, x2 long, y2 long")
    joined, join = [], shapes.spatial_join
    monkeypatch.setattr(shapes, "spatial_join", lambda a, b, *rest: joined.append(a.where("net > 0").count()) or join(a, b, *rest))
    found = {}
    for most, few in ((20_000, 32), (50, 32), (20_000, 1), (1, 1)):  # by lists, crowded by lines, all in a join
        monkeypatch.setattr(shapes, "KEY_RECTS", most)
        monkeypatch.setattr(shapes, "FEW_RECTS", few)
        found[most, few] = sorted(map(tuple, shapes.coalesce_rects(df, ["net"]).select("net", "x1", "y1", "x2", "y2").collect()))
    assert len({tuple(x) for x in found.values()}) == 1 and joined[:2] == [0, 0] and joined[2] > 50
    left = found[20_000, 32]
    assert not any(a != b and a[0] == b[0] and a[1] <= b[1] and a[2] <= b[2] and a[3] >= b[3] and a[4] >= b[4] for a in left for b in left)
    cells = lambda rows: {(k, x, y) for k, x1, y1, x2, y2 in rows for x in range(x1, x2, 5) for y in range(y1, y2, 5)}
    assert cells(left) == cells(boxes)


def test_places_are_numbered_by_many_tasks(spark):
    """The view's window has all rows of a file in one task."""
    folder = "/root/testdata/sf0.001"
    columns = ["file_id", "k", "r", "c", "odd"]
    places = extract_queries._places(spark, folder).select(*columns)
    assert sorted(places.collect()) == sorted(view(spark, folder, "chip_places").select(*columns).collect())
    assert "Window" not in places._jdf.queryExecution().executedPlan().toString()


def test_cell_wires_exchange_each_side_once(spark, monkeypatch):
    """A literal among the keys left the join but not the dealing, so all rows were exchanged twice."""
    plans, join = [], dealing.join

    def seen(left, right, on, how="inner", n=None):
        found = join(left, right, on, how)
        if "text_a" not in left.columns:  # label points come from exchanges of their own
            plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(dealing, "join", seen)
    monkeypatch.setattr(dealing, "FEW_ROWS", 100)
    monkeypatch.setattr(spatial, "BROADCAST_ROWS", 10)
    assert netlist_queries.c2(spark, "/root/testdata/sf0.001").count() > 1000
    assert [(p.count("REPARTITION_BY_NUM"), p.count("ENSURE_REQUIREMENTS")) for p in plans] == [(2, 0), (2, 0)]
