"""Hand-made layouts with exact results, and properties of the geometry and graph operators."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sparklayout.functions import geometry as g
from sparklayout.functions import layers as L
from sparklayout.functions import names
from sparklayout.functions.geometry import Affine, Box
from sparklayout.functions.ranking import global_rank
from sparklayout.operators import analytics, graph, hierarchy, netlist, shapes, spatial, trace
from sparklayout.plans import extract, netlist_queries
from sparklayout.sources import tables as tables_of
from sparklayout.streaming import streams

RECT = "file_id long, cell string, layer long, x1 long, y1 long, x2 long, y2 long"
LABEL = "file_id long, cell string, text string, layer long, x long, y long"
INVERTER = [
    (L.NWELL, -5, 50, 105, 95), (L.DIFF, 0, 0, 100, 20), (L.DIFF, 0, 60, 100, 80), (L.POLY, 45, -5, 55, 85),
    (L.LICON, 10, 5, 20, 15), (L.LICON, 70, 5, 80, 15), (L.LICON, 10, 65, 20, 75), (L.LICON, 70, 65, 80, 75),
    (L.LICON, 47, 38, 53, 44), (L.LI1, 0, -10, 30, 16), (L.LI1, 0, 64, 30, 100), (L.LI1, 65, 4, 85, 76), (L.LI1, 40, 36, 60, 46),
]
NAMES = [("VGND", L.LI1, 5, 0), ("VPWR", L.LI1, 5, 90), ("A", L.LI1, 50, 40), ("Y", L.LI1, 75, 40)]


def rects_of(spark, cells):
    return spark.createDataFrame([(0, c, *r) for c, rs in cells.items() for r in rs], RECT)


def labels_of(spark, cells):
    return spark.createDataFrame([(0, c, *x) for c, ls in cells.items() for x in ls], LABEL)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_inverter_cell(spark):
    out = extract.extract_cells(rects_of(spark, {"inv": INVERTER}), labels_of(spark, {"inv": NAMES}))
    assert rows(out["labels"], "text", "wire") == [("A", 2), ("VGND", 0), ("VPWR", 1), ("Y", 3)]
    assert rows(out["fets"], "gate", "term0", "term1", "type") == [(2, 0, 3, 1), (2, 1, 3, 0)]
    assert out["rejects"].count() == 0
    assert out["rects"].where("layer in (1, 2) and wire is not null").count() == 0


def test_same_name_joins_wires_and_bad_channels_are_rejected(spark):
    cells = {"named": [(L.LI1, 0, 0, 10, 10), (L.LI1, 50, 50, 60, 60)], "bad": [(L.DIFF, 0, 0, 100, 20), (L.POLY, 0, -5, 10, 25)]}
    labels = {"named": [("net1", L.LI1, 5, 5), ("net1", L.LI1, 55, 55)], "bad": [("VGND", L.POLY, 5, 0)]}
    out = extract.extract_cells(rects_of(spark, cells), labels_of(spark, labels))
    assert {r["wire"] for r in out["rects"].where("cell = 'named'").collect()} == {2}
    assert rows(out["rejects"], "cell", "decap", "malformed") == [("bad", 1, 0)]


def test_two_inverters_make_one_tree(spark):
    top = [(L.LI1, 80, 38, 245, 44), (L.LI1, 0, -10, 230, -5), (L.LI1, 0, 95, 230, 100)]
    names = {"inv": NAMES, "top": [("VGND", L.LI1, 100, -7), ("VPWR", L.LI1, 100, 97)]}
    refs = spark.createDataFrame(
        [(0, "top", 0, "inv", 0.0, 1.0, False, 0.0, 0.0), (0, "top", 1, "inv", 0.0, 1.0, False, 200.0, 0.0), (0, "top", 2, "inv", 0.3, 1.0, False, 0.0, 0.0)],
        "file_id long, parent string, ref_idx long, child string, rotation double, mag double, x_reflection boolean, ox double, oy double",
    )
    cells = spark.createDataFrame([(0, "top", "my_top"), (0, "inv", "sky130_fd_sc_hd__inv_1")], "file_id long, cell string, name string")
    out = extract.extract_layout(rects_of(spark, {"inv": INVERTER, "top": top}), labels_of(spark, names), refs, cells)
    assert out["instances"].count() == 3
    fets = out["fets"]
    assert fets.count() == 4 and rows(fets, "term0") == [(0,), (0,), (1,), (1,)]
    pairs = rows(netlist.inverter_pairs(fets), "gate", "out")
    (root,) = {a for a, _ in pairs} - {b for _, b in pairs}
    assert len(pairs) == 2 and len({x for p in pairs for x in p}) == 3
    trees = {r["net"]: r["tree"] for r in out["flat"].select("net", "tree").distinct().collect()}
    assert {trees[n] for n in {x for p in pairs for x in p}} == {root}
    outlines = rows(out["export"].where(F.col("layer") == L.CELLS), "x1", "y1", "x2", "y2", "tree")
    assert outlines == [(-5, -10, 105, 100, root), (195, -10, 305, 100, root)]
    assert (0, -10, 230, -5) in rows(out["export"].where(f"net = 0 and layer = {L.LI1}"), "x1", "y1", "x2", "y2")


def test_many_files_in_one_run_are_as_each_alone(spark):
    """Two layouts with the same cell names: polygons, a path, an array placement, labels in one set of tables."""
    tags = {L.NWELL: (64, 20), L.DIFF: (65, 20), L.POLY: (66, 20), L.LICON: (66, 44), L.LI1: (67, 20)}
    corners = lambda r: [(float(r[i]), float(r[j])) for i, j in ((0, 1), (2, 1), (2, 3), (0, 3))]
    tables = {k: [] for k in tables_of.SCHEMAS}
    for f, copies in ((3, 2), (8, 3)):
        boxes = [("inv", r) for r in INVERTER] + [("top", (L.LI1, 0, -10, 200 * copies, -5)), ("top", (L.LI1, 0, 95, 200 * copies, 100))]
        for k, (cell, (layer, *box)) in enumerate(boxes):
            tables["polygons"].append((f, cell, k, *tags[layer], corners(box), None, None, None, None))
        tables["paths"].append((f, "top", 1, *tags[L.LI1], 6.0, [(80.0, 41.0), (245.0, 41.0)], None, None, None, None))
        tables["references"].append((f, "top", 0, "inv", 0.0, 1.0, False, 0.0, 0.0, copies, 1, 200.0, 0.0))
        for text, layer, x, y in NAMES:
            tables["labels"].append((f, "inv", text, *tags[layer], float(x), float(y), None, None, None, None))
        for text, y in (("VGND", -7.0), ("VPWR", 97.0)):
            tables["labels"].append((f, "top", text, *tags[L.LI1], 100.0, y, None, None, None, None))
    frames = {k: spark.createDataFrame(v, tables_of.SCHEMAS[k]) for k, v in tables.items()}
    both = extract.extract_layout(**extract.prepare(frames), top="no such cell")
    for f, copies in ((3, 2),):  # one of the two suffices: each run is some hundred small jobs
        alone = extract.extract_layout(**extract.prepare({k: d.where(F.col("file_id") == f) for k, d in frames.items()}), top="top")
        for name in ("instances", "nets", "fets", "flat", "export"):
            columns = sorted(alone[name].columns)
            assert rows(both[name].where(F.col("file_id") == f), *columns) == rows(alone[name], *columns), name
        assert alone["instances"].count() == copies + 1 and alone["fets"].count() == 2 * copies
        pairs = rows(netlist.inverter_pairs(alone["fets"]), "gate", "out")
        assert len(pairs) == copies and len({x for p in pairs for x in p}) == 2 * copies - 1  # the path joins the first two


def test_ring_of_inverters_takes_least_net(spark):
    ring = [(a, rail, b, rail == 0) for a, b in ((5, 6), (6, 7), (7, 5)) for rail in (0, 1)]
    fets = spark.createDataFrame([(a, r, b, int(t)) for a, r, b, t in ring], "gate long, term0 long, term1 long, type long")
    nets = spark.createDataFrame([(n,) for n in (4, 5, 6, 7)], "net long")
    assert rows(netlist.inverter_trees(nets, fets), "net", "tree") == [(4, 4), (5, 5), (6, 5), (7, 5)]


def test_fracture_keeps_area(spark):
    polys = {
        1: ([(0, 0), (3, 0), (0, 3)], 0),  # a triangle has three points: nothing
        2: ([(0, 0), (10, 0), (10, 5), (0, 5)], 50),
        3: ([(0, 0), (6, 0), (6, 2), (3, 2), (3, 4), (0, 4)], 18),
        4: ([(0, 0), (9, 0), (9, 6), (6, 6), (6, 2), (3, 2), (3, 6), (0, 6)], 42),
        5: ([(0, 0), (10, 0), (10, 9), (8, 9), (8, 1), (6, 1), (6, 9), (4, 9), (4, 1), (2, 1), (2, 9), (0, 9)], 58),
    }
    pts = spark.createDataFrame([(k, i, float(x), float(y)) for k, (p, _) in polys.items() for i, (x, y) in enumerate(p)], "poly_id long, pt_idx long, x double, y double")
    got = {r["poly_id"]: r["a"] for r in shapes.fracture(pts).groupBy("poly_id").agg(F.sum(g.area(Box.of())).alias("a")).collect()}
    assert got == {k: a for k, (_, a) in polys.items() if a}


def _random_rects(seed, n, span=200, big=40):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y = rng.randrange(-span, span), rng.randrange(-span, span)
        w, h = (rng.randrange(1, 12), rng.randrange(1, 12)) if rng.random() < 0.9 else (rng.randrange(1, big * 20), rng.randrange(1, 4))
        out.append((i, x, y, x + w, y + h))
    return out


@pytest.mark.parametrize("kind", ["touches", "overlaps", "contains"])
def test_binned_join_is_the_filtered_product(spark, kind):
    a, b = _random_rects(1, 120), _random_rects(2, 120)
    schema = "rect_id long, x1 long, y1 long, x2 long, y2 long"
    test = {
        "touches": lambda p, q: p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4],
        "overlaps": lambda p, q: p[1] < q[3] and q[1] < p[3] and p[2] < q[4] and q[2] < p[4],
        "contains": lambda p, q: p[1] <= q[1] and p[2] <= q[2] and p[3] >= q[3] and p[4] >= q[4],
    }[kind]
    got = rows(spatial.spatial_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), kind), "rect_id_a", "rect_id_b")
    assert got == sorted((p[0], q[0]) for p in a for q in b if test(p, q))


def test_coalesce_keeps_cover_and_is_idempotent(spark):
    rng = random.Random(5)
    raw = [(x, y, x + rng.randrange(1, 4), y + rng.randrange(1, 4)) for x, y in ((rng.randrange(20), rng.randrange(20)) for _ in range(80))]
    cover = lambda rs: {(x, y) for a, b, c, d in rs for x in range(a, c) for y in range(b, d)}
    df = spark.createDataFrame([(1, *r) for r in raw], "layer long, x1 long, y1 long, x2 long, y2 long")
    once = shapes.coalesce_rects(df, ["layer"])
    first = rows(once, "x1", "y1", "x2", "y2")
    assert cover(first) == cover(raw) and len(first) <= len(set(raw))
    step = first
    for _ in range(5):  # each pass keeps the cover and never adds rectangles; after some passes nothing changes
        df = spark.createDataFrame([(1, *r) for r in step], df.schema)
        after = rows(shapes.coalesce_rects(df, ["layer"]), "x1", "y1", "x2", "y2")
        assert cover(after) == cover(raw) and len(after) <= len(step)
        if after == step:
            break
        step = after
    assert after == step


@pytest.mark.parametrize("seed,n,m", [(1, 60, 30), (2, 60, 55), (3, 5, 0)])
def test_components_equal_union_find(spark, seed, n, m):
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + ([(i, i + 1) for i in range(20)] if m else [])
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    vertices = spark.createDataFrame([(i,) for i in range(n)], "vertex long")
    got = rows(graph.connected_components(vertices, spark.createDataFrame(edges, "src long, dst long")), "vertex", "component")
    assert got == [(i, find(i)) for i in range(n)]


def test_compose_is_transform_after_transform(spark):
    rng = random.Random(3)
    turns = [(1, 0, 0, 1), (0, -1, 1, 0), (-1, 0, 0, -1), (0, 1, -1, 0), (1, 0, 0, -1), (0, 1, 1, 0), (-2, 0, 0, 2), (0, 3, -3, 0)]

    def matrix():
        a, b, c, d = rng.choice(turns)
        return a, b, rng.randrange(-9, 10), c, d, rng.randrange(-9, 10)

    data = [(*matrix(), *matrix(), 1, 2, 5, 9) for _ in range(60)]
    names = [f"{c}{s}" for s in ("_p", "_c") for c in ("m00", "m01", "tx", "m10", "m11", "ty")] + ["x1", "y1", "x2", "y2"]
    df = spark.createDataFrame(data, ", ".join(f"{c} long" for c in names))
    whole = g.transform(Box.of(), g.compose(Affine.of("_p"), Affine.of("_c")))
    twice = g.transform(g.transform(Box.of(), Affine.of("_c")), Affine.of("_p"))
    one, two = rows(df, *whole.named()), rows(df, *twice.named())
    assert one == two and len(set(one)) > 10


def _unit_refs(spark, found, schema="parent string, ref_idx long, child string"):
    unit = {"m00": 1, "m01": 0, "tx": 0, "m10": 0, "m11": 1, "ty": 0}
    return spark.createDataFrame(found, schema).withColumns({k: F.lit(v).cast("long") for k, v in unit.items()})


def test_walk_numbers_in_preorder(spark):
    refs = _unit_refs(spark, [("t", 0, "a"), ("t", 1, "b"), ("a", 0, "b"), ("a", 1, "b"), ("small", 0, "b")])
    sizes = hierarchy.subtree_sizes(refs)
    assert rows(sizes, "cell", "size", "height") == [("a", 3, 1), ("b", 1, 0), ("small", 2, 1), ("t", 5, 2)]
    top = hierarchy.top_cells(refs, sizes)
    assert rows(top, "cell") == [("t",)] and rows(hierarchy.unused_roots(refs, sizes, top), "cell", "size") == [("small", 2)]
    placed = hierarchy.place_instances(refs, top, sizes)
    assert [r[1] for r in rows(placed, "inst_id", "cell")] == ["t", "a", "b", "b", "b"]


def test_cells_in_a_circle_are_an_error(spark):
    refs = _unit_refs(spark, [("t", 0, "a"), ("a", 0, "b"), ("b", 0, "c"), ("c", 0, "a"), ("c", 1, "leaf")])
    with pytest.raises(ValueError, match="circle.* a, b, c"):
        hierarchy.subtree_sizes(refs)


def test_walk_of_many_siblings_equals_plain_recursion(spark):
    rng = random.Random(8)
    cells = [f"c{i}" for i in range(30)]
    found = [(f, cells[i], k, cells[rng.randrange(i + 1, 30)]) for f in (1, 2) for i in range(24) for k in range(rng.randrange(f, 4))]
    refs = _unit_refs(spark, found, "file_id long, parent string, ref_idx long, child string").withColumn("tx", F.col("ref_idx"))
    sizes = hierarchy.subtree_sizes(refs, keys=["file_id"])
    top = hierarchy.top_cells(refs, sizes, keys=["file_id"])
    want = []
    for f in (1, 2):
        below = {}
        for g_, p, k, c in found:
            if g_ == f:
                below.setdefault(p, []).append((k, c))

        def walk(cell, x, out):
            out.append((cell, x))
            for k, c in sorted(below.get(cell, [])):
                walk(c, x + k, out)
            return out

        roots = sorted(set(below) - {c for v in below.values() for _, c in v}, key=lambda r: (-len(walk(r, 0, [])), r))
        assert (f, roots[0]) in rows(top, "file_id", "cell")
        want += [(f, i, c, x) for i, (c, x) in enumerate(walk(roots[0], 0, []))]
    got = rows(hierarchy.place_instances(refs, top, sizes, ["file_id"]), "file_id", "inst_id", "cell", "tx")
    assert got == sorted(want)


def test_relative_placements_are_compared_once(spark):
    """A row of 60 equal cells under a top with a strap, in turned and mirrored copies of the row: the dictionary grows with how
    cells lie to each other, the edges are those of all flat rectangles."""
    turns = [(1, 0, 0, 1), (0, -1, 1, 0), (-1, 0, 0, -1), (1, 0, 0, -1), (2, 0, 0, 2)]
    instances, n = [(0, "top", 1, 0, 0, 0, 1, 0)], 1
    for t, (a, b, c, d) in enumerate(turns):
        for k in range(60):
            instances.append((n, "leaf", a, b, a * 10 * k + 5000 * t, c, d, c * 10 * k))
            n += 1
    rects = [("leaf", 8, 0, 0, 0, 10, 4), ("leaf", 8, 1, 2, 5, 12, 8), ("leaf", 10, 2, 0, 0, 3, 3), ("leaf", 2, 0, 0, 0, 90, 90), ("top", 10, 0, 0, 0, 25000, 2), ("top", 8, 1, 33, 3, 47, 6), ("top", 8, None, 0, 0, 99, 99), ("gap", 8, 0, 0, 0, 5, 5)]
    instances.append((n, "gap", 1, 0, 0, 0, 1, 0))
    inst = spark.createDataFrame(instances, "inst_id long, cell string, m00 long, m01 long, tx long, m10 long, m11 long, ty long")
    cell_rects = spark.createDataFrame([(c, i, l, w, *b) for i, (c, l, w, *b) in enumerate(rects)], "cell string, rect_id long, layer long, wire long, x1 long, y1 long, x2 long, y2 long")
    fillers = spark.createDataFrame([("gap",)], "cell string")
    got = rows(hierarchy.cross_instance_edges(inst, cell_rects, fillers), "a_inst", "a_wire", "b_inst", "b_wire")
    flat = []
    for i, cell, a, b, tx, c, d, ty in instances:
        for name, layer, w, x1, y1, x2, y2 in rects:
            if name == cell != "gap" and layer >= 4 and w is not None:
                xs, ys = zip(*((a * x + b * y + tx, c * x + d * y + ty) for x, y in ((x1, y1), (x2, y2))))
                flat.append((i, w, layer, min(xs), min(ys), max(xs), max(ys)))
    touch = lambda r, s: r[2] == s[2] and r[3] <= s[5] and s[3] <= r[5] and r[4] <= s[6] and s[4] <= r[6]
    want = sorted({(r[0], r[1], s[0], s[1]) for r in flat for s in flat if r[0] < s[0] and touch(r, s)})
    assert got == want and len(got) > 500
    of_leaves = rows(hierarchy.relative_placements(hierarchy.instance_pairs(hierarchy.instance_boxes(inst.where("cell = 'leaf'"), cell_rects)), inst).select("rel").distinct(), "rel")
    assert len(of_leaves) == 2


def test_global_rank_counts_from_zero(spark):
    df = spark.range(500).withColumn("k", F.xxhash64("id"))
    ranks = rows(global_rank(df, ["k"]), "rank", "k")
    assert [r[0] for r in ranks] == list(range(500)) and [r[1] for r in ranks] == sorted(r[1] for r in ranks)


def test_serial_round_trip_and_framing_error(spark):
    levels, t = [], 50
    for byte in b"Hi\x00\xff":
        bits = [0, *((byte >> k) & 1 for k in range(8)), 1]
        levels += [(1, t + trace.BIT * k, b) for k, b in enumerate(bits)]
        t += trace.BIT * 12
    levels += [(1, t, 0), (1, t + 20, 1)]  # a spike is no start bit
    got = rows(trace.serial_decode(spark.createDataFrame(levels, "stream_id long, tick long, tx long")), "tick", "byte")
    assert bytes(b for _, b in got) == b"Hi\x00\xff"


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "rect_id long, layer long, x1 long, y1 long, x2 long, y2 long")
    assert spatial.touch_self_join(none, ["layer"]).count() == 0
    assert shapes.coalesce_rects(none, ["layer"]).count() == 0
    nothing = spark.createDataFrame([], "src long, dst long")
    assert graph.connected_components(spark.createDataFrame([(1,)], "vertex long"), nothing).count() == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_cell_wires_equal_brute_force_reachability(spark, monkeypatch, seed):
    rng = random.Random(seed)
    boxes = []
    for i in range(150):
        x, y, layer = rng.randrange(0, 400), rng.randrange(0, 400), rng.choice([L.POLY, L.LICON, L.LI1, L.DIFF, L.MET5, L.NWELL])
        boxes.append((i, layer, x, y, x + rng.randrange(1, 30), y + rng.randrange(1, 30)))
    points = [(k, b[1], b[2], b[3], f"L{k % 4}") for k, b in enumerate(rng.sample(boxes, 12))] + [(12, L.LI1, 5000, 0, "L0")]
    tables = {
        "rects": spark.createDataFrame(boxes, "rect_id long, layer long, x1 long, y1 long, x2 long, y2 long"),
        "label_points": spark.createDataFrame(points, "label_id long, layer long, x long, y long, text string"),
    }
    monkeypatch.setattr(netlist_queries, "view", lambda spark, sf, name: tables[name])
    got = {r["rect_id"]: r["component"] for r in netlist_queries.c2(spark, "").collect()}

    conducts = {*spatial.LAYER_PAIRS, *((b, a) for a, b in spatial.LAYER_PAIRS)}
    touch = lambda a, b: a[2] <= b[4] and b[2] <= a[4] and a[3] <= b[5] and b[3] <= a[5]
    named = {i: {t for _, layer, x, y, t in points if layer == m and x1 <= x <= x2 and y1 <= y <= y2} for i, m, x1, y1, x2, y2 in boxes}

    def linked(a, b):
        return (touch(a, b) and (a[1] == b[1] or (a[1], b[1]) in conducts)) or bool(named[a[0]] & named[b[0]])

    want = {}
    for start in boxes:
        if start[0] not in want:
            todo = [start]
            want[start[0]] = start[0]
            while todo:
                a = todo.pop()
                for b in boxes:
                    if b[0] not in want and linked(a, b):
                        want[b[0]] = start[0]
                        todo.append(b)
    assert got == want and 1 < len(set(want.values())) < len(boxes)


def test_rounds_of_components_go_on_with_what_is_open_only(spark, monkeypatch):
    """A chain in the order of its numbers, a hub and many pairs: all rounds together have a few times the edges."""
    counts = []
    kept = graph.counted
    monkeypatch.setattr(graph, "counted", lambda df, tag: counts.append(kept(df, tag)) or counts[-1])
    chain, hub = [(i, i + 1) for i in range(1500)], [(2000, i) for i in range(2001, 3000)]
    pairs = [(2**40 + 2 * i, 2**40 + 2 * i + 1) for i in range(2000)] + [(-5, 7000), (-5, -5)]
    edges = spark.createDataFrame(chain + hub + pairs, "src long, dst long")
    vertices = spark.createDataFrame([(i,) for i in (*range(0, 3000, 7), 5000, 7000, *(b for _, b in pairs))], "vertex long")
    got = dict(map(tuple, graph.connected_components(vertices, edges).collect()))
    least = lambda v: v - v % 2 if v >= 2**40 else -5 if v == 7000 else 0 if 0 <= v <= 1500 else 2000 if 2000 <= v < 3000 else v
    assert got == {v: least(v) for (v,) in vertices.collect()}
    n = [n for _, n in counts]
    assert n[0] == 1500 + 999 + 2001 and n[-1] == 0 and sum(n) <= 3 * n[0] and len(n) <= 20


def _grid_with_straps(spark, n, straps):
    """n small squares in a square grid, and as many straps as asked for along each axis over all of it."""
    side = int(n**0.5)
    small = spark.range(n).selectExpr("id as rect_id", f"cast(id % {side} as bigint) * 40 as x1", f"id div {side} * 40 as y1")
    small = small.selectExpr("0 as layer", "rect_id", "x1", "y1", "x1 + 20 as x2", "y1 + 20 as y2")
    gap = max(1, side // max(1, straps)) * 40
    flat = spark.range(straps).selectExpr("0 as layer", f"{n} + id as rect_id", "0L as x1", f"id * {gap} + 8 as y1", f"{side * 40}L as x2", f"id * {gap} + 12 as y2")
    high = spark.range(straps).selectExpr("0 as layer", f"{n + straps} + id as rect_id", f"id * {gap} + 8 as x1", "0L as y1", f"id * {gap} + 12 as x2", f"{side * 40}L as y2")
    return small.unionByName(flat).unionByName(high)


def test_straps_keep_the_spatial_join_linear(spark):
    """The rows that share a cell grow with the rectangles and with what touches, not with their square."""
    made = {}
    for n in (2500, 10000):
        rects = _grid_with_straps(spark, n, 5)
        made[n] = spatial.candidates(rects, rects, ["layer"]).count()
    assert made[10000] <= 5 * made[2500]
    plain = _grid_with_straps(spark, 10000, 0)
    alone = spatial.candidates(plain, plain, ["layer"]).count()
    assert made[10000] <= 2 * alone + 4 * 10000 * 10
    rects = _grid_with_straps(spark, 400, 4)
    got = {(r["a"], r["b"]) for r in spatial.touch_self_join(rects, ["layer"]).collect()}
    each = [tuple(r) for r in rects.select("rect_id", "x1", "y1", "x2", "y2").collect()]
    assert got == {(a[0], b[0]) for a in each for b in each if a[0] < b[0] and a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]}


def test_spatial_joins_are_broadcast_by_rows_only(spark):
    """Regular rectangles take few bytes in a file, however many they are: their guessed size doesn't send them to the driver."""
    many = spatial.leveled(_grid_with_straps(spark, 22500, 2))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    cut = shapes.subtract_all(spatial.like(many.where("rect_id % 2 = 0"), many), spatial.like(many.where("rect_id % 2 = 1"), many), ["layer"])
    for df in (cut, spatial.touch_self_join(many, ["layer"]), spatial.spatial_join(many, many, "contains", ["layer"])):
        assert "Broadcast" not in plan(df) and "SortMergeJoin" in plan(df)
    boxes = spark.createDataFrame([(0, 0, 0, 100, 100)], "box_id long, x1 long, y1 long, x2 long, y2 long")
    assert "BroadcastHashJoin" in plan(spatial.window_query(many, boxes))
    assert spatial.window_query(many, boxes).count() == sum(x <= 100 and y <= 100 for x in range(0, 6000, 40) for y in range(0, 6000, 40)) + 2


def test_self_join_and_contains_of_all_sizes_equal_brute_force(spark):
    """Each unordered pair once, whatever the two sizes; fewer rows are placed than for pairs in either order."""
    rng = random.Random(12)
    size = lambda: rng.choice([0, 1, 5, 16, 17, 100, 255, 256, 300, 5000, 70000])
    each = [(i, i % 2, x := rng.randrange(-40000, 40000), y := rng.randrange(-300, 300), x + size(), y + size()) for i in range(200)]
    rects = spark.createDataFrame(each, "rect_id long, layer int, x1 long, y1 long, x2 long, y2 long")
    meets = lambda p, q: p[2] <= q[4] and q[2] <= p[4] and p[3] <= q[5] and q[3] <= p[5]
    got = [tuple(r) for r in spatial.spatial_self_join(rects, ["layer"]).collect()]
    want = [(p[1], p[0], *p[2:], q[0], *q[2:]) for p in each for q in each if p[0] < q[0] and p[1] == q[1] and meets(p, q)]
    assert sorted(got) == sorted(want) and got
    small = _grid_with_straps(spark, 2500, 0)
    placed = spatial.candidates(small, small, ["layer"], spatial._ONE_ORDER)
    assert placed.count() <= spatial.candidates(small, small, ["layer"]).count()


@pytest.mark.parametrize("predicate", ["touches", "overlaps", "contains"])
def test_spatial_join_of_all_sizes_equals_brute_force(spark, predicate):
    rng = random.Random(11)
    size = lambda: rng.choice([0, 1, 5, 16, 17, 100, 255, 256, 300, 5000, 70000])
    make = lambda n: [(i, i % 2, x := rng.randrange(-40000, 40000), y := rng.randrange(-300, 300), x + size(), y + size()) for i in range(n)]
    left, right = make(150), make(120)
    schema = "id long, file_id int, x1 long, y1 long, x2 long, y2 long"
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame([*right, (900, 0, None, 0, 1, 1)], schema)
    got = sorted((r["id_a"], r["id_b"]) for r in spatial.spatial_join(a, b, predicate, ["file_id"]).collect())
    tests = {
        "touches": lambda p, q: p[2] <= q[4] and q[2] <= p[4] and p[3] <= q[5] and q[3] <= p[5],
        "overlaps": lambda p, q: p[2] < q[4] and q[2] < p[4] and p[3] < q[5] and q[3] < p[5],
        "contains": lambda p, q: p[2] <= q[2] and p[3] <= q[3] and p[4] >= q[4] and p[5] >= q[5],
    }
    assert got == sorted((p[0], q[0]) for p in left for q in right if p[1] == q[1] and tests[predicate](p, q)) and got


def test_runs_of_ticks_do_not_change_what_is_decoded(spark, monkeypatch):
    """Edges, raster, serial and bus results with one run for a whole stream and with runs of few ticks."""
    rng = random.Random(4)
    ticks = [(s, t, int(t % 37 < 4), int(t % 400 < 50), t % 64) for s in (1, 2) for t in range(s * 7, 3000) if rng.random() < 0.9]
    raster = spark.createDataFrame(ticks, "stream_id long, tick long, hsync long, vsync long, rgb long")
    raster = raster.withColumns({f"bit{k}": F.expr(f"(rgb div {2**k}) % 2") for k in range(6)})
    wires = spark.createDataFrame([(s, w, t, rng.randrange(2)) for s in (1, 2) for w in (1, 2) for t in range(0, 2000, 7) if rng.random() < 0.7], "stream_id long, wire long, tick long, value long")
    levels, t = [], 50
    for k, byte in enumerate(bytes(range(40))):
        levels += [(1, t + trace.BIT * j, b) for j, b in enumerate([0, *((byte >> i) & 1 for i in range(8)), 1])]
        t += trace.BIT * (10 + 7 * (k % 3) * (k % 2))
    # a line of noise that is never idle, with long breaks at 0 and at 1 and the end at 0
    at = 13
    for k in range(2500):
        levels.append((2, at, k % 2))
        at += rng.choice((30, 117, 233, 466, 699, 2000)) if k % 500 else 40_000 + k
    serial = spark.createDataFrame([*levels, (2, at, 0)], "stream_id long, tick long, tx long")
    bus, clock = [], 0
    for t in range(6000):
        clock ^= rng.random() < 0.9
        session = t // 700 % 3 if t % 700 > 20 else 3
        bus.append((1, 3 * t, *(int(session != d) for d in range(3)), clock, int(t % 700 in range(110, 126) or rng.random() < 0.05), rng.randrange(2)))
    bus = spark.createDataFrame(bus, "stream_id long, tick long, cs long, ram_a long, ram_b long, sclk long, mosi long, miso long")
    found = {}
    for n in (10**9, 97, 5000):
        monkeypatch.setattr(trace, "RUN_TICKS", n)
        monkeypatch.setattr(trace, "SERIAL_TICKS", max(n, trace.BYTE))
        bits, starts = trace._spi_bits(bus)
        found[n] = [
            rows(trace.raster_scan(raster, [f"bit{k}" for k in range(6)]), "stream_id", "frame", "y", "x", "r", "g", "b"),
            rows(trace.raster_size(raster), "stream_id", "width", "height"),
            rows(trace.serial_decode(serial), "stream_id", "tick", "byte"),
            rows(trace.edges(wires), "stream_id", "wire", "tick", "edge"),
            rows(bits, "stream_id", "session", "device", "n", "mosi", "miso"),
            rows(starts, "stream_id", "session", "end_tick"),
        ]
    for k in range(6):
        assert found[97][k] == found[10**9][k] == found[5000][k], k
    assert [b for s, _, b in found[97][2] if s == 1] == list(range(40)) and len(found[97][0]) > 1000
    assert len([1 for s, _, _ in found[97][2] if s == 2]) > 100 and len(found[97][4]) > 1000
    # the same by plain loops
    plain, was = [], {}
    for s, w, t, v in rows(wires, "stream_id", "wire", "tick", "value"):
        if v != was.get((s, w), 0):
            plain.append((s, w, t, "rising" if v else "falling"))
        was[s, w] = v
    assert found[97][3] == sorted(plain)
    sessions, last, session, n, plain = [], (None, 0), 0, 0, []
    for s, t, cs, a, b, clk, mosi, miso in rows(bus, *bus.columns):
        device = "flash" if cs == 0 else "psram_a" if a == 0 else "psram_b" if b == 0 else None
        if device != last[0]:
            sessions.append((s, session, t))
            session, n = session + 1, 0
        if device and clk and not last[1]:
            plain.append((s, session, device, n, mosi, miso))
            n += 1
        last = device, clk
    assert found[97][4] == sorted(plain) and found[97][5] == sessions


def test_streams_drop_late_rows_and_leave_no_state(spark, tmp_path):
    """Rows in three micro-batches: out of order within the delay, too late, and a heartbeat; at the end only the heartbeat is kept."""
    minute = lambda rows_: spark.createDataFrame(rows_, "stream_id long, wire long, tick long, value long").withColumn("ts", F.timestamp_seconds(F.col("tick") * 60))
    parts = [[(1, 0, 1, 1), (1, 0, 3, 1), (1, 0, 100, 0), (2, 5, 100, 1)], [(1, 0, 2, 0), (1, 0, 95, 1), (1, 0, 99, 1), (2, 5, 101, 1)], [(9, 9, 10_000, 0)]]
    for part in parts:
        minute(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = "stream_id long, wire long, tick long, value long, ts timestamp"
    progress = []
    stream = streams.read_sample_stream(spark, str(tmp_path / "in"), schema)
    got = rows(streams.run_available(streams.stream_edges(stream, "10 minutes", 3_600_000), progress=progress), "stream_id", "wire", "tick", "edge")
    # 2 comes after the watermark (90) and is dropped; 95 and 99 aren't, and the hour since 3 has made the wire start at 0
    assert got == [(1, 0, 1, "rising"), (1, 0, 95, "rising"), (1, 0, 100, "falling"), (2, 5, 100, "rising")]
    assert progress[-1].stateOperators[0].numRowsTotal <= 6  # the heartbeat's row and its timer


def test_id_ranges_have_no_limit(spark):
    from sparklayout.functions import names

    texts = [(1, "1-999999999999999 7"), (2, "9-5, 4 11 x 3-"), (3, "9223372036854775806-99999999999999999999999999999999999999999"), (4, "99999999999999999999"), (5, "5-140000")]
    df = spark.createDataFrame(texts, "text_id long, text string")
    got = rows(names.parse_id_ranges(df), "text_id", "low", "high")
    assert got == [(1, 1, 999999999999999), (2, 4, 9), (2, 11, 11), (3, (1 << 63) - 2, (1 << 63) - 1), (5, 5, 140000)]
    nets = spark.createDataFrame([(n,) for n in (0, 5, 5, 10, 123456789012345, (1 << 63) - 1)], "net long")
    found = rows(names.ids_in_ranges(nets, names.parse_id_ranges(df.where("text_id > 1"))), "text_id", "net")
    assert found == [(2, 5), (3, (1 << 63) - 1), (5, 5), (5, 10)]
    assert rows(names.parse_id_list(df.where("text_id in (2, 3)")), "text_id", "id") == [(2, k) for k in (4, 5, 6, 7, 8, 9, 11)] + [(3, (1 << 63) - 2), (3, (1 << 63) - 1)]
    assert [i for _, i in rows(names.parse_id_list(df.where("text_id = 5")), "text_id", "id")] == list(range(5, 140001))


def test_intervals_of_one_line_are_merged_by_many_tasks(spark, monkeypatch):
    """A fill of one extent, with long intervals over many stretches, gaps, copies and negative places."""
    rng = random.Random(6)
    lines = [(k, at, at + rng.choice((0, 1, 5, 9, 400))) for k in (1, 2) for at in rng.sample(range(-3000, 3000), 700)]
    lines += lines[:300] + [(3, 10 * i, 10 * i + 10) for i in range(900)] + [(4, 10 * i, 10 * i + 9) for i in range(900)]
    df = spark.createDataFrame(lines, "k long, low long, high long").repartition(5)
    want = []
    for k in (1, 2, 3, 4):
        open_ = None
        for low, high in sorted((a, b) for n, a, b in lines if n == k):
            if open_ and low <= open_[1]:
                open_[1] = max(open_[1], high)
            else:
                open_ = [low, high]
                want.append((k, open_))
    for stretch in (16, 1 << 16):
        monkeypatch.setattr(shapes, "STRETCH", stretch)
        assert rows(shapes.merge_intervals(df, ["k"]), "k", "low", "high") == sorted((k, *x) for k, x in want)


def test_windows_open_only_the_files_that_they_meet(spark, tmp_path):
    places = spark.range(20_000).selectExpr("id as rect_id", "id % 2 + 8 as layer", "(id div 2 % 100) * 50 as x1", "(id div 200) * 50 as y1")
    rects = places.selectExpr("*", "x1 + 40 as x2", "y1 + 40 as y2")
    tables_of.write_tiles(rects, str(tmp_path), 40)
    written = spark.read.parquet(str(tmp_path / "rects")).inputFiles()
    box = spark.createDataFrame([(1, 1000, 1000, 1100, 1100)], "box_id long, x1 long, y1 long, x2 long, y2 long")
    near = tables_of.read_windows(spark, str(tmp_path), box, [9])
    assert len(written) >= 40 and len(near.inputFiles()) <= 4
    want = rows(rects.where("layer = 9 and x1 <= 1100 and x2 >= 1000 and y1 <= 1100 and y2 >= 1000"), "rect_id")
    assert [(r,) for _, r in rows(spatial.window_query(near, box), "box_id", "rect_id")] == want and len(want) == 9
    far = spark.createDataFrame([(1, -900, -900, -800, -800)], "box_id long, x1 long, y1 long, x2 long, y2 long")
    assert tables_of.read_windows(spark, str(tmp_path), far).count() == 0


def test_only_tiles_that_differ_are_compared(spark):
    from sparklayout.operators import analytics

    before = spark.range(5000).selectExpr("id % 3 as layer", "id * 10 as x1", "id % 7 as y1", "id * 10 + 5 as x2", "9L as y2")
    after = before.where("x1 <> 20000").unionByName(before.where("x1 = 40").selectExpr("layer", "x1 + 1 as x1", "y1", "x2", "y2")).repartition(7)
    tiles = rows(analytics.changed_tiles(before, after), "layer", "_tx", "_ty")
    assert tiles == [(1, 0, 0), (2, 4, 0)]
    got = rows(analytics.layout_diff(before, after), "layer", "x1", "change")
    assert got == [(1, 41, "added"), (2, 20000, "removed")]


def test_a_net_is_read_from_one_bucket(spark, tmp_path):
    flat = spark.range(3000).selectExpr("id div 3 as inst_id", "'c' as cell", "id % 3 as wire", "case when id % 3 < 2 then id % 3 else id div 30 end as net", "id as rect_id")
    tables_of.write_net_index(flat, str(tmp_path / "nets"), 16)
    got = tables_of.read_net(spark, str(tmp_path / "nets"), 35, 16)
    assert rows(got, "inst_id", "wire", "net") == [(k, 2, 35) for k in range(350, 360)]
    files = got.select(F.input_file_name()).distinct().collect()
    assert len(files) == 1 and "bucket=3" in files[0][0]
    rail = tables_of.read_net(spark, str(tmp_path / "nets"), 1, 16)
    assert rail.where("wire = 1").count() == 1000


def test_ids_in_ranges_equal_brute_force_without_pairs_in_vain(spark):
    """Ranges of all lengths over dense and far ids; only what is in a range is joined."""
    rng = random.Random(5)
    ids = sorted({*range(0, 700), 2**63 - 1, 2**62, 2**40 + 3, *(rng.randrange(2**20) for _ in range(300))})
    ranges = [(t, low, min(2**63 - 1, low + rng.choice([0, 1, 6, 100, 2**19, 2**62]))) for t in range(300) for low in [rng.choice([rng.randrange(800), rng.randrange(2**63)])]]
    ranges += [(900, 0, 2**63 - 1), (901, 2**63 - 1, 2**63 - 1), (902, 701, 702)]
    nets = spark.createDataFrame([(i,) for i in [-1, *ids]], "net long")
    found = names.ids_in_ranges(nets, spark.createDataFrame(ranges, "text_id long, low long, high long"))
    want = sorted((t, i) for t, low, high in ranges for i in ids if low <= i <= high)
    assert rows(found, "text_id", "net") == want
    assert "BETWEEN" not in (plan := found._jdf.queryExecution().executedPlan().toString().upper()) and plan.count("JOIN") == 1 and "CONDITION" not in plan


def test_set_operations_deal_rows_by_their_number(spark, monkeypatch):
    """As many tasks as the rows need, however small they are when they are exchanged; nulls are equal, repeated rows are one."""
    monkeypatch.setattr(analytics, "ROWS_PER_TASK", 100)
    make = lambda *parts: spark.createDataFrame([(i % 2, None if i % 7 == 0 else i) for r in parts for i in r], "a int, b long")
    before, after = make(range(0, 800), range(5)), make(range(400, 1200))
    found = analytics.layer_set_ops(before, after)
    assert found.rdd.getNumPartitions() >= 16
    own = [{(i % 2, None if i % 7 == 0 else i) for i in r} for r in (range(800), range(400, 1200))]
    change = {True: "kept", False: "removed"}
    want = {(*x, change[x in own[1]]) for x in own[0]} | {(*x, "added") for x in own[1] - own[0]}
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)


def test_intervals_of_common_and_of_crowded_keys_are_merged_alike(spark, monkeypatch):
    """Keys with few rows take one exchange; those with many are still cut into stretches, in the same call."""
    rng = random.Random(9)
    data = [(k, low, low + rng.choice([0, 3, 40, 900])) for k in range(30) for low in (rng.randrange(6000) for _ in range(200 if k == 3 else 12))]
    df = spark.createDataFrame([*data, (None, 0, 1), (1, None, 4)], "k long, low long, high long")
    at_once = shapes.merge_intervals(df, ["k"])
    assert at_once._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    stretches = []
    kept = shapes._merged_by_stretches
    monkeypatch.setattr(shapes, "_merged_by_stretches", lambda rows, *a: stretches.append(rows) or kept(rows, *a))
    monkeypatch.setattr(shapes, "STRETCH", 64)
    monkeypatch.setattr(shapes, "KEY_ROWS", 100)
    both = shapes.merge_intervals(df, ["k"])
    assert {r[0] for r in stretches[0].select("k").distinct().collect()} == {3}
    want = []
    for k, low, high in sorted(data):
        if want and want[-1][0] == k and low <= want[-1][2]:
            want[-1][2] = max(want[-1][2], high)
        else:
            want.append([k, low, high])
    for found in (at_once, both):
        assert rows(found, "k", "low", "high") == [tuple(w) for w in want]
