"""Registered queries: components, hierarchy, devices, netlists."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from sparklayout.functions import names
from sparklayout.operators import analytics, devices, graph, hierarchy, nets, netlist, spatial
from sparklayout.registry import query
from sparklayout.sources.fixtures import duck, view
from sparklayout.sources.work import materialize

_TOUCH = "a.x1 <= b.x2 and b.x1 <= a.x2 and a.y1 <= b.y2 and b.y1 <= a.y2"
#: Layer components by brute force: everything that can be reached.
_COMPONENTS = f"""e as (select a.rect_id as a, b.rect_id as b from rects a join rects b on a.layer = b.layer and a.rect_id <> b.rect_id and {_TOUCH}),
  reach as (select rect_id, rect_id as seen from rects union select r.rect_id, e.b from reach r join e on e.a = r.seen),
  comps as (select rect_id, min(seen) as component from reach group by rect_id)"""


def _layer_components(spark, sf):
    rects = spatial.leveled(view(spark, sf, "rects"))
    pairs = spatial.touch_self_join(rects, ["layer"])
    return rects, graph.connected_components(rects, pairs, "rect_id", "a", "b", ["layer"])


@query("c1_connected_components", duck(f"with {_COMPONENTS} select layer, rect_id, component from comps join rects using (rect_id)", recursive=True))
def c1(spark, sf):
    return _layer_components(spark, sf)[1]


@query(
    "flagship_top_nets",
    duck(f"""with {_COMPONENTS}, s as (select component as net, sum((x2-x1)*(y2-y1))::bigint as area, min(x1) as x1, min(y1) as y1, max(x2) as x2, max(y2) as y2, count(*) as n
      from comps join rects using (rect_id) group by component) select * from s order by area desc, net limit 1000""", recursive=True),
)
def flagship(spark, sf):
    """Touching rectangles to nets, nets ranked by area."""
    rects, comps = _layer_components(spark, sf)
    flat = rects.join(comps.withColumnRenamed("component", "net"), ["layer", "rect_id"])
    return analytics.net_stats(flat).orderBy(F.desc("area"), "net").limit(1000)


def _labelled(spark, sf, rects):
    points = view(spark, sf, "label_points")
    side = points.select("layer", "label_id", "text", *(F.col(c).alias(n) for c, n in (("x", "x1"), ("y", "y1"), ("x", "x2"), ("y", "y2"))))
    side.rect_levels = {(0, 0)}  # points
    hits = spatial.spatial_join(side, spatial.like(rects.select("layer", "rect_id", "x1", "y1", "x2", "y2"), rects), "touches", ["layer"])
    return hits.select("layer", F.col("text_a").alias("text"), F.col("rect_id_b").alias("rect_id"))


@query(
    "c2_cell_wires",
    duck(f"""with {_COMPONENTS},
      lab as materialized (select distinct l.text, r.rect_id from label_points l join rects r on r.layer = l.layer and l.x between r.x1 and r.x2 and l.y between r.y1 and r.y2),
      hub as (select text, min(rect_id) as hub from lab group by text),
      across as (select a.rect_id as a, b.rect_id as b from rects a join rects b on b.layer = a.layer + 1 and a.layer between 6 and 17 and {_TOUCH}
        union select rect_id, hub from lab join hub using (text) where rect_id <> hub),
      parts as materialized (select * from comps),
      half as (select distinct x.component as a, y.component as b from across join parts x on x.rect_id = a join parts y on y.rect_id = b where x.component <> y.component),
      ways as materialized (select a, b from half union select b, a from half),
      whole as (select distinct component as node, component as seen from parts union select w.node, ways.b from whole w join ways on ways.a = w.seen),
      least as (select node, min(seen) as component from whole group by node)
      select 'top' as cell, rect_id, least.component from parts join least on least.node = parts.component""", recursive=True),
)
def c2(spark, sf):
    """Wires over all layers; the SQL first takes what is connected on a layer as one."""
    rects = spatial.leveled(view(spark, sf, "rects"))
    labels = materialize(_labelled(spark, sf, rects).select("text", "rect_id").distinct(), "labels")
    return nets.cell_wires(rects, labels, []).select(F.lit("top").alias("cell"), "rect_id", "component")


_LABELS = """lab as (select l.layer, case l.text when 'L0' then 'VGND' when 'L1' then 'VPWR' when 'L2' then 'VPWR' else l.text end as text, r.rect_id
  from label_points l join rects r on r.layer = l.layer and l.x between r.x1 and r.x2 and l.y between r.y1 and r.y2),
  res as (select layer, text, min(rect_id) as rect_id from lab group by layer, text)"""


def _rail_labels(spark, sf, rects):
    text = F.when(F.col("text") == "L0", "VGND").when(F.col("text").isin("L1", "L2"), "VPWR").otherwise(F.col("text"))
    return _labelled(spark, sf, rects).withColumn("text", text)


@query(
    "c3_assign_wire_ids",
    duck(f"""with {_COMPONENTS}, {_LABELS}, c as (select layer, rect_id, component from comps join rects using (rect_id)),
      n as (select c.layer, c.component, res.text from res join c on c.layer = res.layer and c.rect_id = res.rect_id),
      rails as (select layer, max_by(component, text) filter (text in ('VGND','VSS','vssd1')) as g, max_by(component, text) filter (text in ('VPWR','VDPWR','VDD','vccd1')) as p from n group by layer),
      each as (select layer, component, min(rect_id) as r from c group by layer, component),
      f as (select layer, component, min(text) as t from n group by layer, component),
      k as (select e.layer, e.component, e.r, f.t, case when e.component = rails.p then 1 when e.component = rails.g then 0 end as rail
        from each e left join f using (layer, component) left join rails using (layer))
      select layer, component, coalesce(rail, row_number() over (partition by layer, rail is null order by t nulls last, r) + 1)::bigint as wire from k""", recursive=True),
)
def c3(spark, sf):
    rects, comps = _layer_components(spark, sf)
    labels = _rail_labels(spark, sf, rects).groupBy("layer", "text").agg(F.min("rect_id").alias("rect_id"))
    return nets.assign_wire_ids(comps, labels, ["layer"])


@query(
    "c4_label_resolution",
    duck("""with lab as (select l.text, r.rect_id, r.layer, r.rect_id % 3 as cell from label_points l join rects r on r.layer = l.layer and l.x between r.x1 and r.x2 and l.y between r.y1 and r.y2),
      k as (select *, row_number() over (partition by cell, text order by layer desc, rect_id) as nth from lab)
      select cell, text, rect_id, layer from k where nth = 1"""),
)
def c4(spark, sf):
    rects = view(spark, sf, "rects")
    rows = _labelled(spark, sf, rects).withColumn("cell", F.col("rect_id") % 3)
    return nets.label_resolution(rows, ["cell"])


_MATRIX = """(case quad%4 when 0 then 1 when 1 then 0 when 2 then -1 else 0 end)::bigint as c,
  (case quad%4 when 0 then 0 when 1 then 1 when 2 then 0 else -1 end)::bigint as s"""
_WALK = f"""sup as (select * from refs where not (parent like 'n%' and (ref_idx % 13 = 0 or ref_idx % 17 = 0))),
  m as (select parent, ref_idx, child, ox, oy, refl, {_MATRIX} from sup),
  t as (select parent, ref_idx, child, c as a, case when refl=1 then s else -s end as b, ox as x, s as c, case when refl=1 then -c else c end as d, oy as y from m),
  below as (select distinct parent as root, parent as cell from refs where parent not in (select child from refs) union all select b.root, t.child from below b join t on t.parent = b.cell),
  root as (select root, count(*) as size from below group by root order by size desc, root limit 1),
  walk as (select root as cell, []::bigint[] as path, 0 as depth, 1::bigint as m00, 0::bigint as m01, 0::bigint as tx, 0::bigint as m10, 1::bigint as m11, 0::bigint as ty from root
    union all select t.child, list_append(w.path, t.ref_idx), w.depth + 1, m00*t.a+m01*t.c, m00*t.b+m01*t.d, m00*t.x+m01*t.y+tx, m10*t.a+m11*t.c, m10*t.b+m11*t.d, m10*t.x+m11*t.y+ty
    from walk w join t on t.parent = w.cell),
  inst as (select (row_number() over (order by path) - 1)::bigint as inst_id, cell, depth, m00, m01, tx, m10, m11, ty from walk)"""
_FILLER = """((starts_with(name, 'sg13g2_') and (contains(name, '_fill_') or contains(name, '_decap_'))) or contains(name, '__fill')
  or contains(name, '__decap') or contains(name, '__tap') or contains(name, '__endcap')) and cell not in (select parent from refs)"""
_MOVED = """least(m00*x1+m01*y1, m00*x2+m01*y2)+tx as x1, least(m10*x1+m11*y1, m10*x2+m11*y2)+ty as y1,
  greatest(m00*x1+m01*y1, m00*x2+m01*y2)+tx as x2, greatest(m10*x1+m11*y1, m10*x2+m11*y2)+ty as y2"""
_FLAT = f"""{_WALK}, pf as (select inst_id, i.cell, rect_id, layer, wire, {_MOVED} from inst i join cell_rects r on r.cell = i.cell
  where i.cell not in (select cell from cells where {_FILLER}) and layer not in (1, 2))"""


def _tops(spark, sf, refs):
    """The placements' sizes, and the root with the most of them."""
    every = view(spark, sf, "refs")
    sizes = materialize(hierarchy.subtree_sizes(refs, hierarchy.root_cells(every)), "sizes")
    return sizes, hierarchy.top_cells(every, sizes)


def _instances(spark, sf):
    refs = hierarchy.with_support(view(spark, sf, "raw_refs")).where("supported").drop("supported")
    matrices = materialize(hierarchy.ref_matrix(refs), "matrices")
    sizes, tops = _tops(spark, sf, matrices)
    return hierarchy.place_instances(matrices, tops, sizes)


def _fillers(spark, sf):
    return names.filler_cells(view(spark, sf, "cells"), view(spark, sf, "refs"))


def _flat(spark, sf):
    placed = hierarchy.flatten_rects(_instances(spark, sf), view(spark, sf, "cell_rects"), _fillers(spark, sf))
    return materialize(placed, "flat")


@query("p6_supported_refs", duck("select parent, ref_idx, not (parent like 'n%' and (ref_idx % 13 = 0 or ref_idx % 17 = 0)) as supported from refs"))
def p6(spark, sf):
    return hierarchy.with_support(view(spark, sf, "raw_refs")).select("parent", "ref_idx", "supported")


@query(
    "p7_ref_matrix",
    duck(f"""with m as (select parent, ref_idx, child, ox, oy, refl, {_MATRIX} from refs where not (parent like 'n%' and (ref_idx % 13 = 0 or ref_idx % 17 = 0)))
      select parent, ref_idx, child, c as m00, case when refl=1 then s else -s end as m01, ox as tx, s as m10, case when refl=1 then -c else c end as m11, oy as ty from m"""),
)
def p7(spark, sf):
    refs = hierarchy.with_support(view(spark, sf, "raw_refs")).where("supported").drop("supported")
    return hierarchy.ref_matrix(refs)


_ROOTS = """b as (select distinct parent as root, parent as cell from refs where parent not in (select child from refs) union all select b.root, r.child from b join refs r on r.parent = b.cell),
  n as (select root as cell, count(*) as size from b group by root), k as (select *, row_number() over (order by size desc, cell) as nth from n)"""


@query("j15_top_cells", duck(f"with {_ROOTS} select cell from k where nth = 1", recursive=True))
def j15(spark, sf):
    return _tops(spark, sf, view(spark, sf, "refs"))[1]


@query("j15_unused_roots", duck(f"with {_ROOTS} select cell, size from k where nth > 1", recursive=True))
def j15_unused(spark, sf):
    """Roots that no layout is walked from."""
    sizes, tops = _tops(spark, sf, view(spark, sf, "refs"))
    return hierarchy.unused_roots(view(spark, sf, "refs"), sizes, tops)


@query("j15_subtree_sizes", duck("""with c as (select parent as cell from refs union select child from refs),
  b as (select cell as root, cell, 0 as depth from c union all select b.root, r.child, depth + 1 from b join refs r on r.parent = b.cell)
  select root as cell, count(*) as size, max(depth) as height from b group by root""", recursive=True))
def j15_sizes(spark, sf):
    return hierarchy.subtree_sizes(view(spark, sf, "refs"))


_BY_FILE = """c as (select file_id, cell, name from cells, (select unnest(range(4)) as file_id) where file_id > 0 or cell <> 'k3' union all select f, 'lone', 'lone' from (select unnest(range(4)) as f)),
  rf as (select file_id, parent, child from refs, (select unnest(range(4)) as file_id) where file_id < 3 or parent like 'n%')"""


@query(
    "j15_top_cells_by_name",
    duck(f"""with {_BY_FILE}, roots as (select file_id, cell from c where (file_id, cell) not in (select file_id, child from rf)),
      b as (select file_id, cell as root, cell from roots union all select b.file_id, b.root, r.child from b join rf r on r.file_id = b.file_id and r.parent = b.cell),
      n as (select file_id, root as cell, count(*) as size from b group by all), auto as (select *, row_number() over (partition by file_id order by size desc, cell) as nth from n),
      named as (select file_id, cell from c where name = 'gf180mcu_fd_sc__nand2_3')
      select file_id::bigint as file_id, cell from named union all select file_id::bigint, cell from auto where nth = 1 and file_id not in (select file_id from named)""", recursive=True),
)
def j15_by_name(spark, sf):
    """Four files; the named cell is in three of them, the first falls back on the largest of the cells that are placed nowhere."""
    files = spark.range(4).withColumnRenamed("id", "file_id")
    cells = view(spark, sf, "cells").join(F.broadcast(files)).where("file_id > 0 or cell <> 'k3'").select("file_id", "cell", "name")
    cells = cells.unionByName(files.select("file_id", F.lit("lone").alias("cell"), F.lit("lone").alias("name")))
    refs = view(spark, sf, "refs").join(F.broadcast(files)).where("file_id < 3 or parent like 'n%'").select("file_id", "parent", "child")
    sizes = materialize(hierarchy.subtree_sizes(refs, cells, ["file_id"]), "sizes")
    return hierarchy.top_cells(refs, sizes, cells, "gf180mcu_fd_sc__nand2_3", ["file_id"])


@query("j14_walk_hierarchy", duck(f"with {_WALK} select * from inst", recursive=True))
def j14(spark, sf):
    return _instances(spark, sf)


@query("j9_flatten_rects", duck(f"with {_FLAT} select * from pf", recursive=True))
def j9(spark, sf):
    return _flat(spark, sf)


_BOXES = f"""{_WALK}, lb as (select cell, layer, min(x1) as x1, min(y1) as y1, max(x2) as x2, max(y2) as y2 from cell_rects group by cell, layer),
  ib as (select inst_id, i.cell, layer, {_MOVED} from inst i join lb on lb.cell = i.cell)"""


@query("j7_instance_pairs", duck(f"with {_BOXES} select a.layer, a.inst_id as a, b.inst_id as b from ib a join ib b on a.layer = b.layer and a.layer >= 4 and a.inst_id < b.inst_id and {_TOUCH}", recursive=True))
def j7(spark, sf):
    return hierarchy.instance_pairs(materialize(hierarchy.instance_boxes(_instances(spark, sf), view(spark, sf, "cell_rects")), "boxes"))


_EDGES = f"""{_FLAT}, ce as (select distinct a.inst_id as a_inst, a.wire as a_wire, b.inst_id as b_inst, b.wire as b_wire from pf a join pf b
  on a.layer = b.layer and a.inst_id < b.inst_id and {_TOUCH})"""


@query("j8_cross_instance_edges", duck(f"with {_EDGES} select * from ce", recursive=True))
def j8(spark, sf):
    return hierarchy.cross_instance_edges(materialize(_instances(spark, sf), "instances"), view(spark, sf, "cell_rects"), _fillers(spark, sf))


_SEGMENTS = """wc as (select cell, max(wire) + 1 as n_wires from cell_rects group by cell),
  sg as (select inst_id, i.cell, coalesce(sum(n_wires) over (order by inst_id rows between unbounded preceding and 1 preceding), 0)::bigint as first, n_wires
    from inst i join wc on wc.cell = i.cell)"""


def _segments(spark, sf, instances):
    counts = view(spark, sf, "cell_rects").groupBy("cell").agg((F.max("wire") + 1).alias("n_wires"))
    return hierarchy.number_segments(instances, counts), counts


@query(
    "c5_global_nets",
    duck(f"""with {_EDGES}, {_SEGMENTS}, v as (select first + w as segment from sg, (select unnest(range(5)) as w) where w < n_wires),
      ge as (select a.first + a_wire as a, b.first + b_wire as b from ce join sg a on a.inst_id = a_inst join sg b on b.inst_id = b_inst),
      g2 as (select a, b from ge union select b, a from ge),
      reach as (select segment, segment as seen from v union select r.segment, g2.b from reach r join g2 on g2.a = r.seen),
      comps as (select segment, min(seen) as component from reach group by segment),
      named as (select segment, segment // 7 as rank from v where segment % 7 = 0 and segment < 70),
      k as (select component, min(rank) as rank, bool_or(rank = 1) as p from comps left join named using (segment) group by component),
      r as (select component, rank, case when p then 1 when rank = 0 then 0 end as rail from k),
      ids as (select component, coalesce(rail, row_number() over (partition by rail is null order by rank nulls last, component) + 1)::bigint as net from r)
      select segment, net from comps join ids using (component)""", recursive=True),
)
def c5(spark, sf):
    instances = materialize(_instances(spark, sf), "instances")
    firsts, counts = _segments(spark, sf, instances)
    firsts = materialize(firsts, "segments")
    wires = instances.select("inst_id", "cell").join(counts, "cell").join(firsts, "inst_id")
    segments = wires.select(F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n_wires") - 1)).alias("segment"))
    edges = hierarchy.cross_instance_edges(instances, view(spark, sf, "cell_rects"), _fillers(spark, sf))
    edges = edges.join(firsts.toDF("a_inst", "a_first"), "a_inst").join(firsts.toDF("b_inst", "b_first"), "b_inst")
    edges = edges.select((F.col("a_first") + F.col("a_wire")).alias("a"), (F.col("b_first") + F.col("b_wire")).alias("b"))
    named = segments.where("segment % 7 = 0 and segment < 70").select("segment", F.expr("segment div 7").alias("rank"))
    return nets.global_nets(segments, edges, named)


@query(
    "c6_power_short_check",
    duck("""with l as (select net % 40 as file_id, net // 11 % 9 as component, name from net_labels),
      k as (select file_id, list(distinct component) filter (name in ('VGND','VSS','vssd1')) as g, list(distinct component) filter (name in ('VPWR','VDPWR','VDD','vccd1')) as p from l group by file_id)
      select file_id, coalesce(list_has_any(g, p), false) as shorted, g is null as no_ground, p is null as no_power from k"""),
)
def c6(spark, sf):
    labels = view(spark, sf, "net_labels").select((F.col("net") % 40).alias("file_id"), F.expr("net div 11 % 9").alias("component"), "name")
    return nets.power_short_check(labels)


@query(
    "j10_cell_outline_rects",
    duck(f"""with {_WALK}, std as (select cell from cells where regexp_matches(name, '^(sg13g2|sky130|gf180mcu)_') and not ({_FILLER})),
      bx as (select cell, min(x1) as x1, min(y1) as y1, max(x2) as x2, max(y2) as y2 from cell_rects group by cell),
      ow as (select cell, min(term1) as wire from cell_fets where term0 < term1 group by cell)
      select inst_id, 19::bigint as layer, {_MOVED}, wire from inst i join std on std.cell = i.cell join bx on bx.cell = i.cell left join ow on ow.cell = i.cell""", recursive=True),
)
def j10(spark, sf):
    outputs = view(spark, sf, "cell_fets").where("term0 < term1").select("cell", F.col("term1").alias("wire"))
    return hierarchy.cell_outline_rects(_instances(spark, sf), view(spark, sf, "cell_rects"), view(spark, sf, "cells"), _fillers(spark, sf), outputs)


_LOOKUP = f"""{_FLAT}, {_SEGMENTS}, lk as (select pf.inst_id, pf.cell, rect_id, layer, wire, case when (first + wire) % 9 = 0 then -1 else (first + wire) // 3 end as net
  from pf left join sg using (inst_id))"""


def _looked_up(spark, sf):
    instances = materialize(_instances(spark, sf), "instances")
    flat = hierarchy.flatten_rects(instances, view(spark, sf, "cell_rects"), _fillers(spark, sf))
    firsts, counts = _segments(spark, sf, instances)
    firsts = materialize(firsts, "segments")
    wires = instances.select("inst_id", "cell").join(counts, "cell").join(firsts, "inst_id")
    segments = wires.select(F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n_wires") - 1)).alias("segment"))
    to_net = segments.where("segment % 9 <> 0").select("segment", F.expr("segment div 3").alias("net"))
    to_tree = to_net.select("net").distinct().where("net % 5 <> 0").select("net", F.expr("net div 2").alias("tree"))
    return hierarchy.lookup_nets(flat, firsts, to_net, to_tree), firsts, to_net, instances


@query("j11_lookup_nets", duck(f"with {_LOOKUP} select inst_id, rect_id, layer, net, case when net < 0 or net % 5 = 0 then -1 else net // 2 end as tree from lk", recursive=True))
def j11(spark, sf):
    return _looked_up(spark, sf)[0].select("inst_id", "rect_id", "layer", "net", "tree")


@query(
    "j12_net_to_instances",
    duck(f"""with {_LOOKUP}, on_net as (select distinct inst_id, cell, wire from lk where net = 101)
      select inst_id, string_agg(distinct wire::varchar, ',' order by wire::varchar) as wires, coalesce(string_agg(distinct text, ', ' order by text), '') as labels
      from on_net left join cell_labels using (cell, wire) group by inst_id""", recursive=True),
)
def j12(spark, sf):
    return hierarchy.net_to_instances(_looked_up(spark, sf)[0], 101, view(spark, sf, "cell_labels"))


@query(
    "n5_flatten_fets",
    duck(f"""with {_WALK}, {_SEGMENTS}, f as (select i.inst_id as instance, first + gate as g, first + term0 as t0, first + term1 as t1, type
        from inst i join sg using (inst_id) join cell_fets c on c.cell = i.cell),
      n as (select instance, type, case when g % 9 <> 0 then g // 3 end as gate, case when t0 % 9 <> 0 then t0 // 3 end as t0, case when t1 % 9 <> 0 then t1 // 3 end as t1 from f)
      select gate, least(t0, t1) as term0, greatest(t0, t1) as term1, type, instance from n""", recursive=True),
)
def n5(spark, sf):
    _, firsts, to_net, instances = _looked_up(spark, sf)
    return devices.flatten_fets(instances, view(spark, sf, "cell_fets"), firsts, to_net)


_OVER = "a.x1 < b.x2 and b.x1 < a.x2 and a.y1 < b.y2 and b.y1 < a.y2"
_CHANNELS = f"""ch as (select a.cell, a.rect_id as diff_id, b.rect_id as poly_id, b.wire as gate, greatest(a.x1, b.x1) as x1, greatest(a.y1, b.y1) as y1, least(a.x2, b.x2) as x2, least(a.y2, b.y2) as y2
  from dev_rects a join dev_rects b on a.cell = b.cell and a.layer = 2 and b.layer = 6 and {_OVER})"""
_DEVICES = f"""{_CHANNELS}, ty as (select a.*, case when exists (select 1 from dev_rects b where b.cell = a.cell and b.layer = 1 and {_OVER}) then 0 else 1 end as type from ch a),
  de as (select a.cell, a.diff_id, a.poly_id, a.gate, a.type, count(distinct b.wire) as n_terms, min(b.wire) as term0, max(b.wire) as term1 from ty a
    left join dev_terms b on b.cell = a.cell and (b.layer = 5) = (a.type = 0) and {_TOUCH} group by all)"""


def _dev_rects(spark, sf):
    return spatial.leveled(view(spark, sf, "dev_rects"), "dev-rects")


def _devices(spark, sf):
    return devices.channel_devices(_dev_rects(spark, sf), spatial.leveled(view(spark, sf, "dev_terms"), "terminals"), ["cell"])


@query("n1_derive_channels", duck(f"with {_CHANNELS} select * from ch"))
def n1(spark, sf):
    return devices.derive_channels(_dev_rects(spark, sf), ["cell"])


@query("n2_derive_terminals", duck("select t.cell, t.layer - 4 as rect_id, t.layer, t.x1, t.y1, t.x2, t.y2 from dev_terms t union select cell, 0, 4, 0, 0, 20, 20 from devs where c % 7 = 0"))
def n2(spark, sf):
    return devices.derive_terminals(_dev_rects(spark, sf), ["cell"])


@query("n3_extract_cell_fets", duck(f"with {_DEVICES} select distinct cell, gate, term0, term1, type::bigint as type from de where n_terms = 2"))
def n3(spark, sf):
    return devices.extract_cell_fets(_devices(spark, sf), ["cell"])


@query("n4_fet_rejects", duck(f"with {_DEVICES} select cell, count(*) filter (gate in (0, 1)) as decap, count(*) filter (gate not in (0, 1)) as malformed from de where n_terms <> 2 group by cell"))
def n4(spark, sf):
    return devices.fet_rejects(_devices(spark, sf), ["cell"])


_INVERTERS = "inv as (select distinct a.gate, a.term1 as out from fets a join fets b on a.gate = b.gate and a.term1 = b.term1 and a.term0 = 0 and b.term0 = 1)"


@query("c7_inverter_pairs", duck(f"with {_INVERTERS} select gate, out from inv"))
def c7(spark, sf):
    return netlist.inverter_pairs(view(spark, sf, "fets"))


@query(
    "c8_inverter_trees",
    duck(f"""with {_INVERTERS}, v as (select distinct unnest([gate, term0, term1]) as net from fets),
      up as (select net, net as at from v union all select up.net, inv.gate from up join inv on inv.out = up.at)
      select net, min(up.at) as tree from up where up.at not in (select out from inv) group by net""".replace(" as at ", " as cur ").replace("up.at", "up.cur"), recursive=True),
)
def c8(spark, sf):
    fets = view(spark, sf, "fets")
    every = fets.select(F.explode(F.array("gate", "term0", "term1")).alias("net")).distinct()
    return netlist.inverter_trees(every, fets)


_GROUPS = """gv as (select distinct unnest([term0, term1]) as net from fets), ge as (select term0 as a, term1 as b from fets where term0 >= 2 and term1 >= 2 union select term1, term0 from fets where term0 >= 2 and term1 >= 2),
  reach as (select net, net as seen from gv where net >= 2 union select r.net, ge.b from reach r join ge on ge.a = r.seen), grp as (select net, min(seen) as "group" from reach group by net)"""


@query("c9_channel_groups", duck(f'with {_GROUPS} select net, "group" from grp', recursive=True))
def c9(spark, sf):
    return netlist.channel_groups(view(spark, sf, "fets"))


_NET = 102
_AROUND = f"""{_GROUPS}, ins as (select net from grp where "group" in (select "group" from grp where net = {_NET}) union select {_NET}),
  ed as (select distinct f.*, (s.value = f.type) as open from fets f left join wire_states s on s.wire = f.gate and s.known where gate in (select net from ins) or term0 in (select net from ins) or term1 in (select net from ins))"""


def _around(spark, sf):
    fets = view(spark, sf, "fets")
    return netlist.neighborhood_edges(fets, netlist.channel_groups(fets), _NET, view(spark, sf, "wire_states"))


@query("c10_neighborhood_edges", duck(f"with {_AROUND} select * from ed", recursive=True))
def c10_edges(spark, sf):
    return _around(spark, sf)


@query("c10_neighborhood_nodes", duck(f"with {_AROUND}, n as (select distinct unnest([gate, term0, term1]) as net from ed) select n.net, name from n left join net_labels using (net)", recursive=True))
def c10_nodes(spark, sf):
    return netlist.neighborhood_nodes(_around(spark, sf), names.net_display_names(view(spark, sf, "net_labels")))


@query("n6_fanout", duck("with x as (select gate, unnest([term0, term1]) as net from fets) select distinct gate, net from x where net >= 2"))
def n6(spark, sf):
    return netlist.fanout(view(spark, sf, "fets"))


@query("n6_net_adjacency", duck("""with x as (select term0 as net, term1 as other, gate, type from fets union all select term1, term0, gate, type from fets) select distinct * from x where net >= 2"""))
def n6_adjacency(spark, sf):
    return netlist.net_adjacency(view(spark, sf, "fets"))


@query("n7_affected_nets", duck("with x as (select gate, unnest([term0, term1]) as net from fets) select distinct net from x where net >= 2 and gate in (select wire from wire_states where value = 1 and not known)"))
def n7(spark, sf):
    changed = view(spark, sf, "wire_states").where("value = 1 and not known").select(F.col("wire").alias("net"))
    return netlist.affected_nets(changed, netlist.fanout(view(spark, sf, "fets")))


@query("n8_conducting_fets", duck("select f.* from fets f join wire_states s on s.wire = f.gate and s.value = f.type"))
def n8(spark, sf):
    return netlist.conducting_fets(view(spark, sf, "fets"), view(spark, sf, "wire_states"))


_DRIVE = """op as (select f.* from fets f join wire_states s on s.wire = f.gate and s.known and s.value = f.type),
  dv as (select wire as net from wire_states where wire >= 2), de as (select term0 as a, term1 as b from op where term0 >= 2 and term1 >= 2 union select term1, term0 from op where term0 >= 2 and term1 >= 2),
  reach as (select net, net as seen from dv union select r.net, de.b from reach r join de on de.a = r.seen), gp as (select net, min(seen) as grp from reach group by net),
  mk as (select grp, bit_or(term0 + 1) as mask from op join gp on gp.net = op.term1 where term0 < 2 group by grp),
  un as (select distinct grp from (select unnest([term0, term1]) as net from fets where gate not in (select wire from wire_states where known)) join gp using (net)),
  dr as (select gp.net, gp.grp, coalesce(mask, 0)::bigint as mask, (case coalesce(mask, 0) when 2 then 1 when 0 then s.value else 0 end)::bigint as value, gp.grp in (select grp from un) as unknown
    from gp left join mk on mk.grp = gp.grp join wire_states s on s.wire = gp.net)"""


@query("n9_resolve_drive", duck(f"with {_DRIVE} select * from dr", recursive=True))
def n9(spark, sf):
    return netlist.resolve_drive(view(spark, sf, "fets"), view(spark, sf, "wire_states"))


_SHORTS = re.sub(r"\bfets\b", "shorted_fets", _DRIVE)


@query("n10_short_report", duck(f"with {_SHORTS} select grp, count(*) as nets from dr where mask = 3 group by grp", recursive=True))
def n10(spark, sf):
    return netlist.short_report(netlist.resolve_drive(view(spark, sf, "shorted_fets"), view(spark, sf, "wire_states")))


@query("n10_short_report_by_file", duck(f"with {_SHORTS}, x as (select grp, count(*) as nets from dr where mask = 3 group by grp) select unnest([0, 1])::bigint as file_id, grp, nets from x", recursive=True))
def n10_files(spark, sf):
    """Two files of the same nets: what happens in one doesn't show in the other."""
    files = spark.sql("select explode(array(0L, 1L)) as file_id")
    both = lambda name: view(spark, sf, name).join(F.broadcast(files), F.col("file_id") >= 0)
    return netlist.short_report(netlist.resolve_drive(both("shorted_fets"), both("wire_states"), ["file_id"]), ["file_id"])


@query(
    "n11_state_diff",
    duck("""with b as (select wire, value as before from wire_states where wire % 7 <> 0), a as (select wire, (value + wire // 3) % 2 as after from wire_states where wire % 5 <> 0)
      select wire, before, after, before is distinct from after as flipped from b full join a using (wire)"""),
)
def n11(spark, sf):
    states = view(spark, sf, "wire_states")
    later = states.where("wire % 5 <> 0").select("wire", F.expr("(value + wire div 3) % 2").alias("value"))
    return netlist.state_diff(states.where("wire % 7 <> 0"), later)
