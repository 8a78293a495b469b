"""Registered queries: predicates and projections, geometry, spatial joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparklayout.functions import geometry as g
from sparklayout.functions import layers, names
from sparklayout.functions.geometry import Affine, Box
from sparklayout.operators import shapes, spatial
from sparklayout.registry import query
from sparklayout.sources.fixtures import duck, view

_TAGS = f"tags(pdk, layer, datatype, layer_id) as (values {layers.tags_sql()})"


@query(
    "p1_tag_layers",
    duck(f"""with {_TAGS} select p.poly_id, p.file_id, t.layer_id::integer as layer_id from polygons_tag p
      join tags t on t.pdk = 'sky130A' and t.layer = p.layer and t.datatype = p.datatype"""),
)
def p1(spark, sf):
    return shapes.tag_layers(view(spark, sf, "polygons_tag"), F.lit("sky130A")).select("poly_id", "file_id", "layer_id")


@query("p2_snap", duck("select poly_id, pt_idx, round(x)::bigint as x, round(y)::bigint as y from poly_points"))
def p2(spark, sf):
    pts = view(spark, sf, "poly_points")
    return pts.select("poly_id", "pt_idx", *(shapes.snap(F.col(c), "long").alias(c) for c in "xy"))


@query(
    "p3_filler_cells",
    duck("""select cell, name from cells where ((starts_with(name, 'sg13g2_') and (contains(name, '_fill_') or contains(name, '_decap_')))
      or contains(name, '__fill') or contains(name, '__decap') or contains(name, '__tap') or contains(name, '__endcap'))
      and cell not in (select parent from refs)"""),
)
def p3(spark, sf):
    return names.filler_cells(view(spark, sf, "cells"), view(spark, sf, "refs"))


@query("p4_standard_cells", duck("select cell, regexp_matches(name, '^(sg13g2|sky130|gf180mcu)_') as standard from cells"))
def p4(spark, sf):
    return view(spark, sf, "cells").select("cell", names.is_standard_cell(F.col("name")).alias("standard"))


@query(
    "p5_rail_labels",
    duck("""select net, name, name in ('VGND','VSS','vssd1') as ground, name in ('VPWR','VDPWR','VDD','vccd1') as power from net_labels"""),
)
def p5(spark, sf):
    name = F.col("name")
    return view(spark, sf, "net_labels").select("net", "name", names.is_ground(name).alias("ground"), names.is_power(name).alias("power"))


@query("p9_published_labels", duck("select net, name, layer from net_labels where layer >= 12"))
def p9(spark, sf):
    return view(spark, sf, "net_labels").where(F.col("layer") >= layers.MET2).select("net", "name", "layer")


_BY_BASE = "(net % 7)"
_POWER = "regexp_matches(name, '^(v(dd|ss|pwr|gnd)|vccd|vssd)[0-9]*$', 'i')"


@query(
    "p10_net_display_names",
    duck(f"""with l as (select {_BY_BASE} as net, name, net as pos from net_labels)
      select net, coalesce(max_by(name, pos) filter ({_POWER}), min_by(name, pos)) as name from l group by net"""),
)
def p10(spark, sf):
    labels = view(spark, sf, "net_labels").select((F.col("net") % 7).alias("net"), "name", F.col("net").alias("pos"))
    return names.net_display_names(labels, "pos")


@query(
    "p11_parse_bus",
    duck(r"""select net, name, regexp_extract(name, '^(.+)\[(\d+)\]$', 1) as base, regexp_extract(name, '^(.+)\[(\d+)\]$', 2)::bigint as bit
      from net_labels where net > 1 and upper(name) not in ('VDD', 'VSS') and regexp_matches(name, '^.+\[\d+\]$')"""),
)
def p11(spark, sf):
    return names.parse_bus(view(spark, sf, "net_labels"))


@query(
    "p12_important_signals",
    duck(r"""with n as (select net, regexp_replace(name, '\[\d+\]$', '') as base from net_labels)
      select net, base, regexp_matches(base, '^(?:[iu]o(_in|_out)?|uio(_in|_out)?|clk|ena|rst_?n?|[a-z]{1,2})$', 'i')
        or regexp_matches(base, '^(?:io|ui|uo|uio)_', 'i') as important from n"""),
)
def p12(spark, sf):
    base = F.regexp_replace("name", r"\[\d+\]$", "")
    rows = view(spark, sf, "net_labels").select("net", base.alias("base"))
    return rows.withColumn("important", names.is_important_signal(F.col("base")))


@query(
    "p13_port_pins",
    duck(r"""with p as (select net, case when lower(name) = 'clk' then 'clk' when regexp_matches(name, '^(ui_in|uo_out|uio_in|uio_out)(\[\d+\])?$', 'i')
        then lower(name) end as pin from net_labels)
      select pin, max(net) as net from p where pin is not null group by pin"""),
)
def p13(spark, sf):
    return names.port_pins(view(spark, sf, "net_labels"))


@query(
    "p14_parse_id_list",
    duck(r"""with p as (select text_id, unnest(regexp_split_to_array(text, '[,\s]+')) as part from id_texts),
      e as (select text_id, part like '%-%' as dashed, try_cast(nullif(regexp_extract(part, '^(\d+)', 1), '') as bigint) as a,
        try_cast(nullif(regexp_extract(part, '^\d+-(\d+)', 1), '') as bigint) as b from p)
      select distinct text_id, unnest(range(least(a, coalesce(b, a)), greatest(a, coalesce(b, a)) + 1)) as id from e
      where a is not null and (not dashed or b is not null)"""),
)
def p14(spark, sf):
    return names.parse_id_list(view(spark, sf, "id_texts"))


_RANGES = r"""p as (select text_id, unnest(regexp_split_to_array(text, '[,\s]+')) as part from id_texts),
  e as (select text_id, part like '%-%' as dashed, try_cast(nullif(regexp_extract(part, '^(\d+)', 1), '') as bigint) as a,
    try_cast(nullif(regexp_extract(part, '^\d+-(\d+)', 1), '') as bigint) as b from p)"""


@query(
    "p14_nets_in_id_list",
    duck(f"""with {_RANGES} select distinct text_id, net from e join (select distinct net from net_labels) n on net between least(a, coalesce(b, a)) and greatest(a, coalesce(b, a))
      where a is not null and (not dashed or b is not null)"""),
)
def p14_nets(spark, sf):
    """The nets that each list names, found by ranges."""
    return names.ids_in_ranges(view(spark, sf, "net_labels"), names.parse_id_ranges(view(spark, sf, "id_texts")))


_NEAR = "a.layer = b.layer and a.rect_id < b.rect_id and a.x1 <= b.x2 + 40 and b.x1 <= a.x2 + 40 and a.y1 <= b.y2 + 40 and b.y1 <= a.y2 + 40"


def _near_pairs(spark, sf):
    """Pairs of rectangles at most 40 apart on one layer: the input of the row-local operators."""
    rects = view(spark, sf, "rects")
    by = {"x1": -20, "y1": -20, "x2": 20, "y2": 20}
    grown = spatial.leveled(rects.select("layer", "rect_id", *((F.col(c) + d).alias(c) for c, d in by.items())), "grown")
    pairs = spatial.spatial_self_join(grown, ["layer"])
    own = ((F.col(f"{c}_{x}") - d).alias(f"{c}_{x}") for x in "ab" for c, d in by.items())
    return pairs.select(F.col("rect_id_a").alias("a"), F.col("rect_id_b").alias("b"), *own)


@query(
    "g1_g5_pair_predicates",
    duck(f"""select a.rect_id as a, b.rect_id as b,
      a.x1 < b.x2 and b.x1 < a.x2 and a.y1 < b.y2 and b.y1 < a.y2 as overlaps,
      a.x1 <= b.x2 and b.x1 <= a.x2 and a.y1 <= b.y2 and b.y1 <= a.y2 as touches,
      a.x1 <= b.x1 and a.y1 <= b.y1 and a.x2 >= b.x2 and a.y2 >= b.y2 as contains,
      (a.x2 - a.x1) * (a.y2 - a.y1) as area_a,
      (greatest(a.x2, b.x2) - least(a.x1, b.x1)) * (greatest(a.y2, b.y2) - least(a.y1, b.y1)) as area_union,
      case when a.x1 < b.x2 and b.x1 < a.x2 and a.y1 < b.y2 and b.y1 < a.y2
        then (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) end as area_both
      from rects a join rects b on {_NEAR}"""),
)
def g1_g5(spark, sf):
    a, b = Box.of("_a"), Box.of("_b")
    return _near_pairs(spark, sf).select(
        "a", "b", g.overlaps(a, b).alias("overlaps"), g.touches(a, b).alias("touches"), g.contains(a, b).alias("contains"),
        g.area(a).alias("area_a"), g.area(g.union_box(a, b)).alias("area_union"), g.area(g.intersect_box(a, b)).alias("area_both"),
    )


@query(
    "g6_subtract",
    duck(f"""with p as (select a.rect_id as a, b.rect_id as b, a.x1 ax1, a.y1 ay1, a.x2 ax2, a.y2 ay2, b.x1 bx1, b.y1 by1, b.x2 bx2, b.y2 by2
        from rects a join rects b on {_NEAR} where a.x1 < b.x2 and b.x1 < a.x2 and a.y1 < b.y2 and b.y1 < a.y2),
      c as (select a, b, ax1 as x1, ay1 as y1, ax2 as x2, by1 as y2 from p union all select a, b, ax1, by2, ax2, ay2 from p
        union all select a, b, ax1, greatest(ay1, by1), bx1, least(ay2, by2) from p
        union all select a, b, bx2, greatest(ay1, by1), ax2, least(ay2, by2) from p)
      select * from c where x1 < x2 and y1 < y2"""),
)
def g6(spark, sf):
    a, b = Box.of("_a"), Box.of("_b")
    pairs = _near_pairs(spark, sf).where(g.overlaps(a, b))
    return pairs.select("a", "b", F.explode(g.subtract(a, b)).alias("r")).select("a", "b", "r.*")


@query(
    "g7_subtract_all",
    duck("""with d as (select * from dev_rects where layer = 2), p as (select * from dev_rects where layer = 6),
      e as (select d.cell, d.rect_id, d.x1 as x from d union select d.cell, d.rect_id, d.x2 from d
        union select d.cell, d.rect_id, p.x1 from d join p on p.cell = d.cell union select d.cell, d.rect_id, p.x2 from d join p on p.cell = d.cell),
      s as (select cell, rect_id, x as x1, lead(x) over (partition by cell, rect_id order by x) as x2 from e)
      select s.cell, s.rect_id, s.x1, d.y1, s.x2, d.y2 from s join d on d.cell = s.cell and d.rect_id = s.rect_id
      where s.x2 is not null and not exists (select 1 from p where p.cell = s.cell and p.x1 < s.x2 and s.x1 < p.x2)"""),
)
def g7(spark, sf):
    rects = spatial.leveled(view(spark, sf, "dev_rects"), "dev-rects")
    return shapes.subtract_all(spatial.like(rects.where("layer = 2"), rects), spatial.like(rects.where("layer = 6"), rects), ["cell"])


@query(
    "g8_fracture",
    duck("""with p as (select poly_id, pt_idx, round(x)::bigint as x, round(y)::bigint as y, count(*) over (partition by poly_id) as n from poly_points),
      v as (select a.poly_id, a.x, least(a.y, b.y) as lo, greatest(a.y, b.y) as hi from p a join p b on b.poly_id = a.poly_id
        and b.pt_idx = (a.pt_idx + 1) % a.n where a.n > 4 and a.x = b.x and a.y <> b.y),
      y as (select distinct poly_id, y from p where n > 4),
      s as (select poly_id, y as y1, lead(y) over (partition by poly_id order by y) as y2 from y),
      c as (select s.poly_id, s.y1, s.y2, v.x, row_number() over (partition by s.poly_id, s.y1 order by v.x) as k
        from s join v on v.poly_id = s.poly_id and v.lo <= s.y1 and v.hi >= s.y2 where s.y2 is not null)
      select poly_id, min(x) as x1, min(y) as y1, max(x) as x2, max(y) as y2 from p where n = 4 group by poly_id
      union all select a.poly_id, a.x, a.y1, b.x, a.y2 from c a join c b on b.poly_id = a.poly_id and b.y1 = a.y1 and b.k = a.k + 1
      where a.k % 2 = 1 and a.x < b.x"""),
)
def g8(spark, sf):
    return shapes.fracture(view(spark, sf, "poly_points"))


@query(
    "g9_paths_to_rects",
    duck("""with s as (select path_id, width // 2 as h, pt_idx as seg, x as xa, y as ya, lead(x) over w as xb, lead(y) over w as yb
        from path_points window w as (partition by path_id order by pt_idx))
      select path_id, seg, case when seg = 0 then xa else xa - h end as x1, case when seg = 0 then ya - h else ya - h end as y1,
        case when seg = 0 then xb + h else xa + h end as x2, case when seg = 0 then ya + h else yb end as y2 from s where xb is not null"""),
)
def g9(spark, sf):
    return shapes.paths_to_rects(view(spark, sf, "path_points"))


@query(
    "g10_expand_repetitions",
    duck("""select item_id, c as col, r as row, x + c*dx as x, y + r*dy as y from repeated, (select unnest(range(3)) as c), (select unnest(range(4)) as r)
      where c < n_cols and r < n_rows"""),
)
def g10(spark, sf):
    return shapes.expand_repetitions(view(spark, sf, "repeated"))


_MATRIX = """(case quad%4 when 0 then 1 when 1 then 0 when 2 then -1 else 0 end)::bigint as c,
  (case quad%4 when 0 then 0 when 1 then 1 when 2 then 0 else -1 end)::bigint as s"""


@query(
    "g11_apply_transform",
    duck(f"""with m as (select parent, ref_idx, child, ox, oy, refl, {_MATRIX} from refs),
      t as (select parent, ref_idx, child, c as m00, case when refl=1 then s else -s end as m01, ox, s as m10, case when refl=1 then -c else c end as m11, oy from m)
      select parent, ref_idx, rect_id, least(m00*x1+m01*y1, m00*x2+m01*y2)+ox as x1, least(m10*x1+m11*y1, m10*x2+m11*y2)+oy as y1,
        greatest(m00*x1+m01*y1, m00*x2+m01*y2)+ox as x2, greatest(m10*x1+m11*y1, m10*x2+m11*y2)+oy as y2
      from t join cell_rects r on r.cell = t.child"""),
)
def g11(spark, sf):
    from sparklayout.operators.hierarchy import ref_matrix

    placed = ref_matrix(view(spark, sf, "raw_refs").drop("mag").withColumn("mag", F.lit(1.0)).withColumn("ox", F.floor("ox").cast("double")))
    moved = placed.join(view(spark, sf, "cell_rects").withColumnRenamed("cell", "child"), "child")
    return moved.select("parent", "ref_idx", "rect_id", *g.transform(Box.of(), Affine.of()).named())


@query(
    "g12_compose",
    duck(f"""with m as (select parent, ref_idx, child, ox, oy, refl, {_MATRIX} from refs),
      t as (select parent, ref_idx, child, c as m00, case when refl=1 then s else -s end as m01, ox as tx, s as m10, case when refl=1 then -c else c end as m11, oy as ty from m)
      select p.ref_idx as outer_idx, c.parent as middle, c.ref_idx as inner_idx, p.m00*c.m00+p.m01*c.m10 as m00, p.m00*c.m01+p.m01*c.m11 as m01, p.m00*c.tx+p.m01*c.ty+p.tx as tx,
        p.m10*c.m00+p.m11*c.m10 as m10, p.m10*c.m01+p.m11*c.m11 as m11, p.m10*c.tx+p.m11*c.ty+p.ty as ty
      from t p join t c on c.parent = p.child"""),
)
def g12(spark, sf):
    from sparklayout.operators.hierarchy import ref_matrix

    m = ref_matrix(view(spark, sf, "raw_refs").withColumn("mag", F.lit(1.0)).withColumn("ox", F.floor("ox").cast("double")))
    outer = m.select(F.col("ref_idx").alias("outer_idx"), F.col("child").alias("middle"), *Affine.of().named("_p"))
    inner = m.select(F.col("parent").alias("middle"), F.col("ref_idx").alias("inner_idx"), *Affine.of().named("_c"))
    return outer.join(inner, "middle").select("outer_idx", "middle", "inner_idx", *g.compose(Affine.of("_p"), Affine.of("_c")).named())


_COALESCED = """
  y0 as (select *, max(y2) over (partition by layer, x1, x2 order by y1, y2 rows between unbounded preceding and 1 preceding) as b from rects),
  y1s as (select *, sum(case when b is null or y1 > b then 1 else 0 end) over (partition by layer, x1, x2 order by y1, y2 rows unbounded preceding) as i from y0),
  ym as (select layer, x1, x2, min(y1) as y1, max(y2) as y2 from y1s group by layer, x1, x2, i),
  x0 as (select *, max(x2) over (partition by layer, y1, y2 order by x1, x2 rows between unbounded preceding and 1 preceding) as b from ym),
  x1s as (select *, sum(case when b is null or x1 > b then 1 else 0 end) over (partition by layer, y1, y2 order by x1, x2 rows unbounded preceding) as i from x0),
  xm as (select distinct layer, min(x1) as x1, y1, max(x2) as x2, y2 from x1s group by layer, y1, y2, i),
  merged as (select * from xm a where not exists (select 1 from xm b where b.layer = a.layer and b.x1 <= a.x1 and b.y1 <= a.y1 and b.x2 >= a.x2 and b.y2 >= a.y2
    and not (b.x1 = a.x1 and b.y1 = a.y1 and b.x2 = a.x2 and b.y2 = a.y2)))"""


@query("g13_coalesce_rects", duck(f"with {_COALESCED} select layer, x1, y1, x2, y2 from merged"))
def g13(spark, sf):
    return shapes.coalesce_rects(view(spark, sf, "rects"), ["layer"])


@query(
    "g14_coalesce_stats",
    duck(f"""with {_COALESCED}, b as (select layer, count(*) as n_before from rects group by layer), a as (select layer, count(*) as n_after from merged group by layer)
      select layer, n_before, coalesce(n_after, 0) as n_after, n_before - coalesce(n_after, 0) as discarded, (n_before - coalesce(n_after, 0)) * 100 // n_before as percent
      from b left join a using (layer)"""),
)
def g14(spark, sf):
    rects = view(spark, sf, "rects")
    return shapes.coalesce_stats(rects, shapes.coalesce_rects(rects, ["layer"]))


_TOUCH = "a.x1 <= b.x2 and b.x1 <= a.x2 and a.y1 <= b.y2 and b.y1 <= a.y2"


def _rects(spark, sf):
    return spatial.leveled(view(spark, sf, "rects"))


@query("j1_touch_self_join", duck(f"select a.layer, a.rect_id as a, b.rect_id as b from rects a join rects b on a.layer = b.layer and a.rect_id < b.rect_id and {_TOUCH}"))
def j1(spark, sf):
    return spatial.touch_self_join(_rects(spark, sf), ["layer"])


@query(
    "j2_spatial_join_contains",
    duck("""select a.rect_id as outer_id, b.rect_id as inner_id from rects a join rects b
      on a.rect_id <> b.rect_id and a.x1 <= b.x1 and a.y1 <= b.y1 and a.x2 >= b.x2 and a.y2 >= b.y2"""),
)
def j2(spark, sf):
    rects = _rects(spark, sf)
    r = spatial.like(rects.select("rect_id", "x1", "y1", "x2", "y2"), rects)
    pairs = spatial.spatial_join(r, r, "contains").where("rect_id_a <> rect_id_b")
    return pairs.select(F.col("rect_id_a").alias("outer_id"), F.col("rect_id_b").alias("inner_id"))


@query(
    "j3_interlayer_touch",
    duck(f"""select a.layer as layer_a, b.layer as layer_b, a.rect_id as a, b.rect_id as b from rects a join rects b
      on b.layer = a.layer + 1 and a.layer between 6 and 17 and {_TOUCH}"""),
)
def j3(spark, sf):
    return spatial.interlayer_touch(_rects(spark, sf), [])


@query("j4_window_query", duck(f"select box_id, rect_id from boxes a join rects b on {_TOUCH}"))
def j4(spark, sf):
    return spatial.window_query(_rects(spark, sf), view(spark, sf, "boxes"))


@query(
    "j5_labels_to_rects",
    duck("""select l.label_id, min(r.rect_id) as rect_id from label_points l left join rects r on r.layer = l.layer
      and l.x between r.x1 and r.x2 and l.y between r.y1 and r.y2 group by l.label_id"""),
)
def j5(spark, sf):
    return spatial.labels_to_rects(view(spark, sf, "label_points"), _rects(spark, sf), ["layer"]).select("label_id", "rect_id")


@query(
    "j5_unmatched_labels",
    duck("""with rc as (select layer, x1, y1, x2, y2, cx, unnest(range(y1//100, y2//100+1)) as cy from (select *, unnest(range(x1//100, x2//100+1)) as cx from rects)),
      hit as (select distinct l.label_id from label_points l join rc on rc.layer = l.layer and rc.cx = l.x//100 and rc.cy = l.y//100
        where l.x between rc.x1 and rc.x2 and l.y between rc.y1 and rc.y2)
      select l.label_id, l.text from label_points l left join hit using (label_id) where hit.label_id is null"""),
)
def j5_unmatched(spark, sf):
    return spatial.unmatched_labels(view(spark, sf, "label_points"), _rects(spark, sf), ["layer"]).select("label_id", "text")


@query(
    "j6_overlaps_any",
    duck("""select cell, rect_id from dev_rects d where layer = 2 and exists (select 1 from dev_rects w where w.layer = 1 and w.cell = d.cell
      and w.x1 < d.x2 and d.x1 < w.x2 and w.y1 < d.y2 and d.y1 < w.y2)"""),
)
def j6(spark, sf):
    rects = spatial.leveled(view(spark, sf, "dev_rects"), "dev-rects")
    wells = spatial.like(rects.where("layer = 1"), rects)
    return spatial.overlaps_any(spatial.like(rects.where("layer = 2"), rects), wells, ["cell"]).select("cell", "rect_id")
