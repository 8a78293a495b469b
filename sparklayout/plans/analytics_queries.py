"""Registered queries: sources and sinks, projections, statistics, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparklayout.functions import layers, names
from sparklayout.operators import analytics, hierarchy, netlist, shapes, spatial
from sparklayout.registry import query
from sparklayout.sources import catalog, tables
from sparklayout.sources.fixtures import duck, view
from sparklayout.sources.work import materialize, new_path

_SPECS = f"specs(layer, layer_name, z_rank, exempt) as (values {layers.specs_sql()})"
_TAGS = f"tags(pdk, layer, datatype, layer_id) as (values {layers.tags_sql()})"


@query(
    "s1_read_layout",
    duck("""select p.file_id, p.poly_id, p.layer, p.datatype, count(*) as n_points, min(x) as min_x, max(y) as max_y
      from polygons_tag p join poly_points t using (poly_id) group by p.file_id, p.poly_id, p.layer, p.datatype"""),
)
def s1(spark, sf):
    """Write a layout folder from the polygon fixture and read it with the fixed schemas."""
    path = new_path(spark, "layout")
    points = view(spark, sf, "poly_points").groupBy("poly_id").agg(F.sort_array(F.collect_list(F.struct("pt_idx", "x", "y"))).alias("p"))
    polygons = view(spark, sf, "polygons_tag").join(points, "poly_id")
    ready = polygons.select("file_id", F.lit("top").alias("cell"), "poly_id", "layer", "datatype", F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("points"))
    ready.write.parquet(f"{path}/polygons")
    got = spark.read.schema(tables.SCHEMAS["polygons"]).parquet(f"{path}/polygons")
    xs, ys = F.transform("points", lambda q: q["x"]), F.transform("points", lambda q: q["y"])
    return got.select("file_id", "poly_id", "layer", "datatype", F.size("points").cast("long").alias("n_points"), F.array_min(xs).alias("min_x"), F.array_max(ys).alias("max_y"))


@query(
    "s2_layout_catalog",
    duck(r"""select path, case when path like '%.oas' then 'oas' else 'gds' end as format, case when path like '%.br' then 'br' when path like '%.gz' then 'gz' else 'none' end as compression,
      regexp_replace(split_part(path, '/', 3), '\.(gds|oas)(\.(br|gz))?$', '') as base, split_part(path, '/', 2) as shuttle from layout_files"""),
)
def s2(spark, sf):
    return catalog.layout_catalog(view(spark, sf, "layout_files"))


@query("s3_project_index", duck("select shuttle_id, macro, title, author, description, tiles, subtile_group from projects"))
def s3(spark, sf):
    """Write the index as JSON, one shuttle a file line, and read it back flat."""
    path = new_path(spark, "index")
    fields = ("macro", "title", "author", "description", "tiles", "subtile_group")
    nested = view(spark, sf, "projects").groupBy("shuttle_id").agg(F.collect_list(F.struct(*fields)).alias("projects"))
    shuttles = view(spark, sf, "shuttles").withColumnRenamed("template", "project_gds_url_template")
    shuttles.join(nested, F.col("id") == F.col("shuttle_id")).drop("shuttle_id", "pos").write.json(path)
    raw = spark.read.schema(catalog.SHUTTLE).json(path).withColumn("pos", F.monotonically_increasing_id())
    return catalog.flatten_project_index(raw)[1]


@query("s4_layer_slice", duck("select rect_id, x1, y1, x2, y2, net from flat where layer = 9"))
def s4(spark, sf):
    path = new_path(spark, "flat")
    tables.write_flat_rects(view(spark, sf, "flat"), path)
    return tables.read_layer(spark, path, 9).select("rect_id", "x1", "y1", "x2", "y2", "net")


@query("s4_window_tiles", duck("select box_id, rect_id, layer::bigint as layer from boxes a join flat b on b.layer in (9, 11) and a.x1 <= b.x2 and b.x1 <= a.x2 and a.y1 <= b.y2 and b.y1 <= a.y2"))
def s4_windows(spark, sf):
    """Two layers' rectangles in some windows, from the files that these meet."""
    path, boxes = new_path(spark, "tiles"), view(spark, sf, "boxes")
    tables.write_tiles(view(spark, sf, "flat"), path, 32)
    near = tables.read_windows(spark, path, boxes, [9, 11])
    return spatial.window_query(near, boxes).join(near.select("rect_id", F.col("layer").cast("long").alias("layer")), "rect_id").select("box_id", "rect_id", "layer")


@query(
    "s5_layer_offsets",
    duck(f"""with {_SPECS}, n as (select specs.layer::bigint as layer, count(flat.rect_id) as n from specs left join flat on flat.layer = specs.layer group by specs.layer)
      select layer, (sum(n) over (order by layer) - n)::bigint as start, (sum(n) over (order by layer))::bigint as "end" from n"""),
)
def s5(spark, sf):
    return tables.layer_offsets(view(spark, sf, "flat"))


@query("s6_write_netlist", duck("select gate, term0, term1, type, count(*) as n from fets group by all"))
def s6(spark, sf):
    path = new_path(spark, "netlist")
    tables.write_netlist(view(spark, sf, "fets"), view(spark, sf, "net_labels"), path)
    return spark.read.parquet(f"{path}/fets").groupBy("gate", "term0", "term1", "type").agg(F.count("*").alias("n"))


@query(
    "s7_parse_run_logs",
    duck(r"""select file_id, coalesce(max(nullif(regexp_extract(line, 'Total flat rects: (\d+)', 1), '')::bigint) filter (line like '%Total flat rects: %'), 0) as flat_rects,
      coalesce(max(nullif(regexp_extract(line, 'Wires: (\d+)', 1), '')::bigint) filter (line like '%Wires: %'), 0) as wires, coalesce(max(nullif(regexp_extract(line, 'FETs: (\d+)', 1), '')::bigint) filter (line like '%FETs: %'), 0) as fets,
      count(*) filter (line like '%Warning:%') as warnings, count(*) filter (line like '%Error:%') as errors from run_logs group by file_id"""),
)
def s7(spark, sf):
    return catalog.parse_run_logs(view(spark, sf, "run_logs"))


def _visible_sql(where: str, mode: str) -> str:
    drop = "not layer between 1 and 9" if mode == "cells" else "layer <> 19"
    return duck(f"""with {_SPECS}, pr as (select distinct f.layer, z_rank, exempt from flat f join specs on specs.layer = f.layer),
      zs as (select layer, row_number() over (order by z_rank, layer) - 1 as pos from pr where layer not in (3, 4)),
      k as (select pr.layer, exempt, pos from pr left join zs on zs.layer = case when pr.layer between 3 and 5 then 5 else pr.layer end)
      select rect_id, f.layer, net from flat f join k using (layer) where {drop} and {where}""")


@query("p8_visible_rects_range", _visible_sql("pos between 1 and 4 and (exempt or net not in (0, 1))", "standard"))
def p8_range(spark, sf):
    return analytics.visible_rects(view(spark, sf, "flat"), "standard", 1, 4, show_power=False).select("rect_id", "layer", "net")


@query("p8_visible_rects_solo", _visible_sql("layer = 10", "cells"))
def p8_solo(spark, sf):
    return analytics.visible_rects(view(spark, sf, "flat"), "cells", solo=10).select("rect_id", "layer", "net")


@query(
    "p15_search_projects",
    duck("""select shuttle_id, macro from projects where contains(lower(title), 'blue') or contains(lower(author), 'blue') or contains(lower(description), 'blue')
      or contains(lower(macro), 'blue') or contains(lower(tiles), 'blue')"""),
)
def p15(spark, sf):
    return catalog.search_projects(view(spark, sf, "projects"), "  Blue ").select("shuttle_id", "macro")


@query("p16_highlight", duck("select macro, regexp_replace(title, '(a)', '<mark>\\1</mark>', 'gi') as marked from projects"))
def p16(spark, sf):
    return view(spark, sf, "projects").select("macro", catalog.highlight(F.col("title"), "A").alias("marked"))


@query(
    "p17_layout_urls",
    duck("""with u as (select shuttle_id, macro, replace(coalesce(template, 'https://files.example.org/' || shuttle_id || '/{macro}/{macro}.gds'), '{macro}', coalesce(subtile_group, macro)) as url
      from projects join shuttles on id = shuttle_id)
      select shuttle_id, macro, url, url || '.br' as packed_url, 'https://api.example.org/' || shuttle_id || '/' || macro || '.json' as metadata_url from u"""),
)
def p17(spark, sf):
    default, api = "https://files.example.org/{shuttle}/{macro}/{macro}.gds", "https://api.example.org"
    return catalog.layout_urls(view(spark, sf, "projects"), view(spark, sf, "shuttles"), default, api)


@query(
    "p18_pin_descriptions",
    duck(r"""with k as (select net, name, case when name like '%]' then regexp_replace(name, '_(in|out)(\[\d+\])$', '\2') else name end as key from net_labels),
      d(pin, txt) as (values ('ui[0]', 'start'), ('uo[3]', 'VSync'), ('uo[7]', 'HSync'), ('clk', 'clock'), ('vgnd', 'ground'))
      select net, name, coalesce(a.txt, b.txt, '') as description from k left join d a on a.pin = key left join d b on b.pin = lower(key)"""),
)
def p18(spark, sf):
    pins = {"ui[0]": "start", "uo[3]": "VSync", "uo[7]": "HSync", "clk": "clock", "vgnd": "ground"}
    pinout = F.create_map(*(F.lit(x) for kv in pins.items() for x in kv))
    return catalog.pin_descriptions(view(spark, sf, "net_labels"), pinout)


@query("p19_flag_video", duck("select shuttle_id, macro, regexp_matches(lower(pinout), ':\"[^\"]*(hsync|vsync|vga)') as video from projects"))
def p19(spark, sf):
    return catalog.flag_video(view(spark, sf, "projects"))


_AREA = "(x2 - x1) * (y2 - y1)"
_BOX = "min(x1) as x1, min(y1) as y1, max(x2) as x2, max(y2) as y2"


@query("a1_net_stats", duck(f"select net, sum({_AREA})::bigint as area, {_BOX}, count(*) as n from flat where net >= 0 group by net"))
def a1(spark, sf):
    return analytics.net_stats(view(spark, sf, "flat"))


@query("a1_net_stats_by_file", duck(f"select file_id, net, sum({_AREA})::bigint as area, {_BOX}, count(*) as n from flat where net >= 0 group by file_id, net"))
def a1_files(spark, sf):
    return analytics.net_stats(view(spark, sf, "flat"), keys=["file_id"])


@query("a2_tree_stats_by_file", duck(f"select file_id, tree, sum({_AREA})::bigint as area, count(distinct net) as n_nets from flat where tree >= 0 group by file_id, tree"))
def a2_files(spark, sf):
    return analytics.tree_stats(view(spark, sf, "flat"), ["file_id"])


@query("a3_extent_by_file", duck(f"select file_id, {_BOX} from flat group by file_id"))
def a3_files(spark, sf):
    return analytics.extent(view(spark, sf, "flat"), ["file_id"])


_TREES = f"st as (select tree, sum({_AREA})::bigint as area, count(distinct net) as n_nets from flat where tree >= 0 group by tree)"


@query("a2_tree_stats", duck(f"with {_TREES} select * from st"))
def a2(spark, sf):
    return analytics.tree_stats(view(spark, sf, "flat"))


@query("a2_tree_nets", duck("select distinct tree, net from flat where tree >= 0 and net >= 0"))
def a2_nets(spark, sf):
    return analytics.tree_nets(view(spark, sf, "flat"))


@query("a3_extent", duck(f"select {_BOX} from flat"))
def a3(spark, sf):
    return analytics.extent(view(spark, sf, "flat"))


@query("a4_cell_bbox", duck(f"select cell, layer, {_BOX}, count(*) as n from cell_rects group by grouping sets ((cell, layer), (cell))"))
def a4(spark, sf):
    return hierarchy.cell_bbox(view(spark, sf, "cell_rects"))


@query(
    "a5_detect_pdk",
    duck(f"""with {_TAGS}, k as (select file_id, pdk, count(distinct layer_id) as n from polygons_tag p join tags t on t.layer = p.layer and t.datatype = p.datatype group by file_id, pdk),
      b as (select file_id, arg_max(pdk, n) as pdk, max(n) as n from k group by file_id)
      select f.file_id, case when n > 5 then pdk else 'sky130A' end as pdk, coalesce(n, 0)::bigint as n_layers from (select distinct file_id from polygons_tag) f left join b using (file_id)"""),
)
def a5(spark, sf):
    return shapes.detect_pdk(view(spark, sf, "polygons_tag"))


@query(
    "a6_netlist_summary",
    duck("""select file_id, layer, count(*) as rects, count(distinct inst_id) as instances, greatest(max(net) + 1, 2) as wires from flat group by grouping sets ((file_id, layer), (file_id))"""),
)
def a6(spark, sf):
    return analytics.netlist_summary(view(spark, sf, "flat"))


@query(
    "a6_netlist_totals",
    duck("""with f as (select *, instance % 5 as file_id from fets), sg as (select distinct file_id, rect_id as segment, net from flat),
      n as (select file_id, count(*) as segments, greatest(max(net) + 1, 2) as wires from sg group by file_id),
      i as (select distinct a.file_id, a.gate, a.term1 from f a join f b on a.file_id = b.file_id and a.gate = b.gate and a.term1 = b.term1 and a.term0 = 0 and b.term0 = 1)
      select n.*, coalesce(k.fets, 0) as fets, coalesce(j.inverters, 0) as inverters from n left join (select file_id, count(*) as fets from f group by file_id) k using (file_id)
        left join (select file_id, count(*) as inverters from i group by file_id) j using (file_id)"""),
)
def a6_totals(spark, sf):
    segments = view(spark, sf, "flat").select("file_id", F.col("rect_id").alias("segment"), "net").distinct()
    fets = view(spark, sf, "fets").withColumn("file_id", F.col("instance") % 5)
    return analytics.netlist_totals(segments, fets, ["file_id"])


@query(
    "a7_big_cells",
    duck("""with r as (select inst_id % 50 as cell, count(*) as rects, count(distinct net) as wires from flat group by 1 having count(*) > 900), f as (select instance % 50 as cell, count(*) as fets from fets group by 1)
      select cell, rects, wires, coalesce(fets, 0) as fets from r left join f using (cell)"""),
)
def a7(spark, sf):
    rects = view(spark, sf, "flat").select((F.col("inst_id") % 50).alias("cell"), F.col("net").alias("wire"))
    return analytics.big_cells(rects, view(spark, sf, "fets").withColumn("cell", F.col("instance") % 50), 900)


@query(
    "a8_cell_output_wires",
    duck("with e as (select unnest([term0, term1]) as net, type from fets) select net from e where net in (select net from net_labels) group by net having bool_or(type = 0) and bool_or(type = 1)"),
)
def a8(spark, sf):
    return analytics.cell_output_wires(view(spark, sf, "fets"), view(spark, sf, "net_labels"))


_BITS = r"""bits as (select l.net % 4 as file_id, regexp_extract(name, '^(.+)\[', 1) as base, regexp_extract(name, '\[(\d+)\]$', 1)::bigint as bit, max(value) as value
  from net_labels l join wire_states s on s.wire = l.net where name like '%]' and l.net > 1 group by all)"""


@query(
    "a9_bus_values",
    duck(f"""with {_BITS}, v as (select file_id, base, max(bit) + 1 as w, sum(value * (1::bigint << bit))::bigint as value from bits group by file_id, base)
      select file_id, base, greatest(w, case when base in ('ui_in', 'uo_out') then 8 else 0 end) as width, value, lpad(printf('%X', value), greatest(2, length(printf('%X', value)))::integer, '0') as hex from v"""),
)
def a9(spark, sf):
    named = names.parse_bus(view(spark, sf, "net_labels"))
    bits = named.join(view(spark, sf, "wire_states"), F.col("net") == F.col("wire"))
    return analytics.bus_values(bits.select((F.col("net") % 4).alias("file_id"), "base", "bit", "value"), ["file_id"])


@query(
    "a10_status_counts",
    duck("select pdk, status, id as shuttle_id, count(macro) as projects from shuttles left join projects on shuttle_id = id group by rollup (pdk, status, id)"),
)
def a10(spark, sf):
    return analytics.status_counts(view(spark, sf, "shuttles"), view(spark, sf, "projects"))


@query(
    "w1_top_trees_by_file",
    duck(f"""with st as (select file_id, tree, sum({_AREA})::bigint as area from flat where tree >= 0 group by file_id, tree),
      l as (select file_id, tree, area, coalesce(name || ' (Tree ' || tree || ')', 'Tree ' || tree) || ' (Area: ' || area || ')' as label from st left join net_labels on net = tree and file_id = net % 5)
      select file_id, tree, area, label from (select *, row_number() over (partition by file_id order by area desc, tree) as nth from l where contains(lower(label), 'tree 1')) where nth <= 20"""),
)
def w1_files(spark, sf):
    labels = view(spark, sf, "net_labels").withColumn("file_id", F.col("net") % 5)
    named = names.net_display_names(labels, keys=["file_id"])
    return analytics.top_trees(analytics.tree_stats(view(spark, sf, "flat"), ["file_id"]), named, "Tree 1", 20, ["file_id"])


@query(
    "w1_top_trees",
    duck(f"""with {_TREES}, l as (select tree, area, coalesce(name || ' (Tree ' || tree || ')', 'Tree ' || tree) || ' (Area: ' || area || ')' as label from st left join net_labels on net = tree)
      select * from l where contains(lower(label), 'tree 1') order by area desc, tree limit 20"""),
)
def w1(spark, sf):
    named = names.net_display_names(view(spark, sf, "net_labels"))
    return analytics.top_trees(analytics.tree_stats(view(spark, sf, "flat")), named, "Tree 1", 20)


@query(
    "w2_natural_order",
    duck(r"""select net, name, net % 3 as file_id, row_number() over (partition by net % 3 order by lower(regexp_replace(name, '\[\d+\]$', '')),
      coalesce(try_cast(regexp_extract(name, '\[(\d+)\]$', 1) as bigint), -1), name, net) as pos from net_labels"""),
)
def w2(spark, sf):
    labels = view(spark, sf, "net_labels").select("net", "name", (F.col("net") % 3).alias("file_id"))
    return names.natural_order(labels)


@query(
    "w3_layers_by_z",
    duck(f"""with {_SPECS} select s.layer::bigint as layer, layer_name, (row_number() over (order by z_rank desc, s.layer desc) - 1)::bigint as pos
      from specs s where s.layer in (select layer from flat)"""),
)
def w3(spark, sf):
    present = view(spark, sf, "flat").select("layer").distinct()
    specs = layers.layer_specs(spark).join(present, "layer")
    return analytics.layers_by_z(specs, flipped=True).select("layer", "layer_name", "pos")


@query("w4_unique_sorted", duck("select distinct gate, term0, term1, type from fets order by gate, term1, term0, type"))
def w4(spark, sf):
    return analytics.unique_sorted(view(spark, sf, "fets"))


@query("w5_latest_shuttles", duck("select * from shuttles order by pos desc"))
def w5(spark, sf):
    return analytics.latest_shuttles(view(spark, sf, "shuttles"))


@query(
    "w6_layout_changes",
    duck("""with b as (select distinct gate, term0, term1, type from fets where instance % 3 <> 0), a as (select distinct gate, term0, term1, type from fets where instance % 3 <> 1)
      select *, 'added' as change from (from a except from b) union all select *, 'removed' from (from b except from a) union all select *, 'kept' from (from a intersect from b)"""),
)
def w6(spark, sf):
    fets = view(spark, sf, "fets")
    before, after = (fets.where(F.col("instance") % 3 != k).select("gate", "term0", "term1", "type") for k in (0, 1))
    return analytics.layer_set_ops(before, after)


@query("j13_trees_to_nets", duck("select distinct net from flat where tree in (4, 100, 400) and net >= 0"))
def j13(spark, sf):
    return analytics.trees_to_nets(view(spark, sf, "flat"), [4, 100, 400])


@query("w_a_inverter_fanout_report", duck("""with i as (select distinct a.gate, a.term1 as out from fets a join fets b on a.gate = b.gate and a.term1 = b.term1 and a.term0 = 0 and b.term0 = 1)
  select gate, count(*) as outs from i group by gate order by outs desc, gate limit 100"""))
def inverter_fanout(spark, sf):
    """The gates that drive most inverters."""
    pairs = netlist.inverter_pairs(view(spark, sf, "fets"))
    return pairs.groupBy("gate").agg(F.count("*").alias("outs")).orderBy(F.desc("outs"), "gate").limit(100)


_MOVED = "select layer, x1 + case when rect_id % 1000 = 5 then 3 else 0 end as x1, y1, x2, y2, net from flat where rect_id % 900 <> 7"


@query(
    "w6_layout_diff",
    duck(f"""with a as (select layer, x1, y1, x2, y2, net from flat), b as ({_MOVED})
      select *, 'added' as change from (select * from b except select * from a) union all select *, 'removed' from (select * from a except select * from b)"""),
)
def w6_diff(spark, sf):
    """Some rectangles are moved, some are gone."""
    flat = materialize(view(spark, sf, "flat").select("rect_id", "layer", "x1", "y1", "x2", "y2", "net"), "flat")
    columns = ["layer", "x1", "y1", "x2", "y2", "net"]
    moved = flat.where("rect_id % 900 <> 7").withColumn("x1", F.col("x1") + F.when(F.expr("rect_id % 1000 = 5"), 3).otherwise(0))
    return analytics.layout_diff(flat.select(columns), moved.select(columns))
