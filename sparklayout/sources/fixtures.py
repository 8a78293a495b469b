"""Layout-shaped views over the star-schema test tables, in one SQL text for Spark and DuckDB.

The texts use DuckDB's ``//`` for integer division and ``unnest(range(n))`` for a number list; for Spark
these two are rewritten. All arithmetic is on non-negative integers, where both engines agree.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "benchmark")

VIEWS: dict[str, str] = {
    # seven layers from POLY to MET2; density doesn't change with the scale
    "rects": """
select l_orderkey*8+l_linenumber as rect_id, cast(5+l_linenumber as bigint) as layer,
  (l_orderkey%400)*100 + min(l_partkey)%100 as x1, (l_orderkey//400)*100 + min(l_suppkey)%100 as y1,
  (l_orderkey%400)*100 + min(l_partkey)%100 + 10 + 2*cast(min(l_quantity) as bigint) as x2,
  (l_orderkey//400)*100 + min(l_suppkey)%100 + 10 + cast(max(l_quantity) as bigint) as y2
from lineitem group by l_orderkey, l_linenumber""",
    # inverters driver -> net, some pass gates
    "fets": """
select 2+(o_custkey*10)%o_orderkey as gate, cast(0 as bigint) as term0, 2+o_orderkey as term1, cast(1 as bigint) as type,
  o_orderkey as instance from orders where o_orderkey>0
union all
select 2+(o_custkey*10)%o_orderkey, case when o_orderstatus='P' then 2+o_orderkey//2 else 1 end, 2+o_orderkey,
  cast(0 as bigint), o_orderkey from orders where o_orderkey>0""",
    # some nets are on both rails at once
    "shorted_fets": """
select * from fets union all
select t as gate, cast(1-t as bigint) as term0, 2+o_orderkey as term1, t as type, o_orderkey as instance
from orders, (select cast(0 as bigint) as t union all select 1) x where o_orderkey%50=7""",
    "wire_states": """
select cast(0 as bigint) as wire, cast(0 as bigint) as value, true as known union all select 1, 1, true
union all select 2+o_orderkey, o_custkey%2, o_orderpriority<>'5-LOW' from orders""",
    "net_labels": """
select s_suppkey as net, cast(12+s_nationkey%5 as bigint) as layer,
  case when s_suppkey=0 then 'VGND' when s_suppkey=1 then 'VPWR' when s_suppkey%11=3 then 'vccd1' when s_suppkey=2 then 'clk'
       when s_suppkey=4 then 'rst_n' when s_suppkey%3=0 then 'ui_in['||(s_suppkey//3)%8||']'
       when s_suppkey%3=1 then 'uo_out['||(s_suppkey//3)%8||']' else 'count['||(s_suppkey//3)%16||']' end as name
from supplier""",
    # rectangle, L and U with noise below one unit
    "poly_points": """
select poly_id, cast(i as bigint) as pt_idx, cast(x0+10*fx+0.25 as double) as x, cast(y0+fy*(h//2)-0.25 as double) as y
from (select o_orderkey as poly_id, o_orderkey%3 as shape, 40+2*(o_custkey%10) as h, (o_orderkey%400)*200 as x0,
        (o_orderkey//400)*200 as y0 from orders) o
join (select 0 as shape2, 0 as i, 0 as fx, 0 as fy union all select 0,1,6,0 union all select 0,2,6,2 union all select 0,3,0,2
  union all select 1,0,0,0 union all select 1,1,6,0 union all select 1,2,6,1 union all select 1,3,3,1 union all select 1,4,3,2
  union all select 1,5,0,2 union all select 2,0,0,0 union all select 2,1,6,0 union all select 2,2,6,2 union all select 2,3,4,2
  union all select 2,4,4,1 union all select 2,5,2,1 union all select 2,6,2,2 union all select 2,7,0,2) t on o.shape=t.shape2""",
    "polygons_tag": """
select o_orderkey as poly_id, 64+o_custkey%10 as layer, cast(case when o_orderkey%2=0 then 20 else 44 end as bigint) as datatype,
  o_orderkey%7 as file_id from orders""",
    # top -> region -> nation -> leaf cells, which come in groups of twenty; the second of a group has a filler's
    # name and yet places the first
    "refs": """
select 'top' as parent, cast(r_regionkey as bigint) as ref_idx, 'r'||r_regionkey as child, cast(r_regionkey%4 as bigint) as quad,
  cast(0 as bigint) as refl, cast(r_regionkey as bigint)*2000000 as ox, cast(0 as bigint) as oy from region
union all select 'r'||n_regionkey, cast(n_nationkey as bigint), 'n'||n_nationkey, cast(n_nationkey%4 as bigint),
  cast(n_nationkey%2 as bigint), cast(n_nationkey as bigint)*50000, cast(n_nationkey as bigint)*1000 from nation
union all select 'k'||(20*g+1), cast(0 as bigint), 'k'||(20*g), cast(1 as bigint), cast(0 as bigint), cast(30 as bigint), cast(20 as bigint)
  from (select distinct p_partkey//200 as g from part)
union all select 'n'||c_nationkey, c_custkey, 'k'||(c_custkey//200*20+c_custkey%20), c_custkey%4, (c_custkey//4)%2, (c_custkey%300)*100,
  (c_custkey//300)*100 from customer""",
    "raw_refs": """
select parent, ref_idx, child, cast(quad as double)*1.5707963267948966 as rotation,
  cast(case when ref_idx%13=0 and parent like 'n%' then 1.5 else 1.0 end as double) as mag, refl=1 as x_reflection,
  cast(ox as double)+case when ref_idx%17=0 and parent like 'n%' then 0.5 else 0.0 end as ox, cast(oy as double) as oy from refs""",
    "cells": """
select distinct 'k'||k as cell, case k%20%6 when 0 then 'sky130_fd_sc_hd__inv_'||k when 1 then 'sky130_fd_sc_hd__fill_'||k
  when 2 then 'sg13g2_decap_'||k when 3 then 'gf180mcu_fd_sc__nand2_'||k when 4 then 'sg13g2_fill_'||k else 'my_macro_'||k end as name
from (select p_partkey//200*20+p_partkey%20 as k from part)""",
    "cell_rects": """
select 'k'||(p_partkey//200*20+p_partkey%20) as cell, p_partkey as rect_id, 8+2*(p_partkey%3) as layer,
  ((p_partkey//20)%5)*20 as x1, ((p_partkey//100)%2)*50 as y1, ((p_partkey//20)%5)*20+10+p_size%20 as x2,
  ((p_partkey//100)%2)*50+30+p_size%20 as y2, p_partkey%200//40 as wire from part""",
    "samples": """
select cast(0 as bigint) as stream_id, event_id as tick, ts, cast(user_id%32 as bigint) as wire,
  cast(case when event_type in ('click','purchase','signup') then 1 else 0 end as bigint) as value from events""",
    "raster_ticks": """
select cast(0 as bigint) as stream_id, event_id as tick, cast(case when event_id%100<12 then 1 else 0 end as bigint) as hsync,
  cast(case when event_id%5000<200 then 1 else 0 end as bigint) as vsync, cast(round(value*100) as bigint)%64 as rgb from events""",
    "serial_bytes": """
select item_id as stream_id, cast(k as bigint) as k, 32+(item_id*7+k*13)%95 as byte from benchmark,
  (select unnest(range(4)) as k)""",
    "serial_levels": """
select stream_id, 100+k*2500+233*j as tick,
  cast(case when j=0 then 0 when j=9 then 1 else (byte // cast(power(2, greatest(j-1, 0)) as bigint)) % 2 end as bigint) as tx
from serial_bytes, (select unnest(range(10)) as j)""",
    "spi_xfers": """
select o_orderkey as xfer, o_orderkey%16 as stream_id, o_custkey%3 as device,
  cast(case o_orderkey%3 when 0 then 2 when 1 then 3 else 11 end as bigint) as command,
  (o_orderkey*7919)%16777216 as address, 1+o_custkey%4 as nbytes from orders""",
    "spi_bytes": """
select x.*, i, case when i=0 then command when i=1 then (address//65536)%256 when i=2 then (address//256)%256
  when i=3 then address%256 else (xfer+(i-4)*37)%256 end as byte
from spi_xfers x, (select unnest(range(8)) as i) where i<4+nbytes""",
    "spi_samples": """
select stream_id, xfer*1000+(i*8+bit)*2+ph as tick, cast(case when device=0 then 0 else 1 end as bigint) as cs,
  cast(case when device=1 then 0 else 1 end as bigint) as ram_a, cast(case when device=2 then 0 else 1 end as bigint) as ram_b,
  cast(ph as bigint) as sclk,
  cast(case when i<4 or command=2 then (byte // cast(power(2, 7-bit) as bigint)) % 2 else 0 end as bigint) as mosi,
  cast(case when i>=4 and command<>2 then (byte // cast(power(2, 7-bit) as bigint)) % 2 else 1 end as bigint) as miso
from spi_bytes, (select unnest(range(8)) as bit), (select unnest(range(2)) as ph)
union all select stream_id, xfer*1000+999, 1,1,1,0,0,1 from spi_xfers""",
    "shuttles": """
select cast(r_regionkey as bigint) as pos, 'tt'||r_regionkey as id, r_name as name,
  case r_regionkey%3 when 0 then 'sky130A' when 1 then 'ihp-sg13g2' else 'gf180mcuD' end as pdk,
  case when r_regionkey=4 then 'open' else 'closed' end as status,
  case when r_regionkey%2=0 then 'https://layouts.example.org/'||r_regionkey||'/{macro}.gds' end as template from region""",
    "projects": """
select 'tt'||(p_partkey%5) as shuttle_id, 'um_'||replace(p_name,' ','_')||'_'||p_partkey as macro, p_name as title,
  p_brand as author, p_type as description, (1+p_size%4)||'x'||(1+p_size%2) as tiles,
  case when p_partkey%17=0 then 'um_group_'||(p_partkey//17)%9 end as subtile_group,
  case when p_partkey%6=0 then '{"uo[3]":"VSync","uo[7]":"HSync"}' else '{"ui[0]":"start"}' end as pinout from part""",
    "layout_files": """
select 'gds/'||shuttle_id||'/'||macro||case length(macro)%4 when 0 then '.gds' when 1 then '.gds.br' when 2 then '.gds.gz' else '.oas' end as path
from projects""",
    "run_logs": """
select o_orderkey%40 as file_id, o_orderkey as line_no,
  case o_orderkey//40 when 0 then 'Total flat rects: '||(1000+o_custkey) when 1 then '  Wires: '||(10+o_custkey)
    when 2 then '  FETs: '||(20+o_custkey) when 3 then 'Warning: skipping unsupported reference' else
    case when o_custkey%9=0 then 'Error: unable to load library' when o_custkey%2=0 then 'Warning: malformed' else 'ok' end end as line
from orders""",
    # flat rectangles with made-up nets and trees, a third of them on the rails
    "flat": """
select rect_id, layer, x1, y1, x2, y2, case when rect_id%11=0 then -1 when rect_id%3=0 then rect_id%2 else rect_id%997 end as net,
  case when rect_id%11=0 then -1 when rect_id%3=0 then rect_id%2 else rect_id%997-rect_id%997%4 end as tree,
  rect_id%5 as file_id, rect_id//64 as inst_id from rects""",
    "cell_fets": """
select 'k'||(p_partkey//200*20+p_partkey%20) as cell, p_partkey%200//40 as gate, (p_partkey//20)%5 as term0, (p_partkey//100)%2 as term1,
  p_partkey%2 as type from part""",
    "cell_labels": """
select distinct 'k'||(p_partkey//200*20+p_partkey%20) as cell, 'P'||(p_partkey%7) as text, p_partkey%200//40 as wire from part""",
    "label_points": """
select rect_id as label_id, layer, x1+rect_id%3 as x, y1 as y, 'L'||(rect_id%97) as text from rects where rect_id%50<2
union all select rect_id, layer, x1+1000000, y1, 'miss' from rects where rect_id%500=3""",
    "boxes": """
select cast(n_nationkey as bigint) as box_id, cast(n_nationkey as bigint)*1500 as x1, cast((n_nationkey*13)%300 as bigint) as y1,
  cast(n_nationkey as bigint)*1500+900 as x2, cast((n_nationkey*13)%300+60 as bigint) as y2 from nation""",
    "devs": "select o_orderkey as cell, 1+o_custkey%3 as g, o_custkey as c from orders",
    # one N and one P diffusion, gates across both, a well over the P half
    "dev_rects": """
select cell, cast(2 as bigint) as layer, cast(0 as bigint) as rect_id, cast(0 as bigint) as x1, cast(0 as bigint) as y1,
  cast(100 as bigint) as x2, cast(20 as bigint) as y2, cast(-1 as bigint) as wire from devs
union all select cell, 2, 1, 0, 60, 100, 80, -1 from devs
union all select cell, 1, 2, -5, 50, 105, 95, -1 from devs
union all select cell, 6, 3+i, 20+30*i, -5, 26+30*i, 85, case when c%11=0 then 0 else 10+i end
from devs, (select unnest(range(3)) as i) where i<g""",
    "dev_terms": """
select cell, cast(4+p as bigint) as layer, cast(10*p+j as bigint) as rect_id, cast(case when j=0 then 0 else 26+30*(j-1) end as bigint) as x1,
  cast(60*p as bigint) as y1, cast(case when j=g then 100 else 20+30*j end as bigint) as x2, cast(60*p+20 as bigint) as y2,
  cast(2+j+4*p as bigint) as wire
from devs, (select unnest(range(4)) as j), (select unnest(range(2)) as p) where j<=g and not (c%7=0 and p=0 and j=0)""",
    "path_points": """
select o_orderkey as path_id, 2*(1+o_custkey%5) as width, cast(i as bigint) as pt_idx,
  (o_orderkey%400)*200+case when i>=1 then 60 else 0 end as x, (o_orderkey//400)*200+case when i>=2 then 80 else 0 end as y
from orders, (select unnest(range(3)) as i)""",
    "repeated": """
select o_orderkey as item_id, o_custkey%100 as x, o_custkey%70 as y, 1+o_custkey%3 as n_cols, 1+o_custkey%4 as n_rows,
  40+o_custkey%9 as dx, 30+o_custkey%5 as dy from orders""",
    # two files of inverter chains: sixteen a row, every other row upside down
    "chip_places": """
select file_id, k, k//16 as r, k%16 as c, cast((k//16)%2 as bigint) as odd from (
  select o_orderkey%2 as file_id, cast(row_number() over (partition by o_orderkey%2 order by o_orderkey) as bigint)-1 as k from orders) t""",
    "id_texts": """
select o_orderkey as text_id, o_custkey||', '||(o_custkey%50)||'-'||(o_custkey%60)||' x7 '||(o_orderkey%9) as text
from orders""",
}


def _needs(text: str, known: tuple[str, ...] | list[str]) -> list[str]:
    words = set(re.findall(r"\b[a-z_0-9]+\b", re.sub(r"'[^']*'", "", text)))
    return [k for k in known if k in words]


def _closure(text: str) -> list[str]:
    """The views that a query uses, in an order in which each follows those that it uses."""
    out: list[str] = []

    def visit(t: str) -> None:
        for name in _needs(t, list(VIEWS)):
            if name not in out:
                visit(VIEWS[name])
                out.append(name)

    visit(text)
    return out


def duck(body: str, recursive: bool = False) -> str:
    """A DuckDB query over the views: ``body`` may itself start with ``with``."""
    body = body.strip()
    own = body.lower().startswith("with ")
    body = re.sub(r"(?i)^with\s+(recursive\s+)?", "", body) if own else body
    views = ",\n".join(f"{name} as ({VIEWS[name].strip()})" for name in _closure(body))
    head = "with recursive " if recursive else "with "
    return head + views + (",\n" if own else "\n") + body if views else (head if own else "") + body


def _spark_text(text: str) -> str:
    text = re.sub(r"unnest\(range\((\w+)\)\)", r"explode(sequence(0, \1 - 1))", text)
    parts = text.split("'")  # every second part is a string literal
    return "'".join(x if i % 2 else x.replace("//", " div ") for i, x in enumerate(parts))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view as a DataFrame over the Parquet tables of ``sf_dir``."""
    chain = [*_closure(VIEWS[name]), name]
    tables = _needs(" ".join(VIEWS[v] for v in chain), TABLES)
    parts = [f"{t} as (select * from parquet.`{sf_dir}/{t}.parquet`)" for t in tables]
    parts += [f"{v} as ({_spark_text(VIEWS[v])})" for v in chain]
    return spark.sql(f"with {', '.join(parts)} select * from {name}")
