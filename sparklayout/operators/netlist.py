"""Netlist graphs: inverters, trees, channel groups, conduction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklayout.operators.graph import connected_components
from sparklayout.sources.work import materialize


def inverter_pairs(fets: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, gate, out: a device from ground and one from power to the same net under the same gate."""
    keys = keys or []
    has = lambda rail: F.max(F.col("term0") == rail)
    pairs = fets.groupBy(*keys, "gate", F.col("term1").alias("out")).agg(has(0).alias("_low"), has(1).alias("_high"))
    return pairs.where("_low and _high").select(*keys, "gate", "out")


def inverter_trees(nets: DataFrame, fets: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, net, tree: nets joined by inverters; a tree is named by the net in it that no inverter drives (the
    least such), or by its least net where all are driven. Other nets are trees of their own."""
    keys = keys or []
    pairs = materialize(inverter_pairs(fets, keys), "inverters")
    comps = materialize(connected_components(nets.select(*keys, "net"), pairs, vertex="net", src="gate", dst="out", keys=keys), "trees")
    driven = pairs.select(*keys, F.col("out").alias("net")).distinct().withColumn("_driven", F.lit(True))
    marked = comps.join(driven, [*keys, "net"], "left")
    roots = marked.groupBy(*keys, "component").agg(F.coalesce(F.min(F.when(F.col("_driven").isNull(), F.col("net"))), F.min("net")).alias("tree"))
    return comps.join(roots, [*keys, "component"]).select(*keys, "net", "tree")


def channel_groups(fets: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, net, group: nets joined through channels, never through a rail."""
    keys = keys or []
    nets = fets.select(*keys, F.explode(F.array("term0", "term1")).alias("net")).where("net >= 2")
    edges = fets.where("term0 >= 2 and term1 >= 2").select(*keys, "term0", "term1")
    return connected_components(nets, edges, vertex="net", src="term0", dst="term1", label="group", keys=keys)


def neighborhood_edges(fets: DataFrame, groups: DataFrame, net: int, states: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, gate, term0, term1, type, instance, open: the devices that touch the channel group of ``net`` (in each file) by a
    terminal or the gate. Open: null where the gate's value isn't known."""
    keys = keys or []
    members = groups.join(groups.where(F.col("net") == net).select(*keys, "group"), [*keys, "group"], "left_semi").select(*keys, "net")
    alone = fets.select(*keys, F.lit(net).cast("long").alias("net")).distinct()
    inside = members.unionByName(alone).distinct()
    ends = fets.select("*", F.explode(F.array("gate", "term0", "term1")).alias("net"))
    touching = ends.join(inside, [*keys, "net"], "left_semi").select(*fets.columns).distinct()
    known = states.where("known").select(*keys, F.col("wire").alias("gate"), "value")
    return touching.join(known, [*keys, "gate"], "left").select(*fets.columns, (F.col("value") == F.col("type")).alias("open"))


def neighborhood_nodes(edges: DataFrame, labels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, net, name: all nets of the edges, with a display name where there is one."""
    keys = keys or []
    nets = edges.select(*keys, F.explode(F.array("gate", "term0", "term1")).alias("net")).distinct()
    return nets.join(labels.select(*keys, "net", "name"), [*keys, "net"], "left")


def fanout(fets: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, gate, net: the nets (no rails) that a gate's devices connect."""
    return fets.select(*(keys or []), "gate", F.explode(F.array("term0", "term1")).alias("net")).where("net >= 2").distinct()


def net_adjacency(fets: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, net, other, gate, type: both directions of every channel whose first end is no rail."""
    keys = keys or []
    there = fets.select(*keys, F.col("term0").alias("net"), F.col("term1").alias("other"), "gate", "type")
    back = fets.select(*keys, F.col("term1").alias("net"), F.col("term0").alias("other"), "gate", "type")
    return there.unionByName(back).where("net >= 2").distinct()


def affected_nets(changed: DataFrame, fan: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, net: what has to be looked at again after the gates ``changed`` (keys, net) changed."""
    keys = keys or []
    return fan.join(changed.select(*keys, F.col("net").alias("gate")), [*keys, "gate"], "left_semi").select(*keys, "net").distinct()


def conducting_fets(fets: DataFrame, states: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The devices that are open: a gate at 1 for N, at 0 for P."""
    keys = keys or []
    return fets.join(states.select(*keys, F.col("wire").alias("gate"), "value"), [*keys, "gate"]).where("value = type").select(*fets.columns)


def resolve_drive(fets: DataFrame, states: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, net, grp, mask, value, unknown: one static pass over all nets from 2 on.

    Nets joined by open devices are a group. The mask has bit 1 for ground and bit 2 for power; a group on
    power alone is 1, on ground or both 0, on neither keeps its nets' values. Unknown: some device at one of
    the group's nets has a gate of unknown value.
    """
    keys = keys or []
    by_net, by_group = [*keys, "net"], [*keys, "grp"]
    nets = states.where("wire >= 2").select(*keys, F.col("wire").alias("net"))
    known = states.where("known").select(*keys, "wire", "value")
    opened = conducting_fets(fets, known, keys)
    inner = opened.where("term0 >= 2 and term1 >= 2").select(*keys, "term0", "term1")
    comps = connected_components(nets, inner, vertex="net", src="term0", dst="term1", label="grp", keys=keys)
    rails = opened.where("term0 < 2 and term1 >= 2").select(*keys, F.col("term1").alias("net"), (F.col("term0") + 1).alias("bit"))
    masks = comps.join(rails, by_net).groupBy(*by_group).agg(F.bit_or("bit").alias("mask"))
    shut = fets.join(known.select(*keys, F.col("wire").alias("gate")), [*keys, "gate"], "left_anti")
    unsure = shut.select(*keys, F.explode(F.array("term0", "term1")).alias("net")).where("net >= 2").join(comps, by_net).select(*by_group).distinct()
    rows = comps.join(masks, by_group, "left").join(unsure.withColumn("_unsure", F.lit(True)), by_group, "left")
    rows = rows.join(states.select(*keys, F.col("wire").alias("net"), F.col("value").alias("_was")), by_net)
    mask = F.coalesce("mask", F.lit(0)).cast("long")
    value = F.when(mask == 2, 1).when(mask == 0, F.col("_was")).otherwise(0).cast("long")
    return rows.select(*by_net, "grp", mask.alias("mask"), value.alias("value"), F.coalesce("_unsure", F.lit(False)).alias("unknown"))


def short_report(drives: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, grp, nets: groups on both rails and how many nets they have."""
    return drives.where("mask = 3").groupBy(*(keys or []), "grp").agg(F.count("*").alias("nets"))


def state_diff(before: DataFrame, after: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, wire, before, after, flipped: full outer; a wire that only one side has counts as flipped."""
    on = [*(keys or []), "wire"]
    b, a = before.select(*on, F.col("value").alias("before")), after.select(*on, F.col("value").alias("after"))
    return b.join(a, on, "full").withColumn("flipped", ~F.col("before").eqNullSafe(F.col("after")))
