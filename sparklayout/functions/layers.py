"""Layer numbers, process layer maps and drawing order as small dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Layer numbers.
ERROR, NWELL, DIFF, CHANNEL, N_TERM, P_TERM, POLY, LICON, LI1, MCON = range(10)
MET1, VIA1, MET2, VIA2, MET3, VIA3, MET4, VIA4, MET5, CELLS = range(10, 20)
LAYER_NAMES = (
    "ERROR NWELL DIFF CHANNEL N_TERM P_TERM POLY LICON LI1 MCON MET1 VIA1 MET2 VIA2 MET3 VIA3 MET4 VIA4 MET5 CELLS"
).split()

# Fixed values: (layer, datatype) tags of each process, by layer.
TAGS: dict[str, dict[int, list[tuple[int, int]]]] = {
    "sky130A": {
        NWELL: [(64, 20)],
        DIFF: [(65, 20)],
        POLY: [(66, 20)],
        LICON: [(66, 44)],
        LI1: [(67, 20), (67, 5)],
        MCON: [(67, 44)],
        MET1: [(68, 20), (68, 5)],
        VIA1: [(68, 44)],
        MET2: [(69, 20), (69, 5)],
        VIA2: [(69, 44)],
        MET3: [(70, 20), (70, 5)],
        VIA3: [(70, 44)],
        MET4: [(71, 20), (71, 5)],
        VIA4: [(71, 44)],
        MET5: [(72, 20)],
    },
    "ihp-sg13g2": {
        NWELL: [(31, 0)],
        DIFF: [(1, 0)],
        POLY: [(5, 0)],
        LICON: [(6, 0)],
        LI1: [(8, 0), (8, 1), (8, 2), (8, 25)],
        MCON: [(19, 0)],
        MET1: [(10, 0), (10, 25)],
        VIA1: [(29, 0)],
        MET2: [(30, 0), (30, 25)],
        VIA2: [(49, 0)],
        MET3: [(50, 0), (50, 25)],
        VIA3: [(66, 0)],
        MET4: [(67, 0), (67, 25)],
        VIA4: [(125, 0)],
        MET5: [(126, 0), (126, 2), (126, 25)],
    },
    "gf180mcuD": {
        NWELL: [(21, 0)],
        DIFF: [(22, 0)],
        POLY: [(30, 0)],
        LICON: [(33, 0)],
        LI1: [(34, 0), (34, 10)],
        MCON: [(35, 0)],
        MET1: [(36, 0)],
        VIA1: [(38, 0)],
        MET2: [(42, 0)],
        VIA2: [(40, 0)],
        MET3: [(46, 0), (46, 10)],
        VIA3: [(41, 0)],
        MET4: [(81, 0)],
    },
}

#: Drawing order: layers of one rank are drawn together; every rank is above the one before.
Z_RANK = {ERROR: 99, NWELL: 0, DIFF: 1, CHANNEL: 1, N_TERM: 1, P_TERM: 1, POLY: 2, LICON: 3, CELLS: 0} | {
    layer: layer - 4 for layer in range(LI1, CELLS)
}
#: Layers on which the rail nets are shown even where rails are hidden.
EXEMPT = (N_TERM, P_TERM, LICON)


def layer_map(spark: SparkSession) -> DataFrame:
    """pdk, layer, datatype, layer_id: one row a tag, fewer than a hundred in all."""
    rows = [(pdk, a, b, layer) for pdk, layers in TAGS.items() for layer, tags in layers.items() for a, b in tags]
    return spark.createDataFrame(rows, "pdk string, layer long, datatype long, layer_id int")


def layer_specs(spark: SparkSession) -> DataFrame:
    """layer, layer_name, z_rank, exempt: one row for each of the twenty layers."""
    rows = [(i, name, Z_RANK[i], i in EXEMPT) for i, name in enumerate(LAYER_NAMES)]
    return spark.createDataFrame(rows, "layer long, layer_name string, z_rank int, exempt boolean")


def tags_sql() -> str:
    """The same tags as a DuckDB values list."""
    return ", ".join(
        f"('{pdk}', {a}, {b}, {layer})" for pdk, layers in TAGS.items() for layer, tags in layers.items() for a, b in tags
    )


def specs_sql() -> str:
    """The same layers as a DuckDB values list."""
    return ", ".join(f"({i}, '{n}', {Z_RANK[i]}, {str(i in EXEMPT).lower()})" for i, n in enumerate(LAYER_NAMES))
