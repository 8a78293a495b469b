"""Exact deduplication by a distributed content sort. Native: DataFrame functions only.

Normalised texts are range-partitioned with sampled splitters over (first characters, hash), sorted
inside each partition by Spark's external sort, and equal neighbours found by comparing whole texts. A
text that a bounded sample shows to be hot is dealt out over salts first; the few summary rows of those
texts are merged afterwards, so no partition ever holds one hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparklayout.llm.common import SPACE, sized
from sparklayout.sources.work import materialize

#: The sample that looks for hot texts has so many rows, and this share of all rows at least. A text is hot if it is
#: thought to have HOT_SHARE of all rows, or HOT_ROWS rows: no partition gets many more of one text, at any size.
SAMPLE_ROWS, SAMPLE_SHARE, HOT_SHARE, HOT_ROWS, SALTS = 20_000, 0.002, 0.002, 50_000, 64


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null becomes the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _hot_hashes(docs: DataFrame, text_col: str, total: int) -> DataFrame:
    """_hash of each hot text, written to a table."""
    share = min(1.0, max(SAMPLE_SHARE, SAMPLE_ROWS / max(1, total)))
    sampled = docs.select(text_col).sample(share, seed=7).select(F.xxhash64(normalised(F.col(text_col))).alias("_hash"))
    least = max(8, min(HOT_SHARE * total, HOT_ROWS) * share)
    return materialize(sampled.groupBy("_hash").count().where(F.col("count") >= least).select("_hash"), "hot")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their :func:`normalised` forms are. Null text counts as empty. The row with the
    least id stays (null ids last); of repeated rows with that same id exactly one has ``kept`` true.
    Other columns are not read, so their names cannot clash. An empty input gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_norm"))
    rows = rows.withColumn("_hash", F.xxhash64("_norm"))
    hot = _hot_hashes(docs, text_col, docs.select(id_col).count())
    any_hot = not hot.isEmpty()
    salt = F.lit(-1)
    if any_hot:
        rows = rows.join(sized(hot.withColumn("_is_hot", F.lit(True))), "_hash", "left")
        salt = F.when(F.col("_is_hot"), F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int")).otherwise(-1)
    rows = rows.select("_id", "_norm", "_hash", F.substring("_norm", 1, 16).alias("_head"), salt.alias("_salt"))
    same = ["_head", "_hash", "_salt", "_norm"]
    group = Window.partitionBy(*same)
    placed = rows.repartitionByRange("_head", "_hash", "_salt").select(
        "_id",
        "_salt",
        F.sha2("_norm", 256).alias("text_sha256"),
        F.min("_id").over(group).alias("keep_id"),
        F.count("*").over(group).alias("group_size"),
        F.row_number().over(group.orderBy(F.col("_id").asc_nulls_last())).alias("_nth"),
    )
    if any_hot:
        # SALTS summary rows for each hot text; their sha256 stands for the text here
        piece = placed.where("_salt >= 0 and _nth = 1")
        merged = piece.groupBy("text_sha256").agg(
            F.min("keep_id").alias("_keep"), F.sum("group_size").alias("_size"), F.min("_salt").alias("_first")
        )
        placed = placed.join(sized(materialize(merged, "hot_groups")), "text_sha256", "left")
        keep = F.when(F.col("_size").isNull(), F.col("keep_id")).otherwise(F.col("_keep"))
        # a group of null ids only has no least id; then the first salt's first row stays
        first = F.col("_size").isNull() | F.col("_id").eqNullSafe(F.col("_keep")) & (
            F.col("_keep").isNotNull() | (F.col("_salt") == F.col("_first"))
        )
        placed = placed.select(
            "_id",
            "text_sha256",
            keep.alias("keep_id"),
            F.coalesce("_size", "group_size").alias("group_size"),
            ((F.col("_nth") == 1) & first).alias("kept"),
        )
    else:
        placed = placed.withColumn("kept", F.col("_nth") == 1)
    return placed.select(F.col("_id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; rows repeated in full stay once.

    The decision is joined back by id and text digest, so that rows that share an id but not a text are
    judged apart.
    """
    own = F.unhex("text_sha256").alias("_sha")
    judged = exact_duplicates(docs, id_col, text_col).select(F.col(id_col).alias("_kept_id"), own, "kept")
    per_key = judged.groupBy("_kept_id", "_sha").agg(F.max("kept").alias("stays"), F.count("*").alias("times"))
    odd = materialize(per_key.where("not stays or times > 1").withColumnRenamed("_sha", "_kept_sha"), "duplicates")
    keyed = docs.withColumn("_sha", F.unhex(F.sha2(normalised(F.col(text_col)), 256)))
    same = F.col(id_col).eqNullSafe(F.col("_kept_id")) & (F.col("_sha") == F.col("_kept_sha"))
    once = keyed.join(sized(odd.select("_kept_id", "_kept_sha")), same, "left_anti")
    repeated = keyed.join(sized(odd.where("stays").select("_kept_id", "_kept_sha")), same, "left_semi").dropDuplicates([id_col, "_sha"])
    return once.select(*docs.columns).unionByName(repeated.select(*docs.columns))
