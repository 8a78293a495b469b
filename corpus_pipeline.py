"""A training-corpus pipeline over ``documents``: judge, deduplicate, decontaminate, encode.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame;
all but the last return the columns of ``documents``. Between stages the rows are written and read again.

In every stage: an empty table gives an empty table. Documents are judged by their doc_id, so rows that share one are
kept or dropped together (but for exact duplicates), and rows with a null doc_id, which nothing can name, stay. Texts
are worked on whole, however long. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparklayout.llm.byte_bpe import encode_documents
from sparklayout.llm.common import table
from sparklayout.llm.decontaminate import drop_contaminated
from sparklayout.llm.exact_dedup import drop_exact_duplicates
from sparklayout.llm.ngram_join import drop_near_duplicates
from sparklayout.llm.quality_model import drop_low_quality
from sparklayout.sources.work import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's limit; the model learns from good labels.

    Null, empty and blank texts go; repeated rows are judged alike; without good labels all other texts stay.
    """
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return drop_low_quality(docs, trusted)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal normalised texts, the one with the least doc_id (null last).

    Null and empty texts are one group; of rows repeated in full one stays.
    """
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, the one with the least doc_id.

    Null and blank texts link with nothing and stay; rows that repeat a doc_id that stays, stay.
    """
    return drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null, empty and blank texts and items match nothing.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left: doc_id, n_tokens, ids, digests.

    Null and empty texts have no tokens; repeated rows each have their row.
    """
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", quality),
    ("exact_dedup", exact),
    ("ngram_jaccard_join", near),
    ("benchmark_decontamination", decontaminated),
    ("byte_bpe", encoded),
]

#: SQL cannot express the language model; the stages are tested one by one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
