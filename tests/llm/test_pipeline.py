"""The pipeline's stages on the smallest tables, and the registered queries against SQL."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparklayout.llm import html_extract, queries
from sparklayout.llm.common import table

P = pytest.importorskip("public_tokenizers")

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_only_remove(spark):
    docs = table(spark, FOLDER, "documents")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, FOLDER), name)
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and now < ids, name
        ids = now
    out = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert {r["doc_id"] for r in out.where("exact").collect()} == ids


def test_good_labels_stay(spark):
    good = {r["doc_id"] for r in table(spark, FOLDER, "labels").where("quality = 1").collect()}
    judged = queries.queries()["op5_quality_model"](spark, FOLDER)
    kept = {r["doc_id"] for r in judged.where("keep").collect()}
    assert len(good & kept) >= 0.97 * len(good)


def test_stages_with_odd_rows(spark):
    """Null, blank, repeated and very long texts, null ids, extra columns; and an empty table."""
    docs = table(spark, FOLDER, "documents").limit(150)
    (text,) = docs.where("length(text) between 300 and 3000").select("text").first()
    odd = [(9001, None), (9002, ""), (9003, " \n"), (9004, text), (9004, text), (9005, text + " "), (None, text), (9006, text + (" " + text) * 300)]
    names = docs.columns
    rows = spark.createDataFrame(odd, "doc_id long, text string")
    for c in names:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast(docs.schema[c].dataType))
    rows = docs.unionByName(rows).withColumns({"keep": F.lit("x"), "n_tokens": F.lit("y"), "component_id": F.lit(1), "item_id": F.lit(2)})
    now = rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = now.count()
        now = corpus_pipeline.materialize(stage(spark, now, FOLDER), name)
        assert now.columns == rows.columns and 0 < now.count() <= before, name
        assert stage(spark, rows.limit(0), FOLDER).count() == 0, name
    assert now.where("doc_id in (9001, 9002, 9003)").count() == 0
    assert now.where(F.trim("text") == text.strip()).count() <= 1
    assert corpus_pipeline.STAGES[-1][1](spark, now, FOLDER).count() == now.count()


def test_registered_encoders_equal_the_libraries(spark):
    import tiktoken
    from tokenizers import Tokenizer

    docs = [(r["doc_id"], r["text"] or "") for r in table(spark, FOLDER, "documents").orderBy("doc_id").collect()]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {}
    for i, text in docs:
        ids = own.encode_ordinary(text)
        want[i] = (len(ids), sha(",".join(map(str, ids)).encode()), sha(text.encode()))
    got = queries.queries()["op1_byte_bpe"](spark, FOLDER)
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got.collect()} == want
    words, start, want = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0, {}
    for i, text in docs:
        ids = [*words.encode(text, add_special_tokens=False).ids, 2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = queries.queries()["op4_token_files"](spark, FOLDER)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in got.collect()} == want


def test_held_out_language_accuracy(spark):
    got = queries.queries()["op3_language_id"](spark, FOLDER).join(table(spark, FOLDER, "documents").select("doc_id", "lang"), "doc_id")
    rows = [(r["lang"], r["lang_pred"]) for r in got.where("held_out and lang is not null and lang_pred <> 'und'").collect()]
    assert len(rows) > 20 and sum(a == b for a, b in rows) >= 0.95 * len(rows)


def test_page_query_equals_a_plain_run(spark):
    """Page after page in plain Python: partners by sorted paths, aligned, and the rest of the rules."""
    pages = [tuple(r) for r in table(spark, FOLDER, "pages").select("page_id", "url", "html").collect()]
    split = lambda u: (re.split(r"[/?#]", (u or "").partition("://")[2])[0], re.split(r"[?#]", re.sub(r"^[^/?#]*", "", (u or "").partition("://")[2]))[0])
    by_path = {}
    for i, url, html in pages:
        host, path = split(url)
        key = ("".join(c.lower() if "A" <= c <= "Z" else c for c in host), path)
        by_path.setdefault(key, []).append((url or "", i, html_extract.lines_of(html)))
    keys = sorted(by_path, key=lambda k: (k[0].encode(), k[1].encode()))
    want = {}
    for n, key in enumerate(keys):
        before = keys[n - 1] if n and keys[n - 1][0] == key[0] else None
        after = keys[n + 1] if n + 1 < len(keys) and keys[n + 1][0] == key[0] else None
        other = max(by_path[before])[2] if before else min(by_path[after])[2] if after else None
        for _, i, lines in by_path[key]:
            want[i] = html_extract.main_text(lines, other)
    got = {r["page_id"]: r["text"] for r in queries.queries()["op2_html_extraction"](spark, FOLDER).collect()}
    assert got == want


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    df = queries.queries()[name](spark, FOLDER)
    cursor = con.execute(queries.oracle_sql()[name])
    order = [d[0] for d in cursor.description]
    assert sorted(order) == sorted(df.columns)
    want = sorted((tuple(r) for r in cursor.fetchall()), key=str)
    assert sorted((tuple(r) for r in df.select(*order).collect()), key=str) == want
