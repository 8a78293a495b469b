"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklayout.llm import (
    byte_bpe,
    chat_format,
    decontaminate,
    exact_dedup,
    fingerprints,
    hard_negatives,
    html_extract,
    language_id,
    ngram_join,
    quality_model,
    token_alignment,
    token_files,
    url_filter,
)
from sparklayout.llm.common import table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]):
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


@_query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again by the public rank file."""
    import public_tokenizers

    encoded = byte_bpe.encode_documents(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
        ids=False,
    )
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "exact")


@_query
def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.extract_main_text(table(spark, sf_dir, "pages"))


@_query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the documents that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    trained = language_id.train_profiles(docs.where(~held_out))
    found = language_id.predict_languages(docs, trained)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@_query
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to record files and read back."""
    import public_tokenizers

    index = token_files.write_token_files(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2
    )
    return token_files.read_token_files(index).select("doc_id", "start", "n_tokens", "ids_crc32")


@_query
def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that quotes control strings, digested after reading the output back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    quoting = spark.sql(
        """select * from values (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]')
        as t(conv_id, turn, role, text)"""
    )
    chats = chat_format.format_chats(turns.unionByName(quoting))
    back = chats.withColumn("_back", chat_format.read_back(F.col("formatted")))
    newline = F.lit("\n")
    told = F.transform(
        "_back", lambda t: F.concat(F.coalesce(t["role"], F.lit("")), newline, t["text"], newline)
    )
    trained = F.array_join(F.transform(F.filter("_back", lambda t: t["loss"]), lambda t: t["text"]), "")
    return back.select(
        "conv_id",
        F.size("_back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(told, ""), 256).alias("turns_sha256"),
        F.length(trained).cast("long").alias("loss_chars"),
        F.sha2(trained, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


_SQL["op6_chat_formatting"] = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (
  select *, length(text) + length(text) - length(replace(text, '\', '')) + length(
      regexp_replace(text, '(<s>|</s>|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|\[ROLE\]|\[/ROLE\]|\[TEXT\])', '\1' || '\\', 'g')) - length(text)
    + case role when 'system' then 19 when 'user' then 15 when 'assistant' then 6 end as written,
    lag(role, 1, 'start') over (partition by conv_id order by turn) as before,
    lead(role) over (partition by conv_id order by turn) as after
  from t)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
  (3 + sum(written))::bigint as formatted_chars,
  bool_and((before, role) in (('start', 'system'), ('start', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user'))
    and (after is not null or role = 'assistant')) as valid
from e group by conv_id"""


@_query
def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the rules; unmatched urls are allowed."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


_SQL["op7_url_filters"] = r"""
with p as (
  select page_id, coalesce(url, '') as url, strpos(coalesce(url, ''), '://') as pos from pages),
h as (
  select page_id, case when pos > 0 then substr(url, pos + 3) else '' end as rest from p),
u as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from h),
r(action, rhost, rpath) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m as (
  select page_id, host, path, rhost || rpath as rule, action,
    row_number() over (partition by page_id order by length(rhost || rpath) desc nulls last) as nth
  from u left join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath))
select page_id, host, path, rule, coalesce(action, 'allow') as verdict from m where nth = 1"""


@_query
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of equal normalised texts."""
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


_SQL["op8_exact_dedup"] = r"""
with n as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
  doc_id = min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256 from n"""


@_query
def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its set of 5-word shingles and its component of links."""
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


_SQL["op9_ngram_join"] = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
s as (
  select distinct doc_id, unnest(case when len(words) = 0 then [] when len(words) < 5 then [array_to_string(words, ' ')]
    else list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) end) as shingle from w),
n as (select doc_id, count(*) as n from s group by doc_id),
i as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 75 * (x.n + y.n - shared)),
r(doc_id, seen) as (select doc_id, doc_id from n union select r.doc_id, l.b from r join l on l.a = r.seen)
select w.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, coalesce(min(r.seen), w.doc_id) as component_id
from w left join n on n.doc_id = w.doc_id left join r on r.doc_id = w.doc_id group by w.doc_id"""


@_query
def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's perplexity, judged by a model of the documents labelled as good."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_model.judge_quality(table(spark, sf_dir, "documents"), trusted)


@_query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds within the edit budget."""
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens by two tokenizers, aligned, with how often their pairs are linked in the corpus."""
    import public_tokenizers

    return token_alignment.align_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    )


@_query
def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint beside those of its edited text and of the document that follows."""
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


@_query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh first gets the next label."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    wrong = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(vectors.withColumn("label", wrong), lambda i: i % 100 == 0)


_SQL["op13_hard_negatives"] = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q
  from embeddings where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
d as (select vec_id, label, generate_subscripts(q, 1) as k, unnest(q) as x from v),
s as (
  select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as alike, sum(a.x * b.x)::bigint as score
  from d a join d b on a.k = b.k where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id group by a.vec_id, b.vec_id, a.label, b.label),
p as (
  select anchor_id, other as positive_id, score as positive_score from s where alike
  qualify row_number() over (partition by anchor_id order by score desc, other) <= 5)
select anchor_id, positive_id, (row_number() over (partition by anchor_id, positive_id order by score desc, other))::int as rank,
  other as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not alike and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, other) <= 10"""
