"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over characters, which needs no word list and works for any script; a word that repeats the word
before it is one character of its own, so that the model sees repetition, however long the word. Its n-gram counts
are a table sharded by n-gram; probabilities come from joins of that table with itself, order by order. To score,
documents are dealt into blocks, each block's distinct n-grams are joined with the sharded probabilities,
and every block gets back just its own slice of the model. Texts travel compressed. The model learns from most of
the trusted documents; the others set each language's limit: a high quantile of how far their perplexities lie
above the language's mean, measured against what a text of that length may stray.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sparklayout.llm.common import give_back, settle, slices, small_batches, with_ids, without_ids
from sparklayout.sources.work import materialize

#: Length of n-grams; quantile of the limit; one trusted document in HELD_OUT sets limits, the others are learned from.
ORDER, QUANTILE, HELD_OUT = 4, 0.995, 5
#: A language's quantile weighs as many held-out documents as it has, that of all languages together as many as this.
PRIOR = 100
#: Beyond so many characters longer texts aren't judged more strictly.
FULL_CHARS = 5000
#: Bytes of text in a block, and in what a block takes from one run of rows.
BLOCK_BYTES, PACK_BYTES = 16 << 20, 16 << 20
#: Tables of shorter n-grams up to this many rows are broadcast, else joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Texts are worked on in runs of about so many bytes.
RUN_BYTES = 1 << 20
#: Stands before the first character and after the last; stands for a word like the one before.
EDGE, REPEAT, SPACE = 2, 3, 32


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """For each code point: lower case, digits as 0, white space and control characters as a space."""

    def fold(c: int) -> int:
        x = chr(c)
        if x.isspace() or c < SPACE or 0x7F <= c < 0xA0:
            return SPACE
        return ord("0") if x.isdecimal() else ord(x.lower()) if len(x.lower()) == 1 else c

    return np.fromiter(map(fold, range(0x110000)), np.uint32, 0x110000)


def clean(text: str | None) -> np.ndarray:
    """Folded code points, runs of spaces as one, none at either end; a word that equals the word before it, and
    the space between them, become one REPEAT."""
    if not text:
        return np.empty(0, np.uint32)
    x = _folded()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    keep = x != SPACE
    keep[:-1] |= keep[1:]  # a space right before another character stays
    x = x[keep]
    x = x[1:] if len(x) and x[0] == SPACE else x
    words = x.tobytes().decode("utf-32-le").split(" ")
    if not any(map(eq, words, islice(words, 1, None))):
        return x
    mark = chr(REPEAT)
    pieces = (mark if now == before else f" {now}" for before, now in zip(words, words[1:]))
    return np.frombuffer("".join((words[0], *pieces)).encode("utf-32-le"), np.uint32)


def _compact(key: np.ndarray, bound: int) -> tuple[np.ndarray, int]:
    """Number the distinct keys 0, 1, ...; ``bound`` is above every key."""
    if bound > 1 << 25:
        known, out = np.unique(key, return_inverse=True)
        return out, len(known)
    seen = np.zeros(bound, bool)
    seen[key] = True
    known = np.flatnonzero(seen)
    place = np.zeros(bound, np.int32)
    place[known] = np.arange(len(known), dtype=np.int32)
    return place[key].astype(np.int64), len(known)


def text_grams(texts: list[str | None], order: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct n-grams of some texts, the number of each place's n-gram, and places per text.

    A text has a place for each cleaned character and one for its end; an empty one has none.
    """
    pad, end = np.full(order - 1, EDGE, np.uint32), np.array([EDGE], np.uint32)
    cleaned = [clean(t) for t in texts]
    per_text = np.array([len(x) + 1 if len(x) else 0 for x in cleaned], np.int64)
    parts = [y for x in cleaned if len(x) for y in (pad, x, end)]
    if not parts:
        return [], np.empty(0, np.int64), per_text
    flat = np.concatenate(parts)
    small, base = _compact(flat.astype(np.int64), int(flat.max()) + 1)
    n = len(flat) - order + 1
    key, bound = small[:n], base
    for k in range(1, order):
        key, bound = _compact(key * base + small[k : k + n], bound * base)
    # places where an n-gram starts in one text and ends in the next are left out
    want = np.ones(n, bool)
    ends = np.cumsum(per_text[per_text > 0] + order - 1)[:-1]
    for k in range(order - 1):
        want[ends - 1 - k] = False
    number, found = _compact(key[want], bound)
    first = np.empty(found, np.int64)
    first[number] = np.flatnonzero(want)
    points = flat[first[:, None] + np.arange(order)]
    joined = points.astype("<u4").tobytes().decode("utf-32-le")
    return [joined[i : i + order] for i in range(0, len(joined), order)], number, per_text


def count_ngrams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, n) over the column ``text`` of all of ``docs``; each task adds up its own texts first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for batch in batches:
            for part in slices(batch, "text", RUN_BYTES):
                grams, number, _ = text_grams(part.column("text").to_pylist(), order)
                times = np.bincount(number, minlength=len(grams)) if grams else []
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(times, pa.int64())], ["gram", "n"])

    return docs.select("text").mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and more; fixed ones where the data are too few."""
    if not (n1 and n2 and n3):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), k + 0.95) for k, d in enumerate(found))


class Model:
    """Tables by length n: ``probs[n]`` (gram, p) and ``backoffs[n]`` (context, gamma); ``floor`` is the
    probability of a character of which nothing is known."""

    def __init__(self, counts: DataFrame, order: int = ORDER):
        """``counts``: (gram, n) of the longest n-grams."""
        self.order, self.probs, self.backoffs, self.small = order, {}, {}, {}
        tables = {order: materialize(counts, "ngrams")}
        for k in range(order - 1, 0, -1):  # shorter ones count how many characters stand before them
            shorter = tables[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n"))
            tables[k] = materialize(shorter, "ngrams")
        for k in range(1, order + 1):
            of = [F.count(F.when(F.col("n") == i, 1)) for i in (1, 2, 3, 4)]
            n1, n2, n3, n4, rows = tables[k].agg(*of, F.count("*")).first()
            self.small[k] = rows <= BROADCAST_ROWS
            if k == 1:
                self.floor = 1.0 / (rows + 1)
            d1, d2, d3 = discounts(n1, n2, n3, n4)
            off = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
            table = tables[k].select("gram", "n", F.substring("gram", 1, k - 1).alias("context"), off.alias("off"))
            sums = table.groupBy("context").agg((F.sum("off") / F.sum("n")).alias("gamma"), F.sum("n").alias("total"))
            self.backoffs[k] = materialize(sums, "contexts")
            part = table.join(self.backoffs[k], "context").select(
                "gram", ((F.col("n") - F.col("off")) / F.col("total")).alias("own"), "gamma", F.substring("gram", 2, k - 1).alias("suffix")
            )
            lower = part.withColumn("lower", F.lit(self.floor))
            if k > 1:
                lower = part.join(self.probs[k - 1].toDF("suffix", "lower"), "suffix")
            whole = lower.select("gram", (F.col("own") + F.col("gamma") * F.col("lower")).alias("p"))
            self.probs[k] = materialize(whole, "probs")

    def with_log_probs(self, asked: DataFrame) -> DataFrame:
        """``asked`` (with ``gram``, full-length n-grams) and ``logp``: the longest known end of an n-gram
        gives the probability, and known contexts beyond it pass their backoff on."""
        rows, log = asked, F.log(F.lit(self.floor))
        for k in range(1, self.order + 1):
            hint = F.broadcast if self.small[k] and k < self.order else (lambda x: x)
            end, context = F.substring("gram", self.order - k + 1, k), F.substring("gram", self.order - k + 1, k - 1)
            probs = hint(self.probs[k].toDF(f"_g{k}", f"_p{k}"))
            offs = hint(self.backoffs[k].select(F.col("context").alias(f"_c{k}"), F.col("gamma").alias(f"_o{k}")))
            rows = rows.join(probs, end == F.col(f"_g{k}"), "left").join(offs, context == F.col(f"_c{k}"), "left")
            log = F.coalesce(F.log(f"_p{k}"), log + F.coalesce(F.log(f"_o{k}"), F.lit(0.0)))
        return rows.select(*asked.columns, log.alias("logp"))


def _packed(docs: DataFrame) -> DataFrame:
    """docs(doc_id, lang, text, block) to rows (block, ids, langs, sizes, data): documents of one block that came
    together, with their texts as one compressed string and their sizes in bytes (-1 for null)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for batch in batches:
            for part in slices(batch, "text", PACK_BYTES):
                blocks = part.column("block").to_numpy()
                order = np.argsort(blocks, kind="stable")
                starts = np.flatnonzero(np.diff(blocks[order], prepend=-1))
                ids, langs = part.column("doc_id").to_pylist(), part.column("lang").to_pylist()
                texts = part.column("text").cast(pa.binary()).to_pylist()
                rows = []
                for lo, hi in zip(starts, [*starts[1:], len(order)], strict=True):
                    at = order[lo:hi].tolist()
                    own = [texts[i] for i in at]
                    data = pa.compress(b"".join(x or b"" for x in own), "zstd", asbytes=True)
                    sizes = [-1 if x is None else len(x) for x in own]
                    rows.append((int(blocks[at[0]]), [ids[i] for i in at], [langs[i] for i in at], sizes, data))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    id_type = docs.schema["doc_id"].dataType
    names = ["block", "ids", "langs", "sizes", "data"]
    kinds = [pa.int32(), pa.list_(to_arrow_type(id_type)), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]
    schema = f"block int, ids array<{id_type.simpleString()}>, langs array<string>, sizes array<bigint>, data binary"
    return docs.select("doc_id", "lang", "text", "block").mapInArrow(pack, schema)


def _unpacked(table: pa.Table) -> Iterator[list[str | None]]:
    """The texts of packed rows, in runs of about RUN_BYTES."""
    for sizes, data in zip(table.column("sizes"), table.column("data"), strict=True):
        sizes = sizes.as_py()
        whole = memoryview(pa.decompress(data.as_buffer(), sum(max(0, n) for n in sizes), "zstd"))
        run, at, start = [], 0, 0
        for n in sizes:
            if run and at + n - start > RUN_BYTES:
                yield run
                run, start = [], at
            run.append(None if n < 0 else str(whole[at : at + n], "utf-8"))
            at += max(0, n)
        yield run
    give_back()


def perplexities(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, n_chars (places), nll (sum of -log p) for docs(doc_id, lang, text).

    The blocks' exchange is planned once and read twice: for the n-grams and for the scores. A block is named by a
    hash of its rows, so a repeated task deals them alike.
    """
    order = model.order
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, size // BLOCK_BYTES)
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    placed = _packed(dealt).repartition("block")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def distinct(key: tuple, table: pa.Table) -> pa.Table:
        grams: set[str] = set()
        for texts in _unpacked(table):
            grams.update(text_grams(texts, order)[0])
        return pa.table({"block": pa.array([key[0].as_py()] * len(grams), pa.int32()), "gram": pa.array(list(grams), pa.string())})

    asked = placed.groupBy("block").applyInArrow(distinct, "block int, gram string")
    known = model.with_log_probs(asked)

    def score(key: tuple, packed: pa.Table, table: pa.Table) -> pa.Table:
        logp = dict(zip(table.column("gram").to_pylist(), table.column("logp").to_pylist(), strict=True))
        sizes, sums = [], []
        for texts in _unpacked(packed):
            grams, number, per_text = text_grams(texts, order)
            each = np.fromiter(map(logp.__getitem__, grams), float, len(grams))[number]
            total = np.concatenate(([0.0], np.cumsum(each)))
            ends = np.cumsum(per_text)
            sizes.append(per_text)
            sums.append(total[ends - per_text] - total[ends])
        return pa.table(
            {
                "doc_id": pc.list_flatten(packed.column("ids")),
                "lang": pc.list_flatten(packed.column("langs")),
                "n_chars": pa.array(np.concatenate([*sizes, np.empty(0, np.int64)])),
                "nll": pa.array(np.concatenate([*sums, np.empty(0)])),
            }
        )

    out = f"doc_id {id_type}, lang string, n_chars long, nll double"
    return placed.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(score, out)


def judge_quality(
    docs: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    order: int = ORDER,
    quantile: float = QUANTILE,
) -> DataFrame:
    """doc_id, lang, n_chars, perplexity, excess, limit, keep for every row.

    ``trusted`` holds the ids (column ``id_col``) of documents known to be good. Four in five are learned from, the
    fifth (by a hash of the id; all of them where that leaves none) sets the limits. ``excess`` is how far a text's mean
    of -log p lies above its language's, in units of what a text of its length strays: 1 / sqrt(n) for n characters,
    and not less than that of FULL_CHARS. ``limit`` is the ``quantile`` of the language's held-out excesses, drawn towards that of
    all languages together as far as it rests on few documents (PRIOR); the latter alone serves languages without trusted documents. A null language
    is a language of its own (``und``). Texts without a character to score (null, blank) are rejected and have
    a null perplexity. Where nothing is trusted, limits are null and all other texts are kept. Repeated rows are judged
    alike. An empty table gives an empty result. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text")
    )
    held = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0
    ids = materialize(trusted.select(F.col(id_col).alias("doc_id")).distinct().withColumn("held", held), "trusted")
    split = ids.select("held").distinct().count() == 2
    model = Model(count_ngrams(with_ids(rows, ids.where("not held") if split else ids), order), order)
    scores = materialize(perplexities(rows, model), "scores").withColumn("mean", F.try_divide("nll", "n_chars"))
    judged_by = materialize(scores.where("n_chars > 0").join(ids, "doc_id"), "judged_by")
    judged_by = judged_by if not split or judged_by.where("held").isEmpty() else judged_by.where("held")
    stray = F.sqrt(F.try_divide(F.lit(1.0), "n_chars") + 1 / F.lit(float(FULL_CHARS)))
    centre = F.sum("nll") / F.sum("n_chars")
    by_lang, all_centre = judged_by.groupBy("lang").agg(centre.alias("centre")), judged_by.agg(centre).first()[0]
    excess = ((F.col("mean") - F.col("centre")) / stray).alias("excess")
    excesses = judged_by.join(F.broadcast(by_lang), "lang").select("lang", excess)
    high = F.percentile_approx("excess", quantile, 10_000)
    own = excesses.groupBy("lang").agg(high.alias("own"), F.count("*").alias("n"))
    all_limit = excesses.agg(high).first()[0]
    shrunk = (F.col("n") * F.col("own") + PRIOR * F.lit(all_limit).cast("double")) / (F.col("n") + PRIOR)
    limits = by_lang.join(own, "lang").select("lang", "centre", shrunk.alias("limit"))
    judged = scores.join(F.broadcast(limits), "lang", "left").withColumns(
        {
            "centre": F.coalesce("centre", F.lit(all_centre).cast("double")),
            "limit": F.coalesce("limit", F.lit(all_limit).cast("double")),
        }
    )
    judged = judged.select("doc_id", "lang", "n_chars", F.when(F.col("n_chars") > 0, F.exp("mean")).alias("perplexity"), excess, "limit")
    keep = F.col("perplexity").isNotNull() & F.coalesce(F.col("excess") <= F.col("limit"), F.lit(True))
    return judged.withColumn("keep", keep).withColumnRenamed("doc_id", id_col)


def drop_low_quality(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that :func:`judge_quality` keeps, with all their columns; null ids stay."""
    judged = materialize(judge_quality(docs, trusted, id_col, text_col, lang_col), "judged")
    return without_ids(docs, judged.where("not keep"), id_col)
