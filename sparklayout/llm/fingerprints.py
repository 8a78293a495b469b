"""Document fingerprints by consistent weighted sampling.

A text is a set of weighted terms: its words (and single other marks), each weighing its occurrences times its
characters, so that a long word says more than a short one. For each of SAMPLES independent draws a term gets three
numbers from a hash of the term: r and c, both Gamma(2, 1), and b, uniform. A weight w counts from the step
t = floor(ln w / r + b) on, y = exp(r (t - b)) is the weight at that step, and the term's bid is c / (y e^r). The term with the
least bid is the sample, together with its t. Two texts have the same sample with a probability of
sum(min) / sum(max) over their weights, the generalised Jaccard similarity; so the share of equal samples
estimates it. The draws depend on nothing but the term: texts can be fingerprinted apart and at any time.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType, StructField, StructType

from sparklayout.llm.common import Memo, held, slices, small_batches
from sparklayout.sources.work import materialize

#: Draws of a fingerprint; bytes that a sample takes in it.
SAMPLES, BYTES = 64, 2
#: Texts are worked on in runs of about so many bytes; terms are drawn once for so many of their places, and compared so
#: many at a time.
RUN_BYTES, TOGETHER, TERMS = 1 << 20, 1 << 18, 1 << 10
#: What a worker remembers of words' hashes.
MEMO_BYTES = 48 << 20
#: Rows that stand for the ends of a range.
FIRST, LAST = 1, 2
#: Bits of a hash that choose r and c; the others are b.
R_BITS, C_BITS = 16, 18
#: What is remembered of a term.
_TERM = np.dtype([("hash", ">u8"), ("length", ">u4")])
_TERMS = re.compile(r"\w+|[^\w\s]")
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _gamma() -> tuple[np.ndarray, np.ndarray]:
    """Gamma(2, 1) at the middles of equal shares of probability: values for r, logarithms for c."""

    def quantiles(bits: int) -> np.ndarray:
        p = (np.arange(1 << bits) + 0.5) / (1 << bits)
        low, high = np.zeros(len(p)), np.full(len(p), 64.0)
        for _ in range(60):  # 1 - (1 + x) e^-x = p
            mid = (low + high) / 2
            below = -np.expm1(np.log1p(mid) - mid) < p
            low, high = np.where(below, mid, low), np.where(below, high, mid)
        return low

    return quantiles(R_BITS).astype(np.float32), np.log(quantiles(C_BITS)).astype(np.float32)


def draws(terms: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c and b for each term (hash) and draw: three runs of bits of one hash. Gamma values are looked up, so that
    they are the same on every machine."""
    of_r, of_c = _gamma()
    seeds = _mixed(np.arange(1, samples + 1, dtype=np.uint64) * _GOLD)
    bits = _mixed(terms[:, None] ^ seeds)
    r = of_r.take((bits & np.uint64((1 << R_BITS) - 1)).view(np.int64))
    bits >>= np.uint64(R_BITS)
    c = of_c.take((bits & np.uint64((1 << C_BITS) - 1)).view(np.int64))
    bits >>= np.uint64(C_BITS)
    return r, c, bits.astype(np.float32) / np.float32(1 << (64 - R_BITS - C_BITS))


class Sampler:
    """Fingerprints of texts; remembers words' hashes."""

    def __init__(self, samples: int):
        self.samples = samples
        self.known = Memo(MEMO_BYTES, lambda w: xxhash.xxh3_64_digest(w.encode()) + len(w).to_bytes(4, "big"))

    def fingerprints(self, texts: list[str]) -> list[bytes]:
        """BYTES for each draw, for each text; empty for a text without terms."""
        found = [Counter(_TERMS.findall(t.lower())) for t in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        terms = np.frombuffer(b"".join(map(self.known.__getitem__, chain.from_iterable(found))), _TERM)
        times = np.fromiter(chain.from_iterable(x.values() for x in found), np.int64, len(terms))
        self.known.make_room()
        hashes, weights = terms["hash"].astype(np.uint64), times * terms["length"]
        best = np.full((len(texts), self.samples), np.inf, np.float32)
        key = np.zeros((len(texts), self.samples), np.uint64)
        of_text, log_w = np.repeat(np.arange(len(texts)), sizes), np.log(weights).astype(np.float32)
        for at in range(0, len(hashes), TOGETHER):
            some = slice(at, at + TOGETHER)
            self._bid(hashes[some], log_w[some], of_text[some], best, key)
        whole = (key >> np.uint64(64 - 8 * BYTES)).astype(">u2").tobytes()
        width = self.samples * BYTES
        return [whole[i * width : (i + 1) * width] if n else b"" for i, n in enumerate(sizes.tolist())]

    def _bid(self, hashes: np.ndarray, log_w: np.ndarray, of_text: np.ndarray, best: np.ndarray, key: np.ndarray) -> None:
        """Lower the least bids of some texts by some of their terms. A text may be cut: the least bid of all its parts counts."""
        terms, place = np.unique(hashes, return_inverse=True)
        parts = [draws(terms[lo : lo + TERMS], self.samples) for lo in range(0, len(terms), TERMS)]
        drawn = [np.concatenate(x) for x in zip(*parts, strict=True)]
        for lo in range(0, len(hashes), TERMS):
            at, owner = place[lo : lo + TERMS], of_text[lo : lo + TERMS]
            r, log_c, b = (x.take(at, axis=0) for x in drawn)
            t = np.floor(log_w[lo : lo + TERMS, None] / r + b)
            bid = log_c - r * (t - b + 1)
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            here = owner[first]
            least = np.minimum(np.minimum.reduceat(bid, first, axis=0), best[here])
            best[here] = least
            rows, draw = np.nonzero(bid == np.repeat(least, np.diff(np.append(first, len(bid))), axis=0))
            steps = t[rows, draw].astype(np.int64).astype(np.uint64)
            key[owner[rows], draw] = _mixed(terms[at[rows]] + _mixed(steps))


def same(a: bytes, b: bytes) -> float:
    """The share of equal samples of two fingerprints, an estimate of the generalised Jaccard similarity: 1 for two
    empty ones, 0 for an empty one and another."""
    if a == b or not a or not b:
        return float(a == b)
    return float(np.mean(np.frombuffer(a, ">u2") == np.frombuffer(b, ">u2")))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """:func:`same` for two columns of hexadecimal fingerprints."""
    digits = 2 * BYTES
    starts = F.sequence(F.lit(1), F.lit(samples * digits), F.lit(digits))
    equal = F.filter(starts, lambda i: F.substr(a, i, F.lit(digits)) == F.substr(b, i, F.lit(digits)))
    apart = (F.length(a) == 0) | (F.length(b) == 0)
    return F.when(a == b, 1.0).when(apart, 0.0).otherwise(F.size(equal) / F.lit(float(samples)))


def fingerprint(docs: DataFrame, text_col: str = "text", samples: int = SAMPLES, name: str = "fingerprint") -> DataFrame:
    """``docs`` with a column ``name`` (which must be new): the fingerprint in hexadecimal. Null texts count as empty;
    texts without a word or a mark have an empty fingerprint; equal texts have equal ones. Rows are worked on one by one."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = held("fingerprints", samples, Sampler)
        for batch in batches:
            for part in slices(batch, text_col, RUN_BYTES):
                made = sampler.fingerprints([x or "" for x in part.column(text_col).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x.hex() for x in made], pa.string())], [*part.schema.names, name])

    schema = StructType([*docs.schema.fields, StructField(name, StringType())])
    return docs.mapInArrow(sample, schema)


def edited(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by as many of the first characters of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """How far fingerprints tell an edit from another text: id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next for each row.

    Rows stand in ascending order of the id (null first), then of a hash of the text; repeated rows follow each other;
    after the last comes the first. A row's :func:`edited` text takes from the row that follows. Null texts are empty.
    A table of one row follows itself; an empty one gives an empty result. Other columns aren't read.

    Texts are exchanged once, into ranges. A range gives back the texts of its first and last row, and these few
    are matched with those of the ranges beside them.
    """
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "part", "edge", "text"]
    kinds = [to_arrow_type(id_type), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string()]
    schema = (
        f"doc_id {id_type.simpleString()}, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, "
        "near_edited double, near_next double, part int, edge int, text string"
    )
    n_made = len(names) - 3

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def judged(sampler: Sampler, ids: list, texts: list[str], following: list[str]) -> list[tuple]:
        """One row for each text; following: the text after each."""
        changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
        made = sampler.fingerprints([*texts, following[-1], *changed])
        own, new = made[: len(texts) + 1], made[len(texts) + 1 :]
        return [
            (i, len(t), hashlib.sha256(c.encode()).hexdigest(), f, e, same(f, e), same(f, g))
            for i, t, c, f, e, g in zip(ids, texts, changed, own, new, own[1:], strict=False)
        ]

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, part, last = held("fingerprints", samples, Sampler), TaskContext.get().partitionId(), None
        for batch in batches:
            for run in slices(batch, "text", RUN_BYTES):
                ids, texts = run.column("doc_id").to_pylist(), [x or "" for x in run.column("text").to_pylist()]
                if last is None:
                    yield batch_of([(*[None] * n_made, part, FIRST, texts[0])])
                else:
                    ids.insert(0, last[0])
                    texts.insert(0, last[1])
                last = ids[-1], texts[-1]
                if len(texts) > 1:
                    rows = judged(sampler, ids[:-1], texts[:-1], texts[1:])
                    yield batch_of([(*r, part, None, None) for r in rows])
        if last is not None:
            yield batch_of([(last[0], *[None] * (n_made - 1), part, LAST, last[1])])

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = held("fingerprints", samples, Sampler)
        for batch in batches:
            for i, t, f in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "following")), strict=True):
                yield batch_of([(*judged(sampler, [i], [t], [f])[0], None, None, None)])

    # the last column spreads rows that repeat in full; any order among them gives the same rows
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    keyed = rows.withColumns({"_hash": F.xxhash64("text"), "_copy": F.monotonically_increasing_id()})
    order = ["doc_id", "_hash", "_copy"]
    ranges = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    done = materialize(ranges.mapInArrow(within, schema), "fingerprints")
    lasts, firsts = (done.where(F.col("edge") == e).select("part", "doc_id", "text") for e in (LAST, FIRST))
    parts = Window.orderBy("part")  # one row a range
    first_of_all = F.first("part").over(parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = firsts.select("part").withColumn("next", F.coalesce(F.lead("part").over(parts), first_of_all))
    pairs = lasts.join(after, "part").join(firsts.select(F.col("part").alias("next"), F.col("text").alias("following")), "next")
    across = pairs.select("doc_id", "text", "following").mapInArrow(between, schema)
    text_of = [F.lower(F.hex(x)).alias(x) for x in ("fingerprint", "edited_fingerprint")]
    return (
        done.where("edge is null")
        .unionByName(across)
        .select(F.col("doc_id").alias(id_col), "n_chars", "edited_sha256", *text_of, "near_edited", "near_next")
    )
