"""Benchmark decontamination by the q-gram lemma.

A stretch of text within edit distance k of a benchmark item of m characters shares at least
m - q + 1 - k q of the item's q-grams, and shares them on neighbouring diagonals (text place minus item
place). So shared q-grams are counted in overlapping bands of diagonals; only bands that reach the bound
are compared with the item, by an alignment that stays inside the band. An item shorter than a q-gram has nothing to count and is
too common within sentences to tell a leak: it is found where it makes a whole line, by all its own characters.

The items are a stated query set: they are taken in blocks of bounded size, each block sent to all tasks
and held against all documents in a scan of its own. All blocks pass through the driver and stay there until the
query has run. Documents are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklayout.llm.common import settle, slices, small_batches, without_ids
from sparklayout.sources.work import materialize

#: q-gram length; edits allowed per 100 characters of an item; characters of items in a block (about 40
#: bytes each in every task).
Q, EDITS, BLOCK_CHARS = 8, 8, 1_000_000
SPACE = 32
#: What stands on a line, from its first character to its last.
_LINE = re.compile(r"\S(?:[^\n]*\S)?")
_FACTORS = np.random.Generator(np.random.PCG64(4)).integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """For each code point: its lower-case form if it is a letter or digit, else a space."""

    def fold(c: int) -> int:
        x = chr(c)
        if not x.isalnum():
            return SPACE
        return ord(x.lower()) if len(x.lower()) == 1 else c

    return np.fromiter(map(fold, range(0x110000)), np.uint32, 0x110000)


def normalise(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points with single spaces, and each one's place in ``text``."""
    if not text:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    x = _folded()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    keep = x != SPACE
    keep[1:] |= keep[:-1]  # a space right after a letter or digit stays
    at = np.flatnonzero(keep)
    return x[at], at


def grams(x: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash for each place's q-gram."""
    n = max(0, len(x) - q + 1)
    out = np.zeros(n, np.uint64)
    wide = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(q):
            out += wide[k : k + n] * _FACTORS[k]
    return out ^ (out >> np.uint64(29))


def budget(length: int, edits: int = EDITS, q: int = Q) -> tuple[int, int]:
    """(edits allowed, q-grams that must be shared) for an item; fewer edits where the bound would be 0."""
    k = min(edits * length // 100, max(0, (length - q) // q))
    return k, length - q + 1 - k * q


def align(item: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Least edit distance of ``item`` to a stretch of ``text`` within the diagonals low..high.

    Returns distance, start and end of the stretch. Places outside ``text`` match nothing. The cost and the
    diagonal where the stretch starts are carried in one number; ties go to the lowest start.
    """
    one, width = 1 << 32, high - low + 1
    padded = np.zeros(len(item) + width + 1, np.uint32)
    lo, hi = max(0, low), min(len(text), high + len(item))
    if hi > lo:
        padded[lo - low : hi - low] = text[lo:hi]
    steps = np.arange(width, dtype=np.int64) * one
    row = np.arange(width, dtype=np.int64)  # cost 0, starting on each diagonal
    for i, c in enumerate(item):
        now = row + (padded[i : i + width] != c) * one
        now[:-1] = np.minimum(now[:-1], row[1:] + one)
        row = np.minimum.accumulate(now - steps) + steps
    best = int(np.argmin(row))
    cost, start = int(row[best]) >> 32, int(row[best]) & 0xFFFFFFFF
    return cost, max(0, start + low), min(len(text), best + low + len(item))


class Items:
    """One block of benchmark items with its q-gram index."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, edits: int = EDITS):
        self.q = q
        self.ids = [i for i, _ in items]
        self.texts = [normalise(t)[0] for _, t in items]
        # a space at the end would ask for one more character
        self.texts = [t[:-1] if len(t) and t[-1] == SPACE else t for t in self.texts]
        self.length = np.array([len(t) for t in self.texts], np.int64)
        bounds = [budget(len(t), edits, q) for t in self.texts]
        self.edits = np.array([k for k, _ in bounds], np.int64)
        self.least = np.array([n for _, n in bounds], np.int64)
        hashes = [grams(t, q) for t in self.texts]
        self.short: dict[str, list[int]] = {}
        for i, t in enumerate(self.texts):
            whole = " ".join((items[i][1] or "").split()).lower()
            if whole and len(t) < q:
                self.short.setdefault(whole, []).append(i)
        flat = np.concatenate([*hashes, np.empty(0, np.uint64)])
        owner = np.repeat(np.arange(len(items)), [len(h) for h in hashes])
        place = np.concatenate([*(np.arange(len(h)) for h in hashes), np.empty(0, np.int64)]).astype(np.int64)
        by = np.argsort(flat, kind="stable")
        self.owner, self.place = owner[by], place[by]
        self.hashes, self.first, self.times = np.unique(flat[by], return_index=True, return_counts=True)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.hashes >> np.uint64(42)).astype(np.int64)] = True

    def matches(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(text number, item number, start, end, distance) for each item that a text holds."""
        parts = [normalise(t) for t in texts]
        gap = np.zeros(self.q, np.uint32)
        starts = np.cumsum([0, *(len(x) + self.q for x, _ in parts)])
        flat = np.concatenate([y for x, _ in parts for y in (x, gap)] or [gap])
        found = self._near(parts, starts, flat) if len(self.hashes) else {}
        rows = []
        for (d, i), (cost, start, end) in found.items():
            places = parts[d][1]
            rows.append((d, i, int(places[start]), int(places[end - 1]) + 1, cost))
        if self.short:
            rows += [(d, i, *span, 0) for d, t in enumerate(texts) if t for i, span in self._lines(t).items()]
        return sorted(rows)

    def _lines(self, text: str) -> dict[int, tuple[int, int]]:
        """Item number to start and end of the first line that is such an item, but for white space and case."""
        out: dict[int, tuple[int, int]] = {}
        for line in _LINE.finditer(text):
            for i in self.short.get(" ".join(line[0].split()).lower(), ()):
                out.setdefault(i, line.span())
        return out

    def _near(self, parts: list, starts: np.ndarray, flat: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(text number, item number) to distance, start and end, for items with q-grams."""
        hashed = grams(flat, self.q)
        hits = np.flatnonzero(self.maybe[(hashed >> np.uint64(42)).astype(np.int64)])
        found = np.minimum(np.searchsorted(self.hashes, hashed[hits]), len(self.hashes) - 1)
        real = self.hashes[found] == hashed[hits]
        hits, found = hits[real], found[real]
        if not len(hits):
            return {}
        times = self.times[found]
        entry = np.repeat(self.first[found] - np.cumsum(times) + times, times) + np.arange(times.sum())
        text_at = np.repeat(hits, times)
        item = self.owner[entry]
        doc = np.searchsorted(starts, text_at, side="right") - 1
        # diagonals from 0 on, and bands of k + 1 diagonals; two neighbouring bands overlap the next two
        shift = int(self.length.max())
        diagonal = text_at - self.place[entry] + shift
        wide = self.edits[item] + 1
        n_bands = (len(flat) + shift) + 2
        key = (doc * len(self.ids) + item) * n_bands + diagonal // wide
        bands, shared = np.unique(key, return_counts=True)
        after = np.zeros(len(bands), np.int64)
        after[:-1] = np.where(bands[1:] == bands[:-1] + 1, shared[1:], 0)
        before = np.zeros(len(bands), np.int64)
        before[1:] = np.where(bands[1:] == bands[:-1] + 1, shared[:-1], 0)
        which = (bands // n_bands) % len(self.ids)
        kept = np.flatnonzero(np.maximum(shared + after, shared + before) >= self.least[which])
        out: dict[tuple[int, int], tuple[int, int, int]] = {}
        for b in kept:
            i = int(which[b])
            d = int(bands[b] // n_bands // len(self.ids))
            w, x = int(self.edits[i]) + 1, parts[d][0]
            low = int(bands[b] % n_bands) * w - shift - int(starts[d])
            cost, start, end = align(self.texts[i], x, low - w, low + 2 * w - 1)
            if cost <= self.edits[i] and ((d, i) not in out or (cost, start) < (out[d, i][0], out[d, i][1])):
                out[d, i] = (cost, start, end)
        return out


def _blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of about ``most`` characters."""
    block: list[tuple[int, str]] = []
    size = 0
    for row in benchmark.toLocalIterator():
        block.append((row["item_id"], row["text"]))
        size += len(row["text"])
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    q: int = Q,
    edits: int = EDITS,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """doc_id, item_id, start_char, end_char (places in the text), distance: one row for each document row
    and item that it holds within the edit budget, with the closest stretch.

    Texts and items are compared by letters and digits, lower-cased, with one space for everything between.
    Null and blank texts and items match nothing; items with fewer than ``q`` letters, digits and spaces between
    match where they make a whole line, character for character but for case and white space. Of stretches that are equally close the first is reported. Items that are equal
    are each reported, as is each of repeated rows. Without items or documents the result is empty. Other columns
    are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null")
    schema = (
        f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id long, start_char int, end_char int, distance int"
    )
    found: list[DataFrame] = []
    for block in _blocks(items, block_chars):

        def match(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            settle()
            index = Items(block, q, edits)
            for batch in batches:
                for part in slices(batch, "text", 1 << 20):
                    hits = index.matches(part.column("text").to_pylist())
                    if hits:
                        d, i, start, end, cost = zip(*hits, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [
                                part.column("doc_id").take(pa.array(d)),
                                pa.array([index.ids[x] for x in i], pa.int64()),
                                *(pa.array(x, pa.int32()) for x in (start, end, cost)),
                            ],
                            ["doc_id", "item_id", "start_char", "end_char", "distance"],
                        )

        found.append(rows.mapInArrow(match, schema))
    if not found:
        return spark.createDataFrame([], schema)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; rows with a null id stay."""
    leaks = materialize(find_contamination(docs, benchmark, id_col, text_col), "leaks")
    return without_ids(docs, leaks.withColumnRenamed("doc_id", id_col), id_col)
