"""Language identification with hyperdimensional profiles.

Every letter gets a random vector of +1 and -1. An n-gram is bound by multiplying its letters' vectors,
each permuted (rotated) by its place; a text is the bundle (sum) of its n-grams, a language the bundle of
its training texts. The prediction is the language whose profile has the greatest cosine with the text's.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklayout.llm.common import slices

DIMENSIONS, ORDER, SEED = 1024, 3, 20_240_601
#: Texts are worked on in runs of about so many bytes and rows; n-grams in blocks of so many.
RUN_BYTES, RUN_ROWS, BLOCK = 1 << 20, 256, 2048
SPACE = 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point: itself if it is a letter, else a space."""
    return np.array([c if chr(c).isalpha() else SPACE for c in range(0x110000)], np.int32)


@lru_cache(maxsize=100_000)
def letter_vector(code: int, dimensions: int) -> np.ndarray:
    """The random vector of one letter (or of the space between words)."""
    bits = np.random.Generator(np.random.PCG64([SEED, code])).integers(0, 2, dimensions, np.int8)
    return bits * 2 - 1


def bind(grams: np.ndarray, dimensions: int) -> np.ndarray:
    """Vectors of n-grams (one a row, as code points): the product of their rotated letter vectors."""
    alphabet, at = np.unique(grams, return_inverse=True)
    letters = np.stack([letter_vector(int(c), dimensions) for c in alphabet])
    at = at.reshape(grams.shape)
    n = grams.shape[1]
    out = np.ones((len(grams), dimensions), np.int8)
    for k in range(n):
        out *= np.roll(letters, n - 1 - k, axis=1)[at[:, k]]
    return out


def profiles(texts: list[str], dimensions: int = DIMENSIONS, order: int = ORDER) -> np.ndarray:
    """The bundled vector of each text (float64, zero without a letter).

    Texts are lower-cased, every run of other characters than letters is one space, and there is one
    space on either side, so that words' ends make n-grams too.
    """
    codes, owner = [], []
    for i, text in enumerate(texts):
        if not text:
            continue
        raw = _letters()[np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)]
        raw = np.concatenate(([SPACE], raw, [SPACE]))
        keep = np.ones(len(raw), bool)
        keep[1:] = (raw[1:] != SPACE) | (raw[:-1] != SPACE)
        raw = raw[keep]
        if len(raw) >= order and len(raw) > 2:
            codes.append(raw)
            owner.append(i)
    out = np.zeros((len(texts), dimensions))
    if not codes:
        return out
    flat = np.concatenate(codes)
    alphabet = np.unique(flat)
    place = np.zeros(int(alphabet[-1]) + 1, np.int64)
    place[alphabet] = np.arange(len(alphabet))
    base = len(alphabet)
    lengths = [len(x) - order + 1 for x in codes]
    keys = np.concatenate([_keys(place[x], base, order) for x in codes])
    known, gram = np.unique(keys, return_inverse=True) if base**order > 1 << 22 else _dense_unique(keys, base**order)
    row = np.repeat(np.arange(len(codes)), lengths)
    letters = np.stack([alphabet[(known // base ** (order - 1 - k)) % base] for k in range(order)], 1)
    found = np.zeros((len(codes), dimensions), np.float32)
    blocks = range(0, len(known), BLOCK)
    sorted_by = np.argsort(gram, kind="stable") if len(blocks) > 1 else None
    ordered = gram[sorted_by] if sorted_by is not None else gram
    rows = row[sorted_by] if sorted_by is not None else row
    for b in blocks:
        lo, hi = (np.searchsorted(ordered, (b, b + BLOCK)) if sorted_by is not None else (0, len(ordered)))
        width = min(BLOCK, len(known) - b)
        counts = np.bincount(rows[lo:hi] * width + (ordered[lo:hi] - b), minlength=len(codes) * width)
        found += counts.reshape(len(codes), width).astype(np.float32) @ bind(letters[b : b + width], dimensions).astype(np.float32)
    out[owner] = found
    return out


def _keys(x: np.ndarray, base: int, order: int) -> np.ndarray:
    n = len(x) - order + 1
    out = x[:n].copy()
    for k in range(1, order):
        out = out * base + x[k : k + n]
    return out


def _dense_unique(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    seen = np.zeros(size, bool)
    seen[keys] = True
    known = np.flatnonzero(seen)
    place = np.zeros(size, np.int64)
    place[known] = np.arange(len(known))
    return known, place[keys]


def _runs(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, text_col, RUN_BYTES):
            for at in range(0, part.num_rows, RUN_ROWS):
                yield part.slice(at, RUN_ROWS)


def train_profiles(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS, order: int = ORDER
) -> dict[str, np.ndarray]:
    """One profile per language: the sum of its texts' vectors. Rows without text or language are left out.

    Each task bundles its texts by language, so what reaches the driver is one vector a language.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where("text is not null and lang is not null")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part in _runs(batches, "text"):
            vectors = profiles(part.column("text").to_pylist(), dimensions, order)
            langs = np.array(part.column("lang").to_pylist(), object)
            for lang in set(langs):
                sums[lang] = sums.get(lang, 0) + vectors[langs == lang].sum(0)
        for lang, vector in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(vector)],
                ["lang", "at", "value"],
            )

    sums = rows.mapInArrow(bundle, "lang string, at int, value double").groupBy("lang", "at").agg(F.sum("value").alias("value"))
    by_lang = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "value")))["value"].alias("v"))
    return {r["lang"]: np.array(r["v"]) for r in by_lang.collect()}


def predict_languages(
    docs: DataFrame,
    trained: dict[str, np.ndarray],
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = ORDER,
) -> DataFrame:
    """id, lang_pred and score (the cosine, 0 at least) for every row.

    A null text, one without a letter, and any text where nothing was learned give ``und`` and score 0.
    Equal cosines go to the language that comes first in the alphabet. Other columns are not read.
    """
    names = sorted(k for k, v in trained.items() if np.linalg.norm(v) > 0)
    matrix = np.stack([trained[k] / np.linalg.norm(trained[k]) for k in names], 1) if names else None
    rows = docs.select(id_col, text_col)
    id_type = rows.schema[id_col].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches, text_col):
            n = part.num_rows
            langs, scores = ["und"] * n, [0.0] * n
            if matrix is not None:
                vectors = profiles(part.column(text_col).to_pylist(), len(matrix), order)
                norms = np.linalg.norm(vectors, axis=1)
                cosines = (vectors @ matrix) / np.where(norms > 0, norms, 1)[:, None]
                for i in np.flatnonzero(norms > 0):
                    best = int(np.argmax(cosines[i]))
                    langs[i], scores[i] = names[best], float(min(1.0, max(0.0, cosines[i, best])))
            yield pa.RecordBatch.from_arrays(
                [part.column(id_col), pa.array(langs), pa.array(scores, pa.float64())], [id_col, "lang_pred", "score"]
            )

    return rows.mapInArrow(predict, f"`{id_col}` {id_type}, lang_pred string, score double")
