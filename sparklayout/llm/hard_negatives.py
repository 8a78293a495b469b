"""Hard negatives by scanning columns: rows of another label that score just below an anchor's positives.

Vectors are cut to whole numbers and stored in blocks of about BLOCK_ROWS rows, one array for each dimension, with each
dimension's least and greatest value. Anchors are the query set: groups of them meet every block. For an anchor, a block's
dimensions are read in the descending order of the anchor's own magnitudes. After every few of them the rest can
add no less and no more to a row's score than least and greatest values allow; rows that can no longer come
among the best positives, or into no window of negatives, leave the candidates, and later columns are read for those
that stay. What is left at the end has exact scores.

First the positives of each anchor are found so, then, with the windows that their scores open, the negatives.
Scores, limits and ties are whole numbers, so nothing depends on the order in which dimensions are added up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparklayout.llm.common import small_batches
from sparklayout.sources.work import counted, materialize

#: Rows of a block and anchors of a group, on average; dimensions that are read between two looks at the bounds.
BLOCK_ROWS, GROUP_ROWS, STEP = 4096, 128, 8
#: Anchors that one task holds at most, on average.
TASK_ANCHORS = 65_536
#: Components are floor(SCALE x); positives of an anchor; negatives of a positive; least and greatest negative score, in
#: hundredths of the positive's.
SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 10, 30, 90


def quantised(rows: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, label, vector (whole numbers) of the rows that take part: nothing is null, all components are finite."""
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    whole = F.transform(vector, lambda x: F.floor(x * scale))
    picked = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.coalesce(finite, F.lit(False)))
    return picked.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), whole.alias("vector"))


def _matrix(vectors: list[np.ndarray]) -> np.ndarray:
    """Rows of one length; shorter vectors end in zeros."""
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)), np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


#: Whole numbers of a column or a vector are stored in the least of these that holds them all; its width is the first byte.
_WIDTHS = (np.int16, np.int32, np.int64)


def _packed(x: np.ndarray) -> bytes:
    low, high = (x.min(), x.max()) if len(x) else (0, 0)
    kind = next(t for t in _WIDTHS if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def _unpacked(data: memoryview | bytes | pa.Buffer) -> np.ndarray:
    data = memoryview(data)
    return np.frombuffer(data[1:], f"<i{data[0]}").astype(np.int64)


def _least_of_each(ids: np.ndarray, labels: np.ndarray, vectors: list[tuple]) -> list[int]:
    """Places of one row for each id, the least by label and vector, in the order of labels and ids."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i], labels[i], vectors[i]))
    first = [i for k, i in enumerate(order) if k == 0 or ids[i] != ids[order[k - 1]]]
    return sorted(first, key=lambda i: (labels[i], ids[i]))


def _one_row_an_id(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that repeat an id in a batch are made one before they are exchanged."""
    for batch in batches:
        ids = batch.column("id").to_numpy()
        if len(np.unique(ids)) < len(ids):
            keep = _least_of_each(ids, batch.column("label").to_numpy(), batch.column("vector").to_pylist())
            batch = batch.take(pa.array(keep))
        yield batch


def column_blocks(rows: DataFrame, is_anchor: Callable[[Column], Column]) -> DataFrame:
    """block, ids, labels, starts, anchors, dims, least, greatest of ``rows`` (id, label, vector).

    A block's rows are in the order of labels and ids; ``labels`` and ``starts``: where each label begins; ``dims``:
    a dimension's values (:func:`_packed`). ``anchors``: places of anchors. Of rows that share an id the one
    with the least label, then the least vector, is taken.
    """
    many = rows.count() // BLOCK_ROWS + 1

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        ids, labels, vectors = (table.column(c).to_pylist() for c in ("id", "label", "vector"))
        keep = _least_of_each(ids, labels, vectors)
        matrix = _matrix([np.array(vectors[i], np.int64) for i in keep])
        found = np.array([labels[i] for i in keep], np.int64)
        starts = np.flatnonzero(np.diff(found, prepend=found[0] - 1))
        wanted = table.column("anchor").to_pylist()
        columns = {
            "block": [key[0].as_py()],
            "ids": [[ids[i] for i in keep]],
            "labels": [found[starts]],
            "starts": [starts],
            "anchors": [[k for k, i in enumerate(keep) if wanted[i]]],
            "dims": [[_packed(x) for x in matrix.T]],
            "least": [matrix.min(0) if matrix.size else []],
            "greatest": [matrix.max(0) if matrix.size else []],
        }
        longs = pa.list_(pa.int64())
        kinds = [pa.int64(), longs, longs, longs, longs, pa.list_(pa.binary()), longs, longs]
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(columns.items(), kinds, strict=True)})

    schema = "block long, ids array<bigint>, labels array<bigint>, starts array<bigint>, anchors array<bigint>, dims array<binary>, least array<bigint>, greatest array<bigint>"
    dealt = rows.mapInArrow(_one_row_an_id, rows.schema).select("*", F.coalesce(is_anchor(F.col("id")), F.lit(False)).alias("anchor"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(many)))
    return dealt.groupBy("block").applyInArrow(pack, schema)


def anchors_of(blocks: DataFrame) -> DataFrame:
    """id, label, vector (:func:`_packed`) of the anchors in some blocks."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block = _Block(batch, k)
                at = batch.column("anchors")[k].values.to_numpy()
                rows = np.stack([d[at] for d in block.dims], 1) if block.dims else np.empty((len(at), 0), np.int64)
                data = [block.ids[at], block.label_at(at), [_packed(x) for x in rows]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(data, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["id", "label", "vector"])

    return blocks.mapInArrow(take, "id long, label long, vector binary")


def _groups(anchors: DataFrame, n: int) -> DataFrame:
    """Anchors (id, label, vector, scores: of their positives) in groups of about GROUP_ROWS, as arrays."""
    dealt = anchors.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(n // GROUP_ROWS + 1)))
    listed = F.collect_list(F.struct("id", "label", "vector", "scores")).alias("x")
    return dealt.groupBy("group").agg(listed).select("group", *(F.col(f"x.{c}").alias(f"a_{c}") for c in ("id", "label", "vector", "scores")))


class _Block:
    """Row ``k`` of a batch of blocks."""

    def __init__(self, batch: pa.RecordBatch, k: int):
        of = lambda name: batch.column(name)[k].values.to_numpy()
        self.ids, self.labels = of("ids"), of("labels")
        self.starts = np.append(of("starts"), len(self.ids))
        self.dims = [_unpacked(x.as_buffer()) for x in batch.column("dims")[k]]
        self.least, self.greatest = of("least"), of("greatest")

    def label_at(self, places: np.ndarray) -> np.ndarray:
        return self.labels[np.searchsorted(self.starts, places, "right") - 1]

    def of_label(self, label: int) -> slice:
        at = np.flatnonzero(self.labels == label)
        return slice(self.starts[at[0]], self.starts[at[0] + 1]) if len(at) else slice(0, 0)


def scan(anchor: np.ndarray, block: _Block, places: np.ndarray, keep: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows that ``keep`` leaves, and their scores.

    ``keep`` is given the least and the greatest score that each candidate can still have.
    """
    size = min(len(anchor), len(block.dims))
    q = anchor[:size]
    bounds = np.stack([q * block.least[:size], q * block.greatest[:size]])
    if size and float(np.abs(q).max()) * float(max(-block.least.min(), block.greatest.max(), 0)) * size >= 2.0**62:
        raise ValueError("components are too large for 64-bit scores")
    order = np.argsort(-np.abs(q), kind="stable")
    # what all dimensions after the k-th add at least and at most
    down, up = (np.append(np.cumsum(f(bounds, 0)[order][::-1])[::-1], 0) for f in (np.min, np.max))
    score = np.zeros(len(places), np.int64)
    everything = places
    alive = np.ones(len(places), bool)  # candidates among ``places``
    for k, d in enumerate(order.tolist()):
        if q[d]:
            score += q[d] * block.dims[d][places]
        if (k + 1) % STEP == 0 or k + 1 == size:
            still = keep(score + down[k + 1], score + up[k + 1])
            if not still.all():
                alive[alive] = still
                places, score = everything[alive], score[still]
            if not len(places):
                break
    return places, score


def _best(n: int) -> Callable:
    """Keep what may be among the ``n`` greatest."""

    def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return high >= np.partition(low, len(low) - n)[len(low) - n] if len(low) > n else np.ones(len(low), bool)

    return keep


def _in_windows(windows: list[tuple[int, int]], n: int) -> Callable:
    """Keep what may be among the ``n`` greatest scores of a window."""

    def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        out = np.zeros(len(low), bool)
        for least, most in windows:
            sure = low[(low >= least) & (high <= most)]
            if len(sure) > n:
                least = max(least, int(np.partition(sure, len(sure) - n)[len(sure) - n]))
            out |= (high >= least) & (low <= most)
        return out

    return keep


def _first(ids: np.ndarray, scores: np.ndarray, n: int) -> list[tuple[int, int]]:
    order = np.lexsort((ids, -scores))[:n]
    return list(zip(ids[order].tolist(), scores[order].tolist(), strict=True))


def _grid(partitions: int, blocks: int, anchors: int) -> tuple[int, int]:
    """Shards that blocks and parts that anchors are dealt over, about ``partitions`` together: every shard gets all anchors and every
    part all blocks, so that both sides are repeated to about the same size. A part has TASK_ANCHORS at most."""
    shards = max(1, min(partitions, blocks, ceil(sqrt(partitions * blocks * BLOCK_ROWS / max(1, anchors)))))
    return shards, max(1, min(ceil(partitions / shards), anchors // GROUP_ROWS + 1), ceil(anchors / TASK_ANCHORS))


def _met(blocks: DataFrame, groups: DataFrame, n: int, find: Callable, schema: str) -> DataFrame:
    """What ``find`` (anchor's id, label, vector, scores; block) yields for every block and each of ``n`` anchors in groups. Both are dealt
    over a grid of shards and parts; no row is made of less than a whole block and a whole group. Neither side is ever
    broadcast: Spark would guess a side's bytes from the rows before they are repeated, and the driver gets them after that."""
    shards, parts = _grid(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks.count(), n)
    each = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    left = blocks.withColumns({"shard": F.pmod("block", F.lit(shards)), "part": each(parts)})
    right = groups.withColumns({"part": F.pmod("group", F.lit(parts)), "shard": each(shards)})
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block = _Block(batch, k)
                ids, labels, vectors, scores = (batch.column(f"a_{c}")[k].as_py() for c in ("id", "label", "vector", "scores"))
                rows = []
                for i, label, data, own in zip(ids, labels, vectors, scores, strict=True):
                    rows += find(i, label, _unpacked(data), own, block)
                columns = list(zip(*rows, strict=True)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names)

    return left.join(right.hint("merge"), ["shard", "part"]).drop("shard", "part", "anchors").mapInArrow(run, schema)


def mine_hard_negatives(
    rows: DataFrame,
    is_anchor: Callable[[Column], Column],
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    scale: int = SCALE,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor``: the condition on an id that names the anchors, the query set; all rows are searched for each. A score is the
    inner product of floor(scale x). An anchor's positives are its ``positives`` best other rows of its label; for
    each of them come the ``negatives`` best rows of other labels whose score is from ``low`` to ``high`` hundredths of the
    positive's. Higher scores come first, equal ones by the lesser id; rank counts from 1.

    Rows with a null id, label, vector or component, or one that isn't finite, take no part. An empty vector scores 0; a
    shorter one as if zeros followed. Of rows that share an id the one with the least label, then vector, counts. An anchor
    without another row of its label, or a positive without such negatives (always so below 0), gives no rows.
    Components so large that scores could leave 64 bits raise an error. Other columns aren't read.
    """
    small_batches(rows.sparkSession)
    whole = quantised(rows, id_col, label_col, vector_col, scale)
    blocks = materialize(column_blocks(whole, is_anchor), "blocks")
    anchors, n = counted(anchors_of(blocks), "anchors")

    def best(i: int, label: int, q: np.ndarray, _: list, block: _Block) -> list[tuple]:
        here = block.of_label(label)
        places = np.arange(here.start, here.stop)
        places, score = scan(q, block, places[block.ids[places] != i], _best(positives))
        return [(i, other, s) for other, s in _first(block.ids[places], score, positives)]

    none = F.array().cast("array<bigint>")
    found = _met(blocks, _groups(anchors.withColumn("scores", none), n), n, best, "anchor_id long, positive_id long, positive_score long")
    first = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    chosen = found.withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") <= positives).drop("_nth")
    chosen = materialize(chosen, "positives")

    def below(i: int, label: int, q: np.ndarray, scores: list, block: _Block) -> list[tuple]:
        limits = {p: (-(-low * p // 100), high * p // 100) for p in scores}
        limits = {p: (x, y) for p, (x, y) in limits.items() if x <= y}
        if not limits:
            return []
        here = block.of_label(label)
        places = np.delete(np.arange(len(block.ids)), here)
        places, score = scan(q, block, places, _in_windows(list(limits.values()), negatives))
        out = []
        for p, (x, y) in limits.items():
            inside = (score >= x) & (score <= y)
            out += [(i, p, other, s) for other, s in _first(block.ids[places[inside]], score[inside], negatives)]
        return out

    windows = chosen.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_set("positive_score").alias("scores"))
    found = _met(blocks, _groups(anchors.join(windows.hint("merge"), "id"), n), n, below, "anchor_id long, positive_score long, negative_id long, negative_score long")
    first = Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives)
    return chosen.join(ranked.hint("merge"), ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
