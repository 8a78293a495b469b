"""Near duplicates by an exact Jaccard self-join over word n-grams, with vertical partitioning.

Each text becomes a set of hashed n-grams in one global order. Two sets of similarity t or more share an
n-gram among their first ``n - ceil(t n) + 1``, so only those prefixes are joined. In the order, n-grams
that a sample shows to be frequent come last, which keeps them out of most prefixes; the order changes the
work only, never the result.

Links are looked for in rounds. First the documents of a bucket (documents with one prefix n-gram in
common) are paired with the bucket's least document, which is linear in the bucket, and linked documents are
joined into components. While crowded buckets with several components remain and rounds still help, what is
outside a bucket's largest component is paired with another document of that component. At last all pairs
of different components that still share a bucket are taken. So no group of near copies is expanded into
all its pairs, and no link between components is lost. A pair is compared only if the prefix n-grams that it shares, and all that could follow the last of
them, would be enough, and if their sketches (the parities of the number of n-grams in each of SKETCH bits) don't
differ in more places than two similar sets can. To compare a pair, the order is cut into fragments; the overlap is
counted in every fragment separately and summed per pair.

Hashes have 62 bits: two different n-grams of one pair of texts agree by chance about once in 10^12 pairs
of texts with a thousand n-grams each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparklayout.llm.common import settle, slices, small_batches, without_ids
from sparklayout.operators.graph import connected_components
from sparklayout.sources.work import counted, materialize, scratch

WORDS, PERCENT = 5, 75
#: The sample that finds frequent n-grams: this share of the documents, this many at least; how often an
#: n-gram must occur in it; how many are kept (8 bytes each, sent to all tasks); which share of the documents, or
#: which number of them, makes one hot, and over how many salts a hot one is dealt (more where a salt would get more rows than that).
SAMPLE_SHARE, SAMPLE_LEAST, SEEN, FREQUENT_MOST, HOT_SHARE, HOT_ROWS, SALTS = 0.05, 4000, 3, 200_000, 0.01, 200_000, 32
#: Leaders of a bucket in each further round. The rounds end early when the pairs between the largest
#: components of buckets and what is outside them are at most CROWDED times the rows.
LEADERS, CROWDED = (2, 32), 64
#: Cuts of the global order; frequent n-grams are the last fragment.
FRAGMENTS = 8
#: Bits of a sketch; rows of ids or keys that are sent to all tasks, 16 bytes each, instead of being shuffled for a join.
SKETCH, BROADCAST_KEYS = 2048, 1_000_000
#: Rows from which a bucket is crowded in the last round, and the columns of a short sketch of 512 bits, which there
#: stands beside each key.
CROWD = 32
SHORT = tuple(f"k{i}" for i in range(8))

_BITS = 62
_FACTORS = np.random.Generator(np.random.PCG64(9)).integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit sums over all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) >> np.uint64(64 - _BITS)


def shingles(data: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a UTF-8 text's word n-grams.

    A-Z is lower-cased and words are what stands between ASCII white space. A text with fewer words is
    one n-gram as a whole; one without words has none.
    """
    import xxhash

    found = data.lower().split() if data else []
    n = len(found)
    if not n:
        return np.empty(0, np.int64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, n)
    width = min(words, n)
    with np.errstate(over="ignore"):
        total = np.full(n - width + 1, width, np.uint64)
        for k in range(width):
            total += hashes[k : n - width + 1 + k] * _FACTORS[k % 64]
    return np.unique(_mix(total)).astype(np.int64)


class Order:
    """The global order: frequent n-grams get keys from 2^62 on, the least frequent first."""

    def __init__(self, frequent: np.ndarray, hot: int, salts: int = SALTS):
        """``frequent``: hashes by falling frequency, of which the first ``hot`` are hot and dealt over ``salts``."""
        self.salts = salts
        self.hashes = np.sort(frequent)
        self.keys = (1 << _BITS) + len(frequent) - 1 - np.argsort(frequent)
        self.hot_from = (1 << _BITS) + len(frequent) - hot
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.hashes >> (_BITS - 20)] = True

    def keys_of(self, found: np.ndarray) -> np.ndarray:
        """Sorted keys of sorted hashes."""
        at = np.flatnonzero(self.maybe[found >> (_BITS - 20)])
        if not len(at):
            return found
        place = np.minimum(np.searchsorted(self.hashes, found[at]), len(self.hashes) - 1)
        hit = self.hashes[place] == found[at]
        if not hit.any():
            return found
        out = found.copy()
        out[at[hit]] = self.keys[place[hit]]
        return np.sort(out)


def _by_slices(column: str, make: Callable[[list], pa.RecordBatch]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for batch in batches:
            for part in slices(batch, column, 2 << 20):
                yield make(part)

    return run


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.empty(0, np.int64)])))


def _texts(part: pa.RecordBatch) -> list[bytes | None]:
    return part.column("text").cast(pa.binary()).to_pylist()


def frequent_order(docs: DataFrame, words: int = WORDS) -> Order:
    """Count n-grams over a sample of the documents and put the frequent ones last."""
    total = docs.count()
    share = min(1.0, max(SAMPLE_SHARE, SAMPLE_LEAST / max(1, total)))
    picked = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))

    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(x, words) for x in _texts(part)]
        keys, n = np.unique(np.concatenate([*sets, np.empty(0, np.int64)]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["s", "n"])

    counts = picked.mapInArrow(_by_slices("text", count), "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") >= SEEN).orderBy(F.desc("n"), "s").limit(FREQUENT_MOST).collect()
    least = max(SEEN, share * min(HOT_SHARE * total, HOT_ROWS))
    most = top[0]["n"] / share if top else 0
    return Order(np.array([r["s"] for r in top], np.int64), sum(r["n"] >= least for r in top), max(SALTS, ceil(most / HOT_ROWS)))


def sketch(keys: np.ndarray) -> np.ndarray:
    """SKETCH bits as 64-bit numbers: whether the number of keys that fall on a bit is odd. Two sketches differ in
    no more bits than the sets differ in keys."""
    odd = np.bincount(keys & (SKETCH - 1), minlength=SKETCH).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def _folded(sketch: Column, i: Column) -> Column:
    """The i-th number of a sketch of a quarter of the bits: parities add up."""
    step = SKETCH // 64 // 4
    return reduce(lambda x, y: x.bitwiseXOR(y), (sketch[i + k * step] for k in range(4)))


def prefixes(docs: DataFrame, order: Order, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n (set size), sig (digest of the set), prefix (keys in order, as many as can matter), sketch."""
    import xxhash

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        sizes, sigs, heads, sketches = [], [], [], []
        for data in _texts(part):
            keys = order.keys_of(shingles(data, words))
            n = len(keys)
            sizes.append(n)
            sigs.append(xxhash.xxh3_128_digest(keys.tobytes()))
            heads.append(keys[: n + (-percent * n) // 100 + 1] if n else keys)
            sketches.append(sketch(keys))
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(sizes, pa.int32()), pa.array(sigs, pa.binary()), _lists(heads), _lists(sketches)],
            ["doc_id", "n", "sig", "prefix", "sketch"],
        )

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n int, sig binary, prefix array<bigint>, sketch array<bigint>"
    return docs.mapInArrow(_by_slices("text", make), schema)


def _enough(percent: int):
    """Whether a pair that shares ``c`` prefix keys can be similar: of what follows the last shared key,
    or the shorter of the prefixes, at most so much can be shared."""
    after = f"least(least(left_a, left_b) - 1, greatest(ceil({percent} * n_a / 100D), ceil({percent} * n_b / 100D)) - 1)"
    return F.expr(f"(100 + {percent}) * (c + {after}) >= {percent} * (n_a + n_b)")


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows (a, b, n_a, n_b, left_a, left_b) with the lesser id as ``a``; sizes and rests go with their ids."""
    swap = F.col("a") > F.col("b")
    names = ("a", "b", "n_a", "n_b", "left_a", "left_b")
    other = ("b", "a", "n_b", "n_a", "left_b", "left_a")
    rest = [c for c in rows.columns if c not in names]
    return rows.select(*(F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in zip(names, other, strict=True)), *rest)


def _per_pair(rows: DataFrame, percent: int) -> DataFrame:
    """Rows (a, b, n_a, n_b, left_a, left_b), one for each shared prefix key (or with ``w``, twice the number of keys that they
    stand for, the first and the last among them), to the pairs worth comparing.

    A pair must be in the same order in all its rows. No more can be shared than what follows the first shared key
    (``most``), nor than the shared keys and what follows the last.
    """
    least = (F.min(x).alias(x) for x in ("n_a", "n_b", "left_a", "left_b"))
    most = F.max(F.least("left_a", "left_b")).alias("most")
    keys = F.sum("w") / 2 if "w" in rows.columns else F.count("*")
    pairs = rows.groupBy("a", "b").agg(keys.alias("c"), most, *least)
    return pairs.where(_enough(percent)).where(f"(100 + {percent}) * most >= {percent} * (n_a + n_b)")


def _ids(pairs: DataFrame) -> tuple[DataFrame, int]:
    """The ids of both sides, written to a table, and their number."""
    return counted(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids")


def _among(rows: DataFrame, ids: DataFrame, n: int, key: str) -> DataFrame:
    """The rows whose ``key`` is among ``ids`` (a table with a column of that name and ``n`` rows)."""
    return rows.join(F.broadcast(ids) if n <= BROADCAST_KEYS else ids, key, "left_semi")


def promising(pairs: DataFrame, sketches: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, int]:
    """The pairs (a, b) whose sketches allow the similarity, as a table, and their number.

    ``sketches``: doc_id, n, sketch. Sets of this similarity differ in (100 - percent) / (100 + percent) of their sizes'
    sum at most.
    """
    near = _among(sketches, *_ids(pairs), "doc_id")
    both = pairs.select("a", "b").join(near.toDF("a", "n_a", "s_a"), "a").join(near.toDF("b", "n_b", "s_b"), "b")
    apart = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    close = both.where((100 + percent) * apart <= (100 - percent) * (F.col("n_a") + F.col("n_b")))
    return counted(close.select("a", "b").distinct(), "promising")


def overlaps(docs: DataFrame, pairs: DataFrame, order: Order, words: int = WORDS) -> DataFrame:
    """(a, b, version_a, version_b, n_a, n_b, shared): the sizes of the sets and of their intersections, counted
    fragment by fragment and summed. An id with several texts has as many versions."""
    import xxhash

    def cut(part: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        for doc_id, data in zip(part.column("doc_id").to_pylist(), _texts(part), strict=True):
            keys = order.keys_of(shingles(data, words))
            version = xxhash.xxh3_64_intdigest(keys.tobytes()) >> 1
            edges = np.searchsorted(keys, np.arange(FRAGMENTS + 1) << (_BITS - 3))
            edges[0] = 0
            for f, (lo, hi) in enumerate(zip(edges, [*edges[1:], len(keys)], strict=True)):
                if hi > lo:
                    rows.append((doc_id, version, len(keys), f, keys[lo:hi]))
        doc_ids, versions, sizes, fragments, arrays = zip(*rows, strict=True) if rows else ((),) * 5
        return pa.RecordBatch.from_arrays(
            [
                pa.array(doc_ids, part.schema.field("doc_id").type),
                pa.array(versions, pa.int64()),
                pa.array(sizes, pa.int32()),
                pa.array(fragments, pa.int32()),
                _lists(list(arrays)),
            ],
            ["doc_id", "version", "n", "fragment", "keys"],
        )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, version long, n int, fragment int, keys array<bigint>"
    cuts = materialize(_among(docs, *_ids(pairs), "doc_id").mapInArrow(_by_slices("text", cut), schema), "fragments")
    side = lambda x: cuts.select("fragment", *(F.col(c).alias(y) for c, y in (("doc_id", x), ("version", f"version_{x}"), ("n", f"n_{x}"), ("keys", f"keys_{x}"))))
    partial = pairs.select("a", "b").join(side("a"), "a").join(side("b"), ["b", "fragment"])
    shared = F.size(F.array_intersect("keys_a", "keys_b"))
    return partial.groupBy("a", "b", "version_a", "version_b", "n_a", "n_b").agg(F.sum(shared).alias("shared"))


def _links(docs: DataFrame, pairs: DataFrame, sketches: DataFrame, order: Order, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the similarity, written to a table."""
    close, n = promising(pairs, sketches, percent)
    if not n:
        return close
    linked = overlaps(docs, close, order, words).where(F.expr(f"100 * shared >= {percent} * (n_a + n_b - shared)"))
    return materialize(linked.select("a", "b").distinct(), "links")


def _mixed(rows: DataFrame, labels: DataFrame) -> tuple[DataFrame, int, int]:
    """rows (s, rep, left) of buckets with several components, written to a table: s, rep, n, left, label, the bucket's
    largest component ``most`` and its number of rows ``size``. Also the number of those rows, and of pairs of one
    row inside the largest component and one outside."""
    placed = rows.join(labels, "rep")
    per_label = placed.groupBy("s", "label").agg(F.count("*").alias("size"))
    mixed, n = counted(
        per_label.groupBy("s")
        .agg(
            F.count("*").alias("labels"),
            F.max_by("label", F.struct("size", "label")).alias("most"),
            F.max("size").alias("inside"),
            F.sum("size").cast("int").alias("size"),
        )
        .where("labels > 1")
        .select("s", "most", "inside", "size"),
        "most",
    )
    total, pairs = mixed.agg(F.sum("size"), F.sum(F.expr("inside * (size - inside)"))).first()
    mixed = mixed.drop("inside")
    found = placed.join(F.broadcast(mixed) if n <= BROADCAST_KEYS else mixed, "s")
    return materialize(found.select("s", "rep", "n", "left", "label", "most", "size"), "mixed"), total or 0, pairs or 0


def _with_neighbours(rows: DataFrame) -> DataFrame:
    """``rows`` and the keys before and after in the row's own document (``prev``, ``next``), and the row's number there (``idx``)."""
    own = Window.partitionBy("rep").orderBy("s", F.desc("left"))
    return rows.withColumns({"prev": F.lag("s").over(own), "next": F.lead("s").over(own), "idx": F.row_number().over(own)})


def _meetings(rows: DataFrame, percent: int, short: bool) -> DataFrame:
    """(a, b, n_a, n_b, left_a, left_b, w) for shared prefix keys of pairs of different components, as far as sizes allow.

    ``w``: twice the number of shared keys that a row stands for. With ``short`` (rows have short sketches and
    :func:`_with_neighbours`): as far as the sketches allow too, and only where a run of keys that both have one after the other begins or
    ends; near copies share long ones. The weights of its two ends add up to the run's keys.
    """
    columns = ("rep", "n", "left", "label", *((*SHORT, "prev", "next", "idx") if short else ()))
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in columns]
    outside = rows.where("label <> most").select("s", *side("a"))
    pairs = outside.join(rows.select("s", *side("b"), (F.col("label") == F.col("most")).alias("in_most")), "s")
    pairs = pairs.where("label_a <> label_b and (in_most or rep_a < rep_b)")
    pairs = pairs.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    weight = F.lit(2)
    if short:
        begins, ends = F.expr("coalesce(prev_a <> prev_b, true)"), F.expr("coalesce(next_a <> next_b, true)")
        pairs = pairs.where(begins | ends)
        apart = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{k}_a").bitwiseXOR(F.col(f"{k}_b"))) for k in SHORT))
        pairs = pairs.where(F.coalesce((100 + percent) * apart <= (100 - percent) * (F.col("n_a") + F.col("n_b")), F.lit(True)))
        place = F.col("idx_a") + F.col("idx_b")
        weight = F.when(ends, place + 2).otherwise(0) - F.when(begins, place).otherwise(0)
    found = pairs.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"), "n_a", "n_b", "left_a", "left_b", weight.alias("w"))
    return _ordered(found)


def _short_sketches(sets: DataFrame, ids: tuple[DataFrame, int]) -> DataFrame:
    """rep and the columns SHORT of the documents among ``ids``; null where an id has several texts."""
    own = _among(sets.where("n > 0").select("doc_id", "sketch"), *ids, "doc_id")
    short = F.transform(F.sequence(F.lit(0), F.lit(len(SHORT) - 1)), lambda i: _folded(F.col("sketch"), i)).alias("short")
    one = own.select("doc_id", short).groupBy("doc_id").agg(F.min("short").alias("low"), F.max("short").alias("high"))
    return one.select(F.col("doc_id").alias("rep"), *(F.when(F.col("low") == F.col("high"), F.col("low")[i]).alias(k) for i, k in enumerate(SHORT)))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """doc_id, n_shingles, component_id for every row.

    Documents link when their n-gram sets' intersection is at least ``percent`` % of their union;
    ``component_id`` is the least id that links lead to. Texts without words (null, empty, blank) link
    with nothing; rows with a null id get a null component. Rows that repeat an id with the same text
    each get their row; an id with several texts is linked as if it were one document with any of them.
    An empty input gives an empty result. Other columns are not read. Only the result stays in the shared folder.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    with scratch(docs.sparkSession) as keep:
        found = keep(_components(rows, words, percent), "components")
    return found.withColumnRenamed("doc_id", id_col)


def _components(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id of rows (doc_id, text)."""
    order = frequent_order(rows, words)
    sets = materialize(prefixes(rows, order, words, percent), "sets")

    # equal sets are one: the least id stands for all. What is grouped is written before it is joined, so that
    # a set or a key that many rows have is split by adaptive execution
    known = sets.where("n > 0 and doc_id is not null").select("doc_id", "n", "sig")
    groups = materialize(known.groupBy("sig").agg(F.min("doc_id").alias("rep")), "groups")
    members = materialize(known.join(groups, "sig").select("doc_id", "n", "rep"), "members")
    times = F.count("*").alias("times")
    reps = materialize(members.where("doc_id = rep").groupBy("rep").agg(F.max("n").alias("n"), times), "reps")
    repeated = not reps.where("times > 1").isEmpty()
    reps = reps.drop("times")
    sketches = sets.where("n > 0 and doc_id is not null").select("doc_id", "n", "sig", "sketch")
    sketches = (sketches.dropDuplicates(["doc_id", "sig"]) if repeated else sketches).drop("sig")
    rep_texts = rows.where("text is not null")
    rep_texts = rep_texts.dropDuplicates() if repeated else rep_texts

    # hot keys are dealt over salts; each salt has a leader of its own
    hot = F.col("s") >= order.hot_from
    buckets = sets.where("doc_id is not null").select("doc_id", "n", F.posexplode("prefix").alias("p", "s")).select(
        "s",
        F.when(hot, F.pmod(F.xxhash64("doc_id"), F.lit(order.salts))).otherwise(-1).cast("int").alias("salt"),
        "doc_id",
        "n",
        (F.col("n") - F.col("p")).alias("left"),
    )
    bucket = Window.partitionBy("s", "salt")
    shared = materialize(
        buckets.select(
            "*",
            F.count("*").over(bucket).alias("size"),
            F.min(F.struct("doc_id", "n", "left")).over(bucket).alias("leader"),
        )
        .where("size > 1 or salt >= 0")
        .drop("size"),
        "buckets",
    )

    # round 1: everyone with the leader, leaders of one hot key with the least of them
    by_salt = shared.where("salt >= 0").groupBy("s").agg(F.min("leader").alias("top"))
    tops = shared.where("salt >= 0 and leader.doc_id = doc_id").join(by_salt, "s").withColumn("leader", F.col("top"))
    near = _per_pair(
        shared.unionByName(tops.select(*shared.columns))
        .where("leader.doc_id <> doc_id")
        .select(
            F.col("leader.doc_id").alias("a"),
            F.col("leader.n").alias("n_a"),
            F.col("leader.left").alias("left_a"),
            F.col("doc_id").alias("b"),
            F.col("n").alias("n_b"),
            F.col("left").alias("left_b"),
        ),
        percent,
    ).join(members.select(F.col("doc_id").alias("b"), "rep"), "b")
    pairs = materialize(near.where("a <> rep").select("a", F.col("rep").alias("b")).distinct(), "pairs")
    links = _links(rep_texts, pairs, sketches, order, words, percent)
    compared = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    # further rounds: what is outside the largest component of its bucket with other leaders inside
    rows_left = shared.select("s", F.col("doc_id").alias("rep"), "left").distinct()
    for many in (*LEADERS, 0):
        labels = materialize(
            connected_components(reps, links, vertex="rep", src="a", dst="b", label="label").join(reps.select("rep", "n"), "rep"), "labels"
        )
        rest, left, possible = _mixed(rows_left, labels)
        if not many or not left or possible <= CROWDED * left:
            break
        rows_left = rest.select("s", "rep", "left")
        hashed = F.xxhash64("rep", F.lit(many))
        one = F.min_by(F.struct("rep", "n", "left"), F.struct(hashed, "rep")).alias("leader")
        leaders = rest.where("label = most").groupBy("s", F.pmod(hashed, F.lit(many)).alias("_class")).agg(one)
        tried = _per_pair(
            _ordered(
                rest.where("label <> most")
                .join(leaders, "s")
                .select(
                    F.col("leader.rep").alias("a"),
                    F.col("rep").alias("b"),
                    F.col("leader.n").alias("n_a"),
                    F.col("n").alias("n_b"),
                    F.col("leader.left").alias("left_a"),
                    F.col("left").alias("left_b"),
                )
            ),
            percent,
        ).select("a", "b")
        tried = materialize(tried.join(compared, ["a", "b"], "left_anti"), "pairs")
        links = links.unionByName(_links(rep_texts, tried, sketches, order, words, percent))
        compared = compared.unionByName(tried)

    # all pairs of different components that still share a bucket. In crowded buckets rows bring their short sketches, so
    # only pairs that may be similar leave the join, twice at most for a run of shared keys
    plain, crowded = rest.where(F.col("size") <= CROWD), rest.where(F.col("size") > CROWD)
    ids = counted(crowded.select(F.col("rep").alias("doc_id")).distinct(), "ids")
    meetings = _meetings(plain, percent, False)
    if ids[1]:
        close = _with_neighbours(crowded).join(_short_sketches(sets, ids), "rep")
        meetings = meetings.unionByName(_meetings(close, percent, True))
    more = _per_pair(meetings, percent).select("a", "b")
    more = materialize(more.join(compared, ["a", "b"], "left_anti"), "pairs")
    joined = links.unionByName(_links(rep_texts, more, sketches, order, words, percent))
    final = materialize(connected_components(reps, joined, vertex="rep", src="a", dst="b", label="component_id"), "final")

    known = members.join(final, "rep").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return sets.select("doc_id", "n").join(known, "doc_id", "left").select(
        F.col("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component stays: the one with the component's id. Rows with a null id stay."""
    found = near_duplicates(docs, id_col, text_col)
    return without_ids(docs, found.where(F.col(id_col) != F.col("component_id")), id_col)
