"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The only characters that count as white space for the near and exact duplicate operators.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _malloc_trim() -> Callable[[int], int]:
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive their tasks, and what one stage has freed
    would otherwise count beside the executor's heap in the next."""
    pa.default_memory_pool().release_unused()
    _malloc_trim()(0)


#: Bytes of rows that go to a Python worker at once, where the session has Spark's own default.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python workers in batches of some megabytes: an executor and its workers each hold a batch for every task,
    and with Spark's 64 MB those would be much of their memory. A setting of the session's own is left as it is."""
    if spark.conf.get(BATCH[0], "64m").lower() in ("64m", "64mb", "67108864", "67108864b"):
        spark.conf.set(*BATCH)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts take about ``most_bytes``, at least one row each."""
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)
    give_back()


def lower_ascii(text: Column) -> Column:
    """A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Bytes of keys that may be sent to every task; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def sized(keys: DataFrame) -> DataFrame:
    """``keys`` marked for broadcast if they are found to take at most BROADCAST_BYTES, else as they are, for a join
    by shuffle. So long texts stay where they are while the other side is known to be small."""
    width = F.lit(16)
    for field in keys.schema:
        plain = field.dataType.typeName() not in ("string", "binary")
        width = width + (F.lit(8) if plain else F.coalesce(F.octet_length(field.name), F.lit(0)))
    total = keys.agg(F.sum(width.cast("long"))).first()[0] or 0
    return F.broadcast(keys) if total <= BROADCAST_BYTES else keys


def with_ids(rows: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows whose id is among ``ids``, a table (cheap to read twice) with a column of that name."""
    return rows.join(sized(ids.select(id_col).distinct()), id_col, "left_semi").select(*rows.columns)


def without_ids(rows: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows whose id is not among ``ids``; rows with a null id stay."""
    gone = sized(ids.select(id_col).where(F.col(id_col).isNotNull()).distinct())
    return rows.join(gone, id_col, "left_anti").select(*rows.columns)


class Memo(dict):
    """What ``make`` gives for a key, remembered within ``most_bytes``. ``make_room`` starts a new generation
    where the present one holds half of them; it is called between texts or runs of texts, so a run finds what it
    has put in. What is asked for again comes over from the old generation. Keys of more than ``longest``
    characters are made anew each time."""

    #: What an entry takes beside the characters of key and value.
    ENTRY = 180

    def __init__(self, most_bytes: int, make: Callable | None = None, longest: int = 64):
        super().__init__()
        self.most, self.make, self.longest, self.size = most_bytes // 2, make, longest, 0
        self.old: dict = {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            self[key] = value
            self.size += len(key) + len(value) + self.ENTRY
        return value

    def unknown(self, keys: Iterable[str]) -> list[str]:
        """The keys that aren't remembered; those of the old generation are taken over."""
        missing = [x for x in keys if x not in self]
        if self.old and missing:
            back = [x for x in missing if x in self.old]
            self.learn(back, [self.old[x] for x in back])
            missing = [x for x in missing if x not in self]
        return missing

    def learn(self, keys: list[str], values: list) -> None:
        self.update(zip(keys, values, strict=True))
        self.size += sum(map(len, keys)) + sum(map(len, values)) + self.ENTRY * len(keys)

    def make_room(self) -> None:
        if self.size > self.most:
            self.old = dict(self)
            self.clear()
            self.size = 0


_held: dict[str, tuple] = {}


def held(name: str, key: object, make: Callable) -> object:
    """``make(key)``, kept by the worker process until an operator asks for something else under another name
    or key. Workers outlive their tasks: so one operator's tables never stand beside another's."""
    if _held.get(name, (None,))[0] != key or name not in _held:
        settle()
        _held[name] = (key, make(key))
        give_back()
    return _held[name][1]


def settle() -> None:
    """Let go what another operator holds in this worker; for tasks that hold nothing themselves."""
    if _held:
        _held.clear()
        give_back()
