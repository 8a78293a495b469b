"""Shared scratch tables: the one place where intermediate results are written and lineage is cut."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``.

    A cluster sets it to a folder that all executors share; without it nothing is written there, since executors
    would each write to a disk of their own. Only where all runs in one process on this machine (tests, a
    laptop) is a temporary folder made and set for the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="sparklayout-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Paths made since each open :func:`scratch` began, the innermost last.
_open: list[list[str]] = []


def new_path(spark: SparkSession, tag: str) -> str:
    """A path below :func:`work_dir` that no other run uses."""
    path = f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Remove a table of ours, in whatever store it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables that are written inside are deleted at the end, but for those written by the function that it gives."""
    made: list[str] = []
    kept: list[str] = []
    _open.append(made)

    def keep(df: DataFrame, tag: str) -> DataFrame:
        before = len(made)
        table = materialize(df, tag)
        kept.append(made[before])
        return table

    try:
        yield keep
    finally:
        _open.remove(made)
        for path in made:
            if path not in kept:
                delete(spark, path)
        if _open:
            _open[-1].extend(kept)


def materialize(df: DataFrame, tag: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Later jobs read the files, so a lost executor costs nothing that was computed before, and loops
    don't drag an ever longer lineage along.
    """
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, tag: str = "table") -> tuple[DataFrame, int]:
    """:func:`materialize` and the number of rows, which the writing job takes along."""
    seen = Observation()
    return materialize(df.observe(seen, F.count(F.lit(1)).alias("n")), tag), seen.get["n"]
