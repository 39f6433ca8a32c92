"""Cutting lineage through files that every executor and the driver can read; memory of Python workers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Tables cut on the way to others that are being made, innermost last.
_OPEN: list[list[tuple[SparkSession, str]]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir`` or set on the context; there is no other that all machines share.

    Only where the master is this machine's own process does an unset folder mean a local one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weft-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later plans start from the files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weft-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    if _OPEN:
        _OPEN[-1].append((spark, path))
    return spark.read.schema(schema).parquet(path)


def cut_last(make: Callable[[], DataFrame]) -> DataFrame:
    """``cut(make())``; the tables that were cut on the way go once it is written."""
    _OPEN.append([])
    try:
        out = cut(make())
    finally:
        made = _OPEN.pop()
    *passed, last = made
    for spark, path in passed:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if _OPEN:
        _OPEN[-1].append(last)
    return out


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run inside give Python this many rows at a time at most: for rows that hold whole blocks."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def give_back() -> None:
    """At a task's end: memory that this Python worker, which Spark uses again, no longer needs goes to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


@contextmanager
def one_thread() -> Iterator[None]:
    """NumPy's OpenBLAS keeps to the thread of this Python worker: on small products, more threads mostly wait for one another."""
    before = []
    try:
        with open("/proc/self/maps") as maps:
            paths = {x.split()[-1] for x in maps if "openblas" in x}
        for lib in map(ctypes.CDLL, paths):
            for name in ("scipy_openblas_{}_num_threads64_", "scipy_openblas_{}_num_threads", "openblas_{}_num_threads64_", "openblas_{}_num_threads"):
                if hasattr(lib, name.format("set")):
                    before.append((getattr(lib, name.format("set")), getattr(lib, name.format("get"))()))
                    before[-1][0](1)
                    break
    except OSError:  # another system
        pass
    try:
        yield
    finally:
        for put, n in before:
            put(n)


def carried(df: DataFrame, without: tuple[str, ...] = ()) -> Column:
    """The columns of ``df`` in one struct, so that none can clash with a column that an operator adds on the way."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c not in without])


def batched(kind: str, run: Callable[[pa.Array], pa.Array]) -> Callable[[Column], Column]:
    """A column function of type ``kind`` that runs batch by batch in Python and gives memory back at a task's end.

    It counts as not deterministic, so that no filter on its result is pushed below it and runs it again.
    """

    @F.arrow_udf(kind)
    def over(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            yield from map(run, batches)
        finally:
            give_back()

    return over.asNondeterministic()
