"""Shipping the library to executors that do not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors as a zip, once an application, by Spark's own file server.

    Rows here can hold whole documents, so Arrow batches of Spark's default 10,000 rows are made
    smaller for the session; a size that the user has chosen stays.
    """
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, "1000")
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent
        path = os.path.join(tempfile.mkdtemp(prefix="weft-ship-"), "weft.zip")
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent).as_posix())
        spark.sparkContext.addPyFile(path)
        _SHIPPED.add(app)
    return spark


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt out by ``keys`` over all of the session's shuffle partitions.

    Left to itself, Spark merges partitions until 64 MB of packed rows are in one, and those take twenty times
    as much where they are sorted or hashed; it also hashes the rows of a whole file split before it deals them out.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def settle(df: DataFrame) -> DataFrame:
    """``df`` computed once, its lineage cut, in the shared folder that ``spark.checkpoint.dir`` names.

    Where it is unset a folder of this machine will do only if the executors are threads of this process.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weft-"))
    return df.checkpoint(eager=True)
