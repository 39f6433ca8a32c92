"""The routing log: one row per routing decision, appended, and its roll-up as a batch or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROUTING_SCHEMA = "id long, ts timestamp, question string, route string, confidence float, latency_ms int, template_id string, outcome string"


def append_decisions(rows: DataFrame, path: str) -> None:
    """Append a batch of decisions; files appear whole or not at all."""
    rows.select(
        [F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in ROUTING_SCHEMA.split(", ")]
    ).write.mode("append").parquet(path)


def read_decisions(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.schema(ROUTING_SCHEMA).parquet(path)


def rollup(log: DataFrame, kind: str = "route", ts: str = "ts", value: str = "latency_ms", late: str = "1 hour") -> DataFrame:
    """``day, kind, n, mean``: decisions a day and kind; on a stream, late rows up to ``late`` count."""
    if log.isStreaming:
        log = log.withWatermark(ts, late)
    return log.groupBy(
        F.window(ts, "1 day").alias("w"), F.col(kind).alias("kind")
    ).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("day"), "kind", "n", "mean")
