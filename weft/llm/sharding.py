"""Sharding by a two-pass external shuffle.

Pass one scatters records by seeded hashes: rendezvous hashing of the id names the shard, so the id
and the number of shards decide alone and a further shard takes rows only into itself; a hash of id
and text names one of the shard's buckets, as many as keep a bucket in memory. Spark's exchange is
the external scatter. Pass two runs a seeded Fisher-Yates shuffle over each bucket, and a bucket's
records follow those of the buckets before it, so that places in a shard have no gaps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .scratch import carried


def rendezvous(key: Column, n: int, seed: int = 17) -> Column:
    """The shard in 0..n-1 with the largest seeded hash of the key; null is a key of its own."""
    draws = F.array(*[F.struct(F.xxhash64(F.lit(seed), F.lit(i), key).alias("w"), F.lit(i).alias("i")) for i in range(n)])
    return F.array_max(draws)["i"]


def _permutation(n: int, rng: np.random.Generator) -> np.ndarray:
    """Fisher-Yates: swap each place, from the last, with one drawn from those up to it."""
    order = np.arange(n)
    draws = (rng.random(n) * np.arange(1, n + 1)).astype(np.int64)
    for i in range(n - 1, 0, -1):
        j = draws[i]
        order[i], order[j] = order[j], order[i]
    return order


def shard(
    docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 8 << 20, seed: int = 17
) -> DataFrame:
    """``docs`` with ``_shard``, ``_grown`` (the shard if there were one more) and ``_slot``.

    ``_slot`` counts 0, 1, ... within a shard. Null ids and texts are keys like any other; rows that
    are repeated in full share a bucket and get places of their own. An empty and a very long text are rows
    like any other. Other columns pass through, whatever their names;
    columns named ``_shard``, ``_grown`` or ``_slot`` are replaced. An empty table gives no rows.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    row = carried(docs, ("_shard", "_grown", "_slot"))
    tie = F.xxhash64(F.lit(seed + 1), F.col(id_col), F.col(text_col))
    rows = docs.select(
        row.alias("_row"), rendezvous(F.col(id_col), shards, seed).alias("_shard"),
        rendezvous(F.col(id_col), shards + 1, seed).alias("_grown"), tie.alias("_tie")
    )
    total = docs.agg(F.sum(F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 64)).first()[0] or 0
    buckets = max(1, -(-int(total) // (shards * bucket_bytes)))
    rows = rows.withColumn("_bucket", F.pmod("_tie", F.lit(buckets)).cast("int"))

    counts = rows.groupBy("_shard", "_bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("_shard").orderBy("_bucket")) - F.col("n")
    starts = counts.select("_shard", "_bucket", before.alias("_from"))  # a row per bucket
    # Joined before the scatter, by the keys of the scatter, so that texts are shuffled once.
    rows = rows.join(starts, ["_shard", "_bucket"])

    def shuffled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches)).combine_chunks()  # one bucket
        if not held.num_rows:
            return
        name, start = tuple(held.column(c)[0].as_py() for c in ("_shard", "_bucket")), held.column("_from")[0].as_py()
        held = held.take(pa.array(np.argsort(held.column("_tie").to_numpy(), kind="stable")))
        order = _permutation(held.num_rows, np.random.default_rng((seed, *name)))
        out = held.take(pa.array(order)).append_column("_slot", pa.array(start + np.arange(held.num_rows)))
        yield from out.to_batches(max_chunksize=2_000)

    schema = StructType([*rows.schema.fields]).add("_slot", LongType())
    placed = rows.groupBy("_shard", "_bucket").applyInArrow(shuffled, schema)
    return placed.select("_row.*", "_shard", "_grown", "_slot")


def write_shards(docs: DataFrame, path: str, shards: int, **options) -> None:
    """Write each shard to a folder ``_shard=k`` under ``path``, records in the order of ``_slot``.

    Buckets of a shard go to files of their own, each a run of slots, so no task holds a shard.
    """
    rows = shard(docs, shards, **options)
    rows.repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(path)
