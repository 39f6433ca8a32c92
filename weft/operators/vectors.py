"""Exact nearest neighbours by cosine distance.

One query: a native scan and a top-k. Many queries: a block of queries is sent to every task, and
each Arrow batch of the table is one matrix product; every task keeps k rows per query, so what is
shuffled is k rows per query and task, whatever the table holds. More queries than a block holds are
answered block after block, each written before the next is read, so any number of them is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.session import settle

#: A block of queries goes to every task: at most so many, and at most so many bytes of vectors.
BLOCK_QUERIES, BLOCK_BYTES = 16_384, 16 << 20
_CELLS = 1 << 21  # distances that a task holds at once


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 where a vector has no length."""
    a, b = (F.transform(v, lambda x: x.cast("double")) for v in (a, b))
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def nearest(table: DataFrame, query: list[float], k: int = 5, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows nearest to one vector, with ``dist`` (1 - cosine, never below 0); ties by id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dist = F.greatest(F.round(1 - cosine(F.col(vector_col), q), 6), F.lit(0.0))
    return table.withColumn("dist", dist).orderBy("dist", id_col).limit(k)


def batch_nearest(
    table: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    include_self: bool = True
) -> DataFrame:
    """``query_id, <id>, dist, rank`` of the k nearest rows of ``table`` to each query (``query_id, vector``).

    A null vector, or one of another width than the first query's of a block, is no neighbour. Blocks of
    about ``BLOCK_QUERIES`` queries are chosen by a hash of the query's id. ``include_self``
    false leaves out rows whose id is the query's.
    """
    asked = queries.select(F.col("query_id").cast("long"), F.col("vector").cast("array<double>").alias("v")).where("v is not null")
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("w")).first()
    blocks = max(1, math.ceil(size["n"] / BLOCK_QUERIES), math.ceil(8 * size["w"] / BLOCK_BYTES))
    if blocks == 1:
        return _block_nearest(table, asked.collect(), k, id_col, vector_col, include_self)
    found = None
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64(F.lit(7), "query_id"), F.lit(blocks)) == b).collect()
        part = settle(_block_nearest(table, rows, k, id_col, vector_col, include_self))
        found = part if found is None else found.unionAll(part)
    return found


def _block_nearest(table: DataFrame, rows: list, k: int, id_col: str, vector_col: str, include_self: bool) -> DataFrame:
    """``batch_nearest`` for queries that the driver holds."""
    out_schema = f"query_id long, {id_col} long, dist double"
    if not rows:
        return table.sparkSession.createDataFrame([], out_schema + ", rank int")
    ids = np.array([r["query_id"] for r in rows])
    q = np.array([r["v"] for r in rows])
    q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_d = np.full((len(ids), 0), np.inf)
        best_i = np.zeros((len(ids), 0), np.int64)
        for x in batches:
            v = x.column(1)
            fit = np.flatnonzero(
                (
                    v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == q.shape[1]
                ) & x.column(0).is_valid().to_numpy(zero_copy_only=False)
            )
            step = max(64, _CELLS // len(ids))
            for lo in range(0, len(fit), step):
                rows_ = pa.array(fit[lo : lo + step])
                own = x.column(0).take(rows_).to_numpy()
                m = np.asarray(v.take(rows_).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(own), -1)
                length = np.linalg.norm(m, axis=1)
                d = np.maximum(np.round(1 - np.where(length > 0, (q @ m.T) / np.maximum(length, 1e-300), 0.0), 6), 0.0)
                if not include_self:
                    d[ids[:, None] == own[None, :]] = np.inf
                i = np.broadcast_to(own, d.shape)
                if d.shape[1] > k:  # what is no farther than the k-th nearest, ties included, is sorted
                    least = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
                    near = d <= least
                    width = int(near.sum(axis=1).max())
                    first = np.argsort(~near, axis=1, kind="stable")[:, :width]
                    d, i = np.take_along_axis(np.where(near, d, np.inf), first, 1), np.take_along_axis(i, first, 1)
                d, i = np.concatenate((best_d, d), axis=1), np.concatenate((best_i, i), axis=1)
                take = np.lexsort((i, d), axis=1)[:, :k]
                best_d, best_i = np.take_along_axis(d, take, 1), np.take_along_axis(i, take, 1)
        keep = np.isfinite(best_d)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.broadcast_to(ids[:, None], best_d.shape)[keep]), pa.array(best_i[keep]), pa.array(best_d[keep])],
            ["query_id", id_col, "dist"]
        )

    near = table.select(F.col(id_col).cast("long"), F.col(vector_col)).mapInArrow(run, out_schema)
    w = Window.partitionBy("query_id").orderBy("dist", id_col)
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def label_recall_at_k(found: DataFrame, asked: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """``recall_at_k`` where the rows relevant to a question (``query_id``) are the others of its label.

    ``labels``: id, label. A question and a found row are compared by their labels, and whether a label has
    another row is seen from its least and largest id, so the pairs of a label are never listed.
    """
    named = labels.select("id", "label").where("label is not null")
    own = asked.select(F.col("query_id").alias("id")).distinct().join(named, "id").select(F.col("id").alias("query_id"), "label").distinct()
    span = named.groupBy("label").agg(F.min("id").alias("_lo"), F.max("id").alias("_hi"))
    questions = own.join(span, "label").where("_lo <> query_id or _hi <> query_id").select("query_id").distinct()
    near = found.where((F.col("rank") <= k) & (F.col("id") != F.col("query_id"))).select("query_id", "id")
    hit = near.join(named, "id").join(own, ["query_id", "label"], "left_semi").select("query_id").distinct().withColumn("hit", F.lit(1.0))
    return questions.join(hit, "query_id", "left").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))


def recall_at_k(found: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Share of questions (``query_id``) with any relevant ``id`` among the first k: one row ``recall``."""
    hit = found.where(F.col("rank") <= k).select("query_id", "id").join(
        relevant.select("query_id", "id").distinct(), ["query_id", "id"], "left_semi"
    ).select("query_id").distinct().withColumn("hit", F.lit(1.0))
    return relevant.select("query_id").distinct().join(hit, "query_id", "left").agg(
        F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall")
    )
