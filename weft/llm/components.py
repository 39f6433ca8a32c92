"""Connected components of an edge table by alternating star contraction.

Each round re-links every node's larger neighbours to the smallest node it sees (large star), then
its smaller neighbours (small star); rounds needed grow with the logarithm of the node count. Minima
are pre-aggregated before the shuffle, so a hub with many edges is not gathered in one task; each
round is written to the shared folder, so a lost executor costs that round only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut, cut_last


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    # As a table, so that the join has two plain sides and the partition of a hub can be split.
    least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for each node of an edge other than a component's smallest node.

    ``edges`` holds pairs of longs in any order, repeats and self-loops allowed; pairs with a null
    are left out. ``component`` is the smallest node reachable. No edges: no rows.
    """

    def settled() -> DataFrame:
        now = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
        mark = _mark(now)
        while mark[0]:
            now = cut(_small_star(_large_star(now)))
            before, mark = mark, _mark(now)
            if before == mark:
                break
        return now

    now = cut_last(settled)
    return now.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("component"))
