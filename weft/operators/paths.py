"""Bounded walks over an edge table as unrolled joins.

A trail uses no edge twice but may meet a node again; a simple path meets none twice. Every length
from one to the bound is returned. The frontier is joined to the edges once per hop on the node it
stands at, so Spark picks the join by size, and a walk from an anchor reads only what it reaches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle


def _steps(edges: DataFrame, directed: bool) -> DataFrame:
    """``at, to`` and the edge; both ways where undirected, a self-loop once."""
    key = F.struct("src", "rel", "dst", "chunk_id")
    own = edges.select("src", "rel", "dst", "chunk_id", "source", key.alias("edge"))
    out = own.select(
        F.col("src").alias("at"), F.col("dst").alias("to"), "rel", "chunk_id", "source", F.col("src").alias("start"), "edge"
    )
    if directed:
        return out
    back = own.where("src <> dst").select(
        F.col("dst").alias("at"), F.col("src").alias("to"), "rel", "chunk_id", "source", F.col("src").alias("start"), "edge"
    )
    return out.unionAll(back)


def trails(edges: DataFrame, start: DataFrame, max_hops: int, directed: bool, simple: bool = False) -> DataFrame:
    """``chain, chunk_ids, starts, rels, sources, hops`` of every walk of 1 to ``max_hops`` edges.

    ``start`` has a column ``id``. ``starts`` names the true source of each hop's edge, which is
    what an undirected walk must be rendered with.
    """
    steps = _steps(edges, directed)
    text = "array<string>"
    now = start.select(
        F.array("id").alias("chain"), *[F.array().cast(text).alias(c) for c in ("chunk_ids", "starts", "rels", "sources")],
        F.array().cast("array<struct<src:string,rel:string,dst:string,chunk_id:string>>").alias("edges"), F.col("id").alias("at")
    )
    found = None
    for hop in range(1, max_hops + 1):
        joined = now.join(steps, "at").where(~F.array_contains("edges", F.col("edge")))
        if simple:
            joined = joined.where(~F.array_contains("chain", F.col("to")))
        now = joined.select(
            F.array_append("chain", F.col("to")).alias("chain"), F.array_append("chunk_ids", F.col("chunk_id")).alias("chunk_ids"), F.array_append("starts", F.col("start")).alias("starts"), F.array_append("rels", F.col("rel")).alias("rels"),
            F.array_append("sources", F.col("source")).alias("sources"), F.array_append("edges", F.col("edge")).alias("edges"), F.col("to").alias("at"),
        )
        here = now.drop("edges", "at").withColumn("hops", F.lit(hop))
        found = here if found is None else found.unionAll(here)
    return found


def maximal(paths: DataFrame) -> DataFrame:
    """Paths whose chain is no proper prefix of another's; by an anti-join on exploded prefixes."""
    prefixes = paths.select(
        F.explode(F.expr("transform(sequence(1, size(chain) - 1), n -> slice(chain, 1, n))")).alias("chain")
    ).distinct()
    return paths.join(prefixes, "chain", "left_anti")


def collapsed(paths: DataFrame) -> DataFrame:
    """The distinct edges ``src, dst, chunk_id, source`` that walks pass, each in its true direction."""
    hop = F.explode(
        F.expr(
            "transform(chunk_ids, (c, i) -> struct(starts[i] AS src, if(chain[i] = starts[i], chain[i + 1], chain[i]) AS dst, c AS chunk_id, sources[i] AS source))"
        )
    )
    return paths.select(hop.alias("e")).select("e.*").distinct()


def shortest_path(edges: DataFrame, start: str, end: str, max_hops: int = 4) -> DataFrame:
    """``chain, rels`` of one shortest undirected path of at most ``max_hops`` edges; ties go to the
    smallest chain, then the smallest relationships. Breadth first: a node is kept with its best path
    when it is first reached, and the search ends at the hop that reaches ``end``."""
    spark = edges.sparkSession
    now = spark.createDataFrame([([start], [], start)], "chain array<string>, rels array<string>, at string")
    seen = now.select("at")
    for _ in range(max_hops):
        # The frontier meets the stored edges in both directions; the graph itself is not doubled or regrouped.
        steps = [
            now.join(
                edges.select(F.col(a).alias("at"), F.col(b).alias("to"), "rel").where("at <> to"), "at"
            ) for a, b in (("src", "dst"), ("dst", "src"))
        ]
        reached = steps[0].unionByName(steps[1]).select(
            F.array_append("chain", F.col("to")).alias("chain"), F.array_append("rels", F.col("rel")).alias("rels"),
            F.col("to").alias("at")
        )
        best = reached.join(seen, "at", "left_anti").groupBy("at").agg(F.min(F.struct("chain", "rels")).alias("p"))
        now = settle(best.select("p.chain", "p.rels", "at"))
        hit = now.where(F.col("at") == end)
        if not hit.isEmpty():
            return hit.select("chain", "rels")
        seen = seen.unionAll(now.select("at"))
    return now.where(F.lit(False)).select("chain", "rels")
