"""Chunks of text: ids and greedy packing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chunk_id(repo: Column, path: Column, start: Column, end: Column) -> Column:
    """The first 16 hex digits of a SHA-1 over ``repo:path:start:end``."""
    return F.substring(F.sha1(F.concat_ws(":", repo, path, start.cast("string"), end.cast("string"))), 1, 16)


def content_key(text: Column) -> Column:
    """The first 12 hex digits of a text's SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 12)


def pack(blocks: Column, max_chars: int = 2000, glue: str = "\n\n") -> Column:
    """Spans ``first, last`` (places in ``blocks``) of a greedy packing.

    A span takes the next block while the joined text stays within ``max_chars``, or if the block is
    indented, so that code is not parted from the text that leads to it.
    """
    spans = "array<struct<first:int,last:int,size:int>>"

    def step(s: Column, b: Column) -> Column:
        n, i = F.length(b), F.size(s["seen"])
        last = F.get(s["spans"], F.size(s["spans"]) - 1)
        grown = last["size"] + len(glue) + n
        fits = (F.size(s["spans"]) > 0) & ((grown <= max_chars) | b.rlike(r"^[ \t]"))
        kept = F.slice(s["spans"], F.lit(1), F.greatest(F.size(s["spans"]) - 1, F.lit(0)))
        longer = F.concat(
            kept, F.array(F.struct(last["first"].alias("first"), i.cast("int").alias("last"), grown.cast("int").alias("size")))
        )
        fresh = F.concat(
            s["spans"], F.array(F.struct(i.cast("int").alias("first"), i.cast("int").alias("last"), n.cast("int").alias("size")))
        )
        return F.struct(F.when(fits, longer).otherwise(fresh).alias("spans"), F.concat(s["seen"], F.array(F.lit(1))).alias("seen"))

    zero = F.struct(F.array().cast(spans).alias("spans"), F.array().cast("array<int>").alias("seen"))
    return F.aggregate(blocks, zero, step, lambda s: s["spans"])
