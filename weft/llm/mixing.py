"""Mixing sources to temperature weights, with DataFrame functions only.

Source token shares ``p`` become weights ``w ~ p ** t``: ``t = 1`` keeps the corpus as it is and
``t = 0`` makes sources equal. The exponent is found by bisection (each round divides the bracket in
sixteen at once and costs one aggregate over the table of sources) so that the entropy of ``w``
meets a target, or so that no source is repeated more than ``max_repeats`` times.

The budget is the least at which every document is used: the source that is repeated least is read
once and each other source ``w / p`` times as often, relative to it. A source is read in epochs, each
a seeded permutation of its documents, the last one in part. The stream of every source is cut at
the same fractions, and piece ``b`` of all sources, permuted together, makes block ``b``: each block
holds the weights, within a document of each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import carried, cut

WORD = r"[^\x20\x09-\x0D]+"
SECTIONS, ROUNDS = 16, 9


def tokens(text: Column) -> Column:
    """Words of a text and one end mark; a null text has the mark only."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long") + 1


def _at(sources: DataFrame, exponents: list[float]) -> list:
    """Entropy and largest repetition of the weights at each exponent; one aggregate over sources."""
    share = F.col("tokens") / F.col("total")
    rows = sources.select(
        share.alias("p"), F.explode(F.array(*map(F.lit, exponents))).alias("t")
    ).select("t", "p", F.pow("p", F.col("t")).alias("u"))
    z = rows.groupBy("t").agg(
        F.sum("u").alias("z"), F.sum(F.col("u") * F.log("u")).alias("ul"),
        (F.max(F.col("u") / F.col("p")) / F.min(F.col("u") / F.col("p"))).alias("repeats")
    )
    return z.select("t", (F.log("z") - F.col("ul") / F.col("z")).alias("entropy"), "repeats").orderBy("t").collect()


def temperature(sources: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None) -> float:
    """The largest exponent in [0, 1] whose weights reach ``target_entropy`` (in nats), or the
    smallest that keeps to ``max_repeats``; the nearest end where none does. Rounded to 9 digits.

    ``sources`` has ``tokens`` and ``total``, a row per source. What returns to the driver is
    ``SECTIONS + 1`` rows a round. An empty table gives 1.
    """
    if (target_entropy is None) == (max_repeats is None):
        raise ValueError("one target, please")
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        cuts = [low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)]
        found = _at(sources, cuts)
        if not found:
            return 1.0
        # Both the entropy and the repetition fall as the exponent grows.
        if target_entropy is not None:
            good = [r["entropy"] >= target_entropy for r in found]
            k = max([i for i, ok in enumerate(good) if ok], default=0)
            low, high = cuts[k], cuts[min(k + 1, SECTIONS)]
        else:
            good = [r["repeats"] <= max_repeats for r in found]
            k = min([i for i, ok in enumerate(good) if ok], default=SECTIONS)
            low, high = cuts[max(k - 1, 0)], cuts[k]
    return round(low if target_entropy is not None else high, 9)


def _key(epoch: Column, seed: int) -> Column:
    """Seeded order of a document within an epoch: 60 bits of a hash, as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), "_name")), 1, 15), 16, 10).cast("long")


_BITS = 60


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    target_entropy: float | None = None,
    max_repeats: float | None = 1.25,
    block_tokens: int = 500_000,
    cell_rows: int = 4_000,
    seed: int = 29,
) -> DataFrame:
    """``docs`` drawn to the weights, with a struct ``_mix(tokens, epoch, block, slot)``.

    Every row of ``docs`` comes once at least. ``slot`` counts 0, 1, ... within a block. A null source
    is a source of its own, as is the empty one. Rows without words weigh one end mark. Rows that are equal in id and text are drawn alike; those equal in
    all else too may stand for one another. Other columns pass through, whatever their names; one named ``_mix`` is replaced. An empty table
    gives no rows.
    """
    own = [c for c in docs.columns if c != "_mix"]
    row = carried(docs, ("_mix",))
    text, source = F.col(text_col).cast("string"), F.concat(
        F.when(F.col(source_col).isNull(), "0").otherwise("1"), F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    )
    name = F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.coalesce(F.md5(text), F.lit("")))
    rows = docs.select(row.alias("_row"), source.alias("_source"), tokens(text).alias("_tokens"), name.alias("_name"))
    light = cut(rows.select("_source", "_tokens", "_name"))
    sums = light.groupBy("_source").agg(F.sum("_tokens").alias("tokens"), F.count("*").alias("rows"))
    sources = cut(sums.withColumn("total", F.sum("tokens").over(Window.partitionBy())))  # a row per source
    t = temperature(sources, target_entropy, max_repeats)

    # Epochs of a source relative to the source with the largest share, which is read once.
    plan = sources.withColumn("peak", F.max("tokens").over(Window.partitionBy()))
    ratio = F.pow(F.col("peak") / F.col("tokens"), F.lit(1.0 - t))
    plan = plan.withColumn("quota", F.floor(F.col("tokens") * F.round(ratio, 9) + F.lit(1e-6)).cast("long"))
    plan = plan.withColumn("budget", F.sum("quota").over(Window.partitionBy()))
    plan = plan.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("budget") / block_tokens)).cast("long"))
    plan = plan.withColumn("cells", F.greatest(F.lit(1), F.ceil(F.col("rows") / cell_rows)).cast("long"))
    plan = plan.withColumn("epochs", F.greatest(F.lit(1), F.ceil(F.col("quota") / F.col("tokens"))).cast("int"))
    plan = cut(plan.select("_source", "tokens", "quota", "blocks", "cells", "epochs"))

    drawn = light.join(plan, "_source").select("*", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)).alias("_epoch"))
    drawn = drawn.withColumn("_key", _key(F.col("_epoch"), seed)).withColumn(
        "_cell", F.expr(f"_key div (({1 << _BITS} div cells) + 1)")
    )
    # Places in an epoch by prefix sums at two levels: cells of a source, rows of a cell.
    cells = drawn.groupBy("_source", "_epoch", "_cell").agg(F.sum("_tokens").alias("_sum"))
    upto = F.sum("_sum").over(Window.partitionBy("_source", "_epoch").orderBy("_cell")) - F.col("_sum")
    starts = cells.select("_source", "_epoch", "_cell", upto.alias("_start"))
    inside = F.sum("_tokens").over(
        Window.partitionBy("_source", "_epoch", "_cell").orderBy("_key", "_name").rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
    ) - F.col("_tokens")
    placed = drawn.withColumn("_inside", inside).join(starts, ["_source", "_epoch", "_cell"])
    at = F.col("_epoch") * F.col("tokens") + F.col("_start") + F.col("_inside")
    placed = placed.withColumn("_at", at).where(F.col("_at") < F.col("quota"))
    # Cut at equal fractions of each source's stream; decimals, since blocks x tokens outgrow a long.
    part = F.floor(
        F.col("_at").cast("decimal(19,0)") * F.col("blocks").cast("decimal(18,0)") / F.col("quota").cast("decimal(19,0)")
    ).cast("long")
    placed = placed.withColumn("_block", F.least(part, F.col("blocks") - 1))
    # A block holds about block_tokens tokens.
    spot = F.md5(F.concat_ws("|", F.lit(f"{seed}b"), F.col("_epoch").cast("string"), "_name"))
    slot = F.row_number().over(Window.partitionBy("_block").orderBy(spot, "_name")) - 1
    placed = placed.select("_name", "_source", "_tokens", "_epoch", "_block", slot.cast("long").alias("_slot"))
    # Rows equal in id and text are interchangeable: the n-th of them takes the n-th place of each epoch.
    nth = F.row_number().over(Window.partitionBy("_name", "_source", "_epoch").orderBy("_block", "_slot"))
    placed = placed.withColumn("_nth", nth).groupBy("_name", "_source", "_nth").agg(
        F.collect_list(
            F.struct(
                F.col("_tokens").alias("tokens"), F.col("_epoch").alias("epoch"), F.col("_block").alias("block"),
                F.col("_slot").alias("slot")
            )
        ).alias("_draws")
    )
    # By all else that can be ordered, so that a task that runs again numbers them as before.
    rest = [
        F.col("_row")[c] for c in own if c not in (
            id_col, text_col, source_col
        ) and "map<" not in docs.schema[c].dataType.simpleString()
    ] or [F.lit(0)]
    copies = rows.select("_row", "_name", "_source").withColumn(
        "_nth", F.row_number().over(Window.partitionBy("_name", "_source").orderBy(*rest))
    )
    out = copies.join(placed, ["_name", "_source", "_nth"]).select("_row", F.explode("_draws").alias("_mix"))
    return out.select("_row.*", "_mix")
