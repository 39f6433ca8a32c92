"""Statistics over repeated runs. Rows: run, id, category, system, verdict, credit, latency_ms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CREDIT = {"correct": 1.0, "partial": 0.5, "incorrect": 0.0}


def credit_of() -> Column:
    """Stored credit, else what the verdict is worth."""
    by = F.create_map(*[x for k, v in CREDIT.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce("credit", by[F.col("verdict")], F.lit(0.0))


def upper_median(c: str) -> Column:
    """The element at place n // 2 of the sorted values: the upper of two middle ones."""
    # The lower median of the negated values: counts by value are combined before the shuffle, no list is gathered.
    return -F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY -{c})")


def accuracies(rows: DataFrame) -> list[Column]:
    share = lambda cond: F.round(F.avg(F.when(cond, 100.0).otherwise(0.0)), 1)
    return [
        F.count("*").alias("n"), share(F.col("verdict") == "correct").alias("accuracy"),
        share(F.col("verdict") == "partial").alias("partial"), F.round(F.avg(credit_of()) * 100, 1).alias("score")
    ]


def summary(rows: DataFrame) -> DataFrame:
    """Per category and system: n, accuracy, partial, score and the upper median of the latency."""
    return rows.groupBy("category", "system").agg(
        *accuracies(rows), upper_median("latency_ms").cast("long").alias("median_latency_ms")
    )


def per_run(rows: DataFrame) -> DataFrame:
    """The same per run, for each category and for ``pooled``."""
    every = rows.unionByName(rows.withColumn("category", F.lit("pooled")))
    return every.groupBy("run", "category", "system").agg(*accuracies(rows))


def across_runs(rows: DataFrame) -> DataFrame:
    """Mean, least and most accuracy of a category and system over the runs, and the values by run."""
    return per_run(rows).groupBy("category", "system").agg(
        F.round(F.avg("accuracy"), 1).alias("mean"), F.min("accuracy").alias("min"), F.max("accuracy").alias("max"),
        F.transform(F.array_sort(F.collect_list(F.struct("run", "accuracy"))), lambda x: x["accuracy"]).alias("values")
    )


def paired_delta(rows: DataFrame, system: str, control: str) -> DataFrame:
    """The difference of two systems, paired within a run: mean, least and most."""
    p = per_run(rows)
    both = p.where(F.col("system") == system).select("run", "category", F.col("accuracy").alias("a")).join(
        p.where(F.col("system") == control).select("run", "category", F.col("accuracy").alias("b")), ["run", "category"]
    )
    return both.withColumn("d", F.round(F.col("a") - F.col("b"), 1)).groupBy("category").agg(
        F.round(F.avg("d"), 1).alias("mean"), F.min("d").alias("min"), F.max("d").alias("max")
    )


def stability(rows: DataFrame) -> DataFrame:
    """``id, system, bucket``: right in every run, in none, or flipping."""
    right = F.col("verdict") == "correct"
    g = rows.groupBy("id", "system").agg(F.bool_and(right).alias("every"), F.bool_or(right).alias("some"))
    return g.select(
        "id", "system", F.when(F.col("every"), "always").when(~F.col("some"), "never").otherwise("flipping").alias("bucket")
    )


def flip_rate(rows: DataFrame) -> DataFrame:
    """Per system: keys, keys with more than one verdict, and their share in percent."""
    g = rows.groupBy("id", "system").agg((F.count_distinct("verdict") > 1).alias("unstable"))
    return g.groupBy("system").agg(
        F.count("*").alias("keys"), F.count_if("unstable").alias("unstable"),
        F.round(F.avg(F.when(F.col("unstable"), 100.0).otherwise(0.0)), 1).alias("rate")
    )


def layer_instability(rows: DataFrame, layers: tuple[str, ...]) -> DataFrame:
    """Per system: share of questions, in percent, whose layer differs between trials."""
    g = rows.groupBy("id", "system").agg(*[(F.count_distinct(c) > 1).alias(c) for c in layers])
    return g.groupBy("system").agg(*[F.round(F.avg(F.when(F.col(c), 100.0).otherwise(0.0)), 1).alias(c) for c in layers])


def majority(rows: DataFrame, key: str, value: str, trial: str) -> DataFrame:
    """The most frequent value of each key; the one seen first wins a tie."""
    g = rows.groupBy(key, value).agg(F.count("*").alias("n"), F.min(trial).alias("first"))
    return g.groupBy(key).agg(
        F.max_by(F.struct(value, "n"), F.struct(F.col("n"), -F.col("first"))).alias("w")
    ).select(key, f"w.{value}", F.col("w.n").alias("votes"))


# Fixed values of the estimate: characters a token, tokens of an answer to a chunk, dollars per million tokens.
CHARS_PER_TOKEN, ANSWER_TOKENS, INPUT_PRICE, OUTPUT_PRICE = 3.5, 150, 2.50, 10.00


def cost_estimate(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: chunks, est_input_tokens, est_output_tokens, est_cost_usd of having a model read every text."""
    one = texts.agg(F.count("*").alias("chunks"), F.coalesce(F.sum(F.length(text_col)), F.lit(0)).alias("chars"))
    given, made = F.col("chars") / CHARS_PER_TOKEN, F.col("chunks") * ANSWER_TOKENS
    cost = given / 1e6 * INPUT_PRICE + made / 1e6 * OUTPUT_PRICE
    return one.select(
        "chunks", given.cast("long").alias("est_input_tokens"), made.cast("long").alias("est_output_tokens"),
        F.round(cost, 2).alias("est_cost_usd")
    )
