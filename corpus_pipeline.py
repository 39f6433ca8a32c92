"""The corpus pipeline: documents through five stages, each written and read by the next.

1. quality: rows that the base rule or a proven cutoff rejects go.
2. lines: lines of any length that repeat an earlier one go; a document that loses lines goes when no word is left of it.
3. near_duplicates: of each group of near-duplicates the document with the smallest id stays.
4. mixing: sources to temperature weights; every document stays, those of smaller sources repeat.
5. tokens: SentencePiece ids.

Every stage takes nulls in any column, empty and very long texts, repeated rows and empty tables. Columns
beyond those of documents are dropped by the first stage that meets them, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import linededup, minhash, mixing, quality
from weft.llm.queries import table, tokenised
from weft.llm.scratch import cut_last
from weft.session import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A null, empty or short text fails the base rule; rows without a language have a stratum of their own."""
    ship(spark)
    return quality.judge(docs, table(spark, sf_dir, "labels")).where("_quality.kept").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``n_chars`` follows the text that is left."""
    ship(spark)
    changed = F.col("_lines.exact") + F.col("_lines.near") > 0
    out = linededup.dedup_lines(docs, exact_chars=1).where(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Links at a similarity of 0.80 or more. Rows that share an id share the verdict."""
    ship(spark)
    gone = minhash.near_duplicates(docs, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """No row goes; a null source is a source of its own, a null text weighs one end mark."""
    ship(spark)
    return mixing.mix(docs, max_repeats=1.25).select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, round_trip`` of every row; a null text has null ids and no tokens."""
    ship(spark)
    return tokenised(docs)


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: SQL can express neither the edit neighbourhood on whole tables nor the tokens.
ORACLE_SQL = None


def _after(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """The documents after the first ``n`` stages, as a table; those of the stage before go once it is written."""
    if n == 0:
        return table(spark, sf_dir, "documents")
    return cut_last(lambda: STAGES[n - 1][1](spark, _after(spark, sf_dir, n - 1), sf_dir))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what the last one reads stays in the shared folder."""
    return STAGES[-1][1](spark, _after(spark, sf_dir, len(STAGES) - 1), sf_dir)
