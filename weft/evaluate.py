"""``python -m weft.evaluate``: saved runs, stability probes and traces as tables, printed and optionally written as JSON.

``summary`` and ``stability`` read saved runs; ``oracle`` holds a saved trace against a store's graph; ``cost`` estimates
what reading a store's documentation by a model would take.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import with_all_sources
from .operators import evals, hierarchy
from .session import ship
from .sources import files

LAYERS = ("route", "verdict")
KINDS = (("calls", "CALLS"), ("raises", "RAISES"), ("wraps", "WRAPS_EXCEPTION"))


def summary(runs: DataFrame) -> dict[str, DataFrame]:
    """Tables of repeated runs: each category's accuracy over the runs, the paired difference, what flips, and all verdicts."""
    systems = ("hybrid", "baseline")
    return {
        "totals": evals.summary(runs).orderBy("category", "system"),
        "across_runs": evals.across_runs(runs).orderBy("category", "system"),
        "delta": evals.paired_delta(runs, *systems).orderBy("category"),
        "stability": evals.stability(runs).groupBy("system", "bucket").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("ids")).orderBy("system", "bucket"),
    }


def stability(runs: DataFrame) -> dict[str, DataFrame]:
    """How often a verdict, or a layer before it, differs between runs of the same question."""
    return {"flip_rate": evals.flip_rate(runs).orderBy("system"), "layers": evals.layer_instability(runs, LAYERS).orderBy("system")}


def oracle(
    pairs: DataFrame, edges: DataFrame, packages: tuple[str, ...] | None = None, implicit: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Observed pairs (``kind, a, b``) held against the graph's edges, for each source and for all together, with what is missing."""
    parents = edges.where("rel = 'INHERITS_FROM'").select(F.col("src").alias("id"), F.col("dst").alias("parent"))
    up = hierarchy.closure(parents).select("id", "ancestor")
    rates, lists = [], []
    for kind, rel in KINDS:
        seen = pairs.where(F.col("kind") == kind).select("a", "b")
        tagged = with_all_sources(edges.where(F.col("rel") == rel))
        for tag in sorted(r["tag"] for r in tagged.select("tag").distinct().collect()):  # a row per source
            graph = tagged.where(F.col("tag") == tag).select(F.col("src").alias("a"), F.col("dst").alias("b"))
            rates.append(
                hierarchy.compare_pairs(seen, graph, up, implicit, packages).select(
                    F.lit(kind).alias("kind_of_pair"), F.lit(tag).alias("source"), "*"
                )
            )
            if tag == "all":
                lists.append(
                    hierarchy.unmatched_pairs(seen, graph, up, implicit, packages).select(F.lit(kind).alias("kind_of_pair"), "*")
                )
    union = lambda rows, empty: rows[0] if len(rows) == 1 else rows[0].unionByName(union(rows[1:], empty)) if rows else pairs.sparkSession.createDataFrame([], empty)
    return {
        "rates": union(rates, "kind_of_pair string, source string"),
        "unmatched": union(lists, "kind_of_pair string, kind string, a string, b string")
    }


def report(tables: dict[str, DataFrame], out: str | None) -> None:
    """Print each table and, where asked, write it as JSON lines under ``out``."""
    for name, rows in tables.items():
        print(name)
        rows.show(200, False)
        if out:
            rows.write.mode("overwrite").json(f"{out}/{name}")


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="weft.evaluate")
    top.add_argument("--out")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("summary", "stability"):
        sub.add_parser(name).add_argument("runs", nargs="+")
    p = sub.add_parser("oracle")
    p.add_argument("trace")
    p.add_argument("--store", default="weft-store")
    p.add_argument("--package", action="append")
    p = sub.add_parser("cost")
    p.add_argument("--store", default="weft-store")
    a = top.parse_args(argv)
    spark = ship(SparkSession.builder.appName("weft").getOrCreate())
    if a.command in ("summary", "stability"):
        runs = files.run_results(spark, a.runs)
        report(summary(runs) if a.command == "summary" else stability(runs), a.out)
    elif a.command == "oracle":
        edges = spark.read.parquet(f"{a.store}/edges")
        report(
            oracle(
                files.observed_pairs(spark, a.trace), edges, tuple(a.package) if a.package else None,
                files.implicit_callees(spark, a.trace)
            ),
            a.out
        )
    else:
        report(
            {"cost": evals.cost_estimate(spark.read.parquet(f"{a.store}/chunks").where(F.col("kind").isin("doc", "changelog")))},
            a.out
        )


if __name__ == "__main__":
    main()
