"""``python -m weft.cli``: ingest a source tree, ask it a question, show what is stored."""

from __future__ import annotations

import argparse

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .graph import PropertyGraph
from .ontology import CODE
from .pipeline import Engine
from .providers import HashEmbedder
from .session import settle, ship
from .sources import files
from .sources.extract import chunk_files
from .sources.ingest import build_graph, hints, replay, replayed, upsert_chunks, with_structure


def _embedded(chunks, embedder: HashEmbedder):
    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(embedder.embed(texts.tolist()))

    return chunks.withColumn("embedding", embed("embed_text"))


def ingest(
    spark: SparkSession, store: str, roots: list[str], package: str | None = None, log: str | None = None, dry_run: bool = False,
    corpus: str | None = None, keep: bool = False
) -> None:
    """Read packages, write graph and chunks. With ``keep`` what is stored stays, and what is read goes over it."""
    repos = list(files.load_corpus(corpus).repos) if corpus else [files.detect_repo(r, package) for r in roots]
    sources = None
    for repo in repos:
        rows = files.python_files(spark, repo)
        sources = rows if sources is None else sources.unionByName(rows)
    graph, chunks = build_graph(sources)
    for repo in repos:
        if repo.docs:
            chunks = chunks.unionByName(chunk_files(files.doc_files(spark, repo), "doc"))
        if repo.changelog:
            chunks = chunks.unionByName(chunk_files(files.changelog_file(spark, repo), "changelog"))
    chunks = settle(chunks)
    graph = with_structure(graph, chunks)
    told = None
    if log:
        public, documented = hints(sources)
        told = settle(replayed(graph, files.model_edges(spark, log), chunks, public, documented))
        graph = replay(graph, told, chunks, public, documented)
    if dry_run:
        graph.edges.groupBy("rel").count().orderBy("rel").show(50, False)
        return
    graph.validate()
    embedded = _embedded(chunks, HashEmbedder(384))
    before = load(spark, store) if keep else None
    if before is not None:
        graph = before.graph.upsert_nodes(
            graph.nodes.withColumn("ord", F.lit(0).cast("long"))
        ).upsert_edges(graph.edges.withColumn("ord", F.lit(0).cast("long")))
    embedded = upsert_chunks(before.chunks.select(*embedded.columns) if before else None, embedded)
    # All is computed before anything that it may read is overwritten.
    nodes, edges, embedded = settle(graph.nodes), settle(graph.edges), settle(embedded)
    nodes.write.mode("overwrite").parquet(f"{store}/nodes")
    edges.write.mode("overwrite").partitionBy("rel").parquet(f"{store}/edges")
    embedded.write.mode("overwrite").parquet(f"{store}/chunks")
    if told is not None:  # what became of each logged edge
        told.select(
            "source_surface", "source_type", "relationship", "target_surface", "target_type", "confidence", "chunk_id",
            F.col("src").alias("resolved_source_id"), F.col("dst").alias("resolved_target_id"), "skip_reason"
        ).write.mode("overwrite").json(f"{store}/edge-log")


def load(spark: SparkSession, store: str) -> Engine:
    edges = spark.read.parquet(f"{store}/edges").select("src", "rel", "dst", "chunk_id", "confidence", "source", "props")
    return Engine(
        PropertyGraph(spark.read.parquet(f"{store}/nodes"), edges, CODE), spark.read.parquet(f"{store}/chunks"),
        embedder=HashEmbedder(384)
    )


def status(spark: SparkSession, store: str) -> None:
    engine = load(spark, store)
    engine.graph.edges.groupBy(F.coalesce("source", F.lit("llm")).alias("source")).count().orderBy("source").show(50, False)
    engine.graph.edges.groupBy("rel").count().orderBy(F.desc("count"), "rel").show(50, False)
    engine.chunks.groupBy("repo", "kind").count().orderBy("repo", "kind").show(50, False)


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="weft")
    top.add_argument("--store", default="weft-store")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("ingest")
    p.add_argument("roots", nargs="*")
    p.add_argument("--corpus", help="a file that lists the packages, in place of their folders")
    p.add_argument("--keep", action="store_true", help="write over what is stored, in place of starting anew")
    p.add_argument("--package")
    p.add_argument("--llm-log")
    p.add_argument("--dry-run", action="store_true")
    p = sub.add_parser("ask")
    p.add_argument("question")
    p.add_argument("--show-plan", action="store_true")
    p.add_argument("--show-context", action="store_true")
    p.add_argument("--compare", action="store_true")
    sub.add_parser("status")
    a = top.parse_args(argv)
    spark = ship(SparkSession.builder.appName("weft").getOrCreate())
    if a.command == "ingest":
        if bool(a.roots) == bool(a.corpus):
            top.error("name folders or a corpus file")
        ingest(spark, a.store, a.roots, a.package, a.llm_log, a.dry_run, a.corpus, a.keep)
    elif a.command == "status":
        status(spark, a.store)
    else:
        engine = load(spark, a.store)
        found = engine.answer(a.question)
        got = found["retrieval"]
        if a.show_plan:
            print(got.route, got.plan, got.plan_repair or "")
        if a.show_context:
            print(got.context)
        print(found["answer"])
        if a.compare:
            print("--\n" + engine.baseline(a.question)["answer"])


if __name__ == "__main__":
    main()
