"""From source files to a property graph: facts, names resolved by joins, edges by relationship."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import PLACEHOLDER, PropertyGraph, containment, merge_nodes
from ..ontology import CODE
from ..operators.hierarchy import override_calls
from ..operators.resolve import resolve, unambiguous_index
from ..providers import Extractor
from ..session import settle
from .extract import chunk_files, extract
from .files import MODEL_EDGE


#: Source of edges found by joining names: no types were inferred, so they are not marked as proven.
NAMES = "names"


def _empty_props() -> F.Column:
    return F.map_from_arrays(F.array(), F.array()).cast("map<string,string>")


def build_graph(files: DataFrame) -> tuple[PropertyGraph, DataFrame]:
    """The graph and the code chunks of ``files`` (repo, path, module, text).

    Each structural edge cites the chunk of its subject, or a placeholder where there is none.
    """
    found = settle(extract(files))
    chunks = chunk_files(files, "code")
    kind = lambda k: found.where(F.col("kind") == k)
    symbols = kind("node").select(F.col("owner").alias("id"), F.col("a").alias("label"))
    params = kind("param").select(F.concat_ws(".", "owner", "a").alias("id"), "owner", "a", "b", "ord")
    universe = symbols.select("id").unionAll(params.select("id")).distinct()
    last = Window.partitionBy("module", "local").orderBy(F.col("ord").desc())
    aliases = kind("alias").select(
        "module", F.col("a").alias("local"), F.col("b").alias("target"), "ord"
    ).withColumn("n", F.row_number().over(last)).where("n = 1").select("module", "local", "target")

    owner_class = symbols.where("label = 'Class'").select(F.col("id").alias("cls"))

    def resolved(rows: DataFrame) -> DataFrame:
        """``rows`` (owner, module, surface, ...) with ``dst``, where the surface has one answer."""
        up = F.regexp_replace("owner", r"\.[^.]*$", "")
        named = rows.withColumn("_up", up).join(owner_class, F.col("_up") == F.col("cls"), "left").drop("_up")
        answers = resolve(named.select("surface", "module", "cls"), symbols.select("id"), aliases).where("canonical_id is not null")
        answers = answers.select(
            F.col("surface").alias("_s"), F.col("module").alias("_m"), F.col("cls").alias("_c"), F.col("canonical_id").alias("dst")
        )
        return named.join(
            answers, (F.col("surface") == F.col("_s")) & (F.col("module") == F.col("_m")) & F.col("cls").eqNullSafe(F.col("_c"))
        ).drop("_s", "_m", "_c", "cls")

    def edges(rows: DataFrame, rel: str, source: str = "ast") -> DataFrame:
        return rows.select("src", F.lit(rel).alias("rel"), "dst", F.lit(source).alias("source"))

    def surfaces(k: str) -> DataFrame:
        return kind(k).select("owner", "module", F.explode("surfaces").alias("surface"))

    inherits = settle(resolved(surfaces("inherits")).select(F.col("owner").alias("src"), "dst").distinct())
    calls = settle(resolved(surfaces("calls")).select(F.col("owner").alias("src"), "dst").distinct())
    passes = resolved(
        kind("passes").select(
            "owner", "module", F.col("surfaces")[0].alias("surface"), F.col("a").alias("given"), F.col("b").alias("at")
        )
    )
    place = params.withColumn("pos", F.row_number().over(Window.partitionBy("owner").orderBy("ord")) - 1)
    slot = place.select(
        F.col("owner").alias("dst"), F.col("id").alias("slot"), F.col("a").alias("slot_name"),
        F.concat(F.lit("#"), F.col("pos").cast("string")).alias("slot_at")
    )
    into = passes.join(
        slot, (passes["dst"] == slot["dst"]) & ((F.col("at") == F.col("slot_name")) | (F.col("at") == F.col("slot_at"))), "left"
    )
    # A keyword that no parameter has goes where the callee gathers keywords.
    rest = params.where("b = '**'").select(F.col("owner").alias("_rest_of"), F.col("id").alias("_rest"))
    into = into.join(
        rest, (passes["dst"] == F.col("_rest_of")) & ~F.col("at").startswith("#"), "left"
    ).withColumn("slot", F.coalesce("slot", "_rest"))
    flows = into.select(F.concat_ws(".", "owner", "given").alias("src"), F.coalesce("slot", passes["dst"]).alias("dst")).distinct()
    stores = kind("stores").select(
        F.concat_ws(".", "owner", "a").alias("src"), F.regexp_replace("owner", r"\.[^.]*$", "").alias("dst")
    )
    wraps = kind("wraps").select("owner", "module", F.col("surfaces")[0].alias("surface"), F.col("surfaces")[1].alias("caught"))
    raised = resolved(wraps).select("module", "owner", "caught", F.col("dst").alias("src"))
    wrapped = resolved(
        raised.select("owner", "module", F.col("caught").alias("surface"), "src")
    ).select("src", "dst").where("src <> dst")
    parents = inherits.select(F.col("src").alias("id"), F.col("dst").alias("parent"))
    overrides = override_calls(calls, parents, symbols.select("id")).join(calls, ["src", "dst"], "left_anti").where("src <> dst")
    imports = aliases.join(
        symbols.select(F.col("id").alias("target")), "target", "left_semi"
    ).select(F.col("module").alias("src"), F.col("target").alias("dst"))
    parts = [
        edges(containment(universe), "DEFINED_IN"),
        edges(params.select(F.col("owner").alias("src"), F.col("id").alias("dst")), "HAS_PARAMETER"),
        edges(inherits, "INHERITS_FROM"),
        edges(resolved(surfaces("raises")).select(F.col("owner").alias("src"), "dst"), "RAISES"),
        edges(resolved(surfaces("returns")).select(F.col("owner").alias("src"), "dst"), "RETURNS"),
        edges(stores, "STORED_ON"),
        edges(calls, "CALLS", NAMES),
        edges(overrides, "CALLS", "override"),
        edges(flows, "PASSES_TO", NAMES),
        edges(wrapped, "WRAPS_EXCEPTION"),
        edges(imports, "IMPORTS"),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    cited = chunks.select(F.col("section").alias("src"), "chunk_id").dropDuplicates(["src"])
    every = every.distinct().join(cited, "src", "left")
    every = every.select(
        "src", "rel", "dst", F.coalesce("chunk_id", F.lit(PLACEHOLDER)).alias("chunk_id"), F.lit(1.0).alias("confidence"), "source",
        _empty_props().alias("props")
    )
    outside = every.where(F.col("dst").startswith("builtins.")).select(F.col("dst").alias("id"), F.lit("Exception").alias("label"))
    nodes = symbols.unionAll(params.select("id", F.lit("Parameter").alias("label"))).unionAll(outside)
    writes = nodes.select("id", F.array("label").alias("labels"), _empty_props().alias("props"), F.lit(0).cast("long").alias("ord"))
    return PropertyGraph(settle(merge_nodes(writes)), settle(every), CODE), chunks


def read_edges(texts: DataFrame, extractor: Extractor) -> DataFrame:
    """Logged edges that a model reads out of ``texts`` (chunk_id, text); a text that it fails on gives one row that says so."""
    names = [c.split()[0] for c in MODEL_EDGE.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for chunk, text in zip(pdf["chunk_id"], pdf["text"], strict=True):
                try:
                    found = extractor.edges(text)
                except Exception as e:  # noqa: BLE001 - a model's failure costs its text, not the job
                    found = [{"skip_reason": f"extraction: {e}"}]
                rows += [tuple(chunk if n == "chunk_id" else edge.get(n) for n in names) for edge in found]
            yield pd.DataFrame(rows, columns=names).astype(object)

    return texts.select("chunk_id", "text").mapInPandas(run, MODEL_EDGE)


def hints(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What decides between like-named parameters: ``id`` of what package roots export, and ``function_id, param`` of docstrings."""
    found = extract(files)
    public = found.where("kind = 'alias'").where(~F.contains("module", F.lit("."))).select(F.col("b").alias("id")).distinct()
    return public, found.where("kind = 'documented'").select(
        F.col("owner").alias("function_id"), F.col("a").alias("param")
    ).distinct()


def with_structure(graph: PropertyGraph, chunks: DataFrame) -> PropertyGraph:
    """The graph with a node for each section of the documentation and each release of a changelog."""
    ids = structure_ids(chunks)
    writes = ids.select(
        "id", F.array("label").alias("labels"), F.create_map(F.lit("name"), F.col("section")).alias("props"),
        F.lit(0).cast("long").alias("ord")
    )
    return graph.upsert_nodes(writes)


def structure_ids(chunks: DataFrame) -> DataFrame:
    """``id, label, section`` of documentation and changelog chunks: ``doc:<chunk>`` and ``<repo>:<version>``."""
    doc = F.col("kind") == "doc"
    rows = chunks.where(F.col("kind").isin("doc", "changelog") & F.col("section").isNotNull() & (F.col("section") != ""))
    name = F.when(doc, F.concat(F.lit("doc:"), "chunk_id")).otherwise(F.concat_ws(":", "repo", "section"))
    return rows.select(
        name.alias("id"), F.when(doc, "DocSection").otherwise("Release").alias("label"), "section"
    ).dropDuplicates(["id"])


def upsert_chunks(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Chunks by id, a new one in place of an old one. A chunk without an embedding, or of another width than the rest, is an error."""
    widths = new.agg(
        F.count("*").alias("n"), F.count("embedding").alias("given"), F.min(F.size("embedding")).alias("low"),
        F.max(F.size("embedding")).alias("high")
    ).first()
    if widths["n"] != widths["given"] or widths["low"] != widths["high"]:
        raise ValueError(f"{widths['n']} chunks, {widths['given']} embeddings of {widths['low']} to {widths['high']} numbers")
    new = new.dropDuplicates(["chunk_id"])
    return new if old is None else old.join(new.select("chunk_id"), "chunk_id", "left_anti").unionByName(new)


_BY_LABEL = ("DocSection", "Release")


def replay(
    graph: PropertyGraph, log: DataFrame, chunks: DataFrame | None = None, public: DataFrame | None = None,
    documented: DataFrame | None = None
) -> PropertyGraph:
    """Logged model edges resolved against the graph and upserted; ``replayed`` says what becomes of each."""
    edge = replayed(graph, log, chunks, public, documented).where("skip_reason is null")
    edge = edge.select(
        "src", F.col("relationship").alias("rel"), "dst", "chunk_id", "confidence", F.lit("llm").alias("source"),
        _empty_props().alias("props"), F.lit(1).cast("long").alias("ord")
    )
    return graph.upsert_edges(edge)


def replayed(
    graph: PropertyGraph, log: DataFrame, chunks: DataFrame | None = None, public: DataFrame | None = None,
    documented: DataFrame | None = None
) -> DataFrame:
    """The log with ``src``, ``dst`` and a ``skip_reason`` where an edge is not written.

    Names of sections and releases go by the index of ``chunks`` (names that fit several are left out), a
    concept is its own folded name, and all others go up the ladder, with the graph's calls and, where they
    are given, exports and docstrings to decide between parameters.
    """
    calls = graph.rel("CALLS").select("src", "dst").distinct()
    surface = F.explode(F.array("source_surface", "target_surface")).alias("surface")
    names = log.where("skip_reason is null").select(
        surface, F.lit(None).cast("string").alias("module"), F.lit(None).cast("string").alias("cls")
    ).where("surface is not null")
    known = resolve(
        names, graph.nodes.select("id"), calls=calls, public=public, documented=documented
    ).where("canonical_id is not null").select("surface", "canonical_id")
    index = None
    if chunks is not None:
        ids = structure_ids(chunks)
        parts = [
            unambiguous_index(
                ids.where(F.col("label") == k).select("section", "id")
            ).withColumn("type", F.lit(k)) for k in _BY_LABEL
        ]
        index = parts[0].unionAll(parts[1])
    out = log
    for end, to in (("source", "src"), ("target", "dst")):
        name, kind = F.col(f"{end}_surface"), F.col(f"{end}_type")
        out = out.join(
            known.select(F.col("surface").alias(f"{end}_surface"), F.col("canonical_id").alias("_code")), f"{end}_surface", "left"
        )
        found = F.col("_code")
        if index is not None:
            key = F.regexp_replace(F.trim(F.lower(name)), r"\s+", " ")
            out = out.withColumn("_key", key).join(
                index.select(F.col("key").alias("_key"), F.col("type").alias(f"{end}_type"), F.col("id").alias("_text")),
                ["_key", f"{end}_type"], "left"
            )
            found = F.when(kind.isin(*_BY_LABEL), F.col("_text")).otherwise(found)
        concept = F.regexp_replace(F.trim(F.lower(name)), r"\s+", "-")
        out = out.withColumn(
            to, F.coalesce(f"resolved_{end}_id", F.when(kind == "Concept", concept).otherwise(found))
        ).drop("_code", "_key", "_text")
    allowed = F.col("relationship").isin(*graph.ontology.family("model"))
    reason = F.coalesce(
        "skip_reason", F.when(~allowed, "relationship").when(F.col("src").isNull(), "source").when(F.col("dst").isNull(), "target")
    )
    return out.withColumn("skip_reason", reason)
