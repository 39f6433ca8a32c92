"""Plan -> DataFrame: each plan compiles to one lazy query over a property graph.

Filters on id and relationship stay plain column predicates, so they reach the Parquet scan of a
stored graph. Labels are joined after the filter, to the few rows that are left. Every row says which
way its edge runs, and an edge without a source reads as the model's.
"""

from __future__ import annotations

from functools import singledispatch

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..operators.paths import shortest_path, trails
from . import CallChain, CountRel, DocsFor, EdgesFrom, EdgesTo, FlowOfName, InPackage, Neighbors, OwnersOfName, PathBetween, Plan, RaisedByMembers, RelatedBy, WrapChain

CALL_LIMIT = 500


def _sourced(edges: DataFrame) -> DataFrame:
    return edges.withColumn("source", F.coalesce("source", F.lit("llm")))


def _labels(rows: DataFrame, g: PropertyGraph, **names: str) -> DataFrame:
    for key, out in names.items():
        labels = g.nodes.select(F.col("id").alias(key), F.col("labels").alias(out))
        rows = rows.join(labels, key, "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))
    return rows


def _touching(g: PropertyGraph, edges: DataFrame, entity_id: str) -> DataFrame:
    """Edges at a node in either direction; a self-loop once, as outgoing."""
    edges = _sourced(edges)
    out = edges.where(F.col("src") == entity_id).select(
        "rel", F.col("src").alias("entity"), F.col("dst").alias("neighbor"), "chunk_id", F.lit(True).alias("outgoing"), "source"
    )
    into = edges.where((F.col("dst") == entity_id) & (F.col("src") != entity_id)).select(
        "rel", F.col("dst").alias("entity"), F.col("src").alias("neighbor"), "chunk_id", F.lit(False).alias("outgoing"), "source"
    )
    rows = _labels(out.unionAll(into), g, entity="entity_labels", neighbor="neighbor_labels")
    return rows.select(
        F.col("rel").alias("relationship"), "neighbor", "chunk_id", "outgoing", "entity_labels", "neighbor_labels", "source"
    )


def _edge_rows(g: PropertyGraph, edges: DataFrame) -> DataFrame:
    rows = _sourced(edges).select(F.col("src").alias("entity"), F.col("dst").alias("neighbor"), "chunk_id", "source")
    return _labels(rows, g, entity="entity_labels", neighbor="neighbor_labels").select(
        "entity", "neighbor", "chunk_id", "source", "entity_labels", "neighbor_labels"
    )


@singledispatch
def compile_plan(plan: Plan, g: PropertyGraph) -> DataFrame:
    raise TypeError(f"no template for {type(plan).__name__}")


@compile_plan.register
def _(plan: Neighbors, g: PropertyGraph) -> DataFrame:
    return _touching(g, g.edges, plan.entity_id)


@compile_plan.register
def _(plan: RelatedBy, g: PropertyGraph) -> DataFrame:
    return _touching(g, g.rel(plan.rel), plan.entity_id)


@compile_plan.register
def _(plan: PathBetween, g: PropertyGraph) -> DataFrame:
    return shortest_path(g.edges, plan.entity_id, plan.other_id)


@compile_plan.register
def _(plan: WrapChain, g: PropertyGraph) -> DataFrame:
    start = g.nodes.where(F.col("id") == plan.entity_id).select("id")
    return trails(_sourced(g.rel(plan.rel)), start, plan.max_hops, directed=False).select("chain", "chunk_ids", "starts", "sources")


@compile_plan.register
def _(plan: CallChain, g: PropertyGraph) -> DataFrame:
    """From a class also its members; cycles are cut during the walk, since facts drop them. Chains of a length
    are ordered as they are written, joined by ``|``, which ranks a name behind the longer ones that it begins."""
    anchor = g.nodes.where(F.col("id") == plan.entity_id)
    own = anchor.where(F.array_contains("labels", "Class")).select(F.col("id").alias("dst"))
    members = g.rel("DEFINED_IN").join(own, "dst", "left_semi").select(F.col("src").alias("id"))
    start = members.unionAll(anchor.select("id")).distinct()
    rows = trails(_sourced(g.rel(*plan.rels)), start, plan.max_hops, directed=True, simple=True)
    return rows.orderBy(F.size("chain"), F.array_join("chain", "|"), "chunk_ids").limit(CALL_LIMIT).select(
        "chain", "chunk_ids", "starts", "rels", "sources"
    )


@compile_plan.register
def _(plan: CountRel, g: PropertyGraph) -> DataFrame:
    return g.rel(plan.rel).agg(F.count("*").alias("count"))


@compile_plan.register
def _(plan: DocsFor, g: PropertyGraph) -> DataFrame:
    """A section's id names the chunk that it cites."""
    rows = g.rel(plan.rel).where(F.col("src") == plan.entity_id)
    return rows.select(F.col("dst").alias("doc_section"), F.regexp_replace("dst", "^doc:", "").alias("chunk_id")).distinct()


@compile_plan.register
def _(plan: EdgesFrom, g: PropertyGraph) -> DataFrame:
    return _edge_rows(g, g.rel(plan.rel).where(F.col("src").isin(*plan.entity_ids)))


@compile_plan.register
def _(plan: EdgesTo, g: PropertyGraph) -> DataFrame:
    return _edge_rows(g, g.rel(plan.rel).where(F.col("dst").isin(*plan.entity_ids)))


@compile_plan.register
def _(plan: RaisedByMembers, g: PropertyGraph) -> DataFrame:
    members = g.rel(plan.member_rel).where(F.col("dst") == plan.entity_id).select("src").distinct()
    return _edge_rows(g, g.rel(plan.rel).join(members, "src", "left_semi"))


@compile_plan.register
def _(plan: InPackage, g: PropertyGraph) -> DataFrame:
    rows = g.rel(plan.rel).where(F.col("src").startswith(plan.package + ".")).orderBy("src", "dst", "chunk_id").limit(plan.limit)
    return _edge_rows(g, rows)


def _named(g: PropertyGraph, plan: FlowOfName | OwnersOfName) -> DataFrame:
    holders = g.nodes.where(
        F.col("id").endswith("." + plan.name) & F.array_contains("labels", plan.label)
    ).select(F.col("id").alias("src"))
    return g.rel(plan.rel).where(F.col("src").endswith("." + plan.name)).join(holders, "src", "left_semi")


@compile_plan.register
def _(plan: FlowOfName, g: PropertyGraph) -> DataFrame:
    return _edge_rows(g, _named(g, plan))


@compile_plan.register
def _(plan: OwnersOfName, g: PropertyGraph) -> DataFrame:
    return _edge_rows(g, _named(g, plan).orderBy("src", "dst", "chunk_id").limit(plan.limit))


def run_plan(plan: Plan, g: PropertyGraph, known: frozenset[str], packages: frozenset[str] = frozenset()) -> DataFrame:
    """Check a plan's parameters, then compile it."""
    return compile_plan(plan.validate(g.ontology, known, packages), g)
