"""A property graph as two DataFrames, with the writes that keep it consistent.

``nodes``: id, labels (sorted array), props (map). ``edges``: src, rel, dst, chunk_id, confidence,
source, props. An edge is one piece of evidence: its key is (src, rel, dst, chunk_id), so counts over
edges count evidence and ``distinct_pairs`` counts facts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ontology import Ontology
from .session import spread

NODE_SCHEMA = "id string, labels array<string>, props map<string,string>"
EDGE_SCHEMA = "src string, rel string, dst string, chunk_id string, confidence double, source string, props map<string,string>"
EDGE_KEY = ("src", "rel", "dst", "chunk_id")
#: What an edge stands for that a structural rule wrote and no chunk backs.
PLACEHOLDER = "ast"


def last_write(rows: DataFrame, key: tuple[str, ...], order: str) -> DataFrame:
    """The row with the largest ``order`` of each key; one shuffle, and no gathering of rows."""
    rest = [c for c in rows.columns if c not in key]
    picked = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_last"))
    return picked.select(*key, *[F.col(f"_last.{c}").alias(c) for c in rest if c != order])


def ends(edges: DataFrame) -> DataFrame:
    """The distinct ``id`` of both ends. Edges that were not yet made distinct by key give the same."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


@dataclass(frozen=True)
class PropertyGraph:
    nodes: DataFrame
    edges: DataFrame
    ontology: Ontology

    def validate(self) -> PropertyGraph:
        """Raise on a label or relationship that the ontology lacks; one small action."""
        labels = self.nodes.select(F.explode("labels").alias("x")).distinct().where(~F.col("x").isin(*self.ontology.entity_types))
        rels = self.edges.select(F.col("rel").alias("x")).distinct().where(~F.col("x").isin(*self.ontology.relationships))
        bad = [r["x"] for r in labels.unionAll(rels).limit(5).collect()]
        if bad:
            raise ValueError(f"not in the ontology: {', '.join(map(str, bad))}")
        return self

    def rel(self, *names: str) -> DataFrame:
        for n in names:
            self.ontology.check_relationship(n)
        return self.edges.where(F.col("rel").isin(*names) if len(names) > 1 else F.col("rel") == names[0])

    def distinct_pairs(self) -> DataFrame:
        return self.edges.select("src", "rel", "dst").distinct()

    def upsert_nodes(self, new: DataFrame, order: str = "ord") -> PropertyGraph:
        """Match on id alone: labels accumulate, and the last writer of a property wins."""
        old = self.nodes.withColumn(order, F.lit(-1).cast("long"))
        return PropertyGraph(merge_nodes(old.unionByName(new), order), self.edges, self.ontology)

    def upsert_edges(self, new: DataFrame, order: str = "ord") -> PropertyGraph:
        """The last write of an edge key wins; endpoints that are no nodes yet become bare nodes."""
        old = self.edges.withColumn(order, F.lit(-1).cast("long"))
        edges = last_write(old.unionByName(new), EDGE_KEY, order)
        bare = ends(self.edges.select("src", "dst").unionAll(new.select("src", "dst"))).join(self.nodes, "id", "left_anti").select(
            "id", F.array().cast("array<string>").alias("labels"),
            F.map_from_arrays(F.array(), F.array()).cast("map<string,string>").alias("props")
        )
        return PropertyGraph(self.nodes.unionByName(bare), edges, self.ontology)

    def label_if_unlabelled(self, ids: DataFrame, label: str) -> PropertyGraph:
        self.ontology.check_label(label)
        marked = self.nodes.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
        labels = F.when(F.col("_hit") & (F.size("labels") == 0), F.array(F.lit(label))).otherwise(F.col("labels"))
        return PropertyGraph(marked.withColumn("labels", labels).drop("_hit"), self.edges, self.ontology)

    def replace_slice(self, rel: str, source: str, new: DataFrame) -> PropertyGraph:
        """Delete the edges of (rel, source) and write ``new``: applying it twice changes nothing."""
        self.ontology.check_relationship(rel)
        kept = self.edges.where(~((F.col("rel") == rel) & F.col("source").eqNullSafe(F.lit(source))))
        return PropertyGraph(self.nodes, kept.unionByName(new.dropDuplicates(list(EDGE_KEY))), self.ontology)

    def drop_twins(self, rel: str = "DEFINED_IN") -> PropertyGraph:
        """Delete placeholder edges whose (src, rel, dst) a real chunk backs too."""
        real = F.max(F.col("chunk_id") != PLACEHOLDER).over(Window.partitionBy("src", "rel", "dst"))
        edges = spread(self.edges, "src", "dst").withColumn("_backed", real).where(
            (F.col("rel") != rel) | (F.col("chunk_id") != PLACEHOLDER) | ~F.col("_backed")
        ).drop("_backed")
        return PropertyGraph(self.nodes, edges, self.ontology)

    def describe(self, ids: DataFrame | None = None) -> DataFrame:
        """``id, labels, degree``: edges that touch a node in either direction, 0 where none does."""
        nodes = self.nodes if ids is None else self.nodes.join(ids.select("id").distinct(), "id", "left_semi")
        ends = self.edges.select(F.col("src").alias("id")).unionAll(self.edges.where("src <> dst").select(F.col("dst").alias("id")))
        if ids is not None:
            ends = ends.join(ids.select("id").distinct(), "id", "left_semi")
        degree = ends.groupBy("id").agg(F.count("*").alias("degree"))
        return nodes.select("id", "labels").join(degree, "id", "left").withColumn(
            "degree", F.coalesce("degree", F.lit(0)).cast("long")
        )


def merge_nodes(rows: DataFrame, order: str = "ord") -> DataFrame:
    """``id, labels, props`` merged from writes ``id, labels, props, ord``."""
    labels = rows.select("id", F.explode_outer("labels").alias("label")).groupBy("id").agg(
        F.array_sort(F.collect_set("label")).alias("labels")
    )
    props = rows.select(
        "id", F.explode("props").alias("k", "v"), order
    ).groupBy("id", "k").agg(F.max_by("v", F.col(order)).alias("v"))
    props = props.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("props"))
    empty = F.map_from_arrays(F.array(), F.array()).cast("map<string,string>")
    return labels.join(props, "id", "left").select("id", "labels", F.coalesce("props", empty).alias("props"))


def parent_of(id_: F.Column) -> F.Column:
    """A dotted id without its last segment; null where there is no dot."""
    return F.when(F.contains(id_, F.lit(".")), F.regexp_replace(id_, r"\.[^.]*$", ""))


def containment(ids: DataFrame) -> DataFrame:
    """``src, dst`` for each id whose parent is an id too: one join to the distinct ids.

    A semi-join would be pushed into each kind of a union of ids, and all ids be sent to every one of them.
    """
    derived = ids.select(F.col("id").alias("src"), parent_of(F.col("id")).alias("dst")).where("dst is not null")
    return derived.join(spread(ids.select(F.col("id").alias("dst")), "dst").distinct(), "dst").select("src", "dst")


def nearest_ancestor(ids: DataFrame, known: DataFrame) -> DataFrame:
    """``id, ancestor``: the longest proper dotted prefix of an id that is known, null where none is."""
    parts = F.split("id", r"\.")
    prefixes = F.expr("transform(sequence(1, greatest(size(p) - 1, 1)), n -> array_join(slice(p, 1, n), '.'))")
    rows = ids.select("id", parts.alias("p")).where("size(p) > 1").select("id", F.explode(prefixes).alias("ancestor"))
    hits = rows.join(known.select(F.col("id").alias("ancestor")).distinct(), "ancestor", "left_semi")
    best = hits.groupBy("id").agg(F.max_by("ancestor", F.length("ancestor")).alias("ancestor"))
    return ids.select("id").distinct().join(best, "id", "left")


def with_all_sources(edges: DataFrame) -> DataFrame:
    """``tag, src, dst``: distinct pairs by source (null: ``llm``), and all of them again under ``all``."""
    tag = F.explode(F.array(F.coalesce("source", F.lit("llm")), F.lit("all"))).alias("tag")
    return edges.select(tag, "src", "dst").distinct()


def infer_external_types(edges: DataFrame, universe: DataFrame, roles: dict[str, str]) -> DataFrame:
    """``id, label`` for edge targets outside the universe, by the role their relationship gives them."""
    table = F.create_map(*[x for k, v in sorted(roles.items()) for x in (F.lit(k), F.lit(v))])
    outside = edges.select(F.col("dst").alias("id"), table[F.col("rel")].alias("label")).where("label is not null")
    return outside.join(universe.select("id"), "id", "left_anti").groupBy("id").agg(F.min("label").alias("label"))


def plausible_ends(edges: DataFrame, nodes: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """Edges of which both ends are unknown or carry one of the allowed labels."""
    out = edges
    for end in ("src", "dst"):
        labels = nodes.select(F.col("id").alias(end), F.col("labels").alias(f"_{end}"))
        out = out.join(labels, end, "left").where(
            F.col(f"_{end}").isNull() | (F.size(f"_{end}") == 0) | F.arrays_overlap(f"_{end}", F.array(*map(F.lit, allowed)))
        ).drop(f"_{end}")
    return out
