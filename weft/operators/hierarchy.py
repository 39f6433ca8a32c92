"""Closures of a parent table, and what is decided by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle


def closure(parents: DataFrame, max_depth: int = 16, reflexive: bool = False) -> DataFrame:
    """``id, ancestor, depth`` (the least depth) of the table ``id, parent``.

    Each round joins the newest pairs to the parents and drops pairs known before, so cycles end it, and
    is computed once; it stops as soon as a round adds none. ``max_depth`` bounds the lineage; reaching it raises.
    Ids that are nobody's parent, most of a tree, take no part in the rounds: they are joined once to what
    lies above their parents. Only those with several parents can meet an ancestor by two ways.
    """
    rows = settle(parents.select("id", "parent").where("id is not null and parent is not null").distinct())
    above = rows.select(F.col("parent").alias("id")).distinct()
    step = settle(rows.join(above, "id", "left_semi"))
    known = _rounds(step, max_depth)
    several = F.count("*").over(Window.partitionBy("id")) > 1
    leaves = settle(rows.join(above, "id", "left_anti").withColumn("several", several))
    # Above a parent: itself and its own ancestors, one row for each.
    upward = leaves.join(known.select(F.col("id").alias("parent"), "ancestor", "depth"), "parent")
    if not upward.where(F.col("depth") >= max_depth).isEmpty():
        raise ValueError(f"deeper than {max_depth}")
    out = leaves.select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"), "several").unionAll(
        upward.select("id", "ancestor", F.col("depth") + 1, "several")
    )
    met = out.where("several").groupBy("id", "ancestor").agg(F.min("depth").alias("depth"))
    known = known.unionAll(out.where("not several").select("id", "ancestor", "depth")).unionAll(met)
    if reflexive:
        ids = rows.select(F.col("id")).unionAll(rows.select(F.col("parent").alias("id"))).distinct()
        known = known.unionAll(ids.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth")))
    return known


def _rounds(step: DataFrame, max_depth: int) -> DataFrame:
    """The closure of a settled table of distinct ``id, parent``, a round for each depth."""
    now = step.select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).where("id <> ancestor")
    known = now
    for depth in range(2, max_depth + 2):
        further = now.alias("n").join(
            step.alias("s"), F.col("n.ancestor") == F.col("s.id")
        ).select(F.col("n.id"), F.col("s.parent").alias("ancestor")).distinct()
        now = settle(further.where("id <> ancestor").join(known, ["id", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)))
        if now.isEmpty():
            break
        if depth > max_depth:
            raise ValueError(f"deeper than {max_depth}")
        known = known.unionAll(now)
    return known


def override_calls(calls: DataFrame, parents: DataFrame, universe: DataFrame) -> DataFrame:
    """``src, dst``: a call to a method of a base is a call to each subclass's override of it."""
    base = F.regexp_replace("dst", r"\.[^.]*$", "")
    method = F.substring_index("dst", ".", -1)
    asked = calls.select("src", base.alias("ancestor"), method.alias("method")).distinct()
    below = closure(parents).select("ancestor", F.col("id").alias("cls"))
    forms = asked.join(below, "ancestor").select("src", F.concat_ws(".", "cls", "method").alias("dst"))
    return forms.join(universe.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst").distinct()


def _matched(
    observed: DataFrame, graph: DataFrame, hierarchy: DataFrame | None, implicit: DataFrame | None, packages: tuple[str, ...] | None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Observed pairs, graph pairs, and ``a, b, fa, fb``: which observed pair confirms which graph pair.

    An observed pair is carried up only to the ends that the graph has; rows may repeat if the hierarchy's do.
    """
    if packages is not None:
        inside = [F.substring_index(c, ".", 1).isin(*packages, "builtins") for c in ("a", "b")]
        observed, graph = (rows.where(inside[0] & inside[1]) for rows in (observed, graph))
    seen = observed.where(~F.col("b").rlike(r"\.__(?!init__)\w+__$"))
    if implicit is not None:
        seen = seen.join(implicit.select(F.col("id").alias("b")), "b", "left_anti")
    seen = seen.select("a", F.regexp_replace("b", r"\.__init__$", "").alias("b")).distinct()
    graph = graph.select("a", "b").distinct()
    forms = seen.select("a", "b", F.col("a").alias("fa"), F.col("b").alias("fb"))
    if hierarchy is not None:
        for side in ("a", "b"):
            ends = graph.select(F.col(side).alias("_up")).distinct()
            up = hierarchy.select(F.col("id").alias(f"f{side}"), F.col("ancestor").alias("_up")).join(ends, "_up", "left_semi")
            more = forms.join(up, f"f{side}").withColumn(f"f{side}", F.col("_up")).drop("_up")
            forms = forms.join(ends.withColumnRenamed("_up", f"f{side}"), f"f{side}", "left_semi").unionByName(more)
    return seen, graph, forms.join(graph.select(F.col("a").alias("fa"), F.col("b").alias("fb")), ["fa", "fb"])


def unmatched_pairs(
    observed: DataFrame, graph: DataFrame, hierarchy: DataFrame | None = None, implicit: DataFrame | None = None,
    packages: tuple[str, ...] | None = None
) -> DataFrame:
    """``kind, a, b``: observed pairs ``missing`` from the graph, and pairs of the graph ``unconfirmed`` by any observed one."""
    seen, graph, hits = _matched(observed, graph, hierarchy, implicit, packages)
    missing = seen.join(hits.select("a", "b").distinct(), ["a", "b"], "left_anti")
    unconfirmed = graph.join(hits.select(F.col("fa").alias("a"), F.col("fb").alias("b")).distinct(), ["a", "b"], "left_anti")
    return missing.select(F.lit("missing").alias("kind"), "a", "b").unionAll(unconfirmed.select(F.lit("unconfirmed"), "a", "b"))


def compare_pairs(
    observed: DataFrame, graph: DataFrame, hierarchy: DataFrame | None = None, implicit: DataFrame | None = None,
    packages: tuple[str, ...] | None = None
) -> DataFrame:
    """One row: observed, in_graph, confirmed, recall and observed_precision (3 digits, null over 0).

    Pairs are columns ``a, b``. A call of a constructor is a call of its class, implicit callees
    (``implicit.id`` and double-underscore names but ``__init__``) are left out, and an observed
    pair confirms a graph pair of its ancestors (``hierarchy``: ``id, ancestor``), never of its
    descendants. With ``packages``, only pairs both of whose ends are of these (or builtins) count.
    """
    seen, graph, hits = _matched(observed, graph, hierarchy, implicit, packages)
    counts = [
        seen.agg(F.count("*").alias("observed")),
        graph.agg(F.count("*").alias("in_graph")),
        hits.agg(F.count_distinct("a", "b").alias("confirmed"), F.count_distinct("fa", "fb").alias("confirmed_graph")),
    ]
    one = counts[0].crossJoin(counts[1]).crossJoin(counts[2])  # three rows of counts
    return one.select(
        "observed", "in_graph", "confirmed", F.round(F.try_divide(F.col("confirmed"), F.col("observed")), 3).alias("recall"),
        F.round(F.try_divide(F.col("confirmed_graph"), F.col("in_graph")), 3).alias("observed_precision")
    )


def member_summary(members: DataFrame, parents: DataFrame) -> DataFrame:
    """``base, n, names`` of the members (``id``) under each direct base, by leaf name."""
    rows = parents.join(members.select("id"), "id", "left_semi").distinct()
    return rows.groupBy("parent").agg(
        F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.substring_index("id", ".", -1))), ", ").alias("names")
    ).withColumnRenamed("parent", "base")


def multi_base(members: DataFrame, parents: DataFrame) -> DataFrame:
    """``id, bases`` of the members with more than one distinct base."""
    rows = parents.join(members.select("id"), "id", "left_semi")
    return rows.groupBy("id").agg(F.count_distinct("parent").alias("bases")).where("bases > 1")
