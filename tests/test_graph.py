"""Writes and walks on small graphs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from weft.graph import PLACEHOLDER, PropertyGraph, containment, infer_external_types, plausible_ends
from weft.ontology import CODE, plural
from weft.operators import paths
from weft.plans import CallChain, CountRel, EdgesFrom, InPackage, Neighbors, OwnersOfName, PlanError, RelatedBy, WrapChain
from weft.plans.templates import compile_plan, run_plan

EDGE = "src string, rel string, dst string, chunk_id string, confidence double, source string, props map<string,string>"


def graph(spark, edges, nodes=None):
    rows = [(s, r, d, c, 1.0, src, {}) for s, r, d, c, src in edges]
    ids = sorted({x for e in edges for x in (e[0], e[2])}) if nodes is None else nodes
    labels = [(i, ["Function"] if isinstance(ids, list) else [ids[i]], {}) for i in ids]
    return PropertyGraph(
        spark.createDataFrame(labels, "id string, labels array<string>, props map<string,string>"),
        spark.createDataFrame(rows, EDGE), CODE
    )


def test_upsert_is_idempotent_and_last_write_wins(spark):
    g = graph(spark, [("a", "CALLS", "b", "1", "ast")])
    new = spark.createDataFrame(
        [
            ("a", "CALLS", "b", "1", 0.2, "jedi", {}, 1), ("a", "CALLS", "b", "1", 0.7, "jedi", {}, 2),
            ("a", "CALLS", "z", "1", 0.5, "jedi", {}, 3)
        ],
        EDGE + ", ord long"
    )
    once = g.upsert_edges(new)
    twice = once.upsert_edges(new)
    rows = lambda x: sorted((r["src"], r["dst"], r["confidence"]) for r in x.edges.collect())
    assert rows(once) == rows(twice) == [("a", "b", 0.7), ("a", "z", 0.5)]
    assert {r["id"] for r in twice.nodes.collect()} == {"a", "b", "z"}


def test_node_labels_accumulate(spark):
    g = graph(spark, [], {"a": "Class"})
    new = spark.createDataFrame(
        [("a", ["Exception"], {"k": "1"}, 1), ("a", ["Class"], {"k": "2"}, 2)],
        "id string, labels array<string>, props map<string,string>, ord long"
    )
    row = g.upsert_nodes(new).nodes.first()
    assert row["labels"] == ["Class", "Exception"] and row["props"] == {"k": "2"}


def test_validate_rejects_unknown_names(spark):
    with pytest.raises(ValueError):
        graph(spark, [("a", "LIKES", "b", "1", None)]).validate()
    graph(spark, [("a", "CALLS", "b", "1", None)]).validate()


def test_twins_slices_labels_containment(spark):
    g = graph(
        spark,
        [
            ("a.b", "DEFINED_IN", "a", PLACEHOLDER, "ast"), ("a.b", "DEFINED_IN", "a", "c1", "ast"),
            ("a.c", "DEFINED_IN", "a", PLACEHOLDER, "ast"), ("a", "CALLS", "b", "1", "jedi")
        ]
    )
    assert g.drop_twins().edges.count() == 3
    new = graph(spark, [("a", "CALLS", "c", "1", "jedi")]).edges
    once = g.replace_slice("CALLS", "jedi", new)
    assert once.edges.count() == once.replace_slice("CALLS", "jedi", new).edges.count() == 4
    ids = spark.createDataFrame([("a",), ("a.b",), ("a.b.c.d",)], "id string")
    assert [(r["src"], r["dst"]) for r in containment(ids).collect()] == [("a.b", "a")]
    bare = PropertyGraph(
        spark.createDataFrame([("x", [], {}), ("y", ["Class"], {})], "id string, labels array<string>, props map<string,string>"),
        g.edges, CODE
    )
    marked = bare.label_if_unlabelled(spark.createDataFrame([("x",), ("y",)], "id string"), "Function")
    assert {r["id"]: r["labels"] for r in marked.nodes.collect()} == {"x": ["Function"], "y": ["Class"]}


def test_types_of_ends(spark):
    g = graph(spark, [("f", "RAISES", "E", "1", None), ("f", "CALLS", "q", "1", None)], {"f": "Function"})
    assert [tuple(r) for r in infer_external_types(g.edges, g.nodes, {"RAISES": "Exception"}).collect()] == [("E", "Exception")]
    assert plausible_ends(g.edges, g.nodes, ("Class",)).count() == 0
    assert plausible_ends(g.edges, g.nodes, ("Function",)).count() == 2


def test_neighbors_say_direction_and_self_loops_come_once(spark):
    g = graph(spark, [("a", "CALLS", "a", "1", None), ("b", "CALLS", "a", "2", "jedi"), ("a", "RAISES", "E", "3", "ast")])
    rows = {(r["neighbor"], r["outgoing"], r["source"]) for r in compile_plan(Neighbors("a"), g).collect()}
    assert rows == {("a", True, "llm"), ("b", False, "jedi"), ("E", True, "ast")}
    assert compile_plan(RelatedBy("a", "CALLS"), g).count() == 2
    assert compile_plan(CountRel("CALLS"), g).first()["count"] == 2
    assert g.describe().where("id = 'a'").first()["degree"] == 3


def test_parameters_are_checked(spark):
    g = graph(spark, [("p.a", "CALLS", "b", "1", None)])
    for bad in (
        Neighbors("nobody"), RelatedBy("p.a", "LIKES"), WrapChain("p.a", 9), WrapChain("p.a", True), EdgesFrom((), "CALLS"),
        InPackage("q", "CALLS"), OwnersOfName("a b")
    ):
        with pytest.raises(PlanError):
            run_plan(bad, g, frozenset({"p.a"}), frozenset({"p"}))
    assert run_plan(InPackage("p", "CALLS"), g, frozenset(), frozenset({"p"})).count() == 1


def brute_trails(edges, start, hops, directed, simple):
    out = []

    def walk(at, chain, used):
        for i, (s, _, d, c, _) in enumerate(edges):
            for a, b in [(s, d)] + ([(d, s)] if not directed and s != d else []):
                if a == at and i not in used and not (simple and b in chain):
                    out.append((tuple(chain + [b]), tuple(edges[k][3] for k in used) + (c,)))
                    if len(used) + 1 < hops:
                        walk(b, chain + [b], used + [i])

    walk(start, [start], [])
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_trails_against_a_walker(spark, seed):
    rng = random.Random(seed)
    names = "abcde"
    edges = [(rng.choice(names), "CALLS", rng.choice(names), str(i), None) for i in range(7)]
    g = graph(spark, edges, dict.fromkeys(names, "Function"))
    start = spark.createDataFrame([("a",)], "id string")
    for directed, simple in itertools.product((True, False), repeat=2):
        got = sorted(
            (tuple(r["chain"]), tuple(r["chunk_ids"])) for r in paths.trails(g.edges, start, 3, directed, simple).collect()
        )
        assert got == brute_trails(edges, "a", 3, directed, simple)


def test_call_chain_starts_from_members_and_drops_cycles(spark):
    e = [
        ("C.m", "DEFINED_IN", "C", "1", None), ("C.m", "CALLS", "f", "2", None), ("f", "CALLS", "C.m", "3", None),
        ("f", "CALLS", "g", "4", None)
    ]
    g = graph(spark, e, {"C": "Class", "C.m": "Function", "f": "Function", "g": "Function"})
    chains = {tuple(r["chain"]) for r in compile_plan(CallChain("C", 5), g).collect()}
    assert chains == {("C.m", "f"), ("C.m", "f", "g")}
    assert {tuple(r["chain"]) for r in paths.maximal(compile_plan(CallChain("C", 5), g)).collect()} == {("C.m", "f", "g")}


def test_shortest_path(spark):
    g = graph(
        spark,
        [
            ("a", "CALLS", "b", "1", None), ("c", "CALLS", "b", "1", None), ("c", "CALLS", "d", "1", None),
            ("x", "CALLS", "y", "1", None)
        ]
    )
    assert paths.shortest_path(g.edges, "a", "d").first()["chain"] == ["a", "b", "c", "d"]
    assert paths.shortest_path(g.edges, "a", "y").count() == 0


def test_collapse_keeps_true_direction(spark):
    g = graph(spark, [("b", "CALLS", "a", "1", None), ("b", "CALLS", "c", "2", None)])
    rows = paths.trails(g.edges.withColumn("source", F.lit("llm")), spark.createDataFrame([("a",)], "id string"), 2, directed=False)
    assert {(r["src"], r["dst"]) for r in paths.collapsed(rows).collect()} == {("b", "a"), ("b", "c")}


def test_plurals():
    assert [
        plural(CODE.relationships[r].phrase) for r in ("INHERITS_FROM", "DEFINED_IN", "HAS_PARAMETER", "CHANGED_IN")
    ] == ["inherit from", "are defined in", "have parameter", "changed in"]
