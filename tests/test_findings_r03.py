"""One small case for each finding of the third round."""

import pytest

from weft.graph import PropertyGraph, containment
from weft.ontology import CODE
from weft.operators import hierarchy, vectors
from weft.plans import CallChain
from weft.plans.templates import compile_plan

EDGE = "src string, rel string, dst string, chunk_id string, confidence double, source string, props map<string,string>"


def test_call_chains_are_ordered_as_written(spark):
    """``C.m1|x`` comes behind ``C.m12|x``, as in SQL, which orders by the joined chain; the limit cuts by that order."""
    names = ("C.m1", "C.m12", "C.m2")
    rows = [(n, "DEFINED_IN", "C", n, 1.0, "ast", {}) for n in names] + [(n, "CALLS", "x", n, 1.0, "ast", {}) for n in names]
    nodes = [("C", ["Class"], {}), ("x", ["Function"], {})] + [(n, ["Function"], {}) for n in names]
    g = PropertyGraph(
        spark.createDataFrame(nodes, "id string, labels array<string>, props map<string,string>"), spark.createDataFrame(rows, EDGE),
        CODE
    )
    got = [r["chain"][0] for r in compile_plan(CallChain("C", 5, ("CALLS",)), g).collect()]
    assert got == ["C.m12", "C.m1", "C.m2"]


def test_recall_by_label_is_recall_of_all_pairs_of_a_label(spark):
    """the same figure as from listed pairs, without a join of the rows of a label to one another."""
    rows = [(i, i % 4 if i % 7 else None) for i in range(40)] + [(100, 9), (8, 3)]
    labels = spark.createDataFrame(rows, "id long, label int")
    asked = spark.createDataFrame([(i,) for i in range(0, 40, 3)] + [(100,), (8,)], "query_id long")
    found = spark.createDataFrame(
        [(q, (q * 5 + r * r) % 40, r) for q in [*range(0, 40, 3), 100, 8] for r in range(1, 5)], "query_id long, id long, rank int"
    ).where("id <> query_id")
    pairs = asked.join(labels.withColumnRenamed("id", "query_id"), "query_id").join(labels, "label").where("id <> query_id")
    for k in (1, 3):  # of 13 questions, none and 10
        want = vectors.recall_at_k(found, pairs, k).first()["recall"]
        assert want < 1 and vectors.label_recall_at_k(found, asked, labels, k).first()["recall"] == want


def test_containment_is_one_join_however_many_kinds(spark):
    """a semi-join was pushed into every kind of the union, each against all ids, and merged to one task."""
    kinds = [spark.createDataFrame([(f"r.n{k}",), (f"r.n{k}.c",), ("r",)], "id string") for k in range(4)]
    ids = kinds[0].unionAll(kinds[1]).unionAll(kinds[2]).unionAll(kinds[3])
    rows = containment(ids)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert sorted(tuple(r) for r in rows.distinct().collect()) == sorted([(f"r.n{k}", "r") for k in range(4)] + [(f"r.n{k}.c", f"r.n{k}") for k in range(4)])
    assert rows.count() == 8


def test_closure_of_leaves_with_several_parents(spark):
    """leaves are joined once to what lies above their parents; the least depth of two ways counts."""
    parents = {"a": {"b"}, "b": {"c"}, "x": {"a", "c", "x2"}, "y": {"a"}, "x2": {"x3"}, "l": {"m"}, "m": {"l", "c"}, "z": {"l"}}
    want = {}
    for i in parents:
        now, depth = parents[i], 1
        while now:
            want |= {(i, p): depth for p in now if p != i and (i, p) not in want}
            now, depth = {q for p in now for q in parents.get(p, ())} - {p for j, p in want if j == i} - {i}, depth + 1
    df = spark.createDataFrame([(i, p) for i, ps in parents.items() for p in ps], "id string, parent string")
    got = hierarchy.closure(df).collect()
    assert {(r["id"], r["ancestor"]): r["depth"] for r in got} == want and len(got) == len(want)
    chain = spark.createDataFrame([(str(i), str(i + 1)) for i in range(4)], "id string, parent string")
    assert hierarchy.closure(chain, 4).count() == 10
    with pytest.raises(ValueError):
        hierarchy.closure(chain, 3)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_twins_are_compared_in_all_shuffle_partitions(spark):
    """dealt out by its ends, not by a constant relationship, for which Spark puts a merged exchange in its place."""
    rows = [("a", "b", "ast"), ("a", "b", "1"), ("a", "c", "ast"), ("d", "b", "2")]
    edges = spark.createDataFrame(rows, "src string, dst string, chunk_id string").selectExpr(
        "src", "'DEFINED_IN' AS rel", "dst", "chunk_id", "1.0D AS confidence", "'ast' AS source", "map('k', 'v') AS props"
    )
    left = PropertyGraph(None, edges, CODE).drop_twins().edges
    assert plan(left).count("Exchange ") == plan(left).count("REPARTITION_BY_NUM") == 1
    assert sorted((r["src"], r["dst"], r["chunk_id"]) for r in left.collect()) == [("a", "b", "1"), ("a", "c", "ast"), ("d", "b", "2")]


def test_ends_of_written_edges_do_not_wait_for_the_last_write(spark):
    """nodes come from the ends of all writes, so the writes of a key are not gathered for them."""
    none = spark.createDataFrame([], EDGE)
    rows = [("a", "CALLS", "b", "1", x, "ast", {}, i) for i, x in enumerate((0.1, 0.2))] + [("c", "CALLS", None, "2", 1.0, "ast", {}, 0)]
    g = PropertyGraph(spark.createDataFrame([("a", ["Class"], {})], "id string, labels array<string>, props map<string,string>"), none, CODE)
    done = g.upsert_edges(spark.createDataFrame(rows, EDGE + ", ord long"))
    assert "max_by" in plan(done.edges) and "max_by" not in plan(done.nodes)
    assert sorted((str(r["id"]), r["labels"]) for r in done.nodes.collect()) == [("None", []), ("a", ["Class"]), ("b", []), ("c", [])]
    assert done.edges.where("src = 'a'").first()["confidence"] == 0.2
