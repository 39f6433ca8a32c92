"""Resolution, facts, grading, rules, extraction and the question pipeline on small cases."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from weft import cli, evaluate
from weft.graph import PropertyGraph
from weft.ontology import CODE
from weft.operators import evals, facts, grading, hierarchy, vectors
from weft.operators.resolve import resolve, unambiguous_index
from weft.pipeline import Engine
from weft.plans import CallChain, CountRel, Neighbors, RaisedByMembers, RelatedBy, WrapChain
from weft.plans.rules import Candidate, Hop, expansion, fallbacks, repair
from weft.providers import HashEmbedder, Mention, grounded, mentions, read_mentions, settled_route
from weft.sources import files, ingest
from weft.sources.chunkers import changelog_chunks, code_chunks, markdown_chunks, rst_chunks
from weft.sources.extract import chunk_files, extract
from weft.sources.ingest import build_graph, replay
from weft.streaming import append_decisions, read_decisions, rollup

LIB = Path(__file__).parent / "fixtures" / "minilib"


def test_every_rung_in_order(spark):
    ids = [
        "p.m.f", "p.m.C", "p.m.C.run", "p.n.g", "q.m.g", "p.n.Only", "p.x.D.go", "q.x.D.go", "p.n.h.arg", "q.n.k.arg",
        "p.m.Under_Score", "p.m.ValueError2"
    ]
    rows = [
        ("p.m.f", None, None, "p.m.f", "exact"), ("self.run", "p.m", "p.m.C", "p.m.C.run", "self_reference"), ("self.nope", "p.m", "p.m.C", None, "self_reference"), ("al", "p.m", None, "ext.thing", "import_alias"), ("f", "p.m", None, "p.m.f", "same_module"),
        ("p.Pub", None, None, "p.n.Only", "reexport"), ("C.run", None, None, "p.m.C.run", "qualified"), ("D.go", None, None, None, "qualified"), ("Only", None, None, "p.n.Only", "normalized"), ("underscore", None, None, "p.m.Under_Score", "normalized"),
        ("arg", None, None, "p.n.h.arg", "public_api"), ("g", None, None, None, "ambiguous"), ("KeyError", None, None, "builtins.KeyError", "builtin"), ("nothing", None, None, None, "unresolved"),
    ]
    asked = spark.createDataFrame([r[:3] for r in rows], "surface string, module string, cls string")
    universe = spark.createDataFrame([(i,) for i in ids], "id string")
    aliases = spark.createDataFrame(
        [("p.m", "al", "ext.thing"), ("p", "Pub", "p.n.Only")], "module string, local string, target string"
    )
    public = spark.createDataFrame([("p.n.h",)], "id string")
    documented = spark.createDataFrame([("p.n.h", "arg"), ("q.n.k", "arg")], "function_id string, param string")
    got = {
        (r["surface"], r["module"], r["cls"]): (r["canonical_id"], r["method"]) for r in resolve(
            asked, universe, aliases, None, public, documented
        ).collect()
    }
    assert got == {r[:3]: r[3:] for r in rows}


def test_call_graph_rung(spark):
    universe = spark.createDataFrame([("a.f.x",), ("b.g.x",)], "id string")
    asked = spark.createDataFrame([("x", None, None)], "surface string, module string, cls string")
    calls = spark.createDataFrame([("a.f", "b.g")], "src string, dst string")
    row = resolve(asked, universe, calls=calls).first()
    assert (row["method"], row["canonical_id"]) == ("call_graph", "a.f.x")


def test_index_drops_ambiguous_keys(spark):
    s = spark.createDataFrame(
        [("A > Usage", "1"), ("B > Usage", "2"), (None, "3"), ("A > Only  Here", "4")], "section string, id string"
    )
    assert {r["key"]: r["id"] for r in unambiguous_index(s).collect()} == {
        "a > usage": "1", "b > usage": "2", "a > only here": "4", "only here": "4"
    }


def fact(i, statement, chunk, source="ast", score=0.5, rel="CALLS"):
    return (i, statement, chunk, rel, source, "s", "o", score)


FACTS = "ord int, statement string, chunk_id string, relationship string, source string, subject string, object string, score double"


def test_rank_puts_proven_first_within_a_band(spark):
    rows = [
        fact(0, "a", "1", "llm", 0.84), fact(1, "b", "2", "ast", 0.81), fact(2, "c", "3", "ast", 0.4),
        fact(3, "d", "4", "llm", -0.1), fact(4, "count", None, None, 0.0)
    ]
    got = facts.rank_facts(spark.createDataFrame(rows, FACTS), 2).orderBy("ord").collect()
    assert [r["statement"] for r in got] == ["b", "a", "count"]


def test_context_dedupes_statements_not_chunks(spark):
    f = spark.createDataFrame(
        [fact(0, "x calls y.", "1"), fact(1, "x calls z.", "1"), fact(2, "x calls y.", "2"), fact(3, "2 things.", None, None)],
        FACTS
    )
    p = spark.createDataFrame([("1", "cited already", 0), ("9", "new", 1)], "chunk_id string, text string, ord int")
    text = facts.assemble([tuple(r) for r in facts.context_lines(f, p, CODE).collect()])
    assert text.count("x calls y.") == 1 and "[1] (code) x calls z." in text and "cited already" not in text and text.endswith(
        "=== RETRIEVED PASSAGES ===\n[9] new"
    )
    assert facts.assemble([(2, 0, "[1] t")]) == "=== RETRIEVED PASSAGES ===\n[1] t"


def test_grading(spark):
    cases = [
        ("It raises MaxRetryError.", "RetryError", False, False), ("It is requests.exceptions.ReadTimeout!", "ReadTimeout", True, False), ("a read timeout", "Timeout", False, False), ("uses python 3 and a lib3", "3", False, False), ("there are 3 of them", "3", True, False),
        ("It does not raise Foo.", "Foo", True, True), ("It raises Foo. It is not clear what Foo does.", "Foo", True, False), ("no such word", "Foo", False, False),
    ]
    df = spark.createDataFrame(cases, "answer string, term string, s boolean, n boolean")
    for r in df.select(
        "*", grading.states(F.col("answer"), F.col("term")).alias("gs"), grading.negated(F.col("answer"), F.col("term")).alias("gn")
    ).collect():
        assert (r["gs"], r["gn"]) == (r["s"], r["n"]), r
    d = spark.createDataFrame([("This is not in the corpus.",), ("Not covered. However, it is 3.",), ("It is 3.",)], "a string")
    assert [r[0] for r in d.select(grading.is_refusal(F.col("a"))).collect()] == [True, False, False]
    c = spark.createDataFrame(
        [("A and B", ["A", "C"], ["B"]), ("x", None, None), ("A", ["A"], ["Z"])], "a string, m array<string>, e array<string>"
    )
    assert [r[0] for r in c.select(grading.credit(F.col("a"), F.col("m"), F.col("e"))).collect()] == [0.667, 1.0, 0.5]


def test_evaluation_statistics(spark):
    rows = [
        (r, q, "c", s, v, None, ms) for r, q, s, v, ms in [
            (1, "a", "h", "correct", 4), (1, "b", "h", "partial", 1), (2, "a", "h", "incorrect", 3), (2, "b", "h", "partial", 2),
            (1, "a", "k", "correct", 1), (1, "b", "k", "correct", 1), (2, "a", "k", "correct", 1), (2, "b", "k", "incorrect", 1)
        ]
    ]
    df = spark.createDataFrame(
        rows, "run int, id string, category string, system string, verdict string, credit double, latency_ms int"
    )
    s = {r["system"]: r for r in evals.summary(df).collect()}
    assert (s["h"]["accuracy"], s["h"]["partial"], s["h"]["score"], s["h"]["median_latency_ms"]) == (25.0, 50.0, 50.0, 3)
    d = {r["category"]: r for r in evals.paired_delta(df, "h", "k").collect()}
    assert (d["pooled"]["mean"], d["pooled"]["min"], d["pooled"]["max"]) == (-50.0, -50.0, -50.0)
    assert {(r["id"], r["system"]): r["bucket"] for r in evals.stability(df).collect()} == {
        ("a", "h"): "flipping", ("b", "h"): "never", ("a", "k"): "always", ("b", "k"): "flipping"
    }
    votes = spark.createDataFrame([("k", "x", 2), ("k", "y", 1), ("k", "y", 4), ("k", "x", 3)], "key string, v string, t int")
    assert evals.majority(votes, "key", "v", "t").first()["v"] == "y"


def test_pairs_generalise_upwards_only(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "a string, b string")
    up = spark.createDataFrame([("Sub.m", "Base.m")], "id string, ancestor string")
    got = hierarchy.compare_pairs(
        pairs([("f", "Sub.m"), ("f", "C.__init__"), ("f", "C.__eq__"), ("f", "p")]),
        pairs([("f", "Base.m"), ("f", "C"), ("f", "z")]), up, spark.createDataFrame([("p",)], "id string")
    ).first()
    assert (got["observed"], got["confirmed"], got["recall"], got["observed_precision"]) == (2, 2, 1.0, 0.667)
    none = hierarchy.compare_pairs(pairs([]), pairs([("a", "b")])).first()
    assert none["recall"] is None and none["observed_precision"] == 0.0


def test_closure_survives_cycles(spark):
    p = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "id string, parent string")
    assert hierarchy.closure(p).count() == 6


def test_nearest(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("z", [0.0, 0.0]), ("c", [2.0, 0.0])]
    t = spark.createDataFrame(rows, "chunk_id string, embedding array<float>")
    assert [(r["chunk_id"], r["dist"]) for r in vectors.nearest(t, [1.0, 0.0], 3).collect()] == [("a", 0.0), ("c", 0.0), ("b", 1.0)]
    many = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None), (4, [0.0, 0.0])], "vec_id long, embedding array<float>"
    )
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<float>")
    assert [r["vec_id"] for r in vectors.batch_nearest(many, q, 2, include_self=False).orderBy("rank").collect()] == [2, 4]


C = Candidate


@pytest.mark.parametrize(
    "plan, found, rule",
    [
        (RelatedBy("p", "CALLS"), (C("p", "Parameter"),), "R1"), (RelatedBy("c", "RAISES"), (C("c", "Class"),), "R2"), (WrapChain("f"), (C("f", "Function"),), "R3"), (RelatedBy("f", "WRAPS_EXCEPTION"), (C("f", "Function"),), "R4"),
        (WrapChain("m"), (C("m", "Module"), C("f", "Function")), "R5"), (RelatedBy("m", "INHERITS_FROM"), (C("m", "Module"),), "R6"), (CountRel("INHERITS_FROM"), (C("c", "Class"),), "R7"), (CountRel("CALLS"), (C("m", "Module"), C("m.n", "Module")), "R8"),
    ],
)
def test_repairs(plan, found, rule):
    new, reason = repair(plan, found)
    assert reason.startswith(rule + ":") and new != plan
    if rule == "R8":
        assert new == RelatedBy("m.n", "DEFINED_IN")


def test_no_repair_and_fallbacks():
    assert repair(RelatedBy("m", "DEFINED_IN"), (C("m", "Module"),)) == (RelatedBy("m", "DEFINED_IN"), None)
    assert fallbacks(WrapChain("c"), (C("c", "Class"),), lambda p: isinstance(p, WrapChain))[0] == RaisedByMembers("c")
    assert fallbacks(Neighbors("c"), (C("c", "Class"), C("p.m", "Module")), lambda p: True)[0] == RelatedBy("p.m", "DEFINED_IN")
    assert fallbacks(RelatedBy("c", "IMPLEMENTS"), (C("c", "Class"),), lambda p: True)[0] == RelatedBy("c", "DEFINED_IN")
    assert expansion(CallChain("f")) == (Hop("RAISES"), Hop("RETURNS")) and expansion(CountRel("CALLS")) == ()


def test_providers():
    assert settled_route("REFUSE", 0.5) == "BOTH" and settled_route("REFUSE", 0.9) == "REFUSE"
    assert mentions("What does the constructor of Session call in core.fetch?") == [
        "What", "Session", "core.fetch", "What.__init__", "Session.__init__"
    ]
    assert HashEmbedder(8).embed(["a b"]) == HashEmbedder(8).embed(["a b"]) and HashEmbedder(8).embed([""])[0] == [0.0] * 8


def test_chunkers():
    core = (LIB / "minilib/core.py").read_text()
    code = {c.section: c for c in code_chunks(core, "minilib.core")}
    assert code["minilib.core.HttpAdapter"].text.strip() == "class HttpAdapter(Adapter):" and '"""Send it."""' in code[
        "minilib.core.HttpAdapter.send"
    ].text
    assert code["minilib.core.HttpAdapter.send"].embed_text.endswith("Send it.")
    rst = list(rst_chunks((LIB / "docs/guide.rst").read_text()))
    assert [c.section for c in rst] == ["Guide", "Guide > Timeouts"] and "Left out" not in "".join(c.text for c in rst)
    md = list(markdown_chunks((LIB / "docs/notes.md").read_text(), "notes.md"))
    assert [c.section for c in md] == ["Notes", "Notes > Deeper"]
    assert next(iter(markdown_chunks("plain", "a/stem.md"))).section == "stem"
    assert [c.section for c in changelog_chunks((LIB / "CHANGES.rst").read_text())] == ["1.2.0", "1.1.0"]


@pytest.fixture(scope="module")
def built(spark):
    repo = files.detect_repo(str(LIB))
    assert (repo.name, repo.docs, repo.changelog) == ("minilib", "docs", "CHANGES.rst")
    return build_graph(files.python_files(spark, repo)) + (repo,)


def test_graph_of_a_source_tree(spark, built):
    g, chunks, repo = built
    edges = {(r["src"], r["rel"], r["dst"]) for r in g.edges.collect()}
    m = "minilib.core."
    expected = {
        (m + "HttpAdapter", "INHERITS_FROM", m + "Adapter"), ("minilib.errors.BaseError", "INHERITS_FROM", "builtins.IOError"), (m + "Session.get", "RAISES", "minilib.errors.BaseError"), (m + "Adapter.send", "RAISES", "builtins.NotImplementedError"),
        (m + "HttpAdapter.send", "RAISES", "minilib.errors.ReadError"), ("minilib.errors.ReadError", "WRAPS_EXCEPTION", "builtins.TimeoutError"), (m + "Session.get", "RETURNS", m + "Adapter"), (m + "HttpAdapter.__init__.retries", "STORED_ON", m + "HttpAdapter"),
        (m + "Session.get", "CALLS", m + "Adapter.send"), (m + "Session.get", "CALLS", m + "HttpAdapter.send"), (m + "outer", "CALLS", m + "fetch"), (m + "outer.url", "PASSES_TO", m + "fetch.url"), (m + "Session.get.timeout", "PASSES_TO", m + "Adapter.send.timeout"),
        (m + "Session.get", "HAS_PARAMETER", m + "Session.get.verify"), (m + "Session.get", "DEFINED_IN", m + "Session"), ("minilib", "IMPORTS", m + "Session"),
    }
    assert expected <= edges, expected - edges
    assert g.validate().edges.where("rel = 'CALLS' and source = 'override'").count() >= 1
    assert chunks.where("section = 'minilib.core.fetch'").count() == 1
    docs = chunk_files(files.doc_files(spark, repo), "doc")
    assert docs.select("section").distinct().count() == 4 and docs.where("length(chunk_id) <> 16").count() == 0


def test_replay(spark, built, tmp_path):
    log = tmp_path / "log.jsonl"
    log.write_text(
        '{"source_surface": "Session.get", "relationship": "DELEGATES_TO", "target_surface": "Adapter.send", "confidence": 0.9, "chunk_id": "d1"}\n{"source_surface": "x", "relationship": "EXPLAINS", "target_surface": "nothing", "chunk_id": "d2"}\n'
    )
    g = replay(built[0], files.model_edges(spark, str(log)))
    assert [
        (r["src"], r["dst"]) for r in g.edges.where("source = 'llm'").collect()
    ] == [("minilib.core.Session.get", "minilib.core.Adapter.send")]


def test_replay_by_section_release_and_concept(spark, built):
    g, code, repo = built
    chunks = code.unionByName(chunk_files(files.doc_files(spark, repo), "doc")).unionByName(
        chunk_files(files.changelog_file(spark, repo), "changelog")
    )
    g = ingest.with_structure(g, chunks)
    labels = {r["id"]: r["labels"] for r in g.nodes.where("id like 'doc:%' or id like 'minilib:%'").collect()}
    assert labels["minilib:1.2.0"] == ["Release"] and sum(v == ["DocSection"] for v in labels.values()) >= 4
    rows = [
        ("Session.get", "Function", "DOCUMENTED_IN", "guide >  Timeouts", "DocSection"), ("Adapter.send", "Function", "CHANGED_IN", "1.1.0", "Release"), ("Deeper", "DocSection", "EXPLAINS", "Connection Pool", "Concept"),
        ("Session.get", "Function", "DOCUMENTED_IN", "no such part", "DocSection"), ("Session.get", "Function", "OF_NO_KIND", "Deeper", "DocSection"),
    ]
    log = spark.createDataFrame(
        [(*r, 0.9, f"k{i}", None, None, None) for i, r in enumerate(rows)],
        "source_surface string, source_type string, relationship string, target_surface string, target_type string, confidence double, chunk_id string, resolved_source_id string, resolved_target_id string, skip_reason string"
    )
    told = {r["chunk_id"]: r for r in ingest.replayed(g, log, chunks).collect()}
    assert [told[f"k{i}"]["skip_reason"] for i in range(5)] == [None, None, None, "target", "relationship"]
    assert told["k1"]["dst"] == "minilib:1.1.0" and told["k2"]["dst"] == "connection-pool" and told["k2"]["src"].startswith("doc:") and told["k0"]["dst"].startswith("doc:")
    assert ingest.replay(g, log, chunks).edges.where("source = 'llm'").count() == 3


def test_docstrings_decide_between_parameters(spark):
    text = 'def f(url, **rest):\n    """:param url: where\n    :param dict rest: more"""\ndef g(**kw):\n    f("x", verify=kw)\n'
    rows = spark.createDataFrame(
        [("r", "r/m.py", "r.m", text), ("r", "r/__init__.py", "r", "from .m import f\n")],
        "repo string, path string, module string, text string"
    )
    public, documented = ingest.hints(rows)
    assert {r["id"] for r in public.collect()} == {"r.m.f"}
    assert {tuple(r) for r in documented.collect()} == {("r.m.f", "url"), ("r.m.f", "rest")}
    g, _ = build_graph(rows)
    flows = {(r["src"], r["dst"], r["source"]) for r in g.edges.where("rel = 'PASSES_TO'").collect()}
    assert flows == {("r.m.g.kw", "r.m.f.rest", "names")}


def test_chunks_are_upserted_by_id(spark):
    row = "chunk_id string, text string, embedding array<double>"
    old = spark.createDataFrame([("a", "old", [0.0, 1.0]), ("b", "old", [0.0, 1.0])], row)
    new = spark.createDataFrame([("b", "new", [1.0, 1.0]), ("c", "new", [1.0, 0.0])], row)
    assert {(r[0], r[1]) for r in ingest.upsert_chunks(old, new).collect()} == {("a", "old"), ("b", "new"), ("c", "new")}
    for bad in ([("d", "x", None)], [("d", "x", [1.0]), ("e", "x", [1.0, 2.0])]):
        with pytest.raises(ValueError, match="embeddings"):
            ingest.upsert_chunks(old, spark.createDataFrame(bad, row))


def test_command_line(spark, tmp_path, capsys):
    store = str(tmp_path / "store")
    cli.ingest(spark, store, [str(LIB)])
    once = cli.load(spark, store)
    assert {r[0] for r in once.chunks.select("kind").distinct().collect()} == {"code", "doc", "changelog"}
    counts = [once.graph.nodes.count(), once.graph.edges.count(), once.chunks.count()]
    cli.ingest(spark, store, [str(LIB)], keep=True)
    again = cli.load(spark, store)
    assert counts == [again.graph.nodes.count(), again.graph.edges.count(), again.chunks.count()]
    cli.status(spark, store)
    assert "changelog" in capsys.readouterr().out


class _Reader:
    """Readings that differ; most of them agree."""

    def __init__(self):
        self.n = 0

    def mentions(self, question):
        self.n += 1
        return [Mention("send", "minilib")] if self.n == 1 else [
            Mention("Adapter", "minilib"), Mention("Invented", "minilib"), Mention("session")
        ]


def test_mentions_are_voted_on_and_grounded():
    q = "What do Adapters of the session call, and Session.get?"
    assert [m.surface for m in read_mentions(q, _Reader())] == ["Adapter", "What", "Adapters", "Session.get"]
    assert grounded(
        "iter_content()", "does iter_contents stop?"
    ) and not grounded("Exception", "that exception's base") and not grounded("url", "the url")


def test_candidates_narrow_to_the_named_package(spark):
    nodes = spark.createDataFrame(
        [("one.a.send", ["Function"], {}), ("two.b.send", ["Function"], {})],
        "id string, labels array<string>, props map<string,string>"
    )
    g = PropertyGraph(
        nodes,
        spark.createDataFrame(
            [], "src string, rel string, dst string, chunk_id string, confidence double, source string, props map<string,string>"
        ),
        CODE
    )
    engine = Engine(g)
    assert {c.id for c in engine.candidates(["send"])} == {"one.a.send", "two.b.send"}
    assert [c.id for c in engine.candidates([Mention("send", "two")])] == ["two.b.send"]


def test_a_model_reads_docstrings(spark):
    class Model:
        def edges(self, text):
            if "bad" in text:
                raise ValueError("no")
            return [{"source_surface": text, "relationship": "EXPLAINS", "target_surface": "x", "confidence": 0.5}]

    text = 'class A:\n    """good one"""\n    def f(self, url):\n        """bad one"""\n        return {"at": url, "n": 1}\n'
    rows = spark.createDataFrame([("r", "r/m.py", "r.m", text)], "repo string, path string, module string, text string")
    docs, code = chunk_files(rows, "docstring"), chunk_files(rows, "code")
    assert {r["chunk_id"] for r in docs.collect()} == {r["chunk_id"] for r in code.collect()}
    log = {r["source_surface"]: r for r in ingest.read_edges(docs, Model()).collect()}
    assert log["good one"]["relationship"] == "EXPLAINS" and log[None]["skip_reason"] == "extraction: no"
    assert [(r["owner"], r["a"], r["b"]) for r in extract(rows).where("kind = 'returned'").collect()] == [("r.m.A.f", "at", "url")]


def test_evaluation_reports(spark, tmp_path, capsys):
    one = lambda v: {"verdict": v, "latency_ms": 5, "route": "BOTH"}
    for n, v in enumerate(("correct", "incorrect")):
        (tmp_path / f"run{n}.json").write_text(
            json.dumps({"results": [{"id": "q1", "category": "c", "hybrid": one("correct"), "baseline": one(v)}]})
        )
    evaluate.main(["--out", str(tmp_path / "out"), "summary", str(tmp_path / "run0.json"), str(tmp_path / "run1.json")])
    assert "flipping" in capsys.readouterr().out
    assert {r["bucket"] for r in spark.read.json(str(tmp_path / "out/stability")).collect()} == {"always", "flipping"}
    (tmp_path / "trace.json").write_text(
        json.dumps(
            {"calls": [["p.f", "p.C.g"], ["p.f", "p.C.prop"], ["q.x", "p.y"]], "raises": [], "wraps": [], "implicit": ["p.C.prop"]}
        )
    )
    edges = spark.createDataFrame(
        [("p.f", "CALLS", "p.C.g", "ast"), ("p.f", "CALLS", "p.z", None)], "src string, rel string, dst string, source string"
    )
    trace = str(tmp_path / "trace.json")
    got = evaluate.oracle(files.observed_pairs(spark, trace), edges, ("p",), files.implicit_callees(spark, trace))
    rates = {r["source"]: (r["observed"], r["in_graph"], r["confirmed"]) for r in got["rates"].collect()}
    assert rates == {"all": (1, 2, 1), "ast": (1, 1, 1), "llm": (1, 1, 0)}
    assert [(r["kind"], r["b"]) for r in got["unmatched"].collect()] == [("unconfirmed", "p.z")]
    (tmp_path / "q.json").write_text('[{"id": "q1", "category": "c", "question": "why?", "must_mention": ["a"]}]')
    assert files.questions(spark, str(tmp_path / "q.json")).first()["must_mention"] == ["a"]


def test_question_to_answer(spark, built):
    g, chunks, _ = built
    e = HashEmbedder(32)
    rows = [r.asDict() | {"embedding": e.embed([r["embed_text"]])[0]} for r in chunks.collect()]
    store = spark.createDataFrame(
        [tuple(r.values()) for r in rows],
        "chunk_id string, repo string, path string, section string, kind string, start_line int, end_line int, text string, embed_text string, embedding array<float>"
    )
    engine = Engine(g, store, embedder=e)
    got = engine.retrieve("Which classes inherit from minilib.errors.BaseError?")
    assert got.graph_error is None and got.plan == RelatedBy("minilib.errors.BaseError", "INHERITS_FROM")
    assert "ReadError inherits from minilib.errors.BaseError" in got.context and "2 things inherit from" in got.context
    answer = engine.answer("Which classes inherit from minilib.errors.BaseError?")
    assert answer["citations_valid"] is True
    plain = engine.baseline("Why is there a timeout?")
    assert plain["retrieval"].facts == [] and plain["retrieval"].passages


def test_routing_log(spark, tmp_path):
    rows = spark.createDataFrame(
        [
            (1, "2024-01-01 10:00:00", "q", "GRAPH", 0.5, 10, None, None),
            (2, "2024-01-01 11:00:00", "q", "GRAPH", 0.5, 20, None, None)
        ],
        "id long, ts string, question string, route string, confidence double, latency_ms int, template_id string, outcome string"
    )
    path = str(tmp_path / "log")
    append_decisions(rows, path)
    append_decisions(rows.limit(0), path)
    assert [(r["n"], r["mean"]) for r in rollup(read_decisions(spark, path)).collect()] == [(2, 15.0)]
    q = rollup(
        read_decisions(spark, path, streaming=True)
    ).writeStream.outputMode("complete").format("memory").queryName("roll").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("roll").first()["n"] == 2
