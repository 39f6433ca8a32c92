"""From a question to a cited answer: route, candidates, plan, repair, run, fall back, rank, expand, assemble."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import PropertyGraph
from .operators import facts, hierarchy, vectors
from .operators.resolve import resolve
from .plans import CallChain, CountRel, DocsFor, EdgesFrom, EdgesTo, FlowOfName, Neighbors, PathBetween, Plan, PlanError, RaisedByMembers, RelatedBy, WrapChain
from .plans.rules import Candidate, expansion, fallbacks, repair
from .plans.templates import compile_plan
from .providers import Embedder, ExtractiveSynthesizer, HashEmbedder, Mention, MentionReader, Planner, Router, RulePlanner, RuleRouter, Synthesizer, read_mentions, settled_route


@dataclass
class Retrieval:
    route: str
    confidence: float
    refused: bool = False
    plan: Plan | None = None
    plan_repair: str | None = None
    candidates: tuple[Candidate, ...] = ()
    facts: list[dict] = field(default_factory=list)
    passages: list[dict] = field(default_factory=list)
    context: str = ""
    retrieved_ids: frozenset[str] = frozenset()
    graph_error: str | None = None
    expanded: int = 0
    latency_ms: int = 0


def verbalize(plan: Plan, rows: DataFrame, g: PropertyGraph) -> DataFrame:
    """Facts of a plan's rows, without ``ord``."""
    o = g.ontology
    match plan:
        case Neighbors():
            return facts.neighbor_facts(rows, plan.entity_id, o)
        case RelatedBy():
            stated = facts.neighbor_facts(rows, plan.entity_id, o)
            listed = facts.listings(rows, plan.entity_id, plan.rel, o).select(
                "statement", *[F.lit(None).cast("string").alias(c) for c in facts.FACT[1:]]
            )
            return stated.unionByName(facts.count_facts(rows, plan.entity_id, plan.rel, o)).unionByName(listed)
        case WrapChain() | CallChain() | PathBetween():
            if isinstance(plan, CallChain):
                return facts.path_facts(rows, plan.rels[0], o)
            hops = rows if "rels" in rows.columns else rows.withColumn("rels", F.transform("starts", lambda s: F.lit(plan.rel)))
            if isinstance(plan, WrapChain):
                from .operators.paths import collapsed

                edges = collapsed(hops).select(
                    F.col("src").alias("entity"), F.col("dst").alias("neighbor"), "chunk_id", "source",
                    F.array().cast("array<string>").alias("entity_labels"), F.array().cast("array<string>").alias("neighbor_labels")
                )
                return facts.edge_facts(edges, plan.rel, o)
            text = F.concat(F.lit("A shortest connection: "), F.array_join("chain", " - "), F.lit("."))
            return rows.select(text.alias("statement"), *[F.lit(None).cast("string").alias(c) for c in facts.FACT[1:]])
        case CountRel():
            text = F.concat(F.lit("There are "), F.col("count").cast("string"), F.lit(f" {plan.rel} relationships."))
            return rows.select(
                text.alias("statement"), F.lit(None).cast("string").alias("chunk_id"), F.lit(plan.rel).alias("relationship"),
                *[F.lit(None).cast("string").alias(c) for c in facts.FACT[3:]]
            )
        case DocsFor():
            text = F.concat(F.lit(f"{plan.entity_id} {o.relationships[plan.rel].phrase} "), "doc_section", F.lit("."))
            return rows.select(
                text.alias("statement"), "chunk_id", F.lit(plan.rel).alias("relationship"), F.lit("llm").alias("source"),
                F.lit(plan.entity_id).alias("subject"), F.col("doc_section").alias("object")
            )
    return facts.edge_facts(rows, plan.rel, o)


def _rows(df: DataFrame) -> list[dict]:
    """All rows of one question's result. None is left out: past ``spark.driver.maxResultSize`` Spark fails instead."""
    return [r.asDict() for r in df.collect()]


class Engine:
    """A graph and a chunk table with the providers that read questions."""

    def __init__(
        self, graph: PropertyGraph, chunks: DataFrame | None = None, aliases: DataFrame | None = None,
        embedder: Embedder | None = None, router: Router | None = None, planner: Planner | None = None,
        synthesizer: Synthesizer | None = None, reader: MentionReader | None = None
    ):
        self.graph, self.chunks, self.aliases = graph, chunks, aliases
        self.embedder, self.router = embedder or HashEmbedder(), router or RuleRouter()
        self.planner, self.synthesizer = planner or RulePlanner(graph.ontology), synthesizer or ExtractiveSynthesizer()
        self.spark, self.reader = graph.nodes.sparkSession, reader

    def passages(self, question: str, k: int = 5) -> list[dict]:
        if self.chunks is None:
            return []
        near = vectors.nearest(self.chunks, self.embedder.embed([question])[0], k)
        return _rows(near.select("chunk_id", "repo", "path", "section", "kind", "text", "dist").orderBy("dist", "chunk_id"))

    def candidates(self, named: list[str | Mention]) -> tuple[Candidate, ...]:
        """Resolved names with their kinds; parameters go where the same name is also something else, and of
        several candidates those outside the package that the question names, if any is inside."""
        named = [m if isinstance(m, Mention) else Mention(m) for m in named]
        names, package = [m.surface for m in named], {m.surface: m.package for m in named}
        if not names:
            return ()
        asked = self.spark.createDataFrame([(n, None, None) for n in names], "surface string, module string, cls string")
        found = resolve(asked, self.graph.nodes.select("id"), self.aliases)
        ids = found.select(
            "surface",
            F.explode(F.when(F.col("canonical_id").isNotNull(), F.array("canonical_id")).otherwise(F.col("candidates"))).alias("id")
        )
        known = self.graph.describe(ids.select("id"))
        rows = _rows(ids.join(known, "id"))
        inside = {r["surface"] for r in rows if r["id"].startswith(package[r["surface"]] + ".")}
        rows = [r for r in rows if r["surface"] not in inside or r["id"].startswith(package[r["surface"]] + ".")]
        kept = [
            r for r in rows if "Parameter" not in r["labels"] or not any(
                o["surface"] == r["surface"] and "Parameter" not in o["labels"] for o in rows
            )
        ]
        place = {n: i for i, n in enumerate(names)}
        kept.sort(key=lambda r: (place[r["surface"]], -r["degree"], r["id"]))
        seen = dict.fromkeys(r["id"] for r in kept)
        by = {r["id"]: r for r in kept}
        return tuple(Candidate(i, "/".join(by[i]["labels"]), by[i]["degree"]) for i in seen)

    def _facts(self, question: str, plan: Plan, rows: DataFrame, k: int) -> list[dict]:
        """The facts of a plan in a fixed order; of a plan whose rows are not the answer, the ``k`` most like the question.

        Statements are scored where they are; an embedder has to be picklable.
        """
        order = (F.col("chunk_id").isNull().alias("derived"), "statement", "chunk_id")
        stated = verbalize(plan, rows, self.graph)
        if not plan.capped:
            return _rows(stated.orderBy(*order))
        asked, embedder = self.embedder.embed([question])[0], self.embedder

        @F.pandas_udf("double")
        def alike(statements: pd.Series) -> pd.Series:
            return pd.Series(
                [sum(a * b for a, b in zip(asked, v, strict=True)) for v in embedder.embed(statements.tolist())], dtype="float64"
            )

        scored = stated.withColumn("score", alike("statement")).withColumn("ord", F.struct(*order))
        return _rows(facts.rank_facts(scored, k).orderBy("ord"))

    def _expand(self, plan: Plan, found: list[dict]) -> list[dict]:
        """Further hops from the nodes of the facts that were kept; what is stated is not fetched again."""
        kinds = {c.id: c for c in self._candidates}
        parameter = isinstance(plan, Neighbors) and plan.entity_id in kinds and kinds[plan.entity_id].has("Parameter")
        nodes = sorted({x for f in found for x in (f["subject"], f["object"]) if x})
        more: list[dict] = []
        if parameter:
            flow = FlowOfName(plan.entity_id.rsplit(".", 1)[-1])
            rows = _rows(facts.edge_facts(compile_plan(flow, self.graph), flow.rel, self.graph.ontology))
            more += rows
            nodes = sorted({r["object"] for r in rows}) or nodes
        added: list[str] = []
        for hop in expansion(plan, parameter):
            if hop.rel not in self.graph.ontology.relationships:
                continue
            start = tuple(added) if hop.follow else (plan.entity_id,) if hop.incoming else tuple(nodes)
            if not start:
                continue
            step = EdgesTo(start, hop.rel) if hop.incoming else EdgesFrom(start, hop.rel)
            rows = _rows(
                facts.edge_facts(compile_plan(step, self.graph), hop.rel, self.graph.ontology).orderBy("statement", "chunk_id")
            )
            stated = {f["statement"] for f in found + more}
            rows = [r for r in rows if r["statement"] not in stated]
            more += rows
            added = sorted({r["object"] for r in rows})
        return more

    def retrieve(self, question: str, k: int = 5, facts_kept: int = 8, graph: bool = True) -> Retrieval:
        began = time.perf_counter()
        route, confidence = self.router.route(question)
        out = Retrieval(settled_route(route, confidence), confidence)
        if out.route == "REFUSE":
            out.refused = True
            return out
        if out.route != "GRAPH" or not graph:
            out.passages = self.passages(question, k)
        if graph and out.route != "VECTOR":
            try:
                self._graph(question, out, k, facts_kept)
            except (PlanError, ValueError) as e:
                out.graph_error = str(e)
        self._assemble(out)
        out.latency_ms = round((time.perf_counter() - began) * 1000)
        return out

    def _graph(self, question: str, out: Retrieval, k: int, facts_kept: int) -> None:
        found = self.candidates(read_mentions(question, self.reader))
        if not found or all(c.has("Module") for c in found):
            deep = [p for p in self.passages(question, max(k, 5) * 4) if p["kind"] == "code" and p["section"]]
            seeds = [p["section"] for p in deep if p["section"] not in {c.id for c in found}][:3]
            found += self.candidates(seeds)
        out.candidates = self._candidates = found
        plan = self.planner.plan(question, found)
        if plan is None:
            return
        plan, out.plan_repair = repair(plan, found)
        known = frozenset(c.id for c in found)
        plan.validate(self.graph.ontology, known, frozenset(c.id.split(".")[0] for c in found))
        plan, reason = fallbacks(plan, found, lambda p: compile_plan(p, self.graph).isEmpty())
        out.plan, out.plan_repair = plan, reason or out.plan_repair
        out.facts = self._facts(question, plan, compile_plan(plan, self.graph), facts_kept)
        more = self._expand(plan, out.facts)
        out.expanded = len(more)
        out.facts += more
        if isinstance(plan, RelatedBy) and plan.rel == "DEFINED_IN" and "INHERITS_FROM" in self.graph.ontology.relationships:
            out.facts += self._members(out.facts)

    def _members(self, found: list[dict]) -> list[dict]:
        """Derived lines: members by base, and how many have several bases."""
        members = [(f["subject"],) for f in found if f["relationship"] == "DEFINED_IN" and f["chunk_id"] and f["subject"]]
        parents = [(f["subject"], f["object"]) for f in found if f["relationship"] == "INHERITS_FROM"]
        if not members or not parents:
            return []
        m, p = self.spark.createDataFrame(members, "id string"), self.spark.createDataFrame(parents, "id string, parent string")
        by = _rows(hierarchy.member_summary(m, p).orderBy("base"))
        if not by:
            return []
        several = sorted(r["id"].rsplit(".", 1)[-1] for r in _rows(hierarchy.multi_base(m, p)))
        warned = hierarchy.closure(p).where(F.col("ancestor").rlike(r"Warning$")).join(m, "id", "left_semi").select("id").distinct()
        warnings = sorted(r["id"].rsplit(".", 1)[-1] for r in _rows(warned))
        lines = ["Members by base class: " + "; ".join(f"{r['base'].rsplit('.', 1)[-1]}: {r['names']}" for r in by) + "."]
        if warnings:
            lines.append(f"{len(warnings)} members are warning classes: {', '.join(warnings)}.")
        lines.append(
            f"{len(several)} members have more than one base class: {', '.join(several)}." if several else "No member has more than one base class."
        )
        return [dict.fromkeys(facts.FACT) | {"statement": t} for t in lines]

    def _assemble(self, out: Retrieval) -> None:
        f = self.spark.createDataFrame(
            [tuple(r[c] for c in facts.FACT) + (i,) for i, r in enumerate(out.facts)],
            ", ".join(f"{c} string" for c in facts.FACT) + ", ord int"
        )
        p = self.spark.createDataFrame(
            [(r["chunk_id"], r["text"], i) for i, r in enumerate(out.passages)], "chunk_id string, text string, ord int"
        )
        lines = [(r["section"], r["ord"], r["text"]) for r in facts.context_lines(f, p, self.graph.ontology).collect()]
        out.context = facts.assemble(lines)
        out.retrieved_ids = frozenset([r["chunk_id"] for r in out.facts if r["chunk_id"]] + [r["chunk_id"] for r in out.passages])

    def answer(self, question: str, **options) -> dict:
        """The answer with its citations; declined where there is no context or the route refuses."""
        got = self.retrieve(question, **options)
        if got.refused or not got.context:
            return {"answer": "The question is outside the scope of the corpus.", "citations_valid": None, "retrieval": got}
        text = self.synthesizer.answer(question, got.context)
        row = self.spark.createDataFrame([(text, sorted(got.retrieved_ids))], "a string, ids array<string>")
        valid = row.select(facts.citations_valid(F.col("a"), F.col("ids"))).first()[0]
        return {"answer": text, "citations_valid": valid, "retrieval": got}

    def baseline(self, question: str, **options) -> dict:
        """The same with passages only."""
        return self.answer(question, graph=False, **options)
