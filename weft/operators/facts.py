"""From template rows to cited statements, ranked, deduplicated and assembled into a context.

A fact has ``ord`` (its place), statement, chunk_id (null: derived, cites nothing), relationship,
source, subject and object.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..ontology import Ontology, plural

PROVEN = ("ast", "jedi", "override")
FACT = ("statement", "chunk_id", "relationship", "source", "subject", "object")


def provenance(source: Column) -> Column:
    """``(code)`` for what a parser proved, ``(docs)`` for what a model read, else empty."""
    return F.when(source.isin(*PROVEN), "(code)").when(source == "llm", "(docs)").otherwise("")


def phrase(ontology: Ontology, rel: Column, subject_labels: Column, object_labels: Column) -> Column:
    """The verb of an edge, made exact by what it joins."""
    out = F.create_map(*[x for k, r in ontology.relationships.items() for x in (F.lit(k), F.lit(r.phrase))])[rel]
    for name, sub, obj, text in reversed(ontology.exact_phrases):
        fits = (rel == name) & F.array_contains(subject_labels, sub)
        if obj:
            fits = fits & F.array_contains(object_labels, obj)
        out = F.when(F.coalesce(fits, F.lit(False)), text).otherwise(out)
    return out


def neighbor_facts(rows: DataFrame, entity_id: str, ontology: Ontology) -> DataFrame:
    """A statement for each neighbour row, with the true source of its edge as subject."""
    me = F.lit(entity_id)
    sub, obj = F.when(F.col("outgoing"), me).otherwise(F.col("neighbor")), F.when(
        F.col("outgoing"), F.col("neighbor")
    ).otherwise(me)
    sl = F.when(F.col("outgoing"), F.col("entity_labels")).otherwise(F.col("neighbor_labels"))
    ol = F.when(F.col("outgoing"), F.col("neighbor_labels")).otherwise(F.col("entity_labels"))
    text = F.concat(sub, F.lit(" "), phrase(ontology, F.col("relationship"), sl, ol), F.lit(" "), obj, F.lit("."))
    return rows.select(text.alias("statement"), "chunk_id", "relationship", "source", sub.alias("subject"), obj.alias("object"))


def edge_facts(rows: DataFrame, rel: str, ontology: Ontology) -> DataFrame:
    text = F.concat(
        "entity", F.lit(" "), phrase(ontology, F.lit(rel), F.col("entity_labels"), F.col("neighbor_labels")), F.lit(" "),
        "neighbor", F.lit(".")
    )
    return rows.select(
        text.alias("statement"), "chunk_id", F.lit(rel).alias("relationship"), "source", F.col("entity").alias("subject"),
        F.col("neighbor").alias("object")
    )


def path_facts(paths: DataFrame, default_rel: str, ontology: Ontology) -> DataFrame:
    """*A calls B, which calls C.* for each maximal simple path; it is as proven as its weakest hop."""
    from .paths import maximal

    verbs = F.create_map(*[x for k, r in ontology.relationships.items() for x in (F.lit(k), F.lit(r.phrase))])
    rows = maximal(paths.where(F.size(F.array_distinct("chain")) == F.size("chain")))
    said = F.transform("rels", lambda r: F.coalesce(verbs[r], F.lit(ontology.relationships[default_rel].phrase)))
    head = F.concat(F.col("chain")[0], F.lit(" "), F.col("said")[0], F.lit(" "), F.col("chain")[1])
    tail = F.array_join(F.expr("transform(slice(said, 2, size(said)), (v, i) -> concat(', which ', v, ' ', chain[i + 2]))"), "")
    source = F.when(F.array_contains("sources", "llm"), "llm").otherwise(F.get("sources", F.lit(0)))
    return rows.withColumn("said", said).select(
        F.concat(head, tail, F.lit(".")).alias("statement"), F.col("chunk_ids")[0].alias("chunk_id"),
        F.col("rels")[0].alias("relationship"), source.alias("source"), F.col("chain")[0].alias("subject"),
        F.element_at("chain", -1).alias("object")
    )


def count_facts(rows: DataFrame, entity_id: str, rel: str, ontology: Ontology) -> DataFrame:
    """How many neighbours each way: the incoming line always, the outgoing one if there is any."""
    verb = ontology.relationships[rel].phrase
    n = rows.agg(F.count_if(~F.col("outgoing")).alias("into"), F.count_if("outgoing").alias("out"))
    into = F.concat(F.col("into").cast("string"), F.lit(f" things {plural(verb)} {entity_id}."))
    out = F.concat(
        F.lit(f"{entity_id} {verb} "), F.col("out").cast("string"), F.when(F.col("out") == 1, " thing.").otherwise(" things.")
    )
    lines = n.select(F.explode(F.array_compact(F.array(into, F.when(F.col("out") > 0, out)))).alias("statement"))
    return _derived(lines, rel)


def _derived(lines: DataFrame, rel: str | None) -> DataFrame:
    none = F.lit(None).cast("string")
    return lines.select(
        "statement", none.alias("chunk_id"), F.lit(rel).cast("string").alias("relationship"), none.alias("source"),
        none.alias("subject"), none.alias("object")
    )


def kind_of(ontology: Ontology, labels: Column) -> Column:
    out = F.lit(None).cast("string")
    for label, noun in reversed(ontology.kinds):
        out = F.when(F.array_contains(labels, label), noun).otherwise(out)
    return out


def listings(rows: DataFrame, entity_id: str, rel: str, ontology: Ontology) -> DataFrame:
    """``kind, n, statement``: a line per kind of incoming neighbour that names them all."""
    named = rows.where(~F.col("outgoing")).select(
        kind_of(ontology, F.col("neighbor_labels")).alias("kind"), F.substring_index("neighbor", ".", -1).alias("leaf")
    ).where("kind is not null")
    groups = named.groupBy("kind").agg(F.array_sort(F.collect_set("leaf")).alias("names"))
    text = F.concat(
        F.size("names").cast("string"), F.lit(" "), "kind", F.lit(f" {plural(ontology.relationships[rel].phrase)} {entity_id}: "),
        F.array_join("names", ", "), F.lit(".")
    )
    return groups.select("kind", F.size("names").cast("long").alias("n"), text.alias("statement"))


def numbered(facts: DataFrame, *order: str | Column) -> DataFrame:
    """``facts`` with ``ord`` by a total order; facts of one question are few."""
    return facts.withColumn("ord", F.row_number().over(Window.orderBy(*order)))


def rank_facts(facts: DataFrame, k: int = 8, min_score: float = 0.0) -> DataFrame:
    """The k best of the cited facts, then all derived ones, with a new ``ord``.

    ``facts`` has ``score``. Better is: the higher score rounded to one digit, what a parser proved,
    the higher score, the earlier place.
    """
    cited = facts.where(F.col("chunk_id").isNotNull() & (F.col("score") >= min_score))
    proven = F.when(F.col("source").isin(*PROVEN), 0).otherwise(1)
    best = cited.orderBy(F.round("score", 1).desc(), proven, F.col("score").desc(), "ord").limit(k)
    place = Window.orderBy(F.round("score", 1).desc(), proven, F.col("score").desc(), "ord")
    best = best.withColumn("ord", F.row_number().over(place))
    derived = facts.where("chunk_id is null").withColumn("ord", F.lit(k) + F.row_number().over(Window.orderBy("ord")))
    return best.unionByName(derived)


def dedupe_statements(facts: DataFrame) -> DataFrame:
    """The first fact of each statement; the same chunk may back many statements."""
    first = facts.groupBy("statement").agg(F.min_by(F.struct(*[c for c in facts.columns if c != "statement"]), "ord").alias("f"))
    return first.select("statement", "f.*").select(*facts.columns)


def passages_left(passages: DataFrame, facts: DataFrame) -> DataFrame:
    """Passages whose chunk no fact cites."""
    return passages.join(facts.where("chunk_id is not null").select("chunk_id").distinct(), "chunk_id", "left_anti")


def legend(facts: DataFrame) -> DataFrame:
    """``relationship, first``: relationships in order of their first fact."""
    return facts.where("relationship is not null").groupBy("relationship").agg(F.min("ord").cast("long").alias("first"))


HEAD_FACTS, HEAD_PASSAGES = "=== GRAPH RELATIONSHIPS ===", "=== RETRIEVED PASSAGES ==="


def context_lines(facts: DataFrame, passages: DataFrame, ontology: Ontology) -> DataFrame:
    """``section, ord, text`` of the context: legend, facts, passages; an empty section has no row.

    ``facts`` has ``ord``; ``passages`` has chunk_id, text and ``ord``.
    """
    facts = dedupe_statements(facts)
    tag = provenance(F.col("source"))
    body = F.when(tag != "", F.concat(tag, F.lit(" "), "statement")).otherwise(F.col("statement"))
    line = F.when(F.col("chunk_id").isNotNull(), F.concat(F.lit("["), "chunk_id", F.lit("] "), body)).otherwise(body)
    means = F.create_map(*[x for k, r in ontology.relationships.items() for x in (F.lit(k), F.lit(r.meaning))])
    shown = legend(facts).select(
        F.lit(0).alias("section"), F.col("first").alias("ord"),
        F.concat(F.lit("- "), "relationship", F.lit(": "), means[F.col("relationship")]).alias("text")
    )
    left = passages_left(passages, facts)
    return shown.unionAll(facts.select(F.lit(1), F.col("ord").cast("long"), line)).unionAll(
        left.select(F.lit(2), F.col("ord").cast("long"), F.concat(F.lit("["), "chunk_id", F.lit("] "), "text"))
    )


def assemble(lines: list[tuple[int, int, str]]) -> str:
    """The context's text from its few lines."""
    parts = {k: [t for s, _, t in sorted(lines) if s == k] for k in (0, 1, 2)}
    out = []
    if parts[1]:
        means = "Relationship meanings:\n" + "\n".join(parts[0]) + "\n\n" if parts[0] else ""
        out.append(means + HEAD_FACTS + "\n" + "\n".join(parts[1]))
    if parts[2]:
        out.append(HEAD_PASSAGES + "\n" + "\n".join(parts[2]))
    return "\n\n".join(out)


def citations(answer: Column) -> Column:
    """Distinct bracketed ids of an answer."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[([A-Za-z0-9_:.#/-]+)\]"), F.lit(1)))


def citations_valid(answer: Column, retrieved: Column) -> Column:
    """At least one citation, and none of an id that was not retrieved."""
    c = citations(answer)
    return (F.size(c) > 0) & (F.size(F.array_except(c, retrieved)) == 0)
