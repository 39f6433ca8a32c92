"""Grading of answers by checkable rules, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a declined answer says, what shows that it answers after all, and negations.
REFUSALS = (
    "outside the scope", "not in the corpus", "does not provide", "no supporting information", "cannot answer", "can't answer", "not covered", "unable to answer", "i don't know", "no information",
    "does not contain", "doesn't contain", "not contain information", "no relevant information", "does not include",
)
ANSWERED_ANYWAY = ("however", "```", "general knowledge", "that said", "here is how", "here's how")
NEGATORS = (
    "does not", "doesn't", "is not", "isn't", "no information", "not provide", "cannot", "can't", "never raises", "unable to"
)


def _any_of(text: Column, marks: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(text, m))


def is_refusal(answer: Column) -> Column:
    """Declines, and does not answer anyway."""
    low = F.lower(answer)
    return _any_of(low, REFUSALS) & ~_any_of(low, ANSWERED_ANYWAY)


def _quoted(term: Column) -> Column:
    return F.regexp_replace(term, r"([^A-Za-z0-9_\s])", r"\\$1")


def states(answer: Column, term: Column) -> Column:
    """Whether the term stands on its own: a capitalised one in its own case, digits as a count and
    not in a version, any other in any case."""
    name = lambda t: F.concat(F.lit("(?<![A-Za-z0-9_])"), _quoted(t), F.lit("(?![A-Za-z0-9_])"))
    count = F.concat(F.lit("(?<!python )(?<![A-Za-z0-9_./])"), term, F.lit("(?![A-Za-z0-9_./])"))
    low = F.lower(answer)
    capital = F.substring(term, 1, 1).rlike(r"\p{Lu}")
    return F.when(capital, F.regexp_like(answer, name(term))).when(
        term.rlike(r"^[0-9]+$"), F.regexp_like(low, count)
    ).otherwise(F.regexp_like(low, name(F.lower(term))))


def negated(answer: Column, term: Column) -> Column:
    """Whether every sentence with the term denies something; false where no sentence has it."""
    sentences = F.filter(
        F.split(F.replace(F.lower(answer), F.lit("\n"), F.lit(". ")), r"\."), lambda s: F.contains(s, F.lower(term))
    )
    return (F.size(sentences) > 0) & F.forall(sentences, lambda s: _any_of(s, NEGATORS))


def credit(answer: Column, must: Column, either: Column) -> Column:
    """Share of required slots filled, to 3 digits: each ``must`` term and, if any, the ``either`` list."""
    must, either = (F.coalesce(c, F.array().cast("array<string>")) for c in (must, either))
    said = lambda t: states(answer, t) & ~negated(answer, t)
    slots = F.size(must) + F.when(F.size(either) > 0, 1).otherwise(0)
    filled = F.size(F.filter(must, said)) + F.when(F.exists(either, said), 1).otherwise(0)
    return F.when(slots == 0, F.lit(1.0)).otherwise(F.round(filled / F.greatest(slots, F.lit(1)), 3))


def verdict(share: Column) -> Column:
    return F.when(share >= 1, "correct").when(share > 0, "partial").otherwise("incorrect")


def judged(n_facts: Column, n_missing: Column, contradicts: Column, declines: Column) -> Column:
    """Credit of a judge's report; a contradiction or a refusal earns none."""
    total = F.greatest(n_facts, F.lit(1))
    missing = F.least(n_missing, total)
    return F.when(declines | contradicts, F.lit(0.0)).otherwise(F.round(1 - missing / total, 3))
