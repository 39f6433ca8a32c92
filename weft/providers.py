"""What a language model or an embedder would supply, as protocols with deterministic offline defaults.

The defaults need no network and give the same answer every time; they are stand-ins for the seams,
not models, and their answers are not comparable with those of models.
"""

from __future__ import annotations

import hashlib
import math
import re
from typing import NamedTuple, Protocol

from .plans import CallChain, CountRel, Neighbors, Plan, RelatedBy
from .plans.rules import Candidate


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Router(Protocol):
    def route(self, question: str) -> tuple[str, float]: ...


class Planner(Protocol):
    def plan(self, question: str, candidates: tuple[Candidate, ...]) -> Plan | None: ...


class Synthesizer(Protocol):
    def answer(self, question: str, context: str) -> str: ...


class Mention(NamedTuple):
    """A name as a question writes it, and the package that it is said to be of."""

    surface: str
    package: str = "unknown"


class MentionReader(Protocol):
    def mentions(self, question: str) -> list[Mention]: ...


class Extractor(Protocol):
    """Reads edges out of prose: dicts with the columns of a logged edge, but for its chunk."""

    def edges(self, text: str) -> list[dict]: ...


class HashEmbedder:
    """A bag of words, each word hashed to a signed place; length 1."""

    def __init__(self, width: int = 64):
        self.width = width

    def _one(self, text: str) -> list[float]:
        v = [0.0] * self.width
        for w in re.findall(r"\w+", text.lower()):
            h = int.from_bytes(hashlib.sha1(w.encode()).digest()[:8], "big")
            v[h % self.width] += 1.0 if h >> 63 else -1.0
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v] if n else v

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]


#: A confidence below this asks both stores, whatever the route.
LEAST_CONFIDENCE = 0.6


def settled_route(route: str, confidence: float) -> str:
    if route not in ("GRAPH", "VECTOR", "BOTH", "REFUSE"):
        raise ValueError(f"unknown route {route!r}")
    return route if confidence >= LEAST_CONFIDENCE else "BOTH"


class RuleRouter:
    """Structure words ask the graph, *why* and *how do* the text, anything else both."""

    def route(self, question: str) -> tuple[str, float]:
        q = question.lower()
        if re.search(r"\b(how many|which|inherits?|calls?|raises?|defined|supplies|contains)\b", q):
            return "GRAPH", 0.8
        if re.search(r"\b(why|explain|how do)\b", q):
            return "VECTOR", 0.8
        return "BOTH", 0.5


# Lower-case words that name no entity.
GENERIC_WORDS = frozenset({
    "exception", "exceptions", "error", "errors", "function", "functions", "method",
    "methods", "class", "classes", "module", "modules", "library", "libraries",
    "parameter", "parameters", "adapter", "adapters", "connection", "connections",
    "response", "body", "header", "headers", "url", "urls",
    "session", "sessions", "socket", "redirect", "redirects", "retries", "retry",
})


def grounded(surface: str, question: str) -> bool:
    """Whether a question has a surface: with its capital if it has one, in singular or plural, call brackets left out."""
    name = surface.strip().removesuffix("()")
    if not name[:1].isupper():
        name, question = name.lower(), question.lower()
        if name in GENERIC_WORDS:
            return False
    return bool(name) and any(form in question for form in {name, name.removesuffix("s"), name.removesuffix("es")})


def read_mentions(question: str, reader: MentionReader | None = None, votes: int = 3) -> list[Mention]:
    """What a reader finds in most of ``votes`` readings and the question has, then the names that can be read off the text.

    Of readings that are as frequent the one seen first counts.
    """
    kept: list[Mention] = []
    if reader is not None:
        readings: dict[frozenset, tuple[int, list[Mention]]] = {}
        for _ in range(votes):
            found = reader.mentions(question)
            n, first = readings.get(frozenset(found), (0, found))
            readings[frozenset(found)] = (n + 1, first)
        kept = [m for m in max(readings.values(), key=lambda r: r[0])[1] if grounded(m.surface, question)]
    have = {m.surface for m in kept}
    return kept + [Mention(s) for s in mentions(question) if s not in have]


def mentions(question: str) -> list[str]:
    """Dotted names and capitalised words that a question names, in order, once; *constructor* adds ``__init__``."""
    found = list(dict.fromkeys(re.findall(r"[A-Za-z_][\w]*(?:\.[A-Za-z_]\w*)+|\b[A-Z]\w+\b", question)))
    if "constructor" in question.lower():
        found += [f"{m}.__init__" for m in list(found) if m.rsplit(".", 1)[-1][:1].isupper()]
    return found


class RulePlanner:
    """The relationship whose phrase the question has, on the first candidate."""

    def __init__(self, ontology):
        self.ontology = ontology

    def plan(self, question: str, candidates: tuple[Candidate, ...]) -> Plan | None:
        q = question.lower()
        words = {k: set(re.findall(r"[a-z]{4,}", r.phrase)) for k, r in self.ontology.relationships.items()}
        stems = {w[:5] for w in re.findall(r"[a-z]{4,}", q)}
        rel = next((k for k, ws in words.items() if ws and {w[:5] for w in ws} <= stems), None)
        if not candidates:
            return CountRel(rel) if rel and "how many" in q else None
        first = candidates[0].id
        if "CALLS" in self.ontology.relationships and re.search(r"\b(ultimately|underneath|hand off)\b", q):
            return CallChain(first)
        return RelatedBy(first, rel) if rel else Neighbors(first)


class ExtractiveSynthesizer:
    """The first cited lines of the context, with their citations."""

    def answer(self, question: str, context: str) -> str:
        lines = [x for x in context.splitlines() if x.startswith("[")][:3]
        return "\n".join(lines) if lines else "The context does not contain information on this."
