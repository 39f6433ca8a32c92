"""Repairs of plans that the graph can't answer, fallbacks for empty ones, and what is fetched next.

Rules are data: a condition on the plan and on what its anchors are, a rewrite, and the reason that
is recorded with the result. The first rule that fits is applied, once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from . import CallChain, CountRel, Neighbors, Plan, RaisedByMembers, RelatedBy, WrapChain


@dataclass(frozen=True)
class Candidate:
    """A resolved id with its labels joined by ``/`` and its degree."""

    id: str
    kind: str
    degree: int = 0

    def has(self, label: str) -> bool:
        return label in self.kind.split("/")


@dataclass(frozen=True)
class Case:
    """A plan together with the candidates of its question."""

    plan: Plan
    candidates: tuple[Candidate, ...]

    @property
    def anchor(self) -> str | None:
        return getattr(self.plan, "entity_id", None)

    def anchored_on(self, label: str) -> bool:
        return any(c.id == self.anchor and c.has(label) for c in self.candidates)

    def where(self, keep: Callable[[Candidate], bool]) -> list[Candidate]:
        return [c for c in self.candidates if keep(c)]

    @property
    def modules(self) -> list[Candidate]:
        return self.where(lambda c: c.has("Module"))

    @property
    def others(self) -> list[Candidate]:
        return self.where(lambda c: not c.has("Module"))

    @property
    def specific(self) -> list[Candidate]:
        return self.where(lambda c: not c.has("Module") and not c.has("Parameter"))


@dataclass(frozen=True)
class Rule:
    name: str
    when: Callable[[Case], bool]
    rewrite: Callable[[Case], Plan]
    reason: Callable[[Case], str]


def _related(case: Case, rel: str) -> bool:
    return isinstance(case.plan, RelatedBy) and case.plan.rel == rel


def _start_elsewhere(case: Case) -> Plan:
    other = case.specific[0]
    return RelatedBy(other.id, "RAISES") if other.has("Function") else WrapChain(other.id, case.plan.max_hops)


def _longest(modules: list[Candidate]) -> Candidate:
    return max(modules, key=lambda c: len(c.id))


#: Relationships that a module can have.
OF_MODULES = frozenset({"DEFINED_IN", "IMPORTS"})

REPAIRS = (
    Rule("R1", lambda c: c.anchored_on("Parameter") and not isinstance(c.plan, Neighbors), lambda c: Neighbors(c.anchor), lambda c: "a parameter is answered by its neighbourhood"),
    Rule("R2", lambda c: c.anchored_on("Class") and _related(c, "RAISES"), lambda c: RaisedByMembers(c.anchor), lambda c: "methods raise, not classes: what the members raise"),
    Rule("R3", lambda c: c.anchored_on("Function") and isinstance(c.plan, WrapChain), lambda c: RelatedBy(c.anchor, "RAISES"), lambda c: "a function starts no wrap chain: what it raises"),
    Rule("R4", lambda c: c.anchored_on("Function") and _related(c, "WRAPS_EXCEPTION"), lambda c: RelatedBy(c.anchor, "RAISES"), lambda c: "a function wraps nothing: what it raises"),
    Rule("R5", lambda c: c.anchored_on("Module") and isinstance(c.plan, WrapChain) and bool(c.specific), _start_elsewhere, lambda c: f"a module starts no wrap chain: {c.specific[0].id} does"),
    Rule("R6", lambda c: c.anchored_on("Module") and isinstance(c.plan, RelatedBy) and c.plan.rel not in OF_MODULES, lambda c: RelatedBy(c.anchor, "DEFINED_IN"), lambda c: f"a module has no {c.plan.rel}: its members"),
    Rule("R7", lambda c: isinstance(c.plan, CountRel) and not c.modules and len(c.others) == 1 and c.others[0].has("Class"), lambda c: RelatedBy(c.others[0].id, c.plan.rel), lambda c: "one class is named: its own edges are counted"),
    Rule("R8", lambda c: isinstance(c.plan, CountRel) and bool(c.modules) and (len(c.modules) == 1 or not c.others), lambda c: RelatedBy(_longest(c.modules).id, "DEFINED_IN"), lambda c: "a module is named: its members are counted"),
)


def repair(plan: Plan, candidates: tuple[Candidate, ...]) -> tuple[Plan, str | None]:
    case = Case(plan, tuple(candidates))
    for rule in REPAIRS:
        if rule.when(case):
            return rule.rewrite(case), f"{rule.name}: {rule.reason(case)}"
    return plan, None


def _dotted(case: Case) -> list[Candidate]:
    return [c for c in case.modules if "." in c.id]


def _is_members_of(plan: Plan, id_: str) -> bool:
    return isinstance(plan, RelatedBy) and plan.rel == "DEFINED_IN" and plan.entity_id == id_


#: Tried in this order, each on an empty result of the plan before; F2 and F3 exclude one another.
FALLBACKS = (
    Rule("F1", lambda c: isinstance(c.plan, WrapChain) and c.anchored_on("Class"), lambda c: RaisedByMembers(c.anchor), lambda c: "the wrap chain is empty: what the members raise"),
    Rule("F2", lambda c: bool(_dotted(c)) and not _is_members_of(c.plan, _longest(_dotted(c)).id), lambda c: RelatedBy(_longest(_dotted(c)).id, "DEFINED_IN"), lambda c: "nothing found: the members of the module that is named"),
    Rule("F3", lambda c: c.anchored_on("Class") and getattr(c.plan, "rel", None) != "DEFINED_IN", lambda c: RelatedBy(c.anchor, "DEFINED_IN"), lambda c: "nothing found: the members of the class"),
)


def fallbacks(plan: Plan, candidates: tuple[Candidate, ...], empty: Callable[[Plan], bool]) -> tuple[Plan, str | None]:
    """The plan to use after running ``empty`` on it and on each plan fallen back to."""
    case, reason = Case(plan, tuple(candidates)), None
    if not empty(plan):
        return plan, None
    if FALLBACKS[0].when(case):
        case, reason = Case(FALLBACKS[0].rewrite(case), case.candidates), f"F1: {FALLBACKS[0].reason(case)}"
        if not empty(case.plan):
            return case.plan, reason
    for rule in FALLBACKS[1:]:
        if rule.when(case):
            return rule.rewrite(case), f"{rule.name}: {rule.reason(case)}"
    return case.plan, reason


@dataclass(frozen=True)
class Hop:
    """One further relationship. ``follow``: from the nodes that the hop before added, else from the
    facts' own; ``incoming``: edges to the anchor."""

    rel: str
    follow: bool = False
    incoming: bool = False


_UP, _UP_AGAIN, _WRAPS = Hop("INHERITS_FROM"), Hop("INHERITS_FROM", follow=True), Hop("WRAPS_EXCEPTION")


def expansion(plan: Plan, anchor_is_parameter: bool = False) -> tuple[Hop, ...]:
    """What is fetched beside a plan's facts, after the cap."""
    match plan:
        case WrapChain():
            return (_UP, _UP_AGAIN, Hop("INHERITS_FROM", incoming=True))
        case RelatedBy(rel="DEFINED_IN"):
            return (_UP,)
        case RelatedBy(rel="RAISES") | RaisedByMembers():
            return (_WRAPS, _UP, _UP_AGAIN)
        case CallChain():
            return (Hop("RAISES"), Hop("RETURNS"))
        case RelatedBy(rel="PASSES_TO"):
            return (Hop("PASSES_TO"),)
        case RelatedBy(rel="INHERITS_FROM"):
            return (_WRAPS, _UP)
        case Neighbors() if anchor_is_parameter:
            return (Hop("PASSES_TO"),)
    return ()
