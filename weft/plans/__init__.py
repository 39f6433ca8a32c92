"""Plans are data: which question to ask of a graph, with checked parameters."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

from ..ontology import Ontology

MAX_HOPS = 5
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")


class PlanError(ValueError):
    """A parameter that the plan can't run with."""


@dataclass(frozen=True)
class Plan:
    """Base of all plans. ``capped``: whether ranking may cut its facts (not where the rows are the answer)."""

    capped = True
    offered = True

    def validate(self, ontology: Ontology, known: frozenset[str], packages: frozenset[str] = frozenset()) -> Plan:
        for f in fields(self):
            value = getattr(self, f.name)
            match f.name:
                case "entity_id" | "other_id":
                    if value not in known:
                        raise PlanError(f"{value!r} is not a resolved id")
                case "entity_ids":
                    if not value or not set(value) <= known:
                        raise PlanError("ids must be a non-empty list of resolved ids")
                case "rel":
                    try:
                        ontology.check_relationship(value)
                    except ValueError as e:
                        raise PlanError(str(e)) from None
                case "max_hops":
                    if isinstance(value, bool) or not isinstance(value, int) or not 1 <= value <= MAX_HOPS:
                        raise PlanError(f"hops go from 1 to {MAX_HOPS}")
                case "package":
                    if value not in packages:
                        raise PlanError(f"{value!r} is not a package of the corpus")
                case "name":
                    if not isinstance(value, str) or not _NAME.match(value):
                        raise PlanError(f"{value!r} is not an identifier")
        return self


@dataclass(frozen=True)
class Neighbors(Plan):  # T1
    entity_id: str


@dataclass(frozen=True)
class PathBetween(Plan):  # T2
    entity_id: str
    other_id: str
    offered = False


@dataclass(frozen=True)
class WrapChain(Plan):  # T3
    entity_id: str
    max_hops: int = 3
    rel: str = "WRAPS_EXCEPTION"


@dataclass(frozen=True)
class CallChain(Plan):  # T5
    entity_id: str
    max_hops: int = 5
    rels: tuple[str, ...] = ("DELEGATES_TO", "CALLS")


@dataclass(frozen=True)
class CountRel(Plan):  # T6
    rel: str


@dataclass(frozen=True)
class DocsFor(Plan):  # T7
    entity_id: str
    rel: str = "DOCUMENTED_IN"


@dataclass(frozen=True)
class RelatedBy(Plan):  # T8
    entity_id: str
    rel: str
    capped = False


@dataclass(frozen=True)
class EdgesFrom(Plan):  # T9
    entity_ids: tuple[str, ...]
    rel: str
    offered = False


@dataclass(frozen=True)
class EdgesTo(Plan):  # T9
    entity_ids: tuple[str, ...]
    rel: str
    offered = False


@dataclass(frozen=True)
class RaisedByMembers(Plan):  # T10
    entity_id: str
    member_rel: str = "DEFINED_IN"
    rel: str = "RAISES"
    capped = False
    offered = False


@dataclass(frozen=True)
class InPackage(Plan):  # T11
    package: str
    rel: str
    limit: int = 100
    capped = False


@dataclass(frozen=True)
class FlowOfName(Plan):  # T12
    name: str
    rel: str = "PASSES_TO"
    label: str = "Parameter"
    offered = False


@dataclass(frozen=True)
class OwnersOfName(Plan):  # T13
    name: str
    rel: str = "DEFINED_IN"
    label: str = "Parameter"
    limit: int = 100
    capped = False
