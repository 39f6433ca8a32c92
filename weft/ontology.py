"""Relationship and entity types as data: what may be stored, how it reads, what it means."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Relationship:
    phrase: str
    meaning: str
    family: str = "parser"


@dataclass(frozen=True)
class Ontology:
    entity_types: frozenset[str]
    relationships: dict[str, Relationship] = field(hash=False)
    #: (relationship, subject label, object label or None) -> a more exact phrase, first match wins.
    exact_phrases: tuple[tuple[str, str, str | None, str], ...] = ()
    #: Labels counted in listings, in order of preference, with their plural.
    kinds: tuple[tuple[str, str], ...] = ()

    def check_relationship(self, rel: str) -> str:
        if rel not in self.relationships:
            raise ValueError(f"unknown relationship {rel!r}")
        return rel

    def check_label(self, label: str) -> str:
        if label not in self.entity_types:
            raise ValueError(f"unknown entity type {label!r}")
        return label

    def family(self, name: str) -> frozenset[str]:
        return frozenset(k for k, r in self.relationships.items() if r.family == name)


# Names, phrases and the types of the code ontology.
CODE = Ontology(
    frozenset({"Module", "Class", "Function", "Exception", "Parameter", "Concept", "DocSection", "Release"}),
    {
        "DEFINED_IN": Relationship("is defined in", "the place in the source that holds the thing; location only."),
        "INHERITS_FROM": Relationship("inherits from", "the class has that one as a base."),
        "CALLS": Relationship("calls", "the function invokes that one."),
        "IMPORTS": Relationship("imports", "the module imports that name."),
        "RAISES": Relationship("raises", "the function can throw that exception."),
        "HAS_PARAMETER": Relationship("has parameter", "the function accepts that parameter."),
        "RETURNS": Relationship("returns an instance of", "what the function returns is of that class."),
        "PASSES_TO": Relationship("is passed to", "the parameter's value is an argument of that function or parameter."),
        "STORED_ON": Relationship("is stored as an attribute on", "the parameter's value is kept on that class."),
        "DOCUMENTED_IN": Relationship("is documented in", "that section describes the thing.", "model"),
        "EXPLAINS": Relationship("explains", "that section explains the concept.", "model"),
        "IMPLEMENTS": Relationship("implements", "the code carries out that concept.", "model"),
        "CONTROLS": Relationship("controls", "the setting governs that behaviour.", "model"),
        "DELEGATES_TO": Relationship("delegates to", "the component hands its work to that one.", "model"),
        "WRAPS_EXCEPTION": Relationship("wraps", "the exception is raised in place of that one.", "model"),
        "CHANGED_IN": Relationship("changed in", "the thing was changed in that release.", "model"),
        "CONSTRAINS": Relationship("constrains", "the thing limits that one.", "model"),
    },
    (
        ("DEFINED_IN", "Parameter", None, "is a parameter of"),
        ("DEFINED_IN", "Function", "Class", "is a method of"),
        ("DEFINED_IN", "Module", "Module", "is a submodule of"),
        ("DEFINED_IN", "Class", "Module", "is a class defined in"),
        ("DEFINED_IN", "Function", "Module", "is a function defined in"),
    ),
    (("Parameter", "parameters"), ("Module", "submodules"), ("Function", "functions"), ("Class", "classes")),
)

#: The graph of the business tables.
STAR = Ontology(
    frozenset({"Region", "Nation", "Customer", "Supplier", "Order", "Catalog", "Brand", "Part", "EventType", "Turn", "Page", "Url"}),
    {
        "DEFINED_IN": Relationship("is defined in", "the place that holds the thing; location only."),
        "SUPPLIES": Relationship("supplies", "the supplier delivered that part."),
        "CONTAINS": Relationship("contains", "the order has that part."),
        "NEXT": Relationship("is followed by", "a user's next event was of that type.", "model"),
        "REPLIES": Relationship("replies to", "the turn answers that one."),
        "LINKS": Relationship("links to", "the page has a link to that address.", "model"),
    },
    (("DEFINED_IN", "Nation", "Region", "is a nation of"), ("DEFINED_IN", "Customer", "Nation", "is a customer in"), ("DEFINED_IN", "Supplier", "Nation", "is a supplier in")),
    (("Customer", "customers"), ("Supplier", "suppliers"), ("Nation", "nations"), ("Order", "orders"), ("Brand", "brands"), ("Part", "parts")),
)


def plural(phrase: str) -> str:
    """The form of a phrase for several subjects: *inherits from* -> *inherit from*."""
    verb, space, rest = phrase.partition(" ")
    irregular = {"is": "are", "has": "have", "changed": "changed"}
    return irregular.get(verb, verb.removesuffix("s")) + space + rest
