"""Scalar functions shared by the operators, as column expressions."""

from ..graph import parent_of
from ..operators.chunks import chunk_id
from ..operators.facts import citations, citations_valid, provenance
from ..operators.grading import credit, is_refusal, negated, states
from ..operators.resolve import fold_name, leaf
from ..operators.vectors import cosine, dot

__all__ = [
    "chunk_id", "citations", "citations_valid", "cosine", "credit", "dot", "fold_name", "is_refusal", "leaf", "negated",
    "parent_of", "provenance", "states"
]
