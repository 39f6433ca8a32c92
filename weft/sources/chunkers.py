"""Documents to chunks: code by definition, prose by section, changelogs by release.

Each chunker yields ``section, kind, start_line, end_line, text, embed_text`` with lines from 1, both
ends included. Sections larger than ``MAX_CHARS`` are packed greedily by paragraph.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from pathlib import PurePosixPath
from typing import NamedTuple

MAX_CHARS = 2000
_VERSION = re.compile(r"v?\d+(\.\d+)+\S*")
_ADORNMENT = re.compile(r"([!-/:-@\[-`{-~])\1+\s*\Z")


class Chunk(NamedTuple):
    section: str | None
    kind: str
    start_line: int
    end_line: int
    text: str
    embed_text: str


def _lines(lines: list[str], start: int, end: int) -> str:
    return "\n".join(lines[start - 1 : end])


def _code(node: ast.AST, symbol: str, lines: list[str]) -> Chunk:
    start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
    end = node.end_lineno
    if isinstance(node, ast.ClassDef):
        methods = [m for m in node.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))]
        if methods:
            first = min([methods[0].lineno, *(d.lineno for d in methods[0].decorator_list)])
            end = max(start, first - 1)
    text = _lines(lines, start, end)
    doc = ast.get_docstring(node)
    signature = _lines(lines, node.lineno, max(node.lineno, node.body[0].lineno - 1))
    return Chunk(symbol, "code", start, end, text, f"{signature}\n{doc}" if doc else text)


def definitions(tree: ast.Module, module: str) -> Iterator[tuple[ast.AST, str, str | None]]:
    """Top-level functions and classes and the methods of these: node, symbol, enclosing class."""
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            yield node, f"{module}.{node.name}", None
        elif isinstance(node, ast.ClassDef):
            yield node, f"{module}.{node.name}", None
            for m in node.body:
                if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    yield m, f"{module}.{node.name}.{m.name}", f"{module}.{node.name}"


def code_chunks(text: str, module: str) -> Iterator[Chunk]:
    lines = text.splitlines()
    for node, symbol, _ in definitions(ast.parse(text), module):
        yield _code(node, symbol, lines)


def docstring_chunks(text: str, module: str) -> Iterator[Chunk]:
    """The docstring of each symbol that has one, at the lines of the symbol's code chunk."""
    lines = text.splitlines()
    for node, symbol, _ in definitions(ast.parse(text), module):
        if doc := (ast.get_docstring(node) or "").strip():
            code = _code(node, symbol, lines)
            yield Chunk(symbol, "docstring", code.start_line, code.end_line, doc, doc)


def _paragraphs(lines: list[str], start: int, end: int) -> list[tuple[int, int]]:
    spans: list[tuple[int, int]] = []
    for n in range(start, end + 1):
        if lines[n - 1].strip():
            if spans and spans[-1][1] == n - 1:
                spans[-1] = (spans[-1][0], n)
            else:
                spans.append((n, n))
    return spans


def packed(lines: list[str], start: int, end: int, max_chars: int = MAX_CHARS) -> Iterator[tuple[int, int]]:
    """Line spans of at most ``max_chars``, cut between paragraphs; an indented paragraph stays with the one before."""
    span: tuple[int, int] | None = None
    for a, b in _paragraphs(lines, start, end):
        if span and (len(_lines(lines, span[0], b).strip()) <= max_chars or lines[a - 1][:1].isspace()):
            span = (span[0], b)
        else:
            if span:
                yield span
            span = (a, b)
    if span:
        yield span


def _sections(lines: list[str], heads: list[tuple[int, int, int, str]], kind: str) -> Iterator[Chunk]:
    """``heads``: first line, first line of the body, level, title. What precedes the first is left out."""
    trail: list[tuple[int, str]] = []
    for i, (at, body, level, title) in enumerate(heads):
        trail = [t for t in trail if t[0] < level] + [(level, title)]
        end = heads[i + 1][0] - 1 if i + 1 < len(heads) else len(lines)
        name = " > ".join(t for _, t in trail)
        for a, b in packed(lines, body, end):
            text = _lines(lines, a, b).strip()
            yield Chunk(name, kind, a, b, text, text)


def _underlined(lines: list[str]) -> Iterator[tuple[int, str, str]]:
    """Line, title and adornment character of headings underlined at least to their length."""
    for n in range(1, len(lines)):
        title, under = lines[n - 1].strip(), lines[n].rstrip()
        if title and _ADORNMENT.match(under) and len(under) >= max(2, len(title)) and not _ADORNMENT.match(title):
            yield n, title, under[0]


def rst_chunks(text: str) -> Iterator[Chunk]:
    lines, levels = text.splitlines(), {}
    heads = [(n, n + 2, levels.setdefault(mark, len(levels)), title) for n, title, mark in _underlined(lines)]
    yield from _sections(lines, heads, "doc")


def markdown_chunks(text: str, path: str) -> Iterator[Chunk]:
    lines, heads, fence = text.splitlines(), [], None
    for n, line in enumerate(lines, 1):
        mark = re.match(r"\s{0,3}(```+|~~~+)", line)
        if mark and (fence is None or mark[1].startswith(fence)):
            fence = mark[1] if fence is None else None
        elif fence is None and (m := re.match(r"(#{1,6})\s+(.*?)\s*#*\s*\Z", line)):
            heads.append((n, n + 1, len(m[1]), m[2]))
    if not heads:
        heads = [(1, 1, 1, PurePosixPath(path).stem)]
    yield from _sections(lines, heads, "doc")


def changelog_chunks(text: str) -> Iterator[Chunk]:
    """A section for each release; the version is the section's name."""
    lines = text.splitlines()
    found = [(n, n + 2, v[0].removeprefix("v")) for n, title, _ in _underlined(lines) if (v := _VERSION.match(title))]
    for n, line in enumerate(lines, 1):
        if (m := re.match(r"#{1,3}\s+\[?(v?\d+(?:\.\d+)+[^\s\]]*)", line)):
            found.append((n, n + 1, m[1].removeprefix("v")))
    heads = [(at, body, 1, v) for at, body, v in sorted(found)]
    yield from _sections(lines, heads, "changelog")
