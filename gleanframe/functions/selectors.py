"""A small selector dialect: the parse matches it, and SQL looks the matches up.

Supported: a tag name, ``#id``, ``.class``, ``[a]``, ``[a=v]``, ``[a*=v]`` (with an
optional ``i`` flag), ``:not([a])`` and comma lists. There are no combinators.
"""

from __future__ import annotations

import re

from .text import quote

NODE = (
    "struct<idx:int,parent:int,end:int,tag:string,attrs:array<struct<k:string,v:string>>,"
    "start:int,stop:int,n_children:int>"
)
_ATTR = r"""\[\s*[\w-]+\s*(?:\*?=\s*(?:"[^"]*"|'[^']*'|[^\]\s"']*)\s*i?\s*)?\]"""
_PIECE = re.compile(rf":not\({_ATTR}\)|{_ATTR}|[#.][\w-]+")
_COMPOUND = re.compile(rf"\s*([a-zA-Z][\w-]*|\*)?((?:{_PIECE.pattern})*)\s*")
_ATTR_PARTS = re.compile(r"""\[\s*([\w-]+)\s*(?:(\*?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s"']*))\s*(i)?\s*)?\]""")

# A test is (attribute, operation, value, fold case); a compound is (tag or None, tests).
Test = tuple[str, str, str, bool]
Compound = tuple[str | None, tuple[Test, ...]]


def _test(piece: str) -> Test:
    if piece[0] == "#":
        return ("id", "equals", piece[1:], False)
    if piece[0] == ".":
        return ("class", "word", piece[1:], False)
    name, op, *values, fold = _ATTR_PARTS.search(piece).groups()
    if piece.startswith(":not"):
        if op:
            raise ValueError(f"only :not([name]) is supported: {piece}")
        return (name.lower(), "absent", "", False)
    value = next((v for v in values if v is not None), "")
    value = value.lower() if fold else value
    return (name.lower(), {None: "present", "=": "equals", "*=": "contains"}[op], value, bool(fold))


def compile_selector(selector: str) -> list[Compound]:
    """Compounds of a comma list; raises ValueError outside the dialect."""
    out, pos = [], 0
    while True:
        m = _COMPOUND.match(selector, pos)
        tag, pieces = m.group(1), m.group(2)
        if not (tag or pieces):
            raise ValueError(f"unsupported selector: {selector!r}")
        out.append((None if tag in (None, "*") else tag.lower(), tuple(_test(p) for p in _PIECE.findall(pieces))))
        pos = m.end()
        if pos == len(selector):
            return out
        if selector[pos] != ",":
            raise ValueError(f"unsupported selector: {selector!r}")
        pos += 1


def _places(doc: str, selector: str) -> str:
    compile_selector(selector)
    return f"try_element_at({doc}.found, {quote(selector)})"


def select_nodes(doc: str, selector: str) -> str:
    """Nodes matching a selector that the parse was asked for, in document order: looked up, not searched."""
    none = f"CASE WHEN {doc}.nodes IS NOT NULL THEN CAST(array() AS array<{NODE}>) END"
    return f"coalesce(transform({_places(doc, selector)}, p -> get({doc}.nodes, p)), {none})"


def has_node(doc: str, selector: str) -> str:
    return f"({_places(doc, selector)} IS NOT NULL)"


def attr(node: str, name: str) -> str:
    """First value of the attribute, NULL when the node does not carry it."""
    return f"get(filter({node}.attrs, a -> a.k = {quote(name)}), 0).v"
