"""Extractors: SQL expressions from a document to ``struct<entries array<struct<key,value>>, err boolean>``.

Entries are in writing order and the last write of a key wins; extractors in which the first write
wins hand their entries out reversed.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (
    CONTAINER_SELECTOR,
    GLOBAL_MARK,
    GLOBAL_NAMES,
    GLOBAL_PATTERN,
    HIDDEN_CLASS_SELECTOR,
    HIDDEN_STYLE_SELECTOR,
    INLINE_VAR_PATTERN,
    OBJECT_END_PATTERN,
    META_NAMES,
    RDFA_PREFIXES,
    TOKEN_NAMES,
    UTILITY_CLASSES,
)
from ..functions.html import FULL_TEXT, NO_TEXT, node_text, nodes_with_text
from ..functions.json import next_data_block, object_block, object_or_array_block
from ..functions.selectors import attr, has_node, select_nodes
from ..functions.text import (
    NO_ENTRIES,
    blank_to_null,
    empty_to_null,
    entry,
    in_list,
    let,
    normalise_key,
    present_entries,
    quote,
    raw,
    strip_prefixes,
    trim_space,
)
from ..options import CustomExtractor, Options


@dataclass(frozen=True, eq=False)
class Extractor:
    name: str
    config_name: str
    priority: int
    confidence: float
    selectors: Mapping[str, int]  # selector -> text wanted
    extract: Callable[[str, Options], Column]  # name of the document column -> result


def _result(entries: str, err: str = "false") -> str:
    return f"named_struct('entries', coalesce({entries}, {NO_ENTRIES}), 'err', coalesce({err}, false))"


def _from_blocks(blocks: str) -> str:
    """Good blocks give entries; one bad block sets the error flag of the whole extractor."""
    return let(blocks, "bs", _result("flatten(transform(bs, b -> b.entries))", "exists(bs, b -> NOT b.ok)"))


def _first_wins(entries: str) -> str:
    return _result(f"reverse({present_entries(entries)})")


def _last_wins(entries: str) -> str:
    return _result(present_entries(entries))


LD_JSON = 'script[type="application/ld+json"]'
NEXT_DATA = "script#__NEXT_DATA__"
INLINE_SCRIPT = "script:not([src])"


def json_ld(doc: str, options: Options) -> str:
    texts = f"filter(transform({select_nodes(doc, LD_JSON)}, n -> {trim_space(node_text('n', doc))}), t -> t <> '')"
    return _from_blocks(f"transform({texts}, t -> {object_or_array_block('t', options.legacy_numbers)})")


def next_data(doc: str, options: Options) -> str:
    joined = f"array_join(transform({select_nodes(doc, NEXT_DATA)}, n -> {node_text('n', doc)}), '')"
    texts = f"filter(array({trim_space(joined)}), t -> t <> '')"
    return _from_blocks(f"transform({texts}, t -> {next_data_block('t', options.legacy_numbers)})")


def _script_objects(doc: str, objects: str, options: Options) -> str:
    """Blocks of the objects that an expression over `pieces` finds in each inline script.

    A script is cut at every end of an object with a semicolon. A declaration reaches to the first such end after
    it, which is the end of its piece, so each piece is searched once and the search is linear in the text.
    """
    pieces = f"split({node_text('n', doc)}, {raw(OBJECT_END_PATTERN)})"
    found = let(pieces, "ps", let("slice(ps, 1, size(ps) - 1)", "pieces", objects))
    texts = f"flatten(transform({select_nodes(doc, INLINE_SCRIPT)}, n -> {found}))"
    return _from_blocks(f"transform({texts}, t -> {object_block('t', options.legacy_numbers)})")


def _declared(pattern: str) -> str:
    """The object that the first declaration in each piece begins, for the pieces that hold one."""
    starts = f"filter(transform(pieces, p -> regexp_extract(p, {raw(pattern)}, 1)), o -> o <> '')"
    return f"transform({starts}, o -> concat(o, '}}'))"


def state_globals(doc: str, options: Options) -> str:
    # Patterns are tried in order and each counts once per script.
    firsts = ", ".join(f"slice({_declared(GLOBAL_PATTERN.format(name=name))}, 1, 1)" for name in GLOBAL_NAMES)
    holds = f"filter(pieces, p -> contains(p, {quote(GLOBAL_MARK)}))"
    return _script_objects(doc, let(holds, "pieces", f"concat({firsts})"), options)


def inline_vars(doc: str, options: Options) -> str:
    return _script_objects(doc, _declared(INLINE_VAR_PATTERN), options)


def meta_tags(doc: str, options: Options) -> str:
    title = entry("'title'", blank_to_null(f"get(transform({select_nodes(doc, 'title')}, n -> {node_text('n', doc)}), 0)"))
    links = select_nodes(doc, 'link[rel="canonical"]')
    canonical = f"transform({links}, n -> {entry(quote('canonical_url'), empty_to_null(attr('n', 'href')))})"
    property_name = strip_prefixes(f"lower({strip_prefixes('q', 'og:')})", "twitter:")
    property_key = empty_to_null(f"translate({property_name}, ':', '_')")
    name_key = let(
        strip_prefixes(f"lower({attr('n', 'name')})", "twitter:"),
        "m",
        f"CASE WHEN {in_list('m', META_NAMES)} THEN m "
        f"WHEN startswith(m, 'og:') THEN translate({strip_prefixes('m', 'og:')}, ':', '_') END",
    )
    # A property attribute, even an empty one, hides the name attribute.
    key = let(attr("n", "property"), "q", f"CASE WHEN q IS NOT NULL THEN {property_key} ELSE {name_key} END")
    metas = f"transform({select_nodes(doc, 'meta')}, n -> {entry(key, blank_to_null(attr('n', 'content')))})"
    return _last_wins(f"concat(array({title}), {canonical}, {metas})")


def microdata(doc: str, options: Options) -> str:
    values = (attr("n", "content"), attr("n", "datetime"), node_text("n", doc))
    value = f"coalesce({', '.join(map(blank_to_null, values))})"

    def items(name: str, key: Callable[[str], str]) -> str:
        named = entry(key(blank_to_null(attr("n", name))), value)
        return f"transform({select_nodes(doc, f'[{name}]')}, n -> {named})"

    rdfa = items("property", lambda prop: normalise_key(strip_prefixes(prop, *RDFA_PREFIXES)))
    return _last_wins(f"concat({items('itemprop', normalise_key)}, {rdfa})")


def data_attrs(doc: str, options: Options) -> str:
    named = entry("translate(substr(d.k, 6), '-', '_')", blank_to_null("d.v"))
    card = f"transform(filter(n.attrs, d -> startswith(d.k, 'data-')), d -> {named})"
    return _first_wins(f"flatten(transform({select_nodes(doc, CONTAINER_SELECTOR)}, n -> {card}))")


def hidden_inputs(doc: str, options: Options) -> str:
    named = entry(normalise_key(blank_to_null(attr("n", "name"))), blank_to_null(attr("n", "value")))
    inputs = select_nodes(doc, 'input[type="hidden"]')
    return _first_wins(f"filter(transform({inputs}, n -> {named}), i -> NOT {in_list('i.key', TOKEN_NAMES)})")


def css_hidden(doc: str, options: Options) -> str:
    words = f"split(lower({attr('n', 'class')}), {raw('[' + '\\t-\\r \\x85' + '\\p{Z}]+')})"
    class_key = f"get(filter({words}, w -> w <> '' AND NOT {in_list('w', UTILITY_CLASSES)}), 0)"
    key = normalise_key(f"coalesce({empty_to_null(attr('n', 'id'))}, {class_key})")

    def hidden(selector: str) -> str:
        return f"transform({select_nodes(doc, selector)}, n -> {entry(key, blank_to_null(node_text('n', doc)))})"

    return _first_wins(f"concat({hidden(HIDDEN_STYLE_SELECTOR)}, {hidden(HIDDEN_CLASS_SELECTOR)})")


def dom_text(doc: str, options: Options) -> str:
    """Text of the first match of each caller-supplied selector; no selectors, no fields."""
    found = [
        entry(quote(key), blank_to_null(f"get(transform({select_nodes(doc, selector)}, n -> {node_text('n', doc)}), 0)"))
        for key, selector in options.dom_text_selectors.items()
    ]
    return _last_wins(f"array({', '.join(found)})") if found else _result(NO_ENTRIES)


def _built_in(expression: Callable[[str, Options], str], selectors: Mapping[str, int]) -> Callable[[str, Options], Column]:
    """The expression as a column; a page in which none of its selectors matched has no entries and computes nothing."""

    def extract(doc: str, options: Options) -> Column:
        if not selectors:
            return F.expr(expression(doc, options))
        matched = " OR ".join(has_node(doc, s) for s in selectors)
        return F.expr(f"CASE WHEN {matched} THEN {expression(doc, options)} ELSE {_result(NO_ENTRIES)} END")

    return extract


_REGISTRY = (
    ("json-ld", "json-ld", 0.95, {LD_JSON: FULL_TEXT}, json_ld),
    ("next-data", "next-data", 0.92, {NEXT_DATA: FULL_TEXT}, next_data),
    ("state-globals", "globals", 0.85, {INLINE_SCRIPT: FULL_TEXT}, state_globals),
    ("inline-vars", "inline-var", 0.75, {INLINE_SCRIPT: FULL_TEXT}, inline_vars),
    ("meta-tags", "meta-tags", 0.88, {"title": FULL_TEXT, 'link[rel="canonical"]': NO_TEXT, "meta": NO_TEXT}, meta_tags),
    ("microdata", "microdata", 0.82, {"[itemprop]": FULL_TEXT, "[property]": FULL_TEXT}, microdata),
    ("data-attrs", "data-attr", 0.78, {CONTAINER_SELECTOR: NO_TEXT}, data_attrs),
    ("hidden-inputs", "hidden-input", 0.72, {'input[type="hidden"]': NO_TEXT}, hidden_inputs),
    ("css-hidden", "css-hidden", 0.60, {HIDDEN_STYLE_SELECTOR: FULL_TEXT, HIDDEN_CLASS_SELECTOR: FULL_TEXT}, css_hidden),
    ("dom-text", "dom-text", 0.55, {}, dom_text),
)
# Priorities are the positions, from 1; a smaller one wins.
REGISTRY = tuple(
    Extractor(name, config_name, priority, confidence, selectors, _built_in(expression, selectors))
    for priority, (name, config_name, confidence, selectors, expression) in enumerate(_REGISTRY, start=1)
)


def _custom(extractor: CustomExtractor) -> Extractor:
    def extract(doc: str, options: Options) -> Column:
        entries = F.filter(extractor.entries(F.expr(nodes_with_text(doc))), lambda e: e["key"].isNotNull() & e["value"].isNotNull())
        entries = F.reverse(entries) if extractor.first_wins else entries
        return F.struct(F.coalesce(entries, F.expr(NO_ENTRIES)).alias("entries"), F.lit(False).alias("err"))

    selectors = {s: FULL_TEXT if wants else NO_TEXT for s, wants in extractor.selectors.items()}
    return Extractor(extractor.name, extractor.name, extractor.priority, extractor.confidence, selectors, extract)


def enabled_extractors(options: Options) -> list[Extractor]:
    """The registry under the options: disabled ones are left out, a positive confidence overrides."""
    out = []
    for e in (*REGISTRY, *map(_custom, options.custom_extractors)):
        override = options.extractors.get(e.config_name)
        if override is not None and not override.enabled:
            continue
        confidence = override.confidence if override is not None and override.confidence > 0 else e.confidence
        selectors = e.selectors
        if e.config_name == "dom-text":
            selectors = {s: FULL_TEXT for s in options.dom_text_selectors.values()}
        out.append(Extractor(e.name, e.config_name, e.priority, float(confidence), selectors, e.extract))
    return out


def split_phases(extractors: list[Extractor]) -> tuple[list[Extractor], list[Extractor]]:
    """The first four enabled extractors run first; all run at once when there are no more than four."""
    return (extractors[:4], extractors[4:]) if len(extractors) > 4 else (extractors, [])


def phase_of(source: Column, options: Options) -> Column:
    """The phase, first or second, that the extractor of a source runs in."""
    first, _ = split_phases(enabled_extractors(options))
    return F.when(source.isin([e.name for e in first]), "first").otherwise("second")


def wanted_selectors(extractors: list[Extractor], *more: Mapping[str, int]) -> dict[str, int]:
    wanted: dict[str, int] = {}
    for selectors in [e.selectors for e in extractors] + list(more):
        for selector, mode in selectors.items():
            wanted[selector] = max(mode, wanted.get(selector, NO_TEXT))
    return wanted
