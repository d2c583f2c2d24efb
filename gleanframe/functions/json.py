"""Strict JSON blocks and their flat key/value entries, as SQL expressions on VARIANT.

A block is ``struct<ok boolean, entries array<struct<key,value>>>``.
"""

from __future__ import annotations

from .text import NO_ENTRIES, empty_to_null, entry, let, quote, raw

OBJECT = "map<string,variant>"


def strict_json(text: str) -> str:
    """VARIANT of a text that is exactly one JSON value, else NULL.

    ``try_parse_json`` ignores text after the value. The value is therefore parsed as the first of
    two array elements, the second being a hash of the text, which the text cannot contain.
    """
    mark = f"xxhash64({text})"
    pair = f"try_cast(try_parse_json(concat('[', {text}, ',', string({mark}), ']')) AS array<variant>)"
    return let(pair, "p", f"CASE WHEN size(p) = 2 AND try_cast(get(p, 1) AS bigint) = {mark} THEN get(p, 0) END")


def as_object(value: str) -> str:
    return f"try_cast({value} AS {OBJECT})"


def _strip_zeros(x: str) -> str:
    return f"rtrim('.', rtrim('0', {x}))"


def _number_text(j: str, legacy: bool) -> str:
    """Plain digits between 1e-6 and 1e21, else an exponent with a sign. Legacy numbers pass through a double."""
    size = f"abs(try_cast({j} AS double))"
    wide = _strip_zeros(f"string(try_cast(try_cast({j} AS double) AS decimal(38,16)))")
    fine = _strip_zeros(f"string(try_cast(try_cast({j} AS double) AS decimal(38,24)))")
    scientific = f"replace(string(try_cast({j} AS double)), '.0E', 'E')"
    exponent = f"replace(regexp_replace({scientific}, {raw('E([0-9])')}, 'E+$1'), 'E', 'e')"
    plain = f"NOT contains({j}, 'E') AND NOT ({size} > 0 AND {size} < 1e-6)"
    if legacy:
        plain += " AND length(j) <= 15"
    text = (
        f"CASE WHEN {plain} THEN regexp_replace({j}, {raw('[.]0$')}, '') WHEN {size} = 0 THEN '0' "
        f"WHEN {size} >= 1 AND {size} < 1e21 THEN {wide} WHEN {size} >= 1e-6 AND {size} < 1 THEN {fine} ELSE {exponent} END"
    )
    return _strip_zeros(text) if legacy else text


# A piece of JSON text: a string, a number, or what lies between them.
_PIECE = r'"(?:[^"\\]|\\.)*+"|-?[0-9][0-9.eE+-]*+|[^"0-9-]++'
# Characters that are written as escapes wherever they stand; outside strings they do not occur.
_ESCAPED = {"<": "u003c", ">": "u003e", "&": "u0026", "\u2028": "u2028", "\u2029": "u2029"}


def _canonical(json_text: str) -> str:
    """Nested JSON with its numbers in one spelling (2500 for 2.5E3 and 2500.0) and HTML-safe strings."""
    pieces = f"regexp_extract_all({json_text}, {quote(_PIECE)}, 0)"
    number = let("j", "j", _number_text("j", False))
    plain = f"array_join(transform({pieces}, j -> CASE WHEN rlike(j, '^-?[0-9]') THEN {number} ELSE j END), '')"
    for c, code in _ESCAPED.items():
        plain = f"replace({plain}, {quote(c)}, {quote(chr(92) + code)})"
    return plain


def _field_text(value: str, legacy: bool) -> str:
    """Text of one JSON value: strings as they are (empty dropped), numbers, true/false, null, nested JSON."""
    nested = f"CASE WHEN rlike(j, '^[{{\\\\[]') THEN {_canonical('j')} ELSE j END"
    body = (
        f"CASE WHEN startswith(j, '\"') THEN {empty_to_null(f'try_cast({value} AS string)')} "
        f"WHEN rlike(j, '^-?[0-9]') THEN {_number_text('j', legacy)} ELSE {nested} END"
    )
    return let(f"to_json({value})", "j", body)


def object_entries(obj: str, legacy: bool) -> str:
    """Entries of a ``map<string,variant>``; none for NULL."""
    flat = f"transform(map_entries({obj}), f -> {entry('f.key', _field_text('f.value', legacy))})"
    return f"coalesce(filter({flat}, f -> f.value IS NOT NULL), {NO_ENTRIES})"


def _block(ok: str, entries: str) -> str:
    return f"named_struct('ok', coalesce({ok}, false), 'entries', coalesce({entries}, {NO_ENTRIES}))"


def object_block(text: str, legacy: bool) -> str:
    """Block of a text that must be a JSON object (or null)."""
    body = let(as_object("v"), "m", _block("m IS NOT NULL OR is_variant_null(v)", object_entries("m", legacy)))
    return let(strict_json(text), "v", body)


def object_or_array_block(text: str, legacy: bool) -> str:
    """As :func:`object_block`; an array whose elements are all objects is accepted too."""
    item = let(as_object("x"), "m", _block("m IS NOT NULL OR is_variant_null(x)", object_entries("m", legacy)))
    items = f"CASE WHEN v IS NOT NULL THEN transform(coalesce(try_cast(v AS array<variant>), array(v)), x -> {item}) END"
    entries = "CASE WHEN forall(xs, x -> x.ok) THEN flatten(transform(xs, x -> x.entries)) END"
    return let(strict_json(text), "v", let(items, "xs", _block("forall(xs, x -> x.ok)", entries)))


def next_data_block(text: str, legacy: bool) -> str:
    """An object whose ``props.pageProps`` entries come first, so that top-level keys override them."""
    props = as_object("try_element_at(m, 'props')")
    page_props = as_object(f"try_element_at({props}, 'pageProps')")
    entries = f"concat({object_entries(page_props, legacy)}, {object_entries('m', legacy)})"
    return let(strict_json(text), "v", let(as_object("v"), "m", _block("m IS NOT NULL OR is_variant_null(v)", entries)))
