"""Building blocks of SQL expressions.

Expressions over nested arrays are composed as SQL text and handed to Spark with ``F.expr`` once per
column: one call instead of thousands of small ones while a plan is built.
"""

from __future__ import annotations

from ..constants import WHITE_SPACE

ENTRY = "struct<key:string,value:string>"
NO_ENTRIES = f"CAST(array() AS array<{ENTRY}>)"


def quote(value: str) -> str:
    """SQL literal of a text."""
    plain = "".join(c if c.isascii() and c.isprintable() else f"\\u{ord(c):04x}" for c in value.replace("\\", "\\\\"))
    return "'" + plain.replace("'", "\\'") + "'"


def raw(pattern: str) -> str:
    """SQL literal of a regular expression without quotes in it."""
    return f"r'{pattern}'"


def let(value: str, name: str, body: str) -> str:
    """Bind a value to a name once, for a body that reads it several times."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def trim_space(x: str) -> str:
    """Trim Unicode white space; plain ``trim`` drops blanks only."""
    return f"trim(BOTH {quote(WHITE_SPACE)} FROM {x})"


def empty_to_null(x: str) -> str:
    return let(x, "s", "CASE WHEN s <> '' THEN s END")


def blank_to_null(x: str) -> str:
    return empty_to_null(trim_space(x))


def normalise_key(x: str) -> str:
    return f"translate(lower({x}), '- ', '__')"


def strip_prefixes(x: str, *prefixes: str) -> str:
    """Strip each prefix once, in this order. The prefixes are plain words and colons."""
    return f"regexp_replace({x}, {raw('^' + ''.join(f'(?:{p})?' for p in prefixes))}, '')"


def entry(key: str, value: str) -> str:
    return f"named_struct('key', {key}, 'value', {value})"


def present_entries(entries: str) -> str:
    """Drop entries that lack a key or a value."""
    return f"filter({entries}, e -> e.key IS NOT NULL AND e.value IS NOT NULL)"


def in_list(x: str, values: tuple[str, ...]) -> str:
    return f"{x} IN ({', '.join(map(quote, values))})"


def cut_utf8(x: str, max_bytes: int) -> str:
    """First bytes of a text; a character cut in half becomes a replacement mark."""
    cut = f"make_valid_utf8(CAST(substring(encode({x}, 'UTF-8'), 1, {max_bytes}) AS STRING))"
    return f"CASE WHEN octet_length({x}) > {max_bytes} THEN {cut} ELSE {x} END"
