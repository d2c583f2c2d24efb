"""Page signals, hollow score and page class."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (
    APP_SHELL,
    APP_SHELL_SELECTOR,
    CAPTCHA_SELECTOR,
    CONTENT_RICH,
    LINK_RICH,
    MIXED,
    NOSCRIPT_PHRASES,
)
from ..functions.html import FULL_TEXT, LEAF_TEXT, NO_TEXT, node_text
from ..functions.selectors import has_node, select_nodes
from ..functions.text import let, quote, trim_space
from ..options import Options

COLUMNS = ("is_hollow", "hollow_score", "signals", "page_type", "page_type_confidence", "penalties", "total")
#: What the decision and an analysis row need of them.
DECIDING = ("is_hollow", "hollow_score", "page_type", "page_type_confidence")
SELECTORS = {CAPTCHA_SELECTOR: NO_TEXT, "noscript": FULL_TEXT, APP_SHELL_SELECTOR: LEAF_TEXT, "a": FULL_TEXT}


def text_links(doc: str) -> str:
    """``a`` nodes with text."""
    return f"filter({select_nodes(doc, 'a')}, n -> {trim_space(node_text('n', doc))} <> '')"


def page_facts(doc: str, body_bytes: str) -> str:
    """What the score is computed from: struct<captcha, noscript, n_shells, n_links, body_bytes, text_bytes>."""
    noscript = f"lower(array_join(transform({select_nodes(doc, 'noscript')}, n -> {node_text('n', doc)}), ''))"
    phrases = " OR ".join(f"contains(t, {quote(p)})" for p in NOSCRIPT_PHRASES)
    empty = f"n.n_children = 0 AND {trim_space(node_text('n', doc))} = ''"
    n_shells = f"size(filter({select_nodes(doc, APP_SHELL_SELECTOR)}, n -> {empty}))"

    def found(selector: str, value: str, none: str) -> str:
        return f"CASE WHEN {has_node(doc, selector)} THEN {value} WHEN {doc}.nodes IS NOT NULL THEN {none} END"

    return (
        f"named_struct('captcha', {has_node(doc, CAPTCHA_SELECTOR)}, 'noscript', {found('noscript', let(noscript, 't', phrases), 'false')}, "
        f"'n_shells', {found(APP_SHELL_SELECTOR, n_shells, '0')}, "
        f"'n_links', {found('a', f'size({text_links(doc)})', '0')}, 'body_bytes', {body_bytes}, 'text_bytes', {doc}.body_text_bytes)"
    )


def score_page(facts: str, cf_challenge: str, options: Options, columns: tuple[str, ...] = COLUMNS) -> str:
    """The named columns of struct<is_hollow, hollow_score, signals, page_type, page_type_confidence, penalties, total>."""
    link_rich = f"({facts}.n_links >= {options.link_rich_min_links})"
    density = f"{facts}.text_bytes / CAST({facts}.body_bytes AS double)"
    low_density = f"NOT {link_rich} AND {facts}.body_bytes > 0 AND {density} < {_double(options.text_density_ratio)}"
    fired = {
        "captcha": f"int({facts}.captcha)",
        "noscript-message": f"int({facts}.noscript)",
        "empty-app-shell": f"{facts}.n_shells",
        "low-text-density": f"int({low_density})",
        "tiny-body": f"int(NOT {link_rich} AND {facts}.body_bytes < {options.tiny_body_bytes})",
    }
    rows = ", ".join(
        f"named_struct('name', {quote(name)}, 'times', {times}, 'penalty', {_double(options.penalty(name))})"
        for name, times in fired.items()
    )
    hits = f"filter(array({rows}), s -> s.times > 0)"
    challenge = f"coalesce({cf_challenge}, false)"
    # Penalties are added one by one, in this order, because the thresholds compare doubles.
    total = "0D"
    for name, times in fired.items():
        penalty = _double(options.penalty(name))
        many = f"WHEN {times} > 1 THEN aggregate(array_repeat({penalty}, {times}), {total}, (acc, p) -> acc + p) " if name == "empty-app-shell" else ""
        if many:
            total = f"CASE {many}WHEN {times} = 1 THEN {total} + {penalty} ELSE {total} END"
        else:
            total = f"({total} + CASE WHEN {times} > 0 THEN {penalty} ELSE 0D END)"
    total = f"least(1D, {total})"
    score = f"least(1D, total + CASE WHEN {challenge} THEN {_double(options.penalty('cf-challenge'))} ELSE 0D END)"
    hollow = f"total >= {_double(options.threshold)}"
    growth = f"0.5D + {facts}.n_links / CAST({options.link_rich_min_links} AS double) * 0.2D"
    values = {
        "is_hollow": f"score >= {_double(options.threshold)}",
        "hollow_score": "score",
        "signals": f"concat(CASE WHEN {challenge} THEN array('cf-challenge') ELSE array() END, transform({hits}, s -> s.name))",
        "page_type": f"CASE WHEN {challenge} OR {hollow} THEN '{APP_SHELL}' WHEN {link_rich} THEN '{LINK_RICH}' "
        f"WHEN total = 0 THEN '{CONTENT_RICH}' ELSE '{MIXED}' END",
        "page_type_confidence": f"CASE WHEN {challenge} THEN 1D WHEN {hollow} THEN total "
        f"WHEN {link_rich} THEN least({growth}, 0.95D) ELSE 1D - total END",
        "penalties": f"map_from_entries(transform({hits}, s -> struct(s.name, s.penalty)))",
        "total": "total",
    }
    page = f"named_struct({', '.join(f"'{name}', {values[name]}" for name in columns)})"
    return let(total, "total", let(score, "score", page))


def _double(value: float) -> str:
    return f"{float(value)!r}D"


def page_signals(doc: str, body_bytes: str, cf_challenge: str, options: Options, columns: tuple[str, ...] = COLUMNS) -> Column:
    facts = page_facts(doc, body_bytes)
    return F.expr(let(facts, "facts", score_page("facts", cf_challenge, options, columns)))
