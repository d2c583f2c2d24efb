"""Walls on rendered pages: the reason why a rendered page cannot be used, or NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import CAPTCHA_WALLS, CHALLENGE_WALLS, COOKIE_WALLS, LOGIN_SEGMENTS, PASSWORD_SELECTOR
from ..functions.html import NO_TEXT
from ..functions.selectors import has_node
from ..functions.text import quote

SELECTORS = {
    3: {s: NO_TEXT for s in (*COOKIE_WALLS, PASSWORD_SELECTOR, *CHALLENGE_WALLS)},
    4: {s: NO_TEXT for s in CAPTCHA_WALLS},
}


def _first_hit(doc: str, selectors: tuple[str, ...], label: str) -> list[str]:
    return [f"CASE WHEN {has_node(doc, s)} THEN {quote(f'{label}: {s}')} END" for s in selectors]


def _login_url(rendered_url: str) -> str:
    hit = " OR ".join(f"contains(lower({rendered_url}), {quote(s)})" for s in LOGIN_SEGMENTS)
    return f"CASE WHEN {hit} THEN 'login wall detected in URL' END"


def _checks(doc: str, rendered_url: str, tier: int) -> list[str]:
    if tier == 4:
        return [*_first_hit(doc, CAPTCHA_WALLS, "captcha detected"), _login_url(rendered_url)]
    return [
        *_first_hit(doc, COOKIE_WALLS, "cookie consent wall"),
        _login_url(rendered_url),
        f"CASE WHEN {has_node(doc, PASSWORD_SELECTOR)} THEN 'login wall: password input present' END",
        *_first_hit(doc, CHALLENGE_WALLS, "cloudflare challenge"),
    ]


def wall_reason(doc: str, rendered_url: str, tier: str) -> Column:
    """First wall in the order of the row's tier. Tier 4 looks for captchas and login addresses only."""
    cases = " ".join(f"WHEN {t} THEN coalesce({', '.join(_checks(doc, rendered_url, t))})" for t in SELECTORS)
    return F.expr(f"CASE {tier} {cases} END")
