"""Link table of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.html import FULL_TEXT, node_text, parse_html
from ..functions.selectors import attr
from ..functions.text import trim_space
from ..operators.signals import text_links
from ..options import Options
from ..session import configure
from ..sources.tables import cap_body, drop_blocked


def link_table(responses: DataFrame, options: Options | None = None, key: str = "page_id") -> DataFrame:
    """(key, href, text) of every ``a`` element that has text, in document order within a page."""
    configure(responses.sparkSession)
    options = options or Options()
    doc = parse_html(cap_body(F.col("body"), options.max_body_bytes), {"a": FULL_TEXT})
    link = f"named_struct('href', {attr('n', 'href')}, 'text', {trim_space(node_text('n'))})"
    links = F.expr(f"transform({text_links('doc')}, n -> {link})")
    rows = responses.select(key, doc.alias("doc")).select(key, F.explode(links).alias("link"))
    return rows.select(key, "link.*")


def followable_links(responses: DataFrame, options: Options | None = None, key: str = "page_id", tier: int = 3) -> DataFrame:
    """Links with an address that the block list of the tier lets through."""
    options = options or Options()
    return drop_blocked(link_table(responses, options, key).filter(F.col("href").isNotNull()), options.blocked_in(tier), "href")
