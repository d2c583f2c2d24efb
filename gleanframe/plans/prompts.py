"""Prompts for pages on which structured extraction found nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.html import text_blocks
from ..operators import signals
from ..operators.fallback import clean_text, is_eligible, prompt_text
from ..options import Options
from ..sources.tables import cap_body
from .analyze import computed_once, extract_pages


def readable_text(responses: DataFrame, options: Options | None = None, key: str = "page_id") -> DataFrame:
    """(key, clean_text) of every response."""
    options = options or Options()
    body = cap_body(F.coalesce(F.col("body"), F.lit(b"")), options.max_body_bytes)
    blocks = responses.select(key, text_blocks(body).alias("blocks"))
    return blocks.select(key, computed_once(clean_text("blocks", options.max_text_bytes).alias("clean_text")))


def prompts(responses: DataFrame, options: Options | None = None, key: str = "page_id") -> DataFrame:
    """(key, clean_text, prompt) of the rows that escalate without a field and have readable text.

    Bodies of other rows go into the second parse as NULL: those rows cost next to nothing there.
    """
    options = options or Options()
    page_type = F.coalesce(F.col("page.page_type"), F.lit(""))
    enabled = F.lit(options.fallback_enabled)
    eligible = enabled & is_eligible(F.col("decision"), F.col("fields"), page_type)
    pages = extract_pages(responses, options, signals.DECIDING).select(key, "body", computed_once(eligible.alias("eligible")))
    body = F.when(F.col("eligible"), cap_body(F.coalesce(F.col("body"), F.lit(b"")), options.max_body_bytes))
    return prompts_of(pages.select(key, body.alias("body")), options, key)


def prompts_of(pages: DataFrame, options: Options, *keys: str) -> DataFrame:
    """(keys, clean_text, prompt) of the bodies with readable text; a NULL body has none."""
    texts = pages.select(*keys, text_blocks(F.col("body")).alias("blocks")).select(
        *keys, F.array(clean_text("blocks", options.max_text_bytes)).alias("texts")
    )
    # An explode instead of a filter, which would be pushed below the parse and repeat it.
    found = texts.select(*keys, F.explode(F.filter("texts", lambda t: t != "")).alias("clean_text"))
    return found.select(*keys, "clean_text", prompt_text(F.col("clean_text")).alias("prompt"))
