"""Phases, merge, decision and the text fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import PROMPT
from ..operators.fallback import apply_completions, completion_result
from ..operators.merge import explode_fields, merge_candidates
from ..options import Options
from ..plans.analyze import analyze, candidates, extract_pages
from ..plans.prompts import prompts, readable_text
from .inputs import Col, as_pages, choose, page, prose, table, text, variant
from .registry import query

_LD = '<script type="application/ld+json">{"name":"ld"}</script>'
_BAD = '<script type="application/ld+json">{"name":</script>'
_META = '<meta name="description" content="meta">'


def hollow_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Shells with: nothing, good JSON-LD, good and bad JSON-LD, meta only, good JSON-LD and meta; and a page with text."""
    head = choose(variant("p_partkey", 6), "", _LD, _LD + _BAD, _META, _LD + _META, _META)
    body = F.when(variant("p_partkey", 6) == 5, prose()).otherwise(F.lit('<div id="root"></div>'))
    return as_pages(table(spark, folder, "part"), "p_partkey", page(body, head), "p_name")


@query(
    "m2_any_fields",
    "SELECT p_partkey AS page_id, p_partkey % 6 IN (1, 2, 4) AS any_in_first_phase FROM part",
)
def m2_any_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of a first-phase extractor count even when its error flag is set."""
    from ..operators.merge import any_fields

    extracted = extract_pages(hollow_pages(spark, folder))
    names = [f"x_{n}" for n in ("json-ld", "next-data", "state-globals", "inline-vars")]
    return extracted.select("page_id", F.expr(any_fields(names)).alias("any_in_first_phase"))


@query(
    "m3_second_phase_skip",
    """SELECT p_partkey AS page_id, p_partkey % 6 <> 5 AS is_hollow, p_partkey % 6 IN (1, 2, 4) AS skipped,
              p_partkey % 6 IN (3, 5) AS has_meta FROM part""",
)
def m3_second_phase_skip(spark: SparkSession, folder: str) -> DataFrame:
    extracted = extract_pages(hollow_pages(spark, folder))
    has_meta = F.coalesce(F.size("x_meta-tags.entries") > 0, F.lit(False))
    return extracted.select(
        "page_id", F.col("page.is_hollow"), F.col("skip_second").alias("skipped"), has_meta.alias("has_meta")
    )


def _ranked_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Every extractor writes the key ``price``; a rotating set of them is present."""
    sources = [
        '<script type="application/ld+json">{"price":"1"}</script>',
        '<script id="__NEXT_DATA__">{"price":"2"}</script>',
        '<script>window.__NUXT__={"price":"3"};</script>',
        '<script>var PRICE={"price":"4"};</script>',
        '<meta property="price" content="5">',
        '<b itemprop="price">6</b>',
        '<i class="card" data-price="7"></i>',
        '<input type="hidden" name="price" value="8">',
        '<u class="hidden" id="price">9</u>',
        '<em class="amount">10</em>',
    ]
    key = F.col("p_partkey")
    # Bit i of the key + 1 says whether source i is there; the last source always is.
    parts = [
        F.when((F.shiftright(key + 1, i).bitwiseAND(1) == 1) | F.lit(i == 9), F.lit(s)).otherwise(F.lit("")) for i, s in enumerate(sources)
    ]
    return as_pages(table(spark, folder, "part"), "p_partkey", page(text(*parts, prose())))


_DOM_PRICE = Options(dom_text_selectors={"price": ".amount"})
# The RDFa reading of <meta property> makes microdata present whenever meta tags are, at a weaker priority.
_RANK_SQL = """
SELECT page_id, 'price' AS key, CAST(rank AS VARCHAR) AS value,
       ['json-ld','next-data','state-globals','inline-vars','meta-tags','microdata','data-attrs','hidden-inputs','css-hidden','dom-text'][rank] AS source,
       [0.95,0.92,0.85,0.75,0.88,0.82,0.78,0.72,0.60,0.55][rank]::DOUBLE AS confidence, rank AS priority
FROM (SELECT p_partkey AS page_id, CAST(COALESCE(list_min([i for i in [1,2,3,4,5,6,7,8,9] if ((p_partkey + 1) >> (i - 1)) & 1 = 1]), 10) AS INTEGER) AS rank
      FROM part)
"""


@query("m5_priority_merge", _RANK_SQL)
def m5_priority_merge(spark: SparkSession, folder: str) -> DataFrame:
    result = analyze(_ranked_pages(spark, folder), _DOM_PRICE)
    return explode_fields(result.select("page_id", "fields"), "*")


@query("m5_priority_merge_of_rows", _RANK_SQL)
def m5_priority_merge_of_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The same merge on a table of candidates."""
    return merge_candidates(candidates(_ranked_pages(spark, folder), _DOM_PRICE), "page_id")


@query(
    "m6_script_data",
    "SELECT p_partkey AS page_id, p_partkey % 6 IN (1, 4) AS has_script_data FROM part",
)
def m6_script_data(spark: SparkSession, folder: str) -> DataFrame:
    return extract_pages(hollow_pages(spark, folder)).select("page_id", "has_script_data")


@query(
    "m7_decision",
    """SELECT p_partkey AS page_id, CASE WHEN p_partkey % 6 IN (0, 2) THEN 'Escalate' ELSE 'Done' END AS decision,
              CASE WHEN p_partkey % 6 IN (0, 2) THEN 0 ELSE 1 END AS n_fields FROM part""",
)
def m7_decision(spark: SparkSession, folder: str) -> DataFrame:
    """A hollow page without a merged field escalates, also when an error flag cost it its only fields."""
    return analyze(hollow_pages(spark, folder)).select("page_id", "decision", F.size("fields").alias("n_fields"))


@query(
    "m7_decision_escalate_empty",
    """SELECT page_id, CASE WHEN strlen(html) < 5120 THEN 'mixed' ELSE 'content-rich' END AS page_type, 'Escalate' AS decision FROM pages""",
)
def m7_decision_escalate_empty(spark: SparkSession, folder: str) -> DataFrame:
    """The option that escalates every page without a field."""
    from .inputs import pages

    options = Options(escalate_empty=True, min_confidence=0.99)
    return analyze(pages(spark, folder), options).select("page_id", "page_type", "decision")


@query(
    "m8_analysis_row",
    """SELECT p_partkey AS page_id, CASE WHEN p_partkey % 6 IN (0, 2) THEN 'Escalate' ELSE 'Done' END AS decision,
              CASE WHEN p_partkey % 6 = 5 THEN 'mixed' ELSE 'app-shell' END AS page_type,
              CASE WHEN p_partkey % 6 = 5 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS page_type_confidence,
              CASE WHEN p_partkey % 6 = 5 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS hollow_score, 0.0::DOUBLE AS retry_after_s,
              false AS is_cloudflare FROM part""",
)
def m8_analysis_row(spark: SparkSession, folder: str) -> DataFrame:
    return analyze(hollow_pages(spark, folder)).select(
        "page_id", "decision", "page_type", "page_type_confidence", "hollow_score", "retry_after_s", "tech_hints.is_cloudflare"
    )


# A hollow page that still has readable text: it is large, and its text is small against its bytes.
def _document_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Articles around document texts; every other one is an empty shell beside its article."""
    safe = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    shell = F.when(variant("doc_id", 2) == 0, F.lit('<div id="root"></div>')).otherwise(F.lit(""))
    body = text(
        shell, '<nav><a href="/">Home of boilerplate links and menus</a></nav><article><h1>Story ', Col("doc_id"), "</h1><p>", safe,
        "</p></article><footer><p>Boilerplate footer text that is long enough to be a block</p></footer>",
    )
    return as_pages(table(spark, folder, "documents"), "doc_id", page(body))


@query(
    "l1_eligibility",
    "SELECT doc_id AS page_id, doc_id % 2 = 0 AS eligible FROM documents",
)
def l1_eligibility(spark: SparkSession, folder: str) -> DataFrame:
    from ..operators.fallback import is_eligible

    result = analyze(_document_pages(spark, folder), Options(tiny_body_bytes=1))
    return result.select("page_id", is_eligible(F.col("decision"), F.col("fields"), F.col("page_type")).alias("eligible"))


@query(
    "l2_clean_text",
    "SELECT doc_id AS page_id, true AS has_heading, true AS within_limit, true AS without_boilerplate, true AS is_full FROM documents",
)
def l2_clean_text(spark: SparkSession, folder: str) -> DataFrame:
    """Readable text of every article: starts with its heading, keeps the limit in bytes, holds no boilerplate.

    is_full is true if the text is as long as the limit allows or the article is short.
    """
    cleaned = readable_text(_document_pages(spark, folder), Options(max_text_bytes=400))
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("page_id"), F.octet_length("text").alias("n"))
    # A cut character can become a replacement mark of three bytes.
    size = F.octet_length("clean_text")
    return cleaned.join(texts, "page_id").select(
        "page_id",
        F.startswith("clean_text", text("Story ", Col("page_id"))).alias("has_heading"),
        (size <= 402).alias("within_limit"),
        (~F.contains("clean_text", F.lit("oilerplate"))).alias("without_boilerplate"),
        ((F.col("n") < 500) | (size >= 397)).alias("is_full"),
    )


@query(
    "l3_prompt",
    """SELECT page_id, md5(head || text) AS prompt_md5 FROM (SELECT page_id, '{head}' AS head,
              'You need to enable JavaScript to run page ' || page_id || ', which shows the whole story.' AS text FROM pages)""".replace(
        "{head}", PROMPT.split("%s")[0].replace("'", "''")
    ),
)
def l3_prompt(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts of shells around a line of text, one per page of the table."""
    from .inputs import pages

    line = text("You need to enable JavaScript to run page ", Col("page_id"), ", which shows the whole story.")
    body = page(text('<nav>Menu of the site, long enough for a block</nav><div id="app"></div><p>', line, "</p>"))
    shells = pages(spark, folder).withColumn("body", body.cast("binary"))
    return prompts(shells).select("page_id", F.md5("prompt").alias("prompt_md5"))


def _completions(key: Column) -> Column:
    """Good / fenced / fenced on two lines / a value that is no string / blanks and null / broken / trailing text."""
    good = text('{"title":"T', key, '","price":"$9"}')
    return choose(
        variant("page_id", 7),
        good,
        text(" ```json\n", good, "\n``` "),
        text("```\n", good),
        text('{"title":"T', key, '","price":9}'),
        text('{"title":"T', key, '","price":" ","author":null}'),
        "not json at all",
        text(good, " thanks"),
    )


@query(
    "l4_completion_parse",
    """SELECT doc_id AS page_id, doc_id % 7 IN (2, 3, 5, 6) AS err, CASE doc_id % 7 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 4 THEN 1 ELSE 0 END AS n_fields,
              CASE WHEN doc_id % 7 IN (0, 1, 4) THEN 'T' || doc_id END AS title FROM documents""",
)
def l4_completion_parse(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("page_id"))
    parsed = docs.select("page_id", _completions(F.col("page_id")).alias("completion")).select(
        "page_id", completion_result("completion", "CAST(NULL AS STRING)").alias("r")
    )
    return parsed.select(
        "page_id", "r.err", F.size("r.fields").alias("n_fields"), F.try_element_at("r.fields", F.lit("title")).alias("title")
    )


@query(
    "l5_fallback_merge",
    """SELECT doc_id AS page_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 7 NOT IN (0, 1, 4) THEN 'Escalate' ELSE 'Done' END AS decision,
              CASE WHEN doc_id % 2 = 0 AND doc_id % 7 IN (0, 1, 4) THEN 'T' || doc_id END AS title,
              CASE WHEN doc_id % 2 = 0 AND doc_id % 7 IN (0, 1, 4) THEN 'llm' END AS source,
              CASE WHEN doc_id % 2 = 0 AND doc_id % 7 IN (0, 1, 4) THEN 0.3::DOUBLE END AS confidence FROM documents""",
)
def l5_fallback_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Only eligible rows take their completion; the minimum confidence does not apply."""
    options = Options(tiny_body_bytes=1, fallback_confidence=0.3)
    responses = _document_pages(spark, folder)
    completions = responses.select(
        "page_id", _completions(F.col("page_id")).alias("completion"), F.lit(None).cast("string").alias("error")
    )
    result = apply_completions(analyze(responses, options), completions, options)
    title = F.try_element_at("fields", F.lit("title"))
    return result.select("page_id", "decision", title["value"].alias("title"), title["source"].alias("source"), title["confidence"].alias("confidence"))
