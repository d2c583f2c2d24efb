"""Parse, selectors and page signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.html import FULL_TEXT, NO_TEXT, node_text, parse_html
from ..functions.selectors import attr, select_nodes
from ..functions.text import let, trim_space
from ..operators.merge import explode_fields
from ..operators.signals import SELECTORS, page_facts, page_signals
from ..options import Options
from ..plans.analyze import analyze, classify, extract_pages
from ..plans.links import link_table
from .inputs import SIGNAL_SQL, Col, as_pages, page, pages, prose, signal_pages, table, text, variant
from .registry import query

# Titles of the pages table hold two entities, one of them also cut off before its semicolon.
_DECODED = "trim(regexp_replace(replace({x}, '&quot;', '\"'), '&amp;?', '&', 'g'))"
_TITLE_SQL = _DECODED.format(x="regexp_extract(html, '<title>(.*?)</title>', 1)")
_TINY = "strlen(html) < 5120"


def _parsed(spark: SparkSession, folder: str, wanted: dict[str, int]) -> DataFrame:
    return pages(spark, folder).select("page_id", parse_html(F.col("body"), wanted).alias("doc"))


@query(
    "h1_parse",
    f"SELECT page_id, true AS parsed, {_TITLE_SQL} AS title, 'head' AS parent_tag FROM pages",
)
def h1_parse(spark: SparkSession, folder: str) -> DataFrame:
    """One parse per page. The title hangs below the head, found through the parent number."""
    parsed = _parsed(spark, folder, {"title": FULL_TEXT, "head": NO_TEXT})
    title = "get(filter(doc.nodes, n -> n.tag = 'title'), 0)"
    parent = let(title, "t", "get(filter(doc.nodes, n -> n.idx = t.parent), 0).tag")
    return parsed.select(
        "page_id",
        F.expr("doc.nodes IS NOT NULL").alias("parsed"),
        F.expr(trim_space(let(title, "t", node_text("t")))).alias("title"),
        F.expr(parent).alias("parent_tag"),
    )


_SELECTORS = {
    "a[href]": "len(regexp_extract_all(html, '<a href='))",
    ".ad": "1",
    "nav, footer": "2",
    'html[lang="en"]': "CASE WHEN contains(html, '<html lang=\"en\"') THEN 1 ELSE 0 END",
    "script:not([src])": "1",
    "meta[charset*=utf]": "1",
    "li#none": "0",
}


@query(
    "h2_selector_match",
    " UNION ALL ".join(
        f"SELECT page_id, '{s}' AS selector, CAST({n} AS BIGINT) AS n_nodes FROM pages" for s, n in _SELECTORS.items()
    ),
)
def h2_selector_match(spark: SparkSession, folder: str) -> DataFrame:
    parsed = _parsed(spark, folder, {s: NO_TEXT for s in _SELECTORS})
    counts = [
        F.struct(F.lit(s).alias("selector"), F.expr(f"bigint(size({select_nodes('doc', s)}))").alias("n_nodes"))
        for s in _SELECTORS
    ]
    return parsed.select("page_id", F.explode(F.array(*counts)).alias("r")).select("page_id", "r.*")


@query(
    "h3_subtree_text",
    f"""SELECT page_id, {_DECODED.format(x="regexp_extract(html, '<h1>(.*?)</h1>', 1)")} AS heading,
               'var t="</p>";track(' || page_id || ');' AS script, 'p{{margin:0}}' AS style FROM pages""",
)
def h3_subtree_text(spark: SparkSession, folder: str) -> DataFrame:
    """Text of a heading, and of script and style, which count as text too."""
    parsed = _parsed(spark, folder, {"h1": FULL_TEXT, "script": FULL_TEXT, "style": FULL_TEXT})

    def first(tag: str) -> str:
        return trim_space(f"get(transform({select_nodes('doc', tag)}, n -> {node_text('n')}), 0)")

    return parsed.select(
        "page_id", F.expr(first("h1")).alias("heading"), F.expr(first("script")).alias("script"), F.expr(first("style")).alias("style")
    )


_NESTED = 200


@query(
    "h3_nested_text",
    f"SELECT s_suppkey AS page_id, {_NESTED} AS n_fields, {_NESTED}::BIGINT * length(s_name) AS chars, s_name AS deepest FROM supplier",
)
def h3_nested_text(spark: SparkSession, folder: str) -> DataFrame:
    """Two hundred nested elements that all have the same text: the page's text leaves the parse once."""
    opened = "".join(f'<div itemprop="p{i}">' for i in range(_NESTED))
    rows = as_pages(table(spark, folder, "supplier"), "s_suppkey", page(text(opened, Col("s_name"))))
    fields = analyze(rows).select("page_id", F.map_filter("fields", lambda k, f: f["source"] == "microdata").alias("f"))
    chars = F.aggregate(F.map_values("f"), F.lit(0).cast("bigint"), lambda n, f: n + F.length(f["value"]))
    return fields.select("page_id", F.size("f").alias("n_fields"), chars.alias("chars"), F.col("f")[f"p{_NESTED - 1}"]["value"].alias("deepest"))


@query(
    "h4_child_count",
    "SELECT page_id, CAST(len(regexp_extract_all(html, '<li>')) AS INTEGER) AS list_items, 1 AS nav_children FROM pages",
)
def h4_child_count(spark: SparkSession, folder: str) -> DataFrame:
    parsed = _parsed(spark, folder, {"ul": NO_TEXT, "nav": NO_TEXT})
    return parsed.select(
        "page_id",
        F.expr(f"get({select_nodes('doc', 'ul')}, 0).n_children").alias("list_items"),
        F.expr(f"get({select_nodes('doc', 'nav')}, 0).n_children").alias("nav_children"),
    )


@query(
    "h5_attribute_read",
    "SELECT page_id, regexp_extract(html, '<html lang=\"(.*?)\"', 1) AS lang, 'utf-8' AS charset, CAST(NULL AS VARCHAR) AS dir FROM pages",
)
def h5_attribute_read(spark: SparkSession, folder: str) -> DataFrame:
    parsed = _parsed(spark, folder, {"html": NO_TEXT, "meta[charset]": NO_TEXT})
    root, meta = (f"get({select_nodes('doc', s)}, 0)" for s in ("html", "meta[charset]"))
    return parsed.select(
        "page_id",
        F.expr(let(root, "r", attr("r", "lang"))).alias("lang"),
        F.expr(let(meta, "m", attr("m", "charset"))).alias("charset"),
        F.expr(let(root, "r", attr("r", "dir"))).alias("dir"),
    )


@query(
    "h6_link_table",
    """SELECT page_id, regexp_extract(a, '<a href="(.*?)">', 1) AS href, regexp_extract(a, '>(.*?)</a>', 1) AS text
       FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=".*?">.*?</a>')) AS a FROM pages)""",
)
def h6_link_table(spark: SparkSession, folder: str) -> DataFrame:
    return link_table(pages(spark, folder))


@query(
    "page_class_only",
    f"""SELECT page_id, CASE WHEN {_TINY} THEN 'mixed' ELSE 'content-rich' END AS page_type,
               CASE WHEN {_TINY} THEN 'tiny-body' ELSE '' END AS signals FROM pages""",
)
def page_class_only(spark: SparkSession, folder: str) -> DataFrame:
    """Classes without extraction: the parse is pruned to what the signals need."""
    return classify(pages(spark, folder)).select("page_id", "page_type", F.array_join("signals", ",").alias("signals"))


@query(
    "page_class",
    f"""SELECT page_id, CASE WHEN {_TINY} THEN 'mixed' ELSE 'content-rich' END AS page_type,
               CASE WHEN {_TINY} THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS page_type_confidence,
               CASE WHEN {_TINY} THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS hollow_score, 'Done' AS decision FROM pages""",
)
def page_class(spark: SparkSession, folder: str) -> DataFrame:
    return analyze(pages(spark, folder)).select("page_id", "page_type", "page_type_confidence", "hollow_score", "decision")


@query(
    "page_fields",
    f"SELECT page_id, 'title' AS key, {_TITLE_SQL} AS value, 'meta-tags' AS source, 0.88::DOUBLE AS confidence, 5 AS priority FROM pages",
)
def page_fields(spark: SparkSession, folder: str) -> DataFrame:
    return explode_fields(analyze(pages(spark, folder)).select("page_id", "fields"), "*")


def _signals(spark: SparkSession, folder: str, options: Options | None = None) -> DataFrame:
    extracted = extract_pages(signal_pages(spark, folder), options)
    return extracted.withColumn(
        "facts", F.when(F.expr("doc.nodes IS NOT NULL"), F.expr(page_facts("doc", "body_bytes")))
    )


def _fired(spark: SparkSession, folder: str, signal: str) -> DataFrame:
    return _signals(spark, folder).select("page_id", F.array_contains("page.signals", signal).alias("fired"))


def _signal_query(name: str, signal: str, column: str) -> None:
    @query(name, f"SELECT page_id, {column} AS fired FROM ({SIGNAL_SQL})")
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return _fired(spark, folder, signal)


_signal_query("c1_captcha", "captcha", "captcha")
_signal_query("c2_noscript_message", "noscript-message", "noscript")
_signal_query("c5_low_text_density", "low-text-density", "low_density")
_signal_query("c6_tiny_body", "tiny-body", "tiny")


@query(
    "c5_density_of_bytes",
    """SELECT c_custkey AS page_id, CASE WHEN n / (6010 + n)::DOUBLE < 0.05::DOUBLE THEN 'app-shell' ELSE 'content-rich' END AS page_type
       FROM (SELECT c_custkey, 250 + c_custkey % 200 AS n FROM customer)""",
)
def c5_density_of_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """Pages that are not UTF-8, on both sides of the limit: their text counts as many bytes as it came in."""
    letters = F.expr("repeat('é', CAST(250 + c_custkey % 200 AS INT))")
    rows = as_pages(table(spark, folder, "customer"), "c_custkey", text("<!--", "x" * 6000, "--><p>", letters))
    return classify(rows.withColumn("body", F.encode(F.col("body").cast("string"), "ISO-8859-1"))).select("page_id", "page_type")


@query(
    "c3_empty_app_shell",
    """SELECT c_custkey AS page_id, CAST(c_custkey % 4 AS INTEGER) AS n_shells, LEAST(1.0::DOUBLE,
              0.0::DOUBLE + (CASE WHEN c_custkey % 4 > 0 THEN 0.3 ELSE 0 END)::DOUBLE + (CASE WHEN c_custkey % 4 > 1 THEN 0.3 ELSE 0 END)::DOUBLE
              + (CASE WHEN c_custkey % 4 > 2 THEN 0.3 ELSE 0 END)::DOUBLE) AS hollow_score FROM customer""",
)
def c3_empty_app_shell(spark: SparkSession, folder: str) -> DataFrame:
    """Each empty root adds its penalty; roots with a child or with text do not."""
    shells = [F.lit('<div id="app"></div>'), F.lit('<div id="root"> </div>'), F.lit('<div id="__next">\n</div>')]
    parts = [F.when(variant("c_custkey", 4) > i, s).otherwise(F.lit("")) for i, s in enumerate(shells)]
    html = page(text(*parts, '<div id="app"><b></b></div><p id="root"></p>', prose()))
    options = Options(tiny_body_bytes=1, penalties={"empty-app-shell": 0.3})
    extracted = extract_pages(as_pages(table(spark, folder, "customer"), "c_custkey", html), options)
    facts = F.expr(page_facts("doc", "body_bytes"))
    return extracted.select("page_id", facts["n_shells"].alias("n_shells"), F.col("page.hollow_score"))


@query(
    "c4_link_rich",
    f"SELECT page_id, n_links, link_rich FROM ({SIGNAL_SQL})",
)
def c4_link_rich(spark: SparkSession, folder: str) -> DataFrame:
    return _signals(spark, folder).select("page_id", "facts.n_links", (F.col("facts.n_links") >= 10).alias("link_rich"))


def _challenged(spark: SparkSession, folder: str) -> DataFrame:
    """The scorer used alone, with the challenge hint set on every third page."""
    parsed = signal_pages(spark, folder).select("page_id", parse_html(F.col("body"), SELECTORS).alias("doc"), "body")
    page_column = page_signals("doc", "octet_length(body)", "page_id % 3 = 0", Options())
    return parsed.select("page_id", page_column.alias("page"))


@query(
    "c7_challenge_penalty",
    f"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 1.0::DOUBLE ELSE score END AS hollow_score, score AS total,
               page_id % 3 = 0 AS challenged FROM ({SIGNAL_SQL})""",
)
def c7_challenge_penalty(spark: SparkSession, folder: str) -> DataFrame:
    return _challenged(spark, folder).select(
        "page_id", "page.hollow_score", "page.total", F.array_contains("page.signals", "cf-challenge").alias("challenged")
    )


@query(
    "c8_penalty_lookup",
    f"""SELECT page_id, LEAST(1.0::DOUBLE, 0.0::DOUBLE + (CASE WHEN noscript THEN 0.9 ELSE 0 END)::DOUBLE
               + (CASE WHEN n_shells > 0 THEN 0.2 ELSE 0 END)::DOUBLE + (CASE WHEN low_density THEN 0.7 ELSE 0 END)::DOUBLE
               + (CASE WHEN tiny THEN 0.125 ELSE 0 END)::DOUBLE) AS hollow_score FROM ({SIGNAL_SQL})""",
)
def c8_penalty_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """A configured penalty counts even when it is 0; the others keep their defaults."""
    options = Options(penalties={"captcha": 0.0, "empty-app-shell": 0.2, "tiny-body": 0.125})
    return _signals(spark, folder, options).select("page_id", "page.hollow_score")


@query("c9_score", f"SELECT page_id, score AS hollow_score, score >= 0.7::DOUBLE AS is_hollow FROM ({SIGNAL_SQL})")
def c9_score(spark: SparkSession, folder: str) -> DataFrame:
    return _signals(spark, folder).select("page_id", "page.hollow_score", "page.is_hollow")


@query(
    "c10_page_type",
    f"""SELECT page_id, CASE WHEN score >= 0.7::DOUBLE THEN 'app-shell' WHEN link_rich THEN 'link-rich'
               WHEN score = 0 THEN 'content-rich' ELSE 'mixed' END AS page_type FROM ({SIGNAL_SQL})""",
)
def c10_page_type(spark: SparkSession, folder: str) -> DataFrame:
    return _signals(spark, folder).select("page_id", "page.page_type")


@query(
    "c11_type_confidence",
    f"""SELECT page_id, CASE WHEN score >= 0.7::DOUBLE THEN score
               WHEN link_rich THEN LEAST(0.5::DOUBLE + n_links / 10::DOUBLE * 0.2::DOUBLE, 0.95::DOUBLE)
               ELSE 1::DOUBLE - score END AS page_type_confidence FROM ({SIGNAL_SQL})""",
)
def c11_type_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return _signals(spark, folder).select("page_id", "page.page_type_confidence")


@query(
    "c12_challenge_override",
    f"""SELECT page_id, CASE WHEN page_id % 3 = 0 OR score >= 0.7::DOUBLE THEN 'app-shell' WHEN link_rich THEN 'link-rich'
               WHEN score = 0 THEN 'content-rich' ELSE 'mixed' END AS page_type,
               CASE WHEN page_id % 3 = 0 THEN 1::DOUBLE WHEN score >= 0.7::DOUBLE THEN score WHEN link_rich THEN 0.7::DOUBLE
               ELSE 1::DOUBLE - score END AS page_type_confidence FROM ({SIGNAL_SQL})""",
)
def c12_challenge_override(spark: SparkSession, folder: str) -> DataFrame:
    return _challenged(spark, folder).select("page_id", "page.page_type", "page.page_type_confidence")


@query(
    "c13_penalty_map",
    " UNION ALL ".join(
        f"SELECT page_id, '{name}' AS signal, {penalty}::DOUBLE AS penalty FROM ({SIGNAL_SQL}) WHERE {when}"
        for name, penalty, when in (
            ("captcha", 0.95, "captcha"),
            ("noscript-message", 0.9, "noscript"),
            ("empty-app-shell", 0.85, "n_shells > 0"),
            ("low-text-density", 0.7, "low_density"),
            ("tiny-body", 0.5, "tiny"),
        )
    ),
)
def c13_penalty_map(spark: SparkSession, folder: str) -> DataFrame:
    scored = _signals(spark, folder).select("page_id", F.explode_outer("page.penalties").alias("signal", "penalty"))
    return scored.filter(F.col("signal").isNotNull())

