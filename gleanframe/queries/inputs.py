"""Inputs with known answers, composed from the columns of the given tables.

Every row of a table becomes one page or response, so the work grows with the table. The SQL of a
query reads the same columns and never parses HTML.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import pages_as_responses


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table; one with fewer row groups than cores is dealt over the cores, as parsing is CPU-bound."""
    rows, cores = spark.read.parquet(f"{folder}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < min(cores, 64) else rows


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return pages_as_responses(table(spark, folder, "pages"))


class Col(str):
    """Name of a column among the parts of a text."""


def text(*parts: Column | str) -> Column:
    """Parts joined to one text: columns, names of columns as Col, and plain text."""

    def part(p: Column | str) -> Column:
        if isinstance(p, Col):
            return F.col(p).cast("string")
        return F.lit(p) if isinstance(p, str) else p.cast("string")

    return F.concat(*map(part, parts))


def page(body: Column, head: Column | str = "") -> Column:
    return text("<!DOCTYPE html><html><head>", head, "</head><body>", body, "</body></html>")


def prose() -> Column:
    """Enough text to keep a small page from being hollow."""
    return F.lit("<p>" + "This page has text of its own. " * 8 + "</p>")


def as_pages(df: DataFrame, page_id: str, html: Column, *keep: str) -> DataFrame:
    """Rows as plain 200 responses with the composed HTML."""
    key = F.col(page_id)
    rows = df.select(key.alias("page_id"), text("https://example.com/", key).alias("url"), html.alias("html"), *keep)
    return pages_as_responses(rows, *keep)


def variant(key: str, n: int) -> Column:
    return (F.col(key) % n).cast("int")


def choose(selector: Column, *values: Column | str | None) -> Column:
    """values[selector]"""
    out = None
    for i, v in enumerate(values):
        value = F.lit(v) if v is None or isinstance(v, str) else v
        out = F.when(selector == i, value) if out is None else out.when(selector == i, value)
    return out


def event_responses(spark: SparkSession, folder: str) -> DataFrame:
    """One response per event, in twelve kinds of status and headers."""
    kind = variant("event_id", 12)
    odd = (F.floor(F.col("event_id") / 12) % 2).cast("int") == 1

    def headers(*pairs: tuple[str, Column | str]) -> Column:
        items = [F.lit("Content-Type"), F.array(F.lit("text/html")), F.lit("X-Empty"), F.array().cast("array<string>")]
        for name, value in pairs:
            v = F.lit(value) if isinstance(value, str) else value
            items += [F.lit(name), F.array(v, F.lit("second"))]
        return F.create_map(*items)

    wait = (F.col("user_id") % 50 + 1).cast("string")
    date = "Wed, 21 Oct 2026 07:28:00 GMT"
    return table(spark, folder, "events").select(
        F.col("event_id").alias("page_id"),
        text("https://example.com/event/", F.col("event_id")).alias("url"),
        choose(variant("event_id", 3), "", None, text("https://api.example.com/", F.col("event_id"))).alias("api_endpoint"),
        choose(kind, *[F.lit(s) for s in (200, 404, 401, 403, 429, 429, 503, 503, 500, 503, 404, 200)]).alias("status"),
        F.when(kind == 5, headers(("Retry-After", wait)))
        .when(kind == 6, headers(("retry-after", F.lit("2.5"))))
        .when(kind == 9, headers(("RETRY-AFTER", date)))
        .when(kind == 10, headers(("CF-Mitigated", "Challenge"), ("cf-ray", "8a")))
        .when(kind == 11, headers(("X-Powered-By", F.when(odd, "PHP/8.1, Next.js").otherwise("next.JS")), ("CF-RAY", "77")))
        .otherwise(headers())
        .alias("headers"),
        page(text("<p>", F.col("event_type"), " happened</p>"), text("<title>Event ", F.col("event_id"), "</title>"))
        .cast("binary")
        .alias("body"),
        F.col("event_type"),
        text("https://example.com/event/", F.col("event_id"), "/final").alias("final_url"),
        choose(variant("event_id", 4), "text/html; charset=utf-8", "application/json ;v=1", " text/plain ", "application/json").alias(
            "content_type"
        ),
        F.col("user_id").alias("elapsed_ms"),
        F.col("ts").cast("timestamp").alias("fetched_at"),
    )


# SQL of the gate over event_responses.
GATE_SQL = """
SELECT event_id AS page_id, ts, event_type, user_id,
       CAST(event_id % 12 AS INTEGER) AS kind,
       [200,404,401,403,429,429,503,503,500,503,404,200][CAST(event_id % 12 AS INTEGER) + 1] AS status,
       CASE event_id % 12 WHEN 1 THEN 'Abort' WHEN 2 THEN 'Abort' WHEN 3 THEN 'Abort' WHEN 4 THEN 'Backoff'
            WHEN 5 THEN 'Backoff' WHEN 6 THEN 'Backoff' WHEN 10 THEN 'Escalate' END AS gate,
       CASE event_id % 12 WHEN 5 THEN CAST(user_id % 50 + 1 AS DOUBLE) WHEN 6 THEN 2.5::DOUBLE ELSE 0.0::DOUBLE END AS retry_after_s
FROM events
"""


def signal_pages(spark: SparkSession, folder: str) -> DataFrame:
    """One page per customer; six bits of the key switch the page signals on and off.

    Pages are padded to exactly 5119 or 5120 bytes, with text or with a comment, and have 9 or 10 links.
    """
    key = F.col("c_custkey")

    def bit(n: int) -> Column:
        return F.shiftright(key, n).bitwiseAND(1) == 1

    def bitwise(yes: Column | str, no: Column | str, n: int) -> Column:
        as_col = [F.lit(v) if isinstance(v, str) else v for v in (yes, no)]
        return F.when(bit(n), as_col[0]).otherwise(as_col[1])

    links = F.repeat(F.lit('<a href="/x">l</a>'), bitwise(F.lit(10), F.lit(9), 3))
    parts = text(
        bitwise('<div class="g-recaptcha"></div>', "", 0),
        bitwise("<noscript>You need to ENABLE JavaScript</noscript>", "", 1),
        bitwise('<div id="root"> </div>', '<div id="root"><i></i></div>', 2),
        links,
        '<a href="/blank"> </a>',
    )
    size = bitwise(F.lit(5119), F.lit(5120), 5)
    missing = (size - F.octet_length(page(text(parts, "<!---->")))).cast("int")
    padding = bitwise(
        text("<!--", F.repeat(F.lit("x"), missing), "-->"), text("<p>", F.repeat(F.lit("x"), missing), "</p>"), 4
    )
    customers = table(spark, folder, "customer")
    return as_pages(customers, "c_custkey", page(text(parts, padding)))


SIGNAL_SQL = """
SELECT page_id, captcha, noscript, n_shells, n_links, link_rich, low_density, tiny,
       LEAST(1.0::DOUBLE, 0.0::DOUBLE + (CASE WHEN captcha THEN 0.95 ELSE 0.0 END)::DOUBLE
         + (CASE WHEN noscript THEN 0.90 ELSE 0.0 END)::DOUBLE + (CASE WHEN n_shells > 0 THEN 0.85 ELSE 0.0 END)::DOUBLE
         + (CASE WHEN low_density THEN 0.70 ELSE 0.0 END)::DOUBLE + (CASE WHEN tiny THEN 0.50 ELSE 0.0 END)::DOUBLE) AS score
FROM (SELECT c_custkey AS page_id, c_custkey & 1 > 0 AS captcha, c_custkey & 2 > 0 AS noscript,
             CASE WHEN c_custkey & 4 > 0 THEN 1 ELSE 0 END AS n_shells,
             CASE WHEN c_custkey & 8 > 0 THEN 10 ELSE 9 END AS n_links,
             c_custkey & 8 > 0 AS link_rich,
             c_custkey & 8 = 0 AND c_custkey & 16 > 0 AS low_density,
             c_custkey & 8 = 0 AND c_custkey & 32 > 0 AS tiny
      FROM customer)
"""
