"""Sources, projections and the header gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extractors import phase_of
from ..operators.gate import due_backoffs, header, with_gate
from ..operators.merge import explode_fields
from ..options import ExtractorOption, Options
from ..plans.analyze import analyze, candidates
from ..plans.cascade import public_result
from ..sources import tables as src
from .inputs import GATE_SQL, Col, as_pages, choose, event_responses, page, pages, prose, table, text, variant
from .registry import query


@query(
    "s1_responses",
    """SELECT page_id, url, 200 AS status, 'text/html' AS content_type, CAST(strlen(html) AS BIGINT) AS body_bytes,
              CAST(0 AS BIGINT) AS n_headers FROM pages""",
)
def s1_responses(spark: SparkSession, folder: str) -> DataFrame:
    return pages(spark, folder).select(
        "page_id",
        "url",
        "status",
        "content_type",
        F.octet_length("body").cast("bigint").alias("body_bytes"),
        F.size("headers").cast("bigint").alias("n_headers"),
    )


@query(
    "s2_fetch_target",
    """SELECT event_id AS page_id, CASE WHEN event_id % 3 = 2 THEN 'https://api.example.com/' || event_id
              ELSE 'https://example.com/event/' || event_id END AS target FROM events""",
)
def s2_fetch_target(spark: SparkSession, folder: str) -> DataFrame:
    return event_responses(spark, folder).select(
        "page_id", src.fetch_target(F.col("url"), F.col("api_endpoint")).alias("target")
    )


@query(
    "s3_media_type",
    """SELECT event_id AS page_id, ['text/html','application/json',' text/plain ','application/json'][CAST(event_id % 4 AS INTEGER) + 1]
              AS media_type FROM events""",
)
def s3_media_type(spark: SparkSession, folder: str) -> DataFrame:
    return event_responses(spark, folder).select("page_id", src.media_type(F.col("content_type")).alias("media_type"))


@query(
    "s4_body_cap",
    "SELECT page_id, CAST(LEAST(strlen(html), 2000) AS BIGINT) AS body_bytes, md5(html[1:700]) AS head FROM pages",
)
def s4_body_cap(spark: SparkSession, folder: str) -> DataFrame:
    capped = pages(spark, folder).withColumn("body", src.cap_body(F.col("body"), 2000))
    # 700 characters are at most 2,000 bytes here, so the head of the text survives the cap.
    head = F.make_valid_utf8(F.col("body").cast("string"))
    return capped.select(
        "page_id", F.octet_length("body").cast("bigint").alias("body_bytes"), F.md5(F.substring(head, 1, 700)).alias("head")
    )


_HEADER_SQL = f"""
SELECT page_id, 'Content-Type' AS name, 'text/html' AS value FROM ({GATE_SQL})
UNION ALL SELECT page_id, 'Retry-After', CAST(user_id % 50 + 1 AS VARCHAR) FROM ({GATE_SQL}) WHERE kind = 5
UNION ALL SELECT page_id, 'retry-after', '2.5' FROM ({GATE_SQL}) WHERE kind = 6
UNION ALL SELECT page_id, 'RETRY-AFTER', 'Wed, 21 Oct 2026 07:28:00 GMT' FROM ({GATE_SQL}) WHERE kind = 9
UNION ALL SELECT page_id, 'CF-Mitigated', 'Challenge' FROM ({GATE_SQL}) WHERE kind = 10
UNION ALL SELECT page_id, 'cf-ray', '8a' FROM ({GATE_SQL}) WHERE kind = 10
UNION ALL SELECT page_id, 'CF-RAY', '77' FROM ({GATE_SQL}) WHERE kind = 11
UNION ALL SELECT page_id, 'X-Powered-By', CASE WHEN (page_id // 12) % 2 = 1 THEN 'PHP/8.1, Next.js' ELSE 'next.JS' END
          FROM ({GATE_SQL}) WHERE kind = 11
"""


@query("s5_header_flatten", _HEADER_SQL)
def s5_header_flatten(spark: SparkSession, folder: str) -> DataFrame:
    return event_responses(spark, folder).select(
        "page_id", F.explode(src.flatten_headers(F.col("headers"))).alias("name", "value")
    )


@query(
    "s6_header_lookup",
    f"""SELECT page_id, CASE kind WHEN 5 THEN CAST(user_id % 50 + 1 AS VARCHAR) WHEN 6 THEN '2.5'
               WHEN 9 THEN 'Wed, 21 Oct 2026 07:28:00 GMT' ELSE '' END AS retry_after,
               CASE kind WHEN 10 THEN '8a' WHEN 11 THEN '77' ELSE '' END AS cf_ray, '' AS empty_header FROM ({GATE_SQL})""",
)
def s6_header_lookup(spark: SparkSession, folder: str) -> DataFrame:
    names = {"retry_after": "Retry-After", "cf_ray": "CF-Ray", "empty_header": "x-empty"}
    found = [F.expr(header("headers", name)).alias(column) for column, name in names.items()]
    return event_responses(spark, folder).select("page_id", *found)


@query(
    "s7_stored_round_trip",
    f"""SELECT CAST(page_id AS VARCHAR) AS job_id, status, gate, retry_after_s, user_id AS elapsed_ms,
               'Event ' || page_id AS title, 1 AS values_per_header FROM ({GATE_SQL})""",
)
def s7_stored_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    responses = event_responses(spark, folder)
    stored = responses.select(F.col("page_id").cast("string").alias("job_id"), "url", src.tier1_record(responses).alias("tier1"))
    back = with_gate(src.stored_as_responses(stored))
    widest = F.array_max(F.transform(F.map_values("headers"), lambda v: F.size(v)))
    return back.select(
        "job_id",
        "status",
        "gate",
        "retry_after_s",
        "elapsed_ms",
        F.regexp_extract(F.col("body").cast("string"), "<title>(.*)</title>", 1).alias("title"),
        widest.alias("values_per_header"),
    )


@query(
    "s8_rendered_pages",
    """SELECT page_id, url, url || '#rendered' AS rendered_url, 200 AS status, 'text/html' AS content_type, url AS final_url,
              CAST(strlen(html) AS BIGINT) AS body_bytes FROM pages""",
)
def s8_rendered_pages(spark: SparkSession, folder: str) -> DataFrame:
    rendered = table(spark, folder, "pages").withColumn("rendered_url", text(F.col("url"), "#rendered"))
    return src.rendered_as_responses(rendered).select(
        "page_id",
        "url",
        "rendered_url",
        "status",
        "content_type",
        "final_url",
        F.octet_length("body").cast("bigint").alias("body_bytes"),
    )


@query(
    "s9_public_result",
    f"""SELECT page_id, COALESCE(gate, 'Done') AS decision, user_id AS elapsed_ms,
               CASE WHEN gate IS NULL THEN 'title' END AS field, CASE WHEN gate IS NULL THEN 'Event ' || page_id END AS value,
               CASE WHEN gate IS NULL THEN 'meta-tags' END AS source FROM ({GATE_SQL})""",
)
def s9_public_result(spark: SparkSession, folder: str) -> DataFrame:
    result = public_result(analyze(event_responses(spark, folder)))
    return result.select("page_id", "decision", "elapsed_ms", F.explode_outer("fields").alias("field", "f")).select(
        "page_id", "decision", "elapsed_ms", "field", "f.value", "f.source"
    )


@query(
    "s10_registry",
    """SELECT p_partkey AS page_id, 'brand' AS field, p_brand AS value, 'hidden-inputs' AS source, 0.66::DOUBLE AS confidence FROM part
       UNION ALL SELECT p_partkey, 'title', p_name, 'json-ld', 0.95::DOUBLE FROM part""",
)
def s10_registry(spark: SparkSession, folder: str) -> DataFrame:
    """Meta tags are off, data attributes are listed without ``enabled`` and so off too, one confidence is replaced."""
    options = Options(
        extractors={
            "meta-tags": ExtractorOption(enabled=False, confidence=0.9),
            "data-attr": ExtractorOption(),
            "hidden-input": ExtractorOption(enabled=True, confidence=0.66),
            "json-ld": ExtractorOption(enabled=True),
        }
    )
    html = page(
        text('<div class="card" data-brand="no"></div><input type="hidden" name="brand" value="', F.col("p_brand"), '"><p>', F.col("p_name"), " is a part with a page of its own</p>"),
        text('<title>no</title><script type="application/ld+json">{"title":"', F.col("p_name"), '"}</script>'),
    )
    result = analyze(as_pages(table(spark, folder, "part"), "p_partkey", html), options)
    rows = explode_fields(result.select("page_id", "fields"))
    return rows.select("page_id", F.col("key").alias("field"), "value", "source", "confidence")


@query(
    "s11_options",
    """SELECT page_id, CASE WHEN strlen(html) < 3000 THEN 'app-shell' ELSE 'content-rich' END AS page_type,
              CASE WHEN strlen(html) < 3000 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS hollow_score, 0 AS n_fields,
              CASE WHEN strlen(html) < 3000 THEN 'Escalate' ELSE 'Done' END AS decision FROM pages""",
)
def s11_options(spark: SparkSession, folder: str) -> DataFrame:
    """Thresholds and a penalty are replaced; the minimum confidence is above that of the title's source."""
    options = Options.from_mapping(
        {
            "tier2": {
                "hollow": {
                    "threshold": 0.2,
                    "tiny_body_bytes": 3000,
                    "text_density_ratio": -1,
                    "link_rich_min_links": 1000,
                    "penalties": {"tiny-body": 0.25},
                },
                "merge": {"min_confidence": 0.9},
            }
        }
    )
    result = analyze(pages(spark, folder), options)
    return result.select("page_id", "page_type", "hollow_score", F.size("fields").alias("n_fields"), "decision")


@query(
    "s12_url_blocklist",
    """SELECT event_id, CASE CAST(event_id % 4 AS INTEGER) WHEN 1 THEN 'https://hotjar.example/' || event_id
              ELSE 'https://example.com/tr?x=facebook.com' END AS url FROM events WHERE event_id % 4 IN (1, 3)""",
)
def s12_url_blocklist(spark: SparkSession, folder: str) -> DataFrame:
    links = table(spark, folder, "events").select(
        "event_id",
        choose(
            variant("event_id", 4),
            text("https://www.google-analytics.com/collect?id=", F.col("event_id")),
            text("https://hotjar.example/", F.col("event_id")),
            text("https://www.facebook.com/tr?id=", F.col("event_id")),
            "https://example.com/tr?x=facebook.com",
        ).alias("url"),
    )
    return src.drop_blocked(links, Options().block_domains)


@query(
    "g1_tech_hints",
    f"""SELECT page_id, kind = 11 AS is_nextjs, kind IN (10, 11) AS is_cloudflare, kind = 10 AS cf_challenge,
               page_id % 4 IN (1, 3) AS is_json, kind = 11 AND (page_id // 12) % 2 = 1 AS is_php FROM ({GATE_SQL})""",
)
def g1_tech_hints(spark: SparkSession, folder: str) -> DataFrame:
    return with_gate(event_responses(spark, folder)).select("page_id", "tech_hints.*")


@query("g2_retry_after", f"SELECT page_id, retry_after_s FROM ({GATE_SQL})")
def g2_retry_after(spark: SparkSession, folder: str) -> DataFrame:
    return with_gate(event_responses(spark, folder)).select("page_id", "retry_after_s")


@query("g3_status_gate", f"SELECT page_id, status, gate FROM ({GATE_SQL})")
def g3_status_gate(spark: SparkSession, folder: str) -> DataFrame:
    return with_gate(event_responses(spark, folder)).select("page_id", "status", "gate")


@query(
    "g4_short_circuit",
    f"""SELECT page_id, COALESCE(gate, 'Done') AS decision, CASE WHEN gate IS NULL THEN 'mixed' ELSE '' END AS page_type,
               CASE WHEN gate IS NULL THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS hollow_score,
               CASE WHEN gate IS NULL THEN 1 ELSE 0 END AS n_fields, retry_after_s FROM ({GATE_SQL})""",
)
def g4_short_circuit(spark: SparkSession, folder: str) -> DataFrame:
    result = analyze(event_responses(spark, folder))
    return result.select("page_id", "decision", "page_type", "hollow_score", F.size("fields").alias("n_fields"), "retry_after_s")


@query(
    "g5_due_backoffs",
    f"""SELECT page_id, ts + to_microseconds(CAST(retry_after_s * 1000000 AS BIGINT)) AS retry_at FROM ({GATE_SQL})
        WHERE gate = 'Backoff' AND ts + to_microseconds(CAST(retry_after_s * 1000000 AS BIGINT)) <= TIMESTAMP '2024-01-05 00:00:00'""",
)
def g5_due_backoffs(spark: SparkSession, folder: str) -> DataFrame:
    gated = with_gate(event_responses(spark, folder)).withColumnRenamed("gate", "decision")
    now = F.lit("2024-01-05 00:00:00").cast("timestamp")
    return due_backoffs(gated, now).select("page_id", F.col("retry_at").cast("timestamp_ntz").alias("retry_at"))


@query(
    "m1_phases",
    """WITH p AS (SELECT page_id, page_id % 2 = 0 AS has_json FROM pages)
       SELECT page_id, 'default' AS registry, 'meta-tags' AS source, 'second' AS phase FROM p
       UNION ALL SELECT page_id, 'globals off', 'meta-tags', 'first' FROM p
       UNION ALL SELECT page_id, r, 'json-ld', 'first' FROM p, (VALUES ('default'), ('globals off'), ('four left')) t(r) WHERE has_json""",
)
def m1_phases(spark: SparkSession, folder: str) -> DataFrame:
    """The phase that found each page's candidates: without the globals the meta tags move up to the first one."""
    off = ExtractorOption(enabled=False)
    four = {n: off for n in ("inline-var", "meta-tags", "microdata", "data-attr", "hidden-input", "css-hidden")}
    linked = text('<script type="application/ld+json">{"@type":"Article","headline":"H', Col("page_id"), '"}</script>')
    head = F.concat(choose(variant("page_id", 2), linked, ""), text('<meta name="description" content="M', Col("page_id"), '">'))
    responses = pages(spark, folder).withColumn("body", page(prose(), head).cast("binary"))
    found = None
    for registry, overrides in {"default": {}, "globals off": {"globals": off}, "four left": four}.items():
        options = Options(extractors=overrides)
        rows = candidates(responses, options).filter(F.col("key").isin("headline", "description"))
        rows = rows.select("page_id", F.lit(registry).alias("registry"), "source", phase_of(F.col("source"), options).alias("phase"))
        found = rows if found is None else found.unionByName(rows)
    return found
