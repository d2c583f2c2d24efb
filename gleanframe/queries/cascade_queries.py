"""Walls, tier routing, job store and stream."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..options import Options
from ..plans import jobs
from ..plans.analyze import analyze, analyze_rendered
from ..plans.batch import batch_prompts, run_batch, to_fetch
from ..plans.cascade import decode_decision, encode_decision, public_result, run_cascade
from ..schemas import FIELDS
from ..sources.tables import pages_as_responses, rendered_as_responses
from ..streaming.stream import write_analysis_stream
from .inputs import GATE_SQL, Col, as_pages, choose, event_responses, page, prose, table, text, variant
from .registry import query

_FILLED = '<meta name="description" content="found">'


def _rendered_customers(spark: SparkSession, folder: str, tier: int) -> DataFrame:
    """Rendered pages behind twelve kinds of walls; some show two walls, so that the order counts."""
    kind = variant("c_custkey", 12)
    body = choose(
        kind,
        '<div id="onetrust-banner-sdk"></div><div class="g-recaptcha"></div>',
        '<div class="x fc-dialog-container"></div><input type="password">',
        '<div id="CybotCookiebotDialog"></div>',
        '<b class="cmp-popup"></b>',
        '<input type="password"><i data-sitekey="k"></i>',
        '<div class="h-captcha hcaptcha-box"></div>',
        "",
        '<input type="password"><b id="cf-challenge-running"></b>',
        '<b id="cf-challenge-running"></b><b class="cf-error-type-1010"></b>',
        '<b class="cf-error-type-1010"></b>',
        "",
        "",
    )
    url = choose(kind, *["https://example.com/"] * 4, "https://example.com/LOGIN?x", "https://example.com/a", "https://example.com/SignIn",
                 *["https://example.com/"] * 3, "https://example.com/x/sign-in", "https://example.com/ok")
    html = page(text(body, prose()), _FILLED)
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("page_id"),
        text("https://example.com/", Col("c_custkey")).alias("url"),
        F.lit(tier).alias("tier"),
        url.alias("rendered_url"),
        html.alias("html"),
    )


def _wall_sql(reasons: list[str | None]) -> str:
    cases = " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(reasons) if r)
    return f"""SELECT page_id, CASE WHEN reason = '' THEN 'Done' ELSE 'Escalate' END AS decision, reason AS escalation_reason,
                      CASE WHEN reason = '' THEN 1 ELSE 0 END AS n_fields
               FROM (SELECT c_custkey AS page_id, CASE c_custkey % 12 {cases} ELSE '' END AS reason FROM customer)"""


_COOKIE = [f"cookie consent wall: {s}" for s in ("#onetrust-banner-sdk", ".fc-dialog-container", "#CybotCookiebotDialog", ".cmp-popup")]
_LOGIN = "login wall detected in URL"
_WALLS3 = [*_COOKIE, _LOGIN, None, _LOGIN, "login wall: password input present", "cloudflare challenge: #cf-challenge-running",
           "cloudflare challenge: .cf-error-type-1010", _LOGIN, None]
_WALLS4 = ["captcha detected: [class*=recaptcha]", None, None, None, "captcha detected: [data-sitekey]", "captcha detected: [class*=hcaptcha]",
           _LOGIN, None, None, None, _LOGIN, None]


def _walled(spark: SparkSession, folder: str, tier: int) -> DataFrame:
    result = analyze_rendered(
        rendered_as_responses(_rendered_customers(spark, folder, tier)), tier, Options(tiny_body_bytes=1, penalties={"captcha": 0.0})
    )
    return result.select("page_id", "decision", "escalation_reason", F.size("fields").alias("n_fields"))


@query("r2_tier3_walls", _wall_sql(_WALLS3))
def r2_tier3_walls(spark: SparkSession, folder: str) -> DataFrame:
    return _walled(spark, folder, 3)


@query("r3_tier4_walls", _wall_sql(_WALLS4))
def r3_tier4_walls(spark: SparkSession, folder: str) -> DataFrame:
    return _walled(spark, folder, 4)


@query(
    "r4_walled_row",
    """SELECT c_custkey AS page_id, 'Escalate' AS decision, '' AS page_type, 0.0::DOUBLE AS page_type_confidence, 0.0::DOUBLE AS hollow_score
       FROM customer WHERE c_custkey % 12 NOT IN (5, 11)""",
)
def r4_walled_row(spark: SparkSession, folder: str) -> DataFrame:
    result = analyze_rendered(rendered_as_responses(_rendered_customers(spark, folder, 3)), 3)
    walled = result.filter(F.col("escalation_reason") != "")
    return walled.select("page_id", "decision", "page_type", "page_type_confidence", "hollow_score")


@query(
    "r5_reanalysis",
    """SELECT page_id, url, CASE WHEN strlen(html) < 5120 THEN 'mixed' ELSE 'content-rich' END AS page_type, 'Done' AS decision,
              '' AS escalation_reason, 1 AS n_fields FROM pages""",
)
def r5_reanalysis(spark: SparkSession, folder: str) -> DataFrame:
    rendered = table(spark, folder, "pages").withColumn("rendered_url", F.lit("https://example.com/"))
    result = analyze_rendered(rendered_as_responses(rendered), 4)
    return result.select("page_id", "url", "page_type", "decision", "escalation_reason", F.size("fields").alias("n_fields"))


def _order_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Every third order is an empty shell, every third one is gone, the rest has text."""
    body = choose(variant("o_orderkey", 3), '<div id="root"></div>', "", prose())
    pages = as_pages(table(spark, folder, "orders"), "o_orderkey", page(body, F.when(variant("o_orderkey", 3) == 2, _FILLED).otherwise("")))
    gone = variant("page_id", 3) == 1
    return pages.withColumn("status", F.when(gone, 404).otherwise(200)).withColumn("elapsed_ms", F.col("page_id") % 500)


def _order_renders(spark: SparkSession, folder: str) -> DataFrame:
    """Renders of the shells: tier 3 for three quarters of them (some walled, some still empty), tier 4 for a part of these.

    Some renders belong to pages that did not escalate; they must not count.
    """
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("page_id"))
    kind = variant("page_id", 12)
    shell = page('<div id="root"></div>')
    full = page(prose(), text('<meta name="description" content="tier', Col("tier"), '">'))
    tier3 = orders.filter(kind.isin(0, 3, 6, 8)).withColumn("tier", F.lit(3))
    tier4 = orders.filter(kind.isin(3, 9)).withColumn("tier", F.lit(4))
    both = tier3.unionByName(tier4)
    wall = (F.col("tier") == 3) & (kind == 3)
    return both.select(
        "page_id",
        text("https://example.com/", Col("page_id")).alias("url"),
        "tier",
        F.when(wall, "https://example.com/login").otherwise("https://example.com/").alias("rendered_url"),
        F.when((F.col("tier") == 3) & (kind == 6), shell).otherwise(full).alias("html"),
    )


# Shells are 0, 3, 6 and 9: 0 is done in tier 3, 3 is walled there and done in tier 4, 6 stays empty
# in tier 3 without a tier-4 render, 9 has no tier-3 render, so its tier-4 render is never reached.
_CASCADE_SQL = """
SELECT o_orderkey AS page_id, CASE o_orderkey % 12 WHEN 0 THEN 3 WHEN 3 THEN 4 WHEN 6 THEN 3 ELSE 2 END AS tier,
       CASE o_orderkey % 3 WHEN 1 THEN 'Abort' WHEN 2 THEN 'Done'
            ELSE CASE WHEN o_orderkey % 12 IN (0, 3) THEN 'Done' ELSE 'Escalate' END END AS decision,
       CASE WHEN o_orderkey % 3 = 1 THEN '' WHEN o_orderkey % 12 IN (6, 9) THEN 'app-shell' ELSE 'mixed' END AS page_type,
       CASE WHEN o_orderkey % 3 = 2 THEN 'found' WHEN o_orderkey % 12 = 0 THEN 'tier3' WHEN o_orderkey % 12 = 3 THEN 'tier4' END AS description,
       '' AS escalation_reason
FROM orders
"""


def _described(result: DataFrame) -> DataFrame:
    return result.select(
        "page_id",
        "tier",
        "decision",
        "page_type",
        F.try_element_at("fields", F.lit("description"))["value"].alias("description"),
        "escalation_reason",
    )


@query("r1_cascade", _CASCADE_SQL)
def r1_cascade(spark: SparkSession, folder: str) -> DataFrame:
    return _described(run_cascade(_order_responses(spark, folder), _order_renders(spark, folder)))


@query("r1_routed_cascade", _CASCADE_SQL)
def r1_routed_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Each tier is written, and only renders of pages that escalated are parsed."""
    return _described(run_cascade(_order_responses(spark, folder), _order_renders(spark, folder), work=work_folder(spark)))


@query(
    "r6_missing_tier",
    """SELECT o_orderkey AS page_id, CASE o_orderkey % 12 WHEN 0 THEN 3 WHEN 3 THEN 3 WHEN 6 THEN 3 ELSE 2 END AS tier,
              CASE o_orderkey % 3 WHEN 1 THEN 'Abort' WHEN 2 THEN 'Done' ELSE CASE WHEN o_orderkey % 12 = 0 THEN 'Done' ELSE 'Escalate' END END AS decision,
              CASE WHEN o_orderkey % 3 = 1 OR o_orderkey % 12 = 3 THEN '' WHEN o_orderkey % 12 IN (6, 9) THEN 'app-shell' ELSE 'mixed' END AS page_type,
              CASE WHEN o_orderkey % 3 = 2 THEN 'found' WHEN o_orderkey % 12 = 0 THEN 'tier3' END AS description,
              CASE WHEN o_orderkey % 12 = 3 THEN 'login wall detected in URL' ELSE '' END AS escalation_reason FROM orders""",
)
def r6_missing_tier(spark: SparkSession, folder: str) -> DataFrame:
    """Without a fourth tier the last escalation is the result."""
    return _described(run_cascade(_order_responses(spark, folder), _order_renders(spark, folder), tiers=(3,)))


@query(
    "r7_public_cascade",
    f"""SELECT page_id, tier, decision, page_id % 500 AS elapsed_ms, description AS value,
               CASE WHEN description IS NOT NULL THEN 'meta-tags' END AS source FROM ({_CASCADE_SQL})""",
)
def r7_public_cascade(spark: SparkSession, folder: str) -> DataFrame:
    result = public_result(run_cascade(_order_responses(spark, folder), _order_renders(spark, folder)))
    f = F.try_element_at("fields", F.lit("description"))
    return result.select("page_id", "tier", "decision", "elapsed_ms", f["value"].alias("value"), f["source"].alias("source"))


@query(
    "r8_decision_codec",
    """SELECT event_id, ['Done','Escalate','Abort','Backoff','Unknown'][CAST(event_id % 5 AS INTEGER) + 1] AS stored,
              ['Done','Escalate','Abort','Backoff','Escalate'][CAST(event_id % 5 AS INTEGER) + 1] AS decision FROM events""",
)
def r8_decision_codec(spark: SparkSession, folder: str) -> DataFrame:
    stored = table(spark, folder, "events").select("event_id", encode_decision(variant("event_id", 5)).alias("stored"))
    return stored.withColumn("decision", decode_decision(F.col("stored")))


@query(
    "r1_cascade_hot_address",
    """SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 3 <> 0 THEN 2 WHEN hot THEN 4 ELSE 3 END AS tier,
              CASE o_orderkey % 3 WHEN 1 THEN 'Abort' ELSE 'Done' END AS decision,
              CASE WHEN o_orderkey % 3 = 2 THEN 'found' WHEN o_orderkey % 3 = 0 THEN CASE WHEN hot THEN 'tier4' ELSE 'tier3' END END AS description
       FROM (SELECT o_orderkey, o_orderstatus = 'F' AS hot FROM orders)""",
)
def r1_cascade_hot_address(spark: SparkSession, folder: str) -> DataFrame:
    """The cascade keyed by an address that many responses share: all orders of one status have the same one.

    Its renders are there in many copies, too. It is walled in tier 3 and done in tier 4. Tiers are written, as
    in ``r1_routed_cascade``.
    """
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("page_id"), "o_orderstatus")
    hot = F.col("o_orderstatus") == "F"
    address = F.when(hot, "https://example.com/hot").otherwise(text("https://example.com/", Col("page_id")))
    keyed = orders.select("page_id", address.alias("address"), "o_orderstatus")
    responses = _order_responses(spark, folder).drop("url").join(keyed.select("page_id", F.col("address").alias("url")), "page_id")
    both = keyed.withColumn("tier", F.explode(F.array(F.lit(3), F.lit(4))))
    full = page(prose(), text('<meta name="description" content="tier', Col("tier"), '">'))
    renders = both.select(
        "page_id",
        F.col("address").alias("url"),
        "tier",
        F.when(hot & (F.col("tier") == 3), "https://example.com/login").otherwise("https://example.com/").alias("rendered_url"),
        full.alias("html"),
    )
    result = run_cascade(responses, renders, key="url", salts=8, work=work_folder(spark))
    return _described(result).select("page_id", "tier", "decision", "description")


# Job store ---------------------------------------------------------------------------------------


def _day(days: int) -> Column:
    return (F.col("o_orderdate") + F.make_dt_interval(days=F.lit(days))).cast("timestamp")


def _job_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_orderdate", "o_orderstatus", text("https://example.com/", Col("o_orderkey")).alias("url"), F.lit("b1").alias("batch_id")
    )
    return orders.withColumn("job_id", jobs.job_id(F.col("url"), F.col("batch_id")))


_JOB_SQL = "sha256('b1' || chr(10) || 'https://example.com/' || o_orderkey)"


def _no_analysis(df: DataFrame, decision: Column) -> DataFrame:
    empty = F.create_map().cast(FIELDS)
    return df.withColumns(
        {
            "decision": decision,
            "page_type": F.lit("mixed"),
            "page_type_confidence": F.lit(0.5),
            "hollow_score": F.lit(0.5),
            "escalation_reason": F.lit(""),
            "tech_hints": F.lit(None),
            "fields": empty,
            "elapsed_ms": F.col("o_orderkey"),
        }
    )


def _stage_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Stages of one job per order: tier 2 twice (the later patch counts), tier 3 for odd orders."""
    orders = _job_orders(spark, folder)
    created = orders.select("url", "batch_id", "o_orderdate")
    start = jobs.created_rows(created, F.lit("1990-01-01").cast("timestamp"))
    first = jobs.tier2_rows(_no_analysis(orders, F.lit("Backoff")), _day(1))
    second = jobs.tier2_rows(_no_analysis(orders, F.lit("Escalate")), _day(2))
    odd = orders.filter(F.col("o_orderkey") % 2 == 1)
    third = jobs.render_rows(_no_analysis(odd, F.lit("Done")), 3, _day(3))
    return start.unionByName(first).unionByName(second).unionByName(third)


@query(
    "j1_create_job",
    f"SELECT {_JOB_SQL} AS job_id, 'https://example.com/' || o_orderkey AS url, 'created' AS status, 0 AS stage FROM orders",
)
def j1_create_job(spark: SparkSession, folder: str) -> DataFrame:
    """A request that is there twice is one job."""
    requests = _job_orders(spark, folder).select("url", "batch_id")
    rows = jobs.created_rows(requests.unionByName(requests), F.current_timestamp())
    return rows.select("job_id", "url", "status", "stage")


@query(
    "j2_save_tiers",
    f"""SELECT page_id, CASE WHEN gate = 'Abort' THEN 'aborted' ELSE 'tier2_complete' END AS status, 2 AS stage,
               COALESCE(gate, 'Done') AS tier2_decision, 'tier1_complete' AS tier1_status, status AS tier1_code,
               CAST(NULL AS VARCHAR) AS final_decision FROM ({GATE_SQL})""",
)
def j2_save_tiers(spark: SparkSession, folder: str) -> DataFrame:
    """Tier 1 and tier 2 patches; aborted jobs are marked. The final columns stay empty."""
    responses = event_responses(spark, folder).withColumns({"batch_id": F.lit("b1"), "job_id": F.col("page_id").cast("string")})
    tier1 = jobs.tier1_rows(responses, F.col("fetched_at"))
    options = Options(mark_aborted=True)
    tier2 = jobs.tier2_rows(analyze(responses, options), F.current_timestamp(), options)
    both = tier1.select("job_id", F.col("status").alias("tier1_status"), F.col("tier1.status_code").alias("tier1_code")).join(tier2, "job_id")
    return both.select(
        F.col("job_id").cast("bigint").alias("page_id"),
        "status",
        "stage",
        F.col("tier2.decision").alias("tier2_decision"),
        "tier1_status",
        "tier1_code",
        "final_decision",
    )


@query(
    "j3_save_render",
    f"""SELECT {_JOB_SQL} AS job_id, 'tier3_complete' AS status, 'Done' AS final_decision, 'Done' AS tier3_decision, false AS has_tier4
        FROM orders WHERE o_orderkey % 2 = 1""",
)
def j3_save_render(spark: SparkSession, folder: str) -> DataFrame:
    rows = _stage_rows(spark, folder).filter(F.col("stage") == 3)
    return rows.select(
        "job_id", "status", "final_decision", F.col("tier3.decision").alias("tier3_decision"), F.col("tier4").isNotNull().alias("has_tier4")
    )


@query(
    "j4_job_view",
    f"""SELECT {_JOB_SQL} AS job_id, 'https://example.com/' || o_orderkey AS url, TIMESTAMP '1990-01-01' AS created_at,
               CAST(o_orderdate AS TIMESTAMP) + to_days(CASE WHEN o_orderkey % 2 = 1 THEN 3 ELSE 2 END) AS updated_at,
               CASE WHEN o_orderkey % 2 = 1 THEN 'tier3_complete' ELSE 'tier2_complete' END AS status, 'Escalate' AS tier2_decision,
               CASE WHEN o_orderkey % 2 = 1 THEN 'Done' END AS tier3_decision, CASE WHEN o_orderkey % 2 = 1 THEN 'Done' END AS final_decision
        FROM orders""",
)
def j4_job_view(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.job_view(_stage_rows(spark, folder)).select(
        "job_id",
        "url",
        F.col("created_at").cast("timestamp_ntz").alias("created_at"),
        F.col("updated_at").cast("timestamp_ntz").alias("updated_at"),
        "status",
        F.col("tier2.decision").alias("tier2_decision"),
        F.col("tier3.decision").alias("tier3_decision"),
        "final_decision",
    )


@query(
    "j5_get_job",
    f"SELECT {_JOB_SQL} AS job_id, 'tier3_complete' AS status FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders WHERE o_orderkey % 2 = 1)",
)
def j5_get_job(spark: SparkSession, folder: str) -> DataFrame:
    orders = _job_orders(spark, folder).filter(F.col("o_orderkey") % 2 == 1)
    wanted = orders.agg(F.max_by("job_id", "o_orderkey").alias("job_id")).first().job_id
    return jobs.get_job(_stage_rows(spark, folder), wanted).select("job_id", "status")


@query(
    "j6_resume",
    f"""SELECT {_JOB_SQL} AS job_id, CASE WHEN o_orderkey % 4 = 0 THEN 'Backoff'
               ELSE CASE o_orderkey % 3 WHEN 0 THEN 'Escalate' WHEN 1 THEN 'Abort' ELSE 'Done' END END AS decision FROM orders""",
)
def j6_resume(spark: SparkSession, folder: str) -> DataFrame:
    """A quarter of the jobs was analysed and stored when their sites were busy; only the others are analysed now."""
    path = work_folder(spark)
    responses = _order_responses(spark, folder).withColumn("batch_id", F.lit("b1"))
    responses = responses.withColumn("job_id", jobs.job_id(F.col("url"), F.col("batch_id")))
    busy = responses.filter(F.col("page_id") % 4 == 0).withColumn("status", F.lit(429))
    jobs.write_stage(jobs.tier2_rows(analyze(busy), F.lit("2024-01-01").cast("timestamp")), path)
    stages = jobs.read_stages(spark, path)
    result = jobs.resume_analysis(responses, stages, analyze(jobs.pending(responses, stages, 2)))
    return result.select("job_id", "decision")


def work_folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder; a local session without one gets a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="run-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/gleanframe-{uuid.uuid4().hex}"


@query(
    "j7_stored_codec",
    f"""SELECT page_id, COALESCE(gate, 'Done') AS decision, kind IN (10, 11) AS is_cloudflare, user_id AS elapsed_ms,
               CASE WHEN gate IS NULL THEN 'Event ' || page_id END AS title FROM ({GATE_SQL})""",
)
def j7_stored_codec(spark: SparkSession, folder: str) -> DataFrame:
    responses = event_responses(spark, folder).withColumns({"batch_id": F.lit("b1"), "job_id": F.col("page_id").cast("string")})
    back = jobs.stored_analysis(jobs.tier2_rows(analyze(responses), F.current_timestamp()))
    return back.select(
        F.col("job_id").cast("bigint").alias("page_id"),
        "decision",
        "tech_hints.is_cloudflare",
        "elapsed_ms",
        F.try_element_at("fields", F.lit("title"))["value"].alias("title"),
    )


@query(
    "j8_stage_sink",
    "SELECT 0 AS stage, COUNT(*) AS n FROM orders UNION ALL SELECT 2, 2 * COUNT(*) FROM orders UNION ALL SELECT 3, COUNT(*) FROM orders WHERE o_orderkey % 2 = 1",
)
def j8_stage_sink(spark: SparkSession, folder: str) -> DataFrame:
    """Written twice, read once: a repeated write replaces its own partitions."""
    path = work_folder(spark)
    rows = _stage_rows(spark, folder)
    for _ in range(2):
        jobs.write_stage(rows, path)
    return jobs.read_stages(spark, path).groupBy("stage").agg(F.count("*").alias("n"))


_BATCH_SQL = f"""
SELECT {_JOB_SQL.replace("b1", "b")} AS job_id, tier, decision, page_type, description, c.escalation_reason,
       CASE tier WHEN 2 THEN 'tier2_complete' WHEN 3 THEN 'tier3_complete' ELSE 'tier4_complete' END AS status
FROM ({_CASCADE_SQL}) c JOIN orders ON o_orderkey = page_id
"""


@query("j6_batch_in_two_runs", _BATCH_SQL)
def j6_batch_in_two_runs(spark: SparkSession, folder: str) -> DataFrame:
    """A batch that first knows no rendered pages, and is picked up by a second run that does."""
    path = work_folder(spark)
    responses, renders = _order_responses(spark, folder), _order_renders(spark, folder)
    run_batch(responses, None, path, "b", "1")
    result = run_batch(responses, renders, path, "b", "2")
    return result.select(
        "job_id",
        "tier",
        "decision",
        "page_type",
        F.try_element_at("fields", F.lit("description"))["value"].alias("description"),
        "escalation_reason",
        "status",
    )


@query(
    "j1_requests_without_response",
    f"""SELECT {_JOB_SQL.replace("b1", "b")} AS job_id, CASE WHEN o_orderkey % 5 < 2 THEN 'created' ELSE 'tier2_complete' END AS status,
               CASE o_orderkey % 5 WHEN 0 THEN 'https://api.example.com/' || o_orderkey WHEN 1 THEN 'https://example.com/' || o_orderkey END AS target
        FROM orders""",
)
def j1_requests_without_response(spark: SparkSession, folder: str) -> DataFrame:
    """Requests of which a fifth was never answered and a fifth failed; both are named again, some by their endpoint."""
    path = work_folder(spark)
    responses, kind = _order_responses(spark, folder), variant("page_id", 5)
    endpoint = F.when(kind == 0, text("https://api.example.com/", Col("page_id"))).otherwise("")
    requests = responses.select("url", endpoint.alias("api_endpoint"))
    answered = responses.filter(kind != 0).withColumn("status", F.when(kind != 1, F.col("status")))
    run_batch(answered, None, path, "b", "1", requests=requests.unionByName(requests))
    view = jobs.job_view(jobs.read_stages(spark, path))
    again = to_fetch(requests, path, "b").select("job_id", "target")
    return view.join(again, "job_id", "left").select("job_id", "status", "target")


@query(
    "l5_stored_completions",
    f"""SELECT {_JOB_SQL.replace("b1", "b")} AS job_id, COALESCE(p, false) AS prompted,
               CASE WHEN k % 12 IN (6, 9) THEN CASE WHEN k % 5 = 0 THEN 'Escalate' ELSE 'Done' END ELSE decision END AS decision,
               tier, CASE WHEN k % 12 IN (6, 9) AND k % 5 <> 0 THEN 'C' || k WHEN k % 12 NOT IN (6, 9) THEN description END AS found
        FROM (SELECT o_orderkey AS k, * FROM orders) JOIN ({_CASCADE_SQL}) ON page_id = k
        LEFT JOIN (SELECT o_orderkey AS pk, true AS p FROM orders WHERE o_orderkey % 12 IN (6, 9)) ON pk = k""",
)
def l5_stored_completions(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts of a stored batch go out, a second run brings completions, a third one has nothing left to do.

    The shells have a line of text, so that there is something to ask about; every fifth completion is broken.
    """
    path = work_folder(spark)
    line = "You need to enable JavaScript to run this page, which shows the whole story."
    shell = page(text('<div id="root"></div><p>', line, "</p>"))
    responses, renders = _order_responses(spark, folder), _order_renders(spark, folder)
    responses = responses.withColumn("body", F.when(variant("page_id", 3) == 0, shell.cast("binary")).otherwise(F.col("body")))
    empty = (F.col("tier") == 3) & (variant("page_id", 12) == 6)
    renders = renders.withColumn("html", F.when(empty, shell).otherwise(F.col("html")))
    run_batch(responses, renders, path, "b", "1")
    asked = batch_prompts(renders, path, "b", spark)
    key = F.col("page_id")
    answer = F.when(key % 5 == 0, F.lit("no answer")).otherwise(text('{"description":"C', key, '"}'))
    # Shells that were rendered and done there need no answer in tier 2 any more.
    completions = responses.filter(variant("page_id", 12).isin(6, 9)).select(
        "url", answer.alias("completion"), F.lit(None).cast("string").alias("error"), F.when(variant("page_id", 12) == 6, 3).otherwise(2).alias("tier")
    )
    for run in ("2", "3"):
        result = run_batch(responses, renders, path, "b", run, completions=completions)
    # Prompts that were asked in the tier where the job ended; a job has one prompt per tier.
    prompted = asked.select("job_id", "tier", F.lit(True).alias("prompted"))
    return result.join(prompted, ["job_id", "tier"], "left").select(
        "job_id",
        F.coalesce("prompted", F.lit(False)).alias("prompted"),
        "decision",
        "tier",
        F.try_element_at("fields", F.lit("description"))["value"].alias("found"),
    )


@query(
    "stream_analysis",
    """SELECT url, CASE WHEN strlen(html) < 5120 THEN 'mixed' ELSE 'content-rich' END AS page_type, 'Done' AS decision,
              'tier2_complete' AS status FROM pages""",
)
def stream_analysis(spark: SparkSession, folder: str) -> DataFrame:
    """The pages table as a stream of responses, written as stage rows."""
    path = work_folder(spark)
    # As a glob the path may be one file or a folder of part files; a stream refuses the plain path of a file.
    stream = spark.readStream.schema("page_id bigint, url string, html string").parquet(f"{folder}/[p]ages.parquet")
    write_analysis_stream(pages_as_responses(stream), f"{path}/stages", f"{path}/checkpoint").awaitTermination()
    rows = jobs.read_stages(spark, f"{path}/stages")
    return rows.select("url", F.col("tier2.page_type").alias("page_type"), F.col("tier2.decision").alias("decision"), "status")


