"""Header gate: technology hints, Retry-After and the ordered status decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ABORT, BACKOFF, ESCALATE
from ..functions.text import let, quote, raw

# Texts that both a strict float parser and a SQL cast accept as the same number.
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

# Fixed value: longest delay, 2^63 - 1 nanoseconds.
_MAX_SECONDS = 9223372036.854775807


def header(headers: str, name: str) -> str:
    """First value of a header, by case-insensitive name; '' when absent."""
    found = f"get(filter(map_entries({headers}), h -> lower(h.key) = {quote(name.lower())}), 0)"
    return f"CASE WHEN size({headers}) > 0 THEN coalesce(get({found}.value, 0), '') ELSE '' END"


def tech_hints(headers: str, content_type: str) -> Column:
    powered = f"lower({header(headers, 'x-powered-by')})"
    challenge = f"lower({header(headers, 'cf-mitigated')}) = 'challenge'"
    return F.expr(
        f"named_struct('is_nextjs', contains({powered}, 'next.js'), "
        f"'is_cloudflare', {header(headers, 'cf-ray')} <> '' OR {challenge}, 'cf_challenge', {challenge}, "
        f"'is_json', coalesce(contains({content_type}, 'application/json'), false), 'is_php', contains({powered}, 'php'))"
    )


def retry_after(headers: str) -> Column:
    """Positive seconds, else 0; an HTTP date counts as 0, and so does a delay of centuries."""
    seconds = let(header(headers, "retry-after"), "h", f"CASE WHEN rlike(h, {raw(_NUMBER)}) THEN try_cast(h AS double) END")
    delay = let(seconds, "s", f"CASE WHEN s > 0 AND s < {_MAX_SECONDS!r}D THEN s ELSE 0D END")
    return F.expr(f"CASE WHEN size({headers}) > 0 THEN {delay} ELSE 0D END")


def status_gate(status: Column, cf_challenge: Column, retry_after_s: Column) -> Column:
    """Hard decision, or NULL when analysis goes on."""
    return (
        F.when(cf_challenge, F.lit(ESCALATE))
        .when(status.isin(401, 403, 404), F.lit(ABORT))
        .when(status == 429, F.lit(BACKOFF))
        .when((status == 503) & (retry_after_s > 0), F.lit(BACKOFF))
    )


def with_gate(responses: DataFrame) -> DataFrame:
    """Adds tech_hints, gate and retry_after_s (0 unless the gate says Backoff)."""
    return (
        responses.withColumns(
            {
                "tech_hints": tech_hints("headers", "content_type"),
                "retry_after_s": retry_after("headers"),
            }
        )
        .withColumn("gate", status_gate(F.col("status"), F.col("tech_hints.cf_challenge"), F.col("retry_after_s")))
        .withColumn("retry_after_s", F.when(F.col("gate") == BACKOFF, F.col("retry_after_s")).otherwise(F.lit(0.0)))
    )


def due_backoffs(analysis: DataFrame, now: Column) -> DataFrame:
    """Backed-off rows whose delay is over; adds retry_at. Needs fetched_at."""
    delay = F.make_dt_interval(secs=F.col("retry_after_s").cast("decimal(18,6)"))
    return (
        analysis.filter(F.col("decision") == BACKOFF)
        .withColumn("retry_at", F.col("fetched_at") + delay)
        .filter(F.col("retry_at") <= now)
    )
