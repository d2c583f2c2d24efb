"""The cascade: tier 2 on responses, tiers 3 and 4 on rendered pages of escalated rows.

Rendered HTML is analysed where it lies; only the small result rows are shuffled, aggregated to one
per page and joined, in one join for both tiers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ABORT, BACKOFF, DONE, ESCALATE
from ..functions.joins import attach, hot_keys, keep_matching, one_copy_matching
from ..operators.fallback import apply_completions
from ..options import Options
from ..sources.tables import rendered_as_responses
from .analyze import analyze, analyze_rendered

RESULT_COLUMNS = ("decision", "page_type", "page_type_confidence", "hollow_score", "escalation_reason", "fields")


def decode_decision(c: Column) -> Column:
    """Stored text as a decision; anything unknown is Escalate."""
    return F.when(c.isin(DONE, ESCALATE, ABORT, BACKOFF), c).otherwise(F.lit(ESCALATE))


def encode_decision(number: Column) -> Column:
    """Decision number 0 to 3 as text."""
    names = F.array(*[F.lit(d) for d in (DONE, ESCALATE, ABORT, BACKOFF)])
    return F.coalesce(F.get(names, number), F.lit("Unknown"))


def _copy(body: str) -> Column:
    return F.xxhash64(F.col(body).cast("binary"), "rendered_url")


def tier_results(
    rendered: DataFrame,
    tiers: tuple[int, ...] = (3, 4),
    options: Options | None = None,
    key: str = "page_id",
    completions: DataFrame | None = None,
    salts: int = 1,
) -> DataFrame:
    """Result rows (key, copy, tier, result) of all pages rendered in the tiers, from one scan and one parse.

    ``copy`` tells copies of a page apart by their content.
    """
    pages = rendered_as_responses(rendered.filter(F.col("tier").isin(*tiers)))
    result = analyze_rendered(pages.withColumn("copy", _copy("body")), options=options)
    if completions is not None:
        by_tier = "tier" in completions.columns
        page = F.struct(key, "tier") if by_tier else F.col(key)
        completions = completions.withColumn("_page", page).select("_page", "completion", "error")
        result = apply_completions(result.withColumn("_page", page), completions, options, "_page", salts)
    return result.select(key, "copy", "tier", F.struct(*RESULT_COLUMNS).alias("result"))


def one_row_per_page(results: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, tier3, tier4) of tier results; of several copies of a page the first by content counts.

    One aggregate over both tiers: copies of a page meet before the shuffle, and only results move.
    """
    tiers = [F.min_by("result", F.when(F.col("tier") == t, F.col("copy"))).alias(f"tier{t}") for t in (3, 4)]
    return results.groupBy(key).agg(*tiers)


def follow_tiers(tier2: DataFrame, results: DataFrame, key: str = "page_id", salts: int = 1, hot: list | None = None) -> DataFrame:
    """Joins tier results: a tier is reached only by rows that escalated in the one before.

    A page without a row in a tier keeps its last result.
    """
    joined = attach(tier2, results, key, F.col("tier2.decision") == ESCALATE, salts, hot)
    return joined.withColumn("tier4", F.when(F.col("tier3.decision") == ESCALATE, F.col("tier4")))


def final_result() -> list[Column]:
    """tier, decision, page_type, escalation_reason and fields of the highest tier that ran."""
    last = F.coalesce("tier4", "tier3", "tier2")
    tier = F.when(F.col("tier4").isNotNull(), 4).when(F.col("tier3").isNotNull(), 3).otherwise(2)
    return [
        tier.alias("tier"),
        last["decision"].alias("decision"),
        last["page_type"].alias("page_type"),
        last["escalation_reason"].alias("escalation_reason"),
        last["fields"].alias("fields"),
    ]


def _written(df: DataFrame, folder: str) -> DataFrame:
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _routed(
    tier2: DataFrame, rendered: DataFrame, tiers: tuple[int, ...], options: Options | None, key: str, completions: DataFrame | None, salts: int, work: str
) -> DataFrame:
    """Tier results of the pages that reach their tier: renders are routed on written keys before they are parsed.

    Where an address may have very many renders, which ``salts`` says, equal ones are parsed once per salt group.
    """
    last, results = tier2.select(key, F.col("tier2.decision").alias("decision")), None
    hot = hot_keys(rendered.filter(F.col("tier").isin(*tiers)), key) if salts > 1 else None
    for tier in sorted(tiers):
        escalated = last.filter(F.col("decision") == ESCALATE).select(key).distinct()
        pages = rendered.filter(F.col("tier") == tier)
        if salts > 1:
            reached = one_copy_matching(pages.withColumn("_copy", _copy("html")), escalated, key, "_copy", salts, hot).drop("_copy")
        else:
            reached = keep_matching(pages, escalated, key)
        found = _written(tier_results(reached, (tier,), options, key, completions, salts), f"{work}/tier{tier}")
        results = found if results is None else results.unionByName(found)
        # Of several copies of a page the first by content counts, here as in the result.
        last = found.groupBy(key).agg(F.min_by(F.col("result.decision"), "copy").alias("decision"))
    return results


def run_cascade(
    responses: DataFrame,
    rendered: DataFrame | None = None,
    options: Options | None = None,
    key: str = "page_id",
    completions: DataFrame | None = None,
    tiers: tuple[int, ...] = (3, 4),
    salts: int = 1,
    work: str | None = None,
) -> DataFrame:
    """One result row per response: (key, url, elapsed_ms, tier2, tier3, tier4, tier, decision, ...).

    ``work`` names a new folder in shared storage where each tier is written before the next one starts: then only
    renders of pages that escalated are parsed. Without it everything is one lazy plan, which parses every render.
    ``completions`` has a row per page and, if it has a column ``tier``, per tier. ``key`` should be
    unique among the responses; for one that is not, such as the address, set ``salts`` (see ``attach``).
    """

    analysis = analyze(responses, options)
    if completions is not None:
        first = completions.filter(F.col("tier") == 2) if "tier" in completions.columns else completions
        analysis = apply_completions(analysis, first, options, key, salts)
    passed_on = [c for c in dict.fromkeys((key, "page_id", "url", "elapsed_ms")) if c in analysis.columns]
    tier2 = analysis.withColumn("escalation_reason", F.lit("")).select(*passed_on, F.struct(*RESULT_COLUMNS).alias("tier2"))
    if rendered is not None and tiers:
        if work is None:
            results = tier_results(rendered, tiers, options, key, completions, salts)
        else:
            tier2 = _written(tier2, f"{work}/tier2")
            results = _routed(tier2, rendered, tiers, options, key, completions, salts, work)
        hot = hot_keys(tier2, key) if work is not None and salts > 1 else None
        out = follow_tiers(tier2, one_row_per_page(results, key), key, salts, hot)
    else:
        out = tier2.withColumns({f"tier{t}": F.lit(None).cast(tier2.schema["tier2"].dataType) for t in (3, 4)})
    return out.select("*", *final_result())


def public_result(results: DataFrame) -> DataFrame:
    """Result rows as a caller sees them: fields reduced to value and source."""
    fields = F.transform_values("fields", lambda k, f: F.struct(f["value"].alias("value"), f["source"].alias("source")))
    return results.withColumn("fields", fields)
