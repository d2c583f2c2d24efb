"""Analysis of a table or stream of responses. Every step is narrow: there is no shuffle."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ESCALATE
from ..functions.html import parse_html
from ..operators import signals, walls
from ..operators.extractors import Extractor, enabled_extractors, split_phases, wanted_selectors
from ..operators.gate import with_gate
from ..operators.merge import any_fields, candidate_rows, decide, has_script_data, merge_fields
from ..options import Options
from ..session import configure
from ..sources.tables import cap_body

ANALYSIS_COLUMNS = (
    "decision",
    "retry_after_s",
    "page_type",
    "page_type_confidence",
    "hollow_score",
    "tech_hints",
    "fields",
)
# Gated pages have no document, pages that cannot be parsed have one without nodes.
_PARSED = "doc.nodes IS NOT NULL"
_NOT_PASSED_ON = {"headers", "body", "tech_hints", "retry_after_s", "status"}


def _parsed() -> Column:
    return F.expr(_PARSED)


def _column(e: Extractor) -> str:
    return f"x_{e.name}"


def with_document(gated: DataFrame, options: Options, *more: Mapping[str, int], signals_only: bool = False, capped: bool = True) -> DataFrame:
    """Adds body_bytes and doc. Gated rows send no body to Python and get no document.

    The byte limit is that of a fetch; rendered pages come whole.
    """
    wanted = wanted_selectors([] if signals_only else enabled_extractors(options), signals.SELECTORS, *more)
    body, size = F.coalesce(F.col("body"), F.lit(b"")), F.coalesce(F.octet_length("body"), F.lit(0))
    if capped:
        body, size = cap_body(body, options.max_body_bytes), F.least(size, F.lit(options.max_body_bytes))
    return gated.withColumns(
        {
            "body_bytes": size,
            "doc": parse_html(F.when(F.col("gate").isNull(), body), wanted),
        }
    )


def with_signals(parsed: DataFrame, options: Options, columns: tuple[str, ...] = signals.DECIDING) -> DataFrame:
    page = signals.page_signals("doc", "body_bytes", "tech_hints.cf_challenge", options, columns)
    return parsed.withColumn("page", F.when(_parsed(), page))


def with_extractions(scored: DataFrame, options: Options, usable: Column | None = None) -> DataFrame:
    """Adds one result struct per enabled extractor.

    Pages that are hollow and yielded any field in the first phase skip the second one.
    """
    first, second = split_phases(enabled_extractors(options))
    usable = _parsed() if usable is None else usable
    df = scored.withColumns({_column(e): F.when(usable, e.extract("doc", options)) for e in first})
    skip = F.expr(f"coalesce(page.is_hollow AND ({any_fields([_column(e) for e in first])}), false)")
    df = df.withColumn("skip_second", skip if first else F.lit(False))
    run = usable & ~F.col("skip_second")
    return df.withColumns({_column(e): F.when(run, e.extract("doc", options)) for e in second})


def with_decision(extracted: DataFrame, options: Options) -> DataFrame:
    """Adds fields, has_script_data and decision; a page that could not be parsed escalates."""
    results = {e: _column(e) for e in enabled_extractors(options)}
    decided = F.when(F.col("gate").isNotNull(), F.col("gate")).when(~_parsed(), F.lit(ESCALATE))
    return extracted.withColumns(
        {"fields": merge_fields(results, options), "has_script_data": has_script_data(results, options)}
    ).withColumn("decision", decided.otherwise(decide(F.col("page.is_hollow"), F.col("fields"), options)))


def extract_pages(responses: DataFrame, options: Options | None = None, columns: tuple[str, ...] = signals.COLUMNS) -> DataFrame:
    """All intermediate columns up to the decision; column pruning drops what is not read.

    It does not reach into ``page``: callers that read some of its fields only name them, ``signals.DECIDING`` at least.
    """
    configure(responses.sparkSession)
    options = options or Options()
    parsed = with_document(with_gate(responses), options)
    return with_decision(with_extractions(with_signals(parsed, options, columns), options), options)


def analysis_columns() -> list[Column]:
    page = F.col("page")
    return [
        F.col("decision"),
        F.col("retry_after_s"),
        F.coalesce(page["page_type"], F.lit("")).alias("page_type"),
        F.coalesce(page["page_type_confidence"], F.lit(0.0)).alias("page_type_confidence"),
        F.coalesce(page["hollow_score"], F.lit(0.0)).alias("hollow_score"),
        F.col("tech_hints"),
        F.col("fields"),
    ]


def computed_once(*columns: Column) -> Column:
    """The columns as output of a generator over one row.

    The optimizer pushes a filter on a computed column below the projection that computes it, and so
    computes everything, the parse included, a second time. It does not do so with a generator, while
    filters on columns that are passed on still reach the scan.
    """
    return F.inline(F.array(F.struct(*columns)))


def analyze(responses: DataFrame, options: Options | None = None) -> DataFrame:
    """Responses in, one analysis row per response out; other input columns are passed on.

    Needs status, headers, body and content_type. Works on a stream as it is.
    """
    keep = [c for c in responses.columns if c not in _NOT_PASSED_ON | set(ANALYSIS_COLUMNS)]
    return extract_pages(responses, options, signals.DECIDING).select(*keep, computed_once(*analysis_columns()))


def unparsed(responses: DataFrame, options: Options | None = None) -> DataFrame:
    """Responses that pass the gate and cannot be parsed, with the reason: (passed-on columns, error)."""
    configure(responses.sparkSession)
    parsed = with_document(with_gate(responses), options or Options(), signals_only=True)
    keep = [c for c in responses.columns if c not in _NOT_PASSED_ON]
    return parsed.select(*keep, computed_once(F.col("doc.error").alias("error"))).filter(F.col("error").isNotNull())


def classify(responses: DataFrame, options: Options | None = None) -> DataFrame:
    """Signals and class only, without extraction: (passed-on columns, gate, hollow_score, page_type, ...)."""
    configure(responses.sparkSession)
    options = options or Options()
    scored = with_signals(with_document(with_gate(responses), options, signals_only=True), options, signals.COLUMNS)
    page = F.col("page")
    keep = [c for c in responses.columns if c not in _NOT_PASSED_ON]
    return scored.select(*keep, computed_once(F.col("gate"), *[page[c].alias(c) for c in signals.COLUMNS]))


def candidates(responses: DataFrame, options: Options | None = None, key: str = "page_id") -> DataFrame:
    """Every extractor's fields before the merge, as rows."""
    options = options or Options()
    pages = extract_pages(responses, options, signals.DECIDING)
    return candidate_rows(pages, key, {e: _column(e) for e in enabled_extractors(options)})


def analyze_rendered(rendered: DataFrame, tier: int | None = None, options: Options | None = None) -> DataFrame:
    """Analysis of rendered pages (responses with rendered_url), with the wall check of the tier first.

    A wall gives Escalate with its reason and nothing else. Without ``tier`` the column ``tier`` counts, so
    that one scan and one parse serve all tiers.
    """
    configure(rendered.sparkSession)
    options = options or Options()
    selectors = [walls.SELECTORS[t] for t in walls.SELECTORS if tier in (None, t)]
    parsed = with_document(with_gate(rendered), options, *selectors, capped=False)
    reason = walls.wall_reason("doc", "rendered_url", "tier" if tier is None else str(tier))
    parsed = parsed.withColumn("escalation_reason", F.when(_parsed(), reason))
    free = _parsed() & F.col("escalation_reason").isNull()
    scored = with_signals(parsed, options).withColumn("page", F.when(free, F.col("page")))
    decided = with_decision(with_extractions(scored, options, free), options)
    decided = decided.withColumn(
        "decision", F.when(F.col("escalation_reason").isNotNull(), F.lit(ESCALATE)).otherwise(F.col("decision"))
    )
    keep = [c for c in rendered.columns if c not in _NOT_PASSED_ON | {"rendered_url", "final_url", "content_type"}]
    reason = F.coalesce("escalation_reason", F.lit("")).alias("escalation_reason")
    return decided.select(*keep, computed_once(*analysis_columns(), reason))

