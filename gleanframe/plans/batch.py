"""A batch of jobs through all tiers, on the job store.

Every tier is written before the next one starts, so no tier is computed twice, neither by a later
tier nor by a run that picks up where another one broke off. A job's life: created by its request,
fetched, analysed, rendered where it escalates. Where a tier found no field, ``batch_prompts`` gives the
prompt, and a later run that brings its completion stores the changed result as a stage of its own.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..constants import DONE, ESCALATE
from ..functions.joins import drop_matching, keep_matching
from ..operators.fallback import apply_completions, is_eligible
from ..options import Options
from ..sources.tables import cap_body, fetch_target, media_type, rendered_as_responses, stored_as_responses
from . import jobs
from .analyze import analyze, analyze_rendered
from .prompts import prompts_of


def _stored(rows: DataFrame, path: str) -> DataFrame:
    """The stage table as it is now; empty when nothing was written yet."""
    spark = rows.sparkSession
    try:
        stages = jobs.read_stages(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        types = StructType.fromDDL(jobs.STAGES)
        return spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in types]).limit(0)
    spark.catalog.refreshByPath(path)
    return stages


def _todo(rows: DataFrame, stages: DataFrame, stage: int, salts: int, wanted: DataFrame | None = None) -> DataFrame:
    """Pending rows, with ``wanted`` (job_id) only those of its jobs.

    A first run, which has nothing stored, does not look for stored jobs and so shuffles no bodies for
    it. A later one first asks by the ids alone whether anything is left, as most often nothing is.
    """
    first = stages.filter(F.col("stage") == stage).isEmpty()

    def left(rows: DataFrame) -> DataFrame:
        rows = rows if wanted is None else keep_matching(rows, wanted, "job_id", salts)
        return rows if first else jobs.pending(rows, stages, stage, salts)

    if not first and left(rows.select("job_id").distinct()).isEmpty():
        return rows.filter(F.lit(False))
    return left(rows)


def _of_batch(rows: DataFrame, path: str, batch: str) -> DataFrame:
    return _stored(rows, path).filter(F.regexp_extract("batch_id", r"^(.*)\.[^.]*$", 1) == batch)


def _latest(stages: DataFrame, tier: int, *columns: Column) -> DataFrame:
    """One row per job: the columns of its latest result of a tier, one that a completion has changed first."""
    rows = stages.filter(F.col("stage").isin(tier, jobs.completed_stage(tier)))
    best = F.max_by(F.struct("url", *columns), F.struct(*jobs.VERSION)).alias("r")
    return rows.groupBy("job_id").agg(best).select("job_id", "r.*")


def _unanswered(stages: DataFrame, tier: int, options: Options) -> DataFrame:
    """(job_id, url, record, decision, fields, page_type) of a tier's results that may take a completion."""
    record = F.col(f"tier{tier}")
    rows = _latest(stages, tier, record.alias("record"))
    rows = rows.select("*", *[F.col(f"record.{c}").alias(c) for c in ("decision", "fields", "page_type")])
    return rows.filter(F.lit(options.fallback_enabled) & is_eligible(F.col("decision"), F.col("fields"), F.col("page_type")))


def to_fetch(requests: DataFrame, path: str, batch: str, salts: int = 1) -> DataFrame:
    """(job_id, url, target) of the distinct requests (url, api_endpoint) of a batch that have no stored response yet.

    Of several endpoints for one address the smallest by text counts, so that each job is fetched once.
    """
    endpoint = F.col("api_endpoint") if "api_endpoint" in requests.columns else F.lit(None).cast("string")
    wanted = requests.groupBy("url").agg(F.min(fetch_target(F.col("url"), endpoint)).alias("target"))
    wanted = wanted.select(jobs.job_id(F.col("url"), F.lit(batch)).alias("job_id"), "url", "target")
    return jobs.pending(wanted, _of_batch(requests, path, batch), 1, salts)


def batch_prompts(
    rendered: DataFrame | None, path: str, batch: str, spark: SparkSession, options: Options | None = None, salts: int = 1
) -> DataFrame:
    """(job_id, url, tier, clean_text, prompt) of the stored results without a field that wait for a completion.

    Tier 2 reads the stored bodies; tiers 3 and 4 read ``rendered``.
    """
    options = options or Options()
    stages = _of_batch(spark.range(0), path, batch)
    asked = None
    for tier in (2, 3, 4) if rendered is not None else (2,):
        jobs_asked = _unanswered(stages, tier, options).select("job_id")
        if tier == 2:
            latest = F.max_by(F.struct("url", F.col("tier1.body").alias("body")), F.struct(*jobs.VERSION)).alias("r")
            pages = keep_matching(stages.filter(F.col("stage") == 1), jobs_asked, "job_id", salts)
            pages = pages.groupBy("job_id").agg(latest).select("job_id", "r.url", cap_body(F.col("r.body"), options.max_body_bytes).alias("body"))
        else:
            pages = rendered_as_responses(rendered.filter(F.col("tier") == tier)).select("url", "body")
            pages = pages.withColumn("job_id", jobs.job_id(F.col("url"), F.lit(batch)))
            pages = keep_matching(pages, jobs_asked, "job_id", salts)
            pages = pages.groupBy("job_id").agg(F.first("url").alias("url"), F.min("body").alias("body"))
        found = prompts_of(pages.withColumn("tier", F.lit(tier)), options, "job_id", "url", "tier")
        asked = found if asked is None else asked.unionByName(found)
    return asked


def run_batch(
    responses: DataFrame,
    rendered: DataFrame | None,
    path: str,
    batch: str,
    run: str,
    options: Options | None = None,
    now: Column | None = None,
    salts: int = 1,
    requests: DataFrame | None = None,
    completions: DataFrame | None = None,
) -> DataFrame:
    """Runs what the store at ``path`` still lacks for the batch; returns the results per job.

    A job is an address in a batch. ``run`` names this attempt: a new name skips every job and tier that
    other attempts stored, the same name does its own part again and replaces it; it must then bring the
    jobs it brought before, as these would be lost otherwise. One response per address is expected; of
    several, the one that was stored last counts; set ``salts`` (see ``attach``) where one has very many.

    ``requests`` (url) creates jobs that may have no response yet. A response without a status is a
    fetch that failed: its job stays created, and ``to_fetch`` names it again. ``completions`` (url,
    completion, error, and tier, else for every tier) answers ``batch_prompts``; one that gives no field is not stored.
    """
    if "." in run:
        raise ValueError("the name of a run has no dot: it is what follows the last one in batch_id")
    options = options or Options()
    now = F.current_timestamp() if now is None else now
    part = F.lit(f"{batch}.{run}")

    def with_job(df: DataFrame) -> DataFrame:
        return df.withColumns({"job_id": jobs.job_id(F.col("url"), F.lit(batch)), "batch_id": part})

    def of_batch() -> DataFrame:
        return _of_batch(responses, path, batch)

    def todo(rows: DataFrame, stage: int, wanted: DataFrame | None = None) -> DataFrame:
        # What this very run wrote before is about to be replaced, so it does not count as stored.
        return _todo(rows, of_batch().filter(F.col("batch_id") != part), stage, salts, wanted)

    def write(rows: DataFrame, stage: int) -> None:
        jobs.write_stage(rows, path, (stage, f"{batch}.{run}"))

    def complete(tier: int) -> None:
        if completions is None or not options.fallback_enabled:
            return
        given = completions.filter(F.col("tier") == tier) if "tier" in completions.columns else completions
        given = given.select(jobs.job_id(F.col("url"), F.lit(batch)).alias("job_id"), "completion", "error")
        # What this very run completed before is asked for again from the tier's own result.
        stages = of_batch().filter(~((F.col("stage") == jobs.completed_stage(tier)) & (F.col("batch_id") == part)))
        answered = apply_completions(_unanswered(stages, tier, options), given, options, "job_id", salts)
        done = answered.filter(F.col("decision") == DONE).withColumn("batch_id", part)
        write(jobs.completed_rows(done, tier, now), jobs.completed_stage(tier))

    fetched = with_job(responses)
    addresses = responses.select("url") if requests is None else responses.select("url").unionByName(requests.select("url"))
    created = with_job(jobs.created_rows(with_job(addresses), now))
    before = of_batch().filter((F.col("stage") == 0) & (F.col("batch_id") == part)).select("job_id")
    if not before.isEmpty() and not drop_matching(before, created.select("job_id"), "job_id").isEmpty():
        raise ValueError(f"run {run} has stored jobs that this input lacks; take a new name for other input")
    write(todo(created, 0), 0)
    got = fetched.filter(F.col("status").isNotNull()).withColumn("content_type", media_type(F.col("content_type")))
    write(jobs.tier1_rows(todo(got, 1), now), 1)

    stored = stored_as_responses(of_batch().filter(F.col("stage") == 1)).withColumn("batch_id", part)
    write(jobs.tier2_rows(analyze(todo(stored, 2), options), now, options), 2)
    complete(2)

    for tier in (3, 4) if rendered is not None else ():
        before = _latest(of_batch(), tier - 1, F.col(f"tier{tier - 1}.decision").alias("decision"))
        escalated = before.filter(F.col("decision") == ESCALATE).select("job_id")
        pages = with_job(rendered_as_responses(rendered.filter(F.col("tier") == tier)))
        took = F.col("elapsed_ms") if "elapsed_ms" in pages.columns else F.lit(0)
        pages = pages.withColumn("elapsed_ms", F.coalesce(took, F.lit(0)).cast("bigint"))
        # Routed before they are parsed: parsing is the dearest step.
        reached = todo(pages, tier, escalated)
        write(jobs.render_rows(analyze_rendered(reached, tier, options), tier, now), tier)
        complete(tier)
    return batch_results(of_batch())


def batch_results(stages: DataFrame) -> DataFrame:
    """(job_id, url, status, tier, decision, page_type, escalation_reason, fields) of every job with a result.

    A tier counts only while the one before escalates: a completion that came later may have ended it there.
    """
    view = jobs.job_view(stages)
    for tier in (3, 4):
        escalated = F.col(f"tier{tier - 1}.decision") == ESCALATE
        view = view.withColumn(f"tier{tier}", F.when(escalated, F.col(f"tier{tier}")))
    last = F.coalesce("tier4", "tier3")
    tier = F.when(F.col("tier4").isNotNull(), 4).when(F.col("tier3").isNotNull(), 3).otherwise(2)

    def final(name: str) -> Column:
        return F.when(last.isNotNull(), last[name]).otherwise(F.col(f"tier2.{name}")).alias(name)

    return view.filter(F.col("tier2").isNotNull()).select(
        "job_id",
        "url",
        "status",
        tier.alias("tier"),
        final("decision"),
        final("page_type"),
        F.coalesce(last["escalation_reason"], F.lit("")).alias("escalation_reason"),
        final("fields"),
    )
