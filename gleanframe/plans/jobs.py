"""Job store on append-only stage tables.

Each tier of a batch is one partition (stage, batch_id). Writing replaces that partition, so a job
that is run again after a failure leaves the same rows. A marker row without a job id says that a run
has finished a stage; as it is always there, a stage that yields no rows also replaces what was stored.

Stages 1 to 4 are the tiers; stage 10 + n holds the results of tier n that a completion has changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..constants import ABORT, JOB_ABORTED, JOB_CREATED, JOB_TIER_STATUS
from ..functions.joins import drop_matching, keep_matching
from ..options import Options
from ..schemas import FIELDS, RENDER_RESULT, STAGES, TIER1, TIER2
from ..sources.tables import tier1_record
from .cascade import decode_decision

_PAGE = ("decision", "page_type", "page_type_confidence", "hollow_score")
#: Order of the stored results of one tier; the last one counts.
VERSION = ("stage", "updated_at", "batch_id")
_STAGE_TYPES = {1: TIER1, 2: TIER2, 3: RENDER_RESULT, 4: RENDER_RESULT}


class JobNotFound(LookupError):
    """No job has this id."""


def job_id(url: Column, batch_id: Column) -> Column:
    """The same address in the same batch is the same job, on every run."""
    return F.sha2(F.concat_ws("\n", batch_id, url), 256)


def completed_stage(tier: int) -> int:
    """The stage of a tier's results that a completion has changed."""
    return 10 + tier


def _stage_rows(df: DataFrame, stage: int, status: Column, record: Column | None, updated_at: Column, final: bool) -> DataFrame:
    tiers = {
        f"tier{n}": (record if n == stage % 10 and record is not None else F.lit(None)).cast(_STAGE_TYPES[n]) for n in _STAGE_TYPES
    }
    return df.select(
        "job_id",
        "url",
        status.alias("status"),
        updated_at.alias("updated_at"),
        *[c.alias(name) for name, c in tiers.items()],
        (record["decision"] if final else F.lit(None).cast("string")).alias("final_decision"),
        (record["fields"] if final else F.lit(None)).cast(FIELDS).alias("final_fields"),
        F.lit(stage).alias("stage"),
        "batch_id",
    )


def created_rows(requests: DataFrame, now: Column) -> DataFrame:
    """Stage 0: one row per distinct request of a batch. Needs url and batch_id."""
    jobs = requests.select("url", "batch_id").distinct().withColumn("job_id", job_id(F.col("url"), F.col("batch_id")))
    return _stage_rows(jobs, 0, F.lit(JOB_CREATED), None, now, False)


def tier1_rows(responses: DataFrame, now: Column) -> DataFrame:
    """Stage 1 rows of responses with job_id and batch_id."""
    return _stage_rows(responses, 1, F.lit(JOB_TIER_STATUS[1]), tier1_record(responses), now, False)


def tier2_rows(analysis: DataFrame, now: Column, options: Options | None = None) -> DataFrame:
    """Stage 2 rows of an analysis with job_id, batch_id and elapsed_ms."""
    record = F.struct(*_PAGE, "tech_hints", "fields", "elapsed_ms", now.alias("analyzed_at"))
    status = F.lit(JOB_TIER_STATUS[2])
    if options is not None and options.mark_aborted:
        status = F.when(F.col("decision") == ABORT, F.lit(JOB_ABORTED)).otherwise(status)
    return _stage_rows(analysis, 2, status, record, now, False)


def render_rows(results: DataFrame, tier: int, now: Column) -> DataFrame:
    """Stage 3 or 4 rows; they also carry the final decision and fields."""
    record = F.struct(*_PAGE, "escalation_reason", "fields", "elapsed_ms", now.alias("rendered_at"))
    return _stage_rows(results, tier, F.lit(JOB_TIER_STATUS[tier]), record, now, True)


def completed_rows(results: DataFrame, tier: int, now: Column) -> DataFrame:
    """Rows of a tier's stored results (job_id, url, batch_id, record) with the decision and fields of a completion.

    The status stays that of the tier.
    """
    record = F.col("record").withField("decision", F.col("decision")).withField("fields", F.col("fields"))
    return _stage_rows(results, completed_stage(tier), F.lit(None).cast("string"), record, now, tier > 2)


def write_stage(rows: DataFrame, path: str, part: tuple[int, str] | None = None) -> None:
    """Replaces the (stage, batch_id) partitions the rows belong to.

    ``part`` names the one partition that all rows belong to: it gets a marker row, and so is replaced by no rows, too.
    """
    if part is not None:
        nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields[:-2]]
        marker = rows.sparkSession.range(1).select(*nothing, F.lit(part[0]).alias("stage"), F.lit(part[1]).alias("batch_id"))
        rows = rows.unionByName(marker.withColumn("updated_at", F.current_timestamp()))
    rows.write.partitionBy("stage", "batch_id").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def _all_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(StructType.fromDDL(STAGES)).parquet(path)


def read_stages(spark: SparkSession, path: str) -> DataFrame:
    return _all_rows(spark, path).filter(F.col("job_id").isNotNull())


def finished_stages(spark: SparkSession, path: str) -> DataFrame:
    """(stage, batch_id, finished_at) of every stage that a run has written to its end."""
    markers = _all_rows(spark, path).filter(F.col("job_id").isNull())
    return markers.select("stage", "batch_id", F.col("updated_at").alias("finished_at"))


def _without_body(stages: DataFrame) -> Column:
    t = F.col("tier1")
    names = [f.name for f in stages.schema["tier1"].dataType.fields if f.name != "body"]
    return F.when(t.isNotNull(), F.struct(*[t[n].alias(n) for n in names]))


def job_view(stages: DataFrame, with_body: bool = False) -> DataFrame:
    """One document per job with all patches applied: the latest non-NULL value of each part.

    A tier's result that a completion has changed comes before the one without. Bodies are left out
    unless asked for, and are then not read from storage either.
    """

    def latest(column: str, *order: str | Column) -> Column:
        c = F.col(column)
        return F.max_by(c, F.when(c.isNotNull(), F.struct(*(order or ("updated_at", F.col("stage") % 10, "stage", "batch_id")))))

    rows = stages if with_body else stages.withColumn("tier1", _without_body(stages))
    return rows.groupBy("job_id").agg(
        F.max("url").alias("url"),
        F.min("updated_at").alias("created_at"),
        F.max("updated_at").alias("updated_at"),
        latest("status").alias("status"),
        *[latest(f"tier{n}", *VERSION).alias(f"tier{n}") for n in _STAGE_TYPES],
        latest("final_decision").alias("final_decision"),
        latest("final_fields").alias("final_fields"),
    )


def get_job(stages: DataFrame, job: str, with_body: bool = True) -> DataFrame:
    """The document of one job, read once; raises JobNotFound."""
    found = job_view(stages.filter(F.col("job_id") == job), with_body)
    rows = found.collect()  # one job
    if not rows:
        raise JobNotFound(job)
    return stages.sparkSession.createDataFrame(rows, found.schema)


def done_jobs(stages: DataFrame, stage: int) -> DataFrame:
    """Distinct ids of the jobs that have a stored result of a stage. Rows of a stage hold its result; no struct is read."""
    return stages.filter(F.col("stage") == stage).select("job_id").distinct()


def pending(jobs: DataFrame, stages: DataFrame, stage: int, salts: int = 1) -> DataFrame:
    """Rows of jobs that have no stored result of a stage yet. For ``salts`` see ``attach``."""
    return drop_matching(jobs, done_jobs(stages, stage), "job_id", salts)


def stored_analysis(stages: DataFrame) -> DataFrame:
    """Latest stored tier-2 rows as analysis rows again; unknown decisions read as Escalate."""
    t = F.max_by("tier2", F.struct(*VERSION))
    tier2 = stages.filter(F.col("stage").isin(2, completed_stage(2)) & F.col("tier2").isNotNull())
    rows = tier2.groupBy("job_id").agg(F.max("url").alias("url"), t.alias("t"))
    names = (*_PAGE[1:], "tech_hints", "fields", "elapsed_ms")
    return rows.select(
        "job_id", "url", decode_decision(F.col("t.decision")).alias("decision"), *[F.col(f"t.{n}") for n in names]
    )


def resume_analysis(jobs: DataFrame, stages: DataFrame, analyzed: DataFrame) -> DataFrame:
    """Analysis per job: the stored one where it exists, else the row of ``analyzed``.

    ``analyzed`` should come from ``pending(jobs, stages, 2)``, so that stored jobs are not analysed again.
    """
    stored = stored_analysis(stages)
    return keep_matching(stored, jobs.select("job_id").distinct(), "job_id").unionByName(analyzed.select(*stored.columns))
