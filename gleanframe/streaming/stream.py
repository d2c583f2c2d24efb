"""The same analysis on a stream of responses. It is stateless: each row stands alone."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..options import Options
from ..plans.analyze import analyze
from ..plans.jobs import job_id, tier2_rows, write_stage


def analyze_stream(responses: DataFrame, options: Options | None = None) -> DataFrame:
    return analyze(responses, options)


def write_analysis_stream(
    responses: DataFrame, path: str, checkpoint: str, options: Options | None = None, available_now: bool = True, batch: str | None = None
) -> StreamingQuery:
    """Writes tier-2 stage rows, one partition per micro-batch.

    With ``batch`` the jobs are those of ``run_batch`` for that batch, which then skips what the stream has
    analysed and goes on from there. Without it each response is a job of its own.

    A micro-batch that is replayed after a failure has the same id and replaces its own partition. The
    checkpoint is part of that id: another stream, or the same one from a new checkpoint, replaces nothing.
    """

    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def save(rows: DataFrame, epoch: int) -> None:
        part = f"stream-{stream}-{epoch}" if batch is None else f"{batch}.stream-{stream}-{epoch}"
        scope = F.col("page_id").cast("string") if batch is None else F.lit(batch)
        rows = rows.withColumns({"batch_id": F.lit(part), "job_id": job_id(F.col("url"), scope)})
        write_stage(tier2_rows(rows, F.current_timestamp(), options), path, (2, part))

    writer = analyze_stream(responses, options).writeStream.option("checkpointLocation", checkpoint).foreachBatch(save)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
