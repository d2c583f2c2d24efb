"""Session settings the results depend on, and settings that keep memory bounded."""

from __future__ import annotations

from pyspark.sql import SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Set what the plans need; call it before building a query."""
    # Fields are written last-wins, duplicate JSON keys too.
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # Page bodies are large: bound an Arrow batch by rows and by bytes.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 * 1024 * 1024))
    return spark
