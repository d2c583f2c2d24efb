"""Sources: responses, stored responses, rendered pages and page tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import MAX_BODY_BYTES, WHITE_SPACE
from ..schemas import RENDERED_PAGES, RESPONSES


def read_responses(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Responses as the scan splits them, or dealt over ``partitions``, which shuffles every body."""
    rows = spark.read.schema(RESPONSES).parquet(path)
    return rows.repartition(partitions) if partitions else rows


def stream_responses(spark: SparkSession, path: str, max_files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(RESPONSES).option("maxFilesPerTrigger", max_files_per_trigger).parquet(path)


def read_rendered_pages(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Rendered pages; for ``partitions`` see :func:`read_responses`. Files without elapsed_ms read as NULL there."""
    rows = spark.read.schema(RENDERED_PAGES).parquet(path)
    return rows.repartition(partitions) if partitions else rows


def pages_as_responses(pages: DataFrame, *keep: str) -> DataFrame:
    """A (page_id, url, html) table as plain 200 responses; further columns are kept by name."""
    return pages.select(
        "page_id",
        "url",
        F.lit(200).alias("status"),
        _no_headers().alias("headers"),
        F.col("html").cast("binary").alias("body"),
        F.col("url").alias("final_url"),
        F.lit("text/html").alias("content_type"),
        F.lit(0).cast("bigint").alias("elapsed_ms"),
        F.lit(None).cast("timestamp").alias("fetched_at"),
        *keep,
    )


def rendered_as_responses(rendered: DataFrame) -> DataFrame:
    """Rendered HTML as synthetic responses: status 200, HTML, no headers, final address = requested address."""
    return rendered.select(
        *[c for c in ("page_id", "url", "tier", "rendered_url", "elapsed_ms") if c in rendered.columns],
        F.lit(200).alias("status"),
        _no_headers().alias("headers"),
        F.col("html").cast("binary").alias("body"),
        F.col("url").alias("final_url"),
        F.lit("text/html").alias("content_type"),
    )


def _no_headers() -> Column:
    return F.create_map().cast("map<string,array<string>>")


def fetch_target(url: Column, api_endpoint: Column) -> Column:
    """A non-empty API endpoint replaces the address."""
    return F.coalesce(F.nullif(api_endpoint, F.lit("")), url)


def media_type(content_type: Column) -> Column:
    """Text before ';', trimmed; without ';' the value stays as it is."""
    cut = F.trim(F.substring_index(content_type, ";", 1), F.lit(WHITE_SPACE))
    return F.when(F.contains(content_type, F.lit(";")), cut).otherwise(content_type)


def cap_body(body: Column, max_bytes: int = MAX_BODY_BYTES) -> Column:
    return F.substring(body, 1, max_bytes)


def flatten_headers(headers: Column) -> Column:
    """First value per header; headers without a value are dropped."""
    return F.transform_values(F.map_filter(headers, lambda k, v: F.size(v) > 0), lambda k, v: v[0])


def tier1_record(responses: DataFrame) -> Column:
    """Response columns as the stored tier-1 struct."""
    return F.struct(
        F.col("status").alias("status_code"),
        "final_url",
        "content_type",
        "elapsed_ms",
        flatten_headers(F.col("headers")).alias("headers"),
        "body",
        "fetched_at",
    )


def stored_as_responses(stages: DataFrame) -> DataFrame:
    """Stored tier-1 structs as responses again, one value per header."""
    t = F.col("tier1")
    return stages.filter(t.isNotNull()).select(
        "job_id",
        "url",
        t["status_code"].alias("status"),
        F.transform_values(t["headers"], lambda k, v: F.array(v)).alias("headers"),
        t["body"].alias("body"),
        t["final_url"].alias("final_url"),
        t["content_type"].alias("content_type"),
        t["elapsed_ms"].alias("elapsed_ms"),
        t["fetched_at"].alias("fetched_at"),
    )


def glob_pattern(glob: str) -> str:
    """Regular expression of a glob: '*' is any text, '?' any character."""
    return "^" + "".join({"*": "[\\s\\S]*", "?": "[\\s\\S]"}.get(c, "\\Q" + c + "\\E") for c in glob) + "$"


def drop_blocked(links: DataFrame, block_domains: tuple[str, ...], url: str = "url") -> DataFrame:
    """Rows whose address no glob of the list matches."""
    if not block_domains:
        return links
    blocked = F.rlike(F.col(url), F.lit("|".join(f"(?:{glob_pattern(g)})" for g in block_domains)))
    return links.filter(~F.coalesce(blocked, F.lit(False)))
