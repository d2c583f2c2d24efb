"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR is the folder of tables, BENCH_CPUS the number of local cores. Each query is built and
run to the end, without collecting its rows; ``pages_per_sec`` is the analysis of the pages table.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gleanframe.queries import QUERIES  # noqa: E402

HEADLINE = (
    "page_fields",
    "page_class",
    "h6_link_table",
    "g4_short_circuit",
    "c9_score",
    "e1_json_ld",
    "e5_meta_tags",
    "e9_css_hidden",
    "m5_priority_merge",
    "m5_priority_merge_of_rows",
    "l2_clean_text",
    "l5_fallback_merge",
    "r1_cascade",
    "r2_tier3_walls",
    "j4_job_view",
    "j6_resume",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("gleanframe-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-"))

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    wanted = sys.argv[1:] or HEADLINE
    run(wanted[0])  # starts the JVM's and the Python workers' warm life
    seconds = {name: run(name) for name in wanted}
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
    }
    if "page_fields" in seconds:
        n_pages = spark.read.parquet(f"{folder}/pages.parquet").count()
        result["pages_per_sec"] = round(n_pages / seconds["page_fields"], 1)
    print(json.dumps(result))


if __name__ == "__main__":
    main()
