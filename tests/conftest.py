from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gleanframe.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("gleanframe-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
    yield configure(session)
    session.stop()


@pytest.fixture
def analyzed(spark):
    """Analyses one hand-written page: (row, {key: (value, source)})."""
    from gleanframe.plans.analyze import analyze
    from gleanframe.schemas import RESPONSES

    def run(html, options=None, status=200, headers=None, content_type="text/html"):
        body = html.encode() if isinstance(html, str) else html
        row = (1, "https://example.com/", status, headers or {}, bytearray(body), "https://example.com/", content_type, 1, None)
        result = analyze(spark.createDataFrame([row], RESPONSES), options).first()
        return result, {k: (f.value, f.source) for k, f in result.fields.items()}

    return run
