"""Exact copies against plain Python, with collisions forced by a short hash."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gleanframe.llm import exact_dedup as dedup

SCHEMA = "doc_id long, text string, lang string, keep_id string"
TEXTS = ["a  b", "a b", "a\tb", "a b ", None, "", "c", "c", "d" * 5000, "d" * 5000, " ", " ", "A b", "e"]


def normal(text: str | None) -> str:
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("digest", [dedup.content_hash, lambda c: F.substring(F.md5(c), 1, 1).cast("binary")])
def test_groups(spark, digest):
    rows = [(100 - i, t, None, "clash") for i, t in enumerate(TEXTS)]
    out = {r.doc_id: r for r in dedup.exact_dedup(spark.createDataFrame(rows, SCHEMA), digest=digest).collect()}
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[normal(t)].append(i)
    assert len(out) == len(rows)
    for i, t, *_ in rows:
        r, ids = out[i], groups[normal(t)]
        assert (r.keep_id, r.group_size, r.kept) == (min(ids), len(ids), i == min(ids))
        assert r.text_sha256 == hashlib.sha256(normal(t).encode()).hexdigest()


def test_one_row_stays_where_rows_or_ids_repeat(spark):
    rows = [(1, "a", "x", "k"), (1, "a", "x", "k"), (1, "a", "y", "k"), (None, "b", "x", "k"), (None, "b", "x", "k"), (2, "b c", "x", "k"), (2, "d", "x", "k")]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = dedup.exact_dedup(docs).collect()
    assert len(out) == 7 and sum(r.kept for r in out) == 4
    kept = dedup.without_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "b"), (1, "a"), (2, "b c"), (2, "d")]


def test_a_hot_group(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    out = dedup.exact_dedup(docs)
    assert out.filter("keep_id = 0 AND group_size = 1000").count() == 1000
    assert out.filter("kept").count() == 2001


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert dedup.exact_dedup(empty).count() == 0 and dedup.without_copies(empty).count() == 0
