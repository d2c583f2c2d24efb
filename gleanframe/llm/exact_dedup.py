"""Exact copies: 128-bit content hash, smallest id, bytes compared inside the groups.

Two texts are equal when they are identical after every run of white space became one space. NULL
counts as the empty text, and all empty texts are one group. A NULL id is larger than any other.
Rows that repeat an id are separate rows; if several rows of a group carry the smallest id, exactly
one of them is kept. Other columns are left alone, whatever their names.

Plan: one aggregate on (hash, text) with map-side combine. The text in its key is the comparison of
bytes: equal hashes with different bytes end as different rows. It moves each distinct text once per
map task, a hot group no more than any other. What follows moves hashes and ids only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACES, fresh, join_hot, saved

_OWN = ("_hash", "_keep", "_size", "_texts", "_text")


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def content_hash(text: Column) -> Column:
    """128 bits of the normalised text."""
    return F.unhex(F.md5(text))


def groups(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per distinct text: _hash, _keep, _size, and _text where other texts share its hash (else NULL)."""
    text = normalised(F.col(text_col))
    rows = docs.select(digest(text).alias("_hash"), text.alias("_text"), F.col(id_col).alias("_id"))
    by_text = rows.groupBy("_hash", "_text").agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
    # One struct instead of a second copy of the text: first text of the hash, and whether there are others.
    by_hash = by_text.groupBy("_hash").agg(
        F.count(F.lit(1)).alias("_texts"), F.min("_keep").alias("_keep"), F.sum("_size").alias("_size")
    )
    by_hash = saved(by_hash)
    alone = by_hash.filter("_texts = 1").select("_hash", "_keep", "_size", F.lit(None).cast("string").alias("_text"))
    clashes = by_hash.filter("_texts > 1").select("_hash")
    if clashes.isEmpty():
        return alone
    others = by_text.join(clashes, "_hash", "left_semi").select("_hash", "_keep", "_size", "_text")
    return saved(alone.unionByName(others))


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = content_hash
) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256 (of the normalised text, in hex)."""
    text = normalised(F.col(text_col))
    found = groups(docs, id_col, text_col, digest)
    rows = docs.select(F.col(id_col).alias("_id"), digest(text).alias("_hash"), F.sha2(text, 256).alias("_sha"))
    plain = join_hot(rows, found.filter("_text IS NULL").drop("_text"), "_hash", "_size")
    clashing = found.filter("_text IS NOT NULL")
    if not clashing.isEmpty():
        texts = docs.select(F.col(id_col).alias("_id"), digest(text).alias("_hash"), text.alias("_text"), F.sha2(text, 256).alias("_sha"))
        plain = plain.unionByName(texts.join(clashing, ["_hash", "_text"]).drop("_text"))
    # Among rows that repeat the smallest id one stays; a running number needs no buffer.
    first = F.row_number().over(Window.partitionBy("_hash", "_sha", "_id").orderBy("_size")) == 1
    return plain.select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        (F.col("_id").eqNullSafe(F.col("_keep")) & first).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    key, sha, own = fresh(docs, "_id", "_sha", "_sha_of_row")
    kept = exact_dedup(docs, id_col, text_col).filter("kept").select(F.col(id_col).alias(key), F.col("text_sha256").alias(sha))
    rows = docs.withColumn(own, F.sha2(normalised(F.col(text_col)), 256))
    same = F.col(own).eqNullSafe(F.col(sha)) & F.col(id_col).eqNullSafe(F.col(key))
    rows = rows.join(kept, same, "left_semi")
    return rows.dropDuplicates([id_col, own]).drop(own)
