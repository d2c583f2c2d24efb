"""Joins that stand a hot key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: A key is hot if it holds at least this share of the rows; so at most 1 / HOT_SHARE keys are hot.
HOT_SHARE = 0.001


def hot_keys(rows: DataFrame, key: str) -> list:
    """The keys that hold HOT_SHARE of the rows or more, a bounded number. Reads the keys alone."""
    counts = rows.select(key).filter(F.col(key).isNotNull())
    least = max(2.0, counts.count() * HOT_SHARE)
    return [r[0] for r in counts.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select(key).collect()]


def _salted(left: DataFrame, right: DataFrame, salts: int, key: str | None = None, hot: list | None = None) -> tuple[DataFrame, DataFrame]:
    if salts <= 1:
        return left, right
    content = [c for c, kind in left.dtypes if "map<" not in kind and "variant" not in kind]
    salt, copies = F.pmod(F.xxhash64(*content), F.lit(salts)), F.sequence(F.lit(0), F.lit(salts - 1))
    if hot is not None:
        is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
        salt, copies = F.when(is_hot, salt).otherwise(F.lit(0)), F.when(is_hot, copies).otherwise(F.array(F.lit(0)))
    return left.withColumn("_salt", salt), right.withColumn("_right_salt", F.explode(copies))


def attach(
    left: DataFrame, right: DataFrame, key: str, condition: Column | None = None, salts: int = 1, hot: list | None = None
) -> DataFrame:
    """Left join with a right side that has one row per key; the right key is dropped.

    With a key that is unique on the left too, one salt is right. Where one key may hold a large share
    of the left rows, they are split into ``salts`` groups and each right row is copied once per group.
    The salt of a row is a hash of its content (maps aside), wherever the row lies. With ``hot``, the
    :func:`hot_keys` of the left, only these keys are split and copied.
    """
    left, right = _salted(left, right, salts, key, hot)
    right = right.withColumnRenamed(key, "_right_key")
    on = left[key] == right["_right_key"]
    if salts > 1:
        on = on & (left["_salt"] == right["_right_salt"])
    if condition is not None:
        on = on & condition
    return left.join(right, on, "left").drop("_right_key", "_salt", "_right_salt")


def _filtered(left: DataFrame, keys: DataFrame, key: str, how: str, salts: int, hot: list | None = None) -> DataFrame:
    left, keys = _salted(left, keys, salts, key, hot)
    keys = keys.withColumnRenamed(key, "_right_key")
    on = left[key] == keys["_right_key"]
    if salts > 1:
        on = on & (left["_salt"] == keys["_right_salt"])
    return left.join(keys, on, how)


def keep_matching(left: DataFrame, keys: DataFrame, key: str, salts: int = 1) -> DataFrame:
    """Left rows whose key is in a table of distinct keys; salted as in :func:`attach`."""
    return _filtered(left, keys, key, "left_semi", salts).drop("_salt")


def one_copy_matching(left: DataFrame, keys: DataFrame, key: str, copy: str, salts: int, hot: list | None) -> DataFrame:
    """As :func:`keep_matching`, but of the rows that agree in key and ``copy`` only one per salt group.

    The groups lie where the salted join has put them, so nothing is shuffled again.
    """
    kept = _filtered(left, keys, key, "left_semi", salts, hot)
    return kept.groupBy(key, "_salt", copy).agg(F.first(F.struct(*left.columns)).alias("_row")).select("_row.*")


def drop_matching(left: DataFrame, keys: DataFrame, key: str, salts: int = 1) -> DataFrame:
    """Left rows whose key is not in a table of distinct keys; salted as in :func:`attach`."""
    return _filtered(left, keys, key, "left_anti", salts).drop("_salt")
