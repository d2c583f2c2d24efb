"""Helpers the operators share: a written table to cut lineage, fixed-size bit filters, joins on hot keys."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Runs of the six ASCII white-space characters, for the regular expressions of the JVM.
SPACES = r"[\x20\x09-\x0D]+"
#: Bits of a filter: 8 MB, whatever the size of the data. A fuller filter lets more rows through, never fewer.
FILTER_BITS = 1 << 26
#: Rows of a bitmap that the built-in aggregate makes.
_BLOCK = 32768
#: A key is hot if it holds at least this share of the rows; so at most 1 / HOT_SHARE keys are hot.
HOT_SHARE = 0.001


def work_folder(spark: SparkSession) -> str:
    """A new folder below the shared one that the cluster names, else below the warehouse."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: later reads survive lost executors and compute nothing twice."""
    folder = work_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, made longer until df has no column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while not taken.isdisjoint(n.lower() for n in names):
        names = tuple(n + "_" for n in names)
    return list(names)


def words(text: Column) -> Column:
    """The words of a text as an array; NULL and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


class BitFilter:
    """Which 64-bit keys may be in a set: a bitmap of fixed size, collected once and sent to the tasks.

    A key that was put in is always found; others are found with a chance that grows as the map fills.
    Callers use it only to leave out rows that an exact step would drop later.
    """

    def __init__(self, keys: DataFrame, column: str, bits: int = FILTER_BITS):
        slot = F.pmod(F.col(column), F.lit(bits))
        parts = (
            keys.select(slot.alias("slot"))
            .groupBy((F.col("slot") / _BLOCK).cast("int").alias("block"))
            .agg(F.bitmap_construct_agg(F.col("slot") % _BLOCK).alias("bitmap"))
            .collect()  # at most bits / _BLOCK rows of 4 KB
        )
        table = np.zeros(bits // 8, dtype=np.uint8)
        for row in parts:
            at = row.block * _BLOCK // 8
            table[at : at + _BLOCK // 8] = np.frombuffer(bytes(row.bitmap), dtype=np.uint8)
        self.bits = bits
        self._table = keys.sparkSession.sparkContext.broadcast(table)

    def __contains__(self, _):
        raise TypeError("use has()")

    def has(self, keys: np.ndarray) -> np.ndarray:
        """For each 64-bit key whether it may have been put in."""
        slot = keys.astype(np.uint64) & np.uint64(self.bits - 1)
        table = self._table.value
        return (table[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def join_hot(left: DataFrame, right: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """Join where ``right`` has one row per key and says in ``weight`` how many rows of ``left`` have it.

    Keys with HOT_SHARE of the weight or more, a bounded number, are joined by broadcast where their rows
    lie; only the others are shuffled. With no more keys than could be hot all are broadcast, and ``left`` is
    computed once. ``right`` is read three times: pass a written table.
    """
    keys, total = right.agg(F.count(F.lit(1)), F.sum(weight)).first()
    if keys <= 1 / HOT_SHARE:
        return left.join(F.broadcast(right), key, how)
    is_hot = F.col(weight) >= max(2.0, (total or 0) * HOT_SHARE)
    hot = F.broadcast(right.filter(is_hot))
    known = left.join(hot, key, "inner")
    rest = left.join(F.broadcast(right.filter(is_hot).select(key)), key, "left_anti")
    return known.unionByName(rest.join(right.filter(~is_hot), key, how))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once per row, also where later lambdas read them again and again.

    Without the generator the optimizer may copy a column's expression into the lambda that reads it.
    """
    name = "_once_" + uuid.uuid4().hex[:8]
    fields = F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias(name)
    keep = [c for c in df.columns if c not in columns]
    return df.select(*keep, fields).select(*keep, *[F.col(f"{name}.{k}").alias(k) for k in columns])


def map_rows(df: DataFrame, schema: str | StructType, rows: Callable[[Iterator[tuple]], Iterable[tuple]]) -> DataFrame:
    """mapInArrow over rows as tuples: ``rows`` gets those of one bounded batch at a time."""
    types = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = list(rows(zip(*(c.to_pylist() for c in batch.columns), strict=True)))
            columns = list(zip(*out, strict=True)) if out else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types, strict=True)], schema=types)

    return df.mapInArrow(run, schema)
