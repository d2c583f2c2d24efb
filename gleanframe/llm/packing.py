"""Best-fit packing planned on the histogram of lengths.

Texts become token ids and an end mark. A document longer than a sequence is cut into full pieces,
its first piece taking the remainder; shorter ones stay whole. At most `size` different lengths
exist, so the best-fit-decreasing plan is made on counts: runs of equal bins stand for any number of
sequences. Documents then take the planned slots: the plan says where the r-th piece of each length
goes, and pieces join it on (length, rank). Ranks are counted in blocks of pieces, never in one task.

NULL and empty texts are one piece that holds the end mark. Ids of documents may be NULL or repeated:
each row is packed. Columns of docs are not passed on.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved
from .tokens import Pieces, encoding, packed, tokenizer

END_ID = 2
SEQUENCE = 1024
#: Ranks are counted within blocks of about this many pieces, and slots joined in blocks of as many.
BLOCK = 4096
#: Below this character the two libraries know the same classes of letters; others go to the first one.
_COMMON = "ɐ"

_PIECES = "doc_id long, row long, piece int, start long, length int, ids binary"


def _encoder(json_path: str, ranks_path: str | None, pattern: str | None):
    """Ids as `tokenizers` gives them. With the same vocabulary as ranks, common texts take the faster library."""
    slow = tokenizer(json_path)
    marks = [t.content for t in slow.get_added_tokens_decoder().values()]
    if not ranks_path:
        return Pieces(lambda text: slow.encode(text, add_special_tokens=False).ids), marks, slow
    fast = encoding(ranks_path, pattern)

    def encode(text: str) -> list[int]:
        if max(text, default="") < _COMMON:
            return fast.encode_ordinary(text)
        return slow.encode(text, add_special_tokens=False).ids

    return Pieces(encode), marks, slow


def tokenised(
    docs: DataFrame, json_path: str, ranks_path: str | None = None, pattern: str | None = None,
    id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE, end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: doc_id, row (number of the input row), piece, start, length, ids (binary, little-endian)."""
    if docs.schema[id_col].dataType.simpleString() not in ("bigint", "int"):
        raise TypeError("ids of documents must be integers")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, marks, slow = _encoder(json_path, ranks_path, pattern)
        end = packed([end_id])
        for batch in batches:
            out: list[tuple] = []
            for doc, row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = text or ""
                if any(mark in text for mark in marks):
                    ids = packed(slow.encode(text, add_special_tokens=False).ids) + end
                else:
                    ids = encode(text) + end
                n = len(ids) // 4
                first = n % size or min(n, size)
                cuts = [0, *range(first, n + 1, size)]
                out += [(doc, row, i, a, b - a, ids[4 * a : 4 * b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, _TYPES, strict=True)], _NAMES
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, _PIECES)


_NAMES = ["doc_id", "row", "piece", "start", "length", "ids"]
_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]


def plan(counts: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, first rank, pieces, first sequence, pieces per sequence, offset).

    The i-th piece of a row goes to sequence first + i // per at offset + i % per * length. A run is a
    number of sequences with neighbouring numbers and equal room; a length takes runs with the least
    sufficient room first, fills each sequence of it as far as it goes, and splits one run at most.
    """
    out: list[tuple[int, int, int, int, int, int]] = []
    runs: dict[int, list[tuple[int, int]]] = {}  # room -> [(first sequence, number of sequences)]
    opened = 0
    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        left, rank = counts[length], 0
        for room in [*sorted(r for r in runs if r >= length), size]:
            per = room // length
            waiting = runs.pop(room, []) if room < size or left else []
            while left and (waiting or room == size):
                first, number = waiting.pop() if waiting else (opened, -(-left // per))
                if first == opened:
                    opened += number
                full, over = divmod(min(left, number * per), per)
                out.append((length, rank, full * per + over, first, per, size - room))
                left, rank = left - full * per - over, rank + full * per + over
                if full:
                    runs.setdefault(room - per * length, []).append((first, full))
                if over:
                    runs.setdefault(room - over * length, []).append((first + full, 1))
                if (rest := number - full - bool(over)) > 0:
                    waiting.append((first + number - rest, rest))
            if waiting:
                runs.setdefault(room, []).extend(waiting)
            if not left:
                break
        runs.pop(0, None)
    return out


def packed_pieces(pieces: DataFrame, size: int = SEQUENCE, block: int = BLOCK) -> DataFrame:
    """Pieces (doc_id, row, piece, length, ...) with sequence_id and offset. Pass a written table: it is read twice."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `size` rows
    total = sum(histogram.values())
    parts = max(1, -(-total // block))
    deals = F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(parts))
    dealt = pieces.withColumn("_part", deals)
    # Rank within (length, part) plus the pieces of the same length in the parts before.
    sizes = dealt.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = Window.partitionBy("length", "_part").orderBy("doc_id", "row", "piece")
    ranked = dealt.withColumn("_own", F.row_number().over(own) - 1).join(sizes, ["length", "_part"])
    ranked = ranked.withColumn("_rank", F.col("_own") + F.col("_before")).withColumn("_block", F.expr(f"_rank div {block}"))
    rows = [(a, b, n, s, per, at) for a, b, n, s, per, at in plan(histogram, size)]
    slots = spark.createDataFrame(rows, "length int, _from long, _pieces long, _sequence long, _per long, _offset long")
    slots = slots.withColumn("_block", F.explode(F.expr(f"sequence(_from div {block}, (_from + _pieces - 1) div {block})")))
    placed = ranked.join(slots, ["length", "_block"]).filter("_rank >= _from AND _rank < _from + _pieces")
    nth = F.col("_rank") - F.col("_from")
    return placed.select(
        *pieces.columns,
        (F.col("_sequence") + F.floor(nth / F.col("_per"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + nth % F.col("_per") * F.col("length")).cast("long").alias("offset"),
    )


def pack(
    docs: DataFrame, json_path: str, ranks_path: str | None = None, pattern: str | None = None,
    id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE, end_id: int = END_ID, keep_ids: bool = False,
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with keep_ids the ids themselves."""
    pieces = tokenised(docs, json_path, ranks_path, pattern, id_col, text_col, size, end_id)
    slim = pieces.select("doc_id", "row", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), *["ids"] * keep_ids)
    placed = packed_pieces(saved(slim), size)
    return placed.withColumn("length", F.col("length").cast("long")).drop("row")


def fewest(counts: Counter, size: int = SEQUENCE) -> int:
    """A lower bound for the number of sequences: tokens over room."""
    return -(-sum(k * n for k, n in counts.items()) // size)


def crc32(ids: list[int]) -> int:
    """What ids_crc32 holds, in plain Python."""
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())
