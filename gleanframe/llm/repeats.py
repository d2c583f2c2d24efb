"""Repeated passages: word windows of one length that start anywhere else are found by level-wise doubling.

Lengths double from a short one up to `window` (9, 18, 35). Only windows whose part of the length below
is repeated are counted at the next level; the last level decides. At the first level each window is
represented by its part with the smallest hash, which equal windows share, so that about one place in
fourteen is counted there.

A window found once carries its own place through the count: what comes back from the last level is the
candidates to spare, and no list of the repeated ones. The counts combine on the map side, so a passage
that a third of all rows hold costs no more than any other. Between the levels go bitmaps of fixed size;
a fuller one lets more candidates through to the next count and changes no result.

Windows are compared by 64-bit hashes of their words. NULL and blank texts have no words. Ids may be NULL
or repeated; rows that repeat id and text repeat each other's windows. Other columns are not passed on.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import BitFilter, saved

WINDOW = 35
#: Candidates that wait for each other before they leave a task; those of one text leave together.
_SEND = 1 << 16


def levels(window: int, least: int = 6) -> list[int]:
    """Lengths from a short one to `window`, each at most twice the one before."""
    out = [window]
    while out[-1] > 1 and (out[-1] + 1) // 2 >= least:
        out.append((out[-1] + 1) // 2)
    return out[::-1]


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` values the place of its smallest one, the first of equals; runs double in length."""
    place, length = np.arange(len(values)), 1
    while length < width:
        step = min(length, width - length)
        left, right = place[:-step], place[step:]
        place = np.where(values[right] < values[left], right, left)
        length += step
    return place


class Candidates:
    """Windows of a text that the levels so far leave, and what the next level counts of them."""

    def __init__(self, window: int):
        self.window = window
        self.lengths = levels(window)
        self.filters: list[BitFilter] = []

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of what the next level counts."""
        return self.of_bytes(W.bytes_of(text))

    def of_bytes(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.of(W.hashes(data, *W.spans(data)))

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(words) < self.window:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        found = W.windows(words, self.lengths[: len(self.filters) + 1])
        starts = np.arange(len(words) - self.window + 1)
        part = smallest(found[self.lengths[0]], self.window - self.lengths[0] + 1)
        place = part
        for length, filter_ in zip(self.lengths, self.filters, strict=False):
            if length != self.lengths[0]:
                place = np.minimum(part, starts + self.window - length)
            has = filter_.has(found[length])
            left = has[place]
            starts, part = starts[left], part[left]
            place = place[left]
        length = self.lengths[len(self.filters)]
        if len(self.filters):
            place = np.minimum(part, starts + self.window - length)
        if length != self.window:
            place = np.unique(place)
        return place, found[length][place]


def _joined(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], ["h", "key", "at"])


def _key(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col), F.col(text_col))


def _bytes(texts: pa.Array) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each text; NULL has none."""
    return (np.frombuffer(text or b"", dtype=np.uint8) for text in texts.cast(pa.binary()).to_pylist())


def _counted(rows: DataFrame, candidates: Candidates) -> DataFrame:
    """One row per hash that the next level counts: h, n, and the place (key, at) of one of them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            waiting = 0
            for key, data in zip(batch.column(0).to_pylist(), _bytes(batch.column(1)), strict=True):
                at, h = candidates.of_bytes(data)
                if len(h):
                    parts.append((h.view(np.int64), np.full(len(h), key, np.int64), at.astype(np.int32)))
                    waiting += len(h)
                if waiting >= _SEND:
                    yield _joined(parts)
                    parts, waiting = [], 0
            if parts:
                yield _joined(parts)

    return rows.mapInArrow(run, "h long, key long, at int").groupBy("h").agg(
        F.count(F.lit(1)).alias("n"), F.min("key").alias("key"), F.min("at").alias("at")
    )


def repeated_windows(rows: DataFrame, window: int) -> tuple[Candidates, DataFrame]:
    """Candidates of the last level, and those of them that are found once: (key, spare: their places)."""
    candidates = Candidates(window)
    for _ in candidates.lengths[:-1]:
        found = _counted(rows, candidates).filter("n > 1").select("h")
        candidates.filters = [*candidates.filters, BitFilter(found, "h")]
    once = _counted(rows, candidates).filter("n = 1")
    return candidates, saved(once.groupBy("key").agg(F.collect_list("at").alias("spare")))  # no longer than its text


def removed(words: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which words the windows at `starts` cover."""
    steps = np.zeros(words + 1, dtype=np.int64)
    steps[starts] += 1
    steps[starts + window] -= 1
    return np.cumsum(steps[:-1]) > 0


def kept_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> str:
    """The words from starts up to ends, joined by one space: the byte before a word is never inside another one."""
    steps = np.zeros(len(data) + 1, dtype=np.int8)
    steps[starts], steps[ends] = 1, -1
    stays = np.cumsum(steps[:-1], dtype=np.int8).view(bool)
    gaps = starts[1:] - 1
    stays[gaps] = True
    text = data.copy()
    text[gaps] = 32
    return text[stays].tobytes().decode()


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept (the words that stay, joined by one space)."""
    rows = docs.select(_key(id_col, text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    candidates, spare = repeated_windows(rows, window)
    some = BitFilter(spare, "key")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, data, places in zip(batch.column(0).to_pylist(), _bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                a, b = W.spans(data)
                at, _ = candidates.of(W.hashes(data, a, b))
                gone = removed(len(a), np.setdiff1d(at, places or []).astype(np.int64), window)
                out.append((doc, len(a), int(gone.sum()), kept_words(data, a[~gone], b[~gone])))
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)

    full = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), _key(id_col, text_col).alias("key"))
    alone, joined = _split(full, some)
    empty = F.lit(None).cast("array<int>").alias("spare")
    ready = alone.select("doc_id", "text", empty).unionByName(joined.join(spare, "key", "left").select("doc_id", "text", "spare"))
    return ready.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def _split(full: DataFrame, some: BitFilter) -> tuple[DataFrame, DataFrame]:
    """Rows that certainly have nothing to spare, and the others: only these need the join. Only keys go to Python."""

    @F.arrow_udf("boolean")
    def may_have(keys: pa.Array) -> pa.Array:
        return pa.array(some.has(keys.to_numpy(zero_copy_only=False).view(np.uint64)))

    return full.filter(~may_have("key")), full.filter(may_have("key"))


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

