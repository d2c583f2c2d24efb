"""Hard negatives of anchors among vectors: exact top lists by inner product, searched with pruning by length and coordinates.

Rows are dealt into blocks of one label and one length bucket, anchors into chunks of one label; a block and a chunk
are one row of bounded size each, and a pair of them is the unit of work. Pairs whose lengths cannot reach what the
anchors need are never formed. Within a pair the search is that of LEMP: the block keeps, for each coordinate, its
unit vectors in ascending order; an anchor needs a cosine of at least t there, so along each of its FOCUS largest
coordinates only values within a feasible range can occur; rows inside all ranges are candidates, those that the
rest of their lengths cannot lift over t go, and the others are verified by whole-number products.

First each anchor meets one block of its label, the longest one, which says what score its positives reach at
least; then the other blocks of its label. Negatives need a share of the weakest positive's score from the outset.
Lists are merged over blocks by the window's limit, so no task sees more than its blocks' best rows.

Whole numbers are the floor of SCALE times each component. Rows whose label, vector or id is NULL, or that hold a
component that is NULL or not finite, take no part. Of equal scores the smaller id comes first; rows that repeat an
id are rows of their own, so a copy of an anchor's row is another row, and repeated rows of one score are alike.
Shorter vectors count as filled up with zeros. Scores beyond a long become the nearest long. An empty table
has no negatives, and neither has an anchor without positives. Other columns are neither read nor passed on.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot, saved

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
#: A negative's score is at least this share of the positive's, in hundredths.
FLOOR = 80
#: Vectors of one block, and anchors of one chunk, as far as a hash deals them evenly.
BLOCK = 16_384
CHUNK = 2_048
#: A length bucket ends at this multiple of its start.
BAND = 1.1
#: Coordinates of an anchor whose feasible ranges are intersected.
FOCUS = 3
#: Slack of cosines computed in floating point.
_EPS = 1e-9
#: Sums below it are exact in floating point.
_EXACT = float(1 << 53)


class Pack:
    """Vectors of one block or chunk: rows, ids and whole numbers."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, offsets: np.ndarray, flat: np.ndarray):
        self.rows, self.ids = rows, ids
        widths = np.diff(offsets)
        width = int(widths.max(initial=0))
        values = np.zeros((len(rows), width))
        if len(rows) and width:
            values[np.arange(width) < widths[:, None]] = flat[offsets[0] : offsets[-1]]
        self._prepare(values)

    @classmethod
    def of(cls, cell: pa.ListScalar) -> Pack:
        """From an array of struct (row, id, v)."""
        held = cell.values
        vectors = held.field("v")
        return cls(held.field("row").to_numpy(), held.field("id").to_numpy(), vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False))

    def _prepare(self, values: np.ndarray) -> None:
        self.values = values
        # Scaled before squaring, as components may be large.
        top = np.maximum(np.abs(values).max(axis=1, initial=0.0), 1.0)
        self.lengths = top * np.sqrt(((values / top[:, None]) ** 2).sum(axis=1))
        self.unit = values / np.maximum(self.lengths, 1e-300)[:, None]
        self.longest = float(self.lengths.max(initial=0.0))
        self.largest = float(np.abs(values).max(initial=0.0))
        self._lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def widened(self, width: int) -> None:
        if width > self.values.shape[1]:
            self._prepare(np.pad(self.values, ((0, 0), (0, width - self.values.shape[1]))))

    def products(self, rows: np.ndarray | slice, q: np.ndarray, exact: bool) -> np.ndarray:
        """Whole-number products: in floating point where all sums are exact, else in Python's integers."""
        if exact:
            return (self.values[rows] @ q).astype(np.int64)
        whole = [int(x) for x in q.tolist()]
        top = (1 << 63) - 1
        return np.array([max(-top, min(top, sum(int(a) * b for a, b in zip(v, whole, strict=True)))) for v in self.values[rows].tolist()], np.int64)

    def sorted_list(self, coordinate: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the rows by their value along a coordinate, and those values."""
        if coordinate not in self._lists:
            order = np.argsort(self.unit[:, coordinate], kind="stable")
            self._lists[coordinate] = order, self.unit[order, coordinate]
        return self._lists[coordinate]


def feasible(a: float, t: float) -> tuple[float, float]:
    """Values x along a coordinate where a unit vector may have a cosine of at least t with one that holds a there."""
    a, t = max(-1.0, min(1.0, a)), max(-1.0, min(1.0, t))
    angle, slack = math.acos(a), math.acos(t)
    low = -1.0 if angle + slack >= math.pi else math.cos(angle + slack)
    high = 1.0 if angle <= slack else math.cos(angle - slack)
    return low - _EPS, high + _EPS


def candidates(block: Pack, unit: np.ndarray, t: float) -> np.ndarray | slice:
    """Places of the rows whose cosine with the unit vector may reach t; no other row does."""
    n = len(block.ids)
    if t <= -1.0 or not unit.size:
        return slice(0, n)
    focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
    ranges = []
    for f in focus.tolist():
        low, high = feasible(float(unit[f]), t)
        order, values = block.sorted_list(f)
        i, j = int(np.searchsorted(values, low, "left")), int(np.searchsorted(values, high, "right"))
        if j - i < n:
            ranges.append(order[i:j])
    if not ranges:
        return slice(0, n)
    ranges.sort(key=len)
    found = ranges[0]
    if len(ranges) > 1:
        count = np.zeros(n, dtype=np.int8)
        for rows in ranges:
            count[rows] += 1
        found = found[count[found] == len(ranges)]
    # What the focus coordinates leave of both lengths bounds the rest of the product.
    part = block.unit[np.ix_(found, focus)]
    rest = np.sqrt(np.maximum(0.0, 1 - (part**2).sum(axis=1)) * max(0.0, 1 - float((unit[focus] ** 2).sum())))
    return found[part @ unit[focus] + rest >= t - _EPS]


def reaching(block: Pack, anchors: Pack, k: int, need: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the block with their products with anchor k: all of those that reach `need`, and maybe others."""
    bound = float(anchors.lengths[k]) * block.longest
    exact = float(np.abs(anchors.values[k]).max(initial=0.0)) * block.largest * anchors.values.shape[1] < _EXACT
    if need is None or need <= 0:
        rows: np.ndarray | slice = slice(0, len(block.ids))
    elif need > bound * (1 + _EPS):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    else:
        rows = candidates(block, anchors.unit[k], need / bound * (1 - _EPS))
    products = block.products(rows, anchors.values[k], exact)
    places = np.arange(len(block.ids))[rows]
    if need is not None:
        places, products = places[products >= need], products[products >= need]
    return places, products


def first(block: Pack, places: np.ndarray, products: np.ndarray, most: int) -> list[tuple[int, int, int]]:
    """(row, id, product) of the best ones: by product, then id, then row."""
    if len(places) > 4 * most:
        edge = np.partition(products, len(products) - most)[len(products) - most]
        places, products = places[products >= edge], products[products >= edge]
    order = np.lexsort((block.rows[places], block.ids[places], -products))[:most]
    return [(int(block.rows[p]), int(block.ids[p]), int(s)) for p, s in zip(places[order], products[order], strict=True)]


def _rows(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, label: Column | None) -> DataFrame:
    """Per row that takes part: row, id, label, v (whole numbers as double), band (of its length)."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), (F.col(label_col) if label is None else label).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    good = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    most = F.lit(1e308)
    whole = lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(F.greatest(-most, F.least(most, x)))
    rows = rows.filter(good).withColumn("v", F.transform("v", lambda x: whole(x * SCALE)))
    top = F.greatest(F.lit(1.0), F.array_max(F.transform("v", F.abs)))
    length = F.least(most, top * F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / top) * (x / top))))
    band = F.floor(F.log(BAND, F.greatest(length, F.lit(1.0)))).cast("int")
    return saved(rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", "v", band.alias("band"), length.alias("length")))


def _packed(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    """Rows as groups of about `most` of one key: by, part, top (largest length), members."""
    sizes = saved(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("held")).withColumn("key", F.xxhash64(*by)).withColumn("parts", F.ceil(F.col("held") / most).cast("int")))
    keyed = rows.withColumn("key", F.xxhash64(*by))
    sizes = saved(sizes.select("key", *[F.col(c).alias(f"_{c}") for c in by], "held", "parts"))
    same = F.lit(True)
    for c in by:
        same = same & (F.col(c) == F.col(f"_{c}"))
    dealt = join_hot(keyed, sizes, "key", "held").filter(same).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    return dealt.groupBy(*by, "part").agg(F.max("length").alias("top"), F.collect_list(F.struct("row", "id", "v")).alias("members"))


def _together(anchors: Pack, block: Pack) -> None:
    width = max(anchors.values.shape[1], block.values.shape[1])
    anchors.widened(width)
    block.widened(width)


def _searched(pairs: DataFrame, schema: str, found: Callable[[Pack, Pack, dict], Iterable[tuple]]) -> DataFrame:
    """Rows that found(anchors, block, needs by anchor's row) gives for each pair of a chunk and a block."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for needs, asked, held in zip(*batch.columns, strict=True):
                anchors, block = Pack.of(asked), Pack.of(held)
                _together(anchors, block)
                out = np.array([*found(anchors, block, {n["row"]: n["need"] for n in needs.as_py() or []})], np.int64).reshape(-1, len(names))
                yield pa.RecordBatch.from_arrays([pa.array(out[:, k]) for k in range(len(names))], names)

    return pairs.select("needs", "asked", "held").mapInArrow(run, schema)


def _best(pairs: DataFrame) -> DataFrame:
    """(anchor_row, row, id, score): of each pair of a chunk and a block the best other rows of each anchor that reach its need."""

    def found(anchors: Pack, block: Pack, needs: dict) -> Iterator[tuple]:
        for k, anchor in enumerate(anchors.rows.tolist()):
            places, products = reaching(block, anchors, k, needs.get(anchor))
            other = block.rows[places] != anchor
            for best in first(block, places[other], products[other], POSITIVES):
                yield anchor, *best

    return _searched(pairs, "anchor_row long, row long, id long, score long", found)


def _within(pairs: DataFrame) -> DataFrame:
    """(anchor_row, place, row, id, score): the best rows of the block in the range of each positive of each anchor."""

    def found(anchors: Pack, block: Pack, needs: dict) -> Iterator[tuple]:
        for k, anchor in enumerate(anchors.rows.tolist()):
            scores = [s for s in needs.get(anchor, ()) if s >= 0]  # no score lies between 80 and 100 hundredths of a negative one
            if not scores:
                continue
            places, products = reaching(block, anchors, k, -(-FLOOR * min(scores) // 100))
            for place, score in enumerate(needs[anchor]):
                fits = (products >= -(-FLOOR * score // 100)) & (products <= score)
                for best in first(block, places[fits], products[fits], NEGATIVES):
                    yield anchor, place, *best

    return _searched(pairs, "anchor_row long, place long, row long, id long, score long", found)


def _pairs(chunks: DataFrame, blocks: DataFrame, meta: DataFrame) -> DataFrame:
    """Chunks and blocks side by side, as meta (chunk, block) says."""
    return meta.join(chunks, "chunk").join(blocks, "block").repartition("chunk", "block").select("needs", F.col("members").alias("asked"), "held")


def _ranked(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "id", "row")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def hard_negatives(
    vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", label: Column | None = None, block: int = BLOCK, chunk: int = CHUNK
) -> DataFrame:
    """Per anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `anchor` is a condition on `id` (the row's id); `label` replaces the label column, as a column over vectors.
    """
    rows = _rows(vectors, id_col, vector_col, label_col, label)
    blocks = _packed(rows, ["label", "band"], block).select(F.concat_ws(":", "label", "band", "part").alias("block"), F.col("label").alias("block_label"), "band", "part", "top", F.col("members").alias("held"))
    blocks = saved(blocks)
    asked = _packed(rows.filter(anchor), ["label"], chunk).select(F.concat_ws(":", "label", "part").alias("chunk"), "label", "members", F.col("top").alias("reach"))
    asked = saved(asked)
    block_meta = saved(blocks.select("block", "block_label", "band", "part", "top"))
    chunk_meta = saved(asked.select("chunk", "label", "reach"))
    held = blocks.select("block", "held")

    # The longest block of each label says what an anchor's positives reach at least.
    longest = block_meta.groupBy("block_label").agg(F.max(F.struct("band", "part", "block")).alias("best")).select(F.col("block_label").alias("label"), F.col("best.block").alias("block"))
    start = chunk_meta.join(longest, "label").select("chunk", "block")
    chunks = asked.select("chunk", "members", F.lit(None).cast("array<struct<row:long,need:long>>").alias("needs"))
    begun = saved(_best(_pairs(chunks, held, start)))
    floor = begun.groupBy("anchor_row").agg(F.min("score").alias("need"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= POSITIVES).select(F.col("anchor_row").alias("row"), "need")
    of_chunk = saved(asked.select("chunk", F.explode("members.row").alias("row")))
    needs = of_chunk.join(floor, "row", "left").groupBy("chunk").agg(F.collect_list(F.when(F.col("need").isNotNull(), F.struct("row", "need"))).alias("needs"), F.min(F.coalesce("need", F.lit(-1))).alias("least"))
    needs = saved(needs)
    reach = (F.col("least") <= 0) | (F.col("least") <= F.col("reach") * F.col("top") * (1 + _EPS))
    same = chunk_meta.join(needs.select("chunk", "least"), "chunk").join(block_meta.withColumnRenamed("block_label", "label"), "label").filter(reach).select("chunk", "block")
    same = same.join(start, ["chunk", "block"], "left_anti")
    more = _best(_pairs(asked.select("chunk", "members").join(needs.select("chunk", "needs"), "chunk"), held, same))
    positives = saved(_ranked(begun.unionByName(more), ["anchor_row"], POSITIVES).withColumn("place", (F.col("rank") - 1).cast("long")))

    scores = positives.groupBy("anchor_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda x: x["score"]).alias("scores"))
    wanted = of_chunk.join(scores.withColumnRenamed("anchor_row", "row"), "row")
    weakest = F.array_min(F.filter("scores", lambda s: s >= 0))
    needs = saved(wanted.groupBy("chunk").agg(F.collect_list(F.struct("row", F.col("scores").alias("need"))).alias("needs"), F.min(weakest).alias("least")))
    reach = F.col("least") * FLOOR <= 100 * F.col("reach") * F.col("top") * (1 + _EPS)
    # Chunks against blocks: one row for 2,048 anchors and one for 16,384 vectors, only where lengths and labels fit.
    other = chunk_meta.join(needs.select("chunk", "least"), "chunk").join(block_meta, (F.col("label") != F.col("block_label")) & reach).select("chunk", "block")
    found = _within(_pairs(asked.select("chunk", "members").join(needs.select("chunk", "needs"), "chunk"), held, other))
    found = _ranked(found, ["anchor_row", "place"], NEGATIVES)
    names = rows.filter(anchor).select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id"))
    known = positives.select("anchor_row", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(names, "anchor_row")
    return found.join(known, ["anchor_row", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
