"""Hard negatives against all products in plain Python; pruning never loses a row."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanframe.llm import negatives
from gleanframe.llm.negatives import Pack, candidates, feasible, hard_negatives, reaching

SCHEMA = "vec_id long, embedding array<double>, label int, row string, band int, held int"


def whole(v: list) -> list[int]:
    return [math.floor(256 * x) for x in v]


def product(a: list, b: list) -> int:
    return sum(x * y for x, y in zip(whole(a), whole(b), strict=False))


def plain(rows: list[tuple]) -> list[tuple]:
    good = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    out = []
    for i, a in enumerate(good):
        if a[0] % 100:
            continue
        scored = sorted((-product(a[1], b[1]), b[0], b[2]) for j, b in enumerate(good) if i != j)
        for s, p, _ in [x for x in scored if x[2] == a[2]][:5]:
            fits = [x for x in scored if x[2] != a[2] and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(a[0], p, k, n, -s, -t) for k, (t, n, _) in enumerate(fits, 1)]
    return sorted(out)


def made(n: int, dims: int, seed: int, spread: float = 0.0) -> list[tuple]:
    """Vectors around a few centres, of one length or of many."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    out = []
    for i in range(n):
        v = [c + rng.gauss(0, 0.5) for c in rng.choice(centres)]
        length = math.sqrt(sum(x * x for x in v)) / math.exp(rng.gauss(0, spread))
        out.append((i, [x / length for x in v], rng.choice([1, 1, 1, 2, 3, 4]), "clash", 1, 1))
    return out


@pytest.mark.parametrize(("n", "dims", "spread", "block", "chunk"), [(900, 8, 0.0, 16_384, 2_048), (1_200, 6, 0.6, 40, 2), (500, 3, 0.3, 7, 3)])
def test_against_all_products(spark, n, dims, spread, block, chunk):
    rows = made(n, dims, n, spread)
    rows += [(None, [1.0] * dims, 1, "", 0, 0), (2_000, None, 1, "", 0, 0), (2_100, [1.0] * dims, None, "", 0, 0), (2_200, [float("nan")] * dims, 1, "", 0, 0)]
    rows += [(2_300, [None] + [1.0] * (dims - 1), 1, "", 0, 0), (2_400, [0.0] * dims, 2, "", 0, 0), (2_500, [0.1], 3, "", 0, 0), (2_600, [], 1, "", 0, 0)]
    # Ties, and rows that repeat an id.
    rows += [(3_000 + k, rows[7][1], 1 + k % 2, "", 0, 0) for k in range(12)] + [rows[100], (100, rows[100][1], 2, "", 0, 0)]
    rows += [(4_000, [float("inf")] * dims, 1, "", 0, 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = hard_negatives(docs, F.col("id") % 100 == 0, block=block, chunk=chunk)
    assert sorted(map(tuple, got.collect())) == plain(rows)


def test_large_components_are_exact(spark):
    rows = made(300, 4, 9)
    rows = [(i, [x * 1e6 for x in v], *rest) for i, v, *rest in rows]
    got = hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == plain(rows) and any(abs(r[4]) > 2**53 for r in plain(rows))


def test_no_rows_and_lone_anchors(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert hard_negatives(none, F.col("id") % 100 == 0).count() == 0
    lone = spark.createDataFrame([(100, [1.0, 0.0], 1, "", 0, 0), (1, [1.0, 0.0], 2, "", 0, 0)], SCHEMA)
    assert hard_negatives(lone, F.col("id") % 100 == 0).count() == 0


def pack(values: np.ndarray) -> Pack:
    n, width = values.shape
    return Pack(np.arange(n), np.arange(n), np.arange(n + 1) * width, values.ravel())


def test_pruning_loses_nothing_and_prunes():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    block = pack(np.floor(256 * (centres[rng.integers(0, 20, 2_000)] + 0.2 * rng.normal(size=(2_000, 16)))))
    asked = pack(block.values[:40])
    kept = 0
    for k in range(40):
        products = block.values @ asked.values[k]
        need = int(np.sort(products)[-20])
        places, found = reaching(block, asked, k, need)
        assert sorted(places.tolist()) == np.flatnonzero(products >= need).tolist() and (found == products[places]).all()
        some = candidates(block, asked.unit[k], need / (asked.lengths[k] * block.longest))
        kept += 2_000 if isinstance(some, slice) else len(some)
    assert kept < 40 * 2_000 / 2


def test_feasible_ranges():
    rng = np.random.default_rng(5)
    for _ in range(2_000):
        a, b = rng.normal(size=(2, 3))
        a, b = a / np.linalg.norm(a), b / np.linalg.norm(b)
        low, high = feasible(float(a[0]), float(a @ b))
        assert low <= b[0] <= high
    assert negatives.FOCUS >= 2
