"""Repeated passages against a count of every window."""

from __future__ import annotations

import random
import re
from collections import Counter

from gleanframe.llm.repeats import levels, without_repeats

SCHEMA = "doc_id long, text string, key string, h int"


def plain(texts: list[str | None], window: int) -> list[tuple[int, int, str]]:
    parts = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(p[i : i + window]) for p in parts for i in range(len(p) - window + 1))
    out = []
    for p in parts:
        gone = {j for i in range(len(p) - window + 1) if seen[tuple(p[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(p), len(gone), " ".join(w for j, w in enumerate(p) if j not in gone)))
    return out


def texts() -> list[str | None]:
    rng = random.Random(4)
    word = lambda: rng.choice("ab cd e é f 漢 gh".split())
    passages = [[f"w{rng.randint(0, 99)}" for _ in range(n)] for n in (34, 35, 36, 70, 200)]
    out: list[str | None] = [None, "", " \n", "a " * 36, "b " * 35, "c " * 2_000, "x" * 50_000]
    for k in range(60):
        body = [f"{word()}{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 60))]
        for p in rng.sample(passages, rng.randint(0, 2)):
            at = rng.randint(0, len(body))
            body[at:at] = p[rng.randint(0, 3) :]
        out.append(rng.choice([" ", "\n", " \t "]).join(body))
        if k % 9 == 0:
            out.append(out[-1])
    return out


def test_levels():
    assert levels(35) == [9, 18, 35]


def test_every_window_is_judged(spark):
    rows = [(i if i % 7 else None, t, "clash", 1) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for window in (35, 6):
        got = sorted((r.doc_id or -1, r.n_words, r.n_removed, r.kept) for r in without_repeats(docs, window=window).collect())
        expected = [(row[0] or -1, *x) for row, x in zip(rows, plain([t for _, t, *_ in rows], window), strict=True)]
        assert got == sorted(expected)


def test_no_rows(spark):
    assert without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_smallest_parts_and_window_hashes():
    import numpy as np

    from gleanframe.llm import words as W
    from gleanframe.llm.repeats import smallest

    values = np.random.default_rng(1).integers(0, 9, 200).astype(np.uint64)
    for width in (1, 2, 3, 27):
        assert smallest(values, width).tolist() == [min(range(i, i + width), key=lambda k: (values[k], k)) for i in range(201 - width)]
    words = W.mix(values % np.uint64(3))
    for n, found in W.windows(words, [2, 9]).items():
        seen = {}
        assert all(seen.setdefault(tuple(words[i : i + n].tolist()), h) == h for i, h in enumerate(found.tolist()))
        assert len(set(seen.values())) == len(seen)
