"""Counts against plain Python, verdicts on planted outliers, and odd tables."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from gleanframe.llm import quality
from gleanframe.llm.common import saved

SCHEMA = "doc_id long, text string, lang string, source string, n_words string, _n string"


def plain(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def prose(rng: random.Random, n: int) -> str:
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + 12]).capitalize() + "." for i in range(0, n, 12))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    texts = [prose(rng, rng.randint(60, 300)) for _ in range(240)]
    junk = [re.sub(r"(\w+)", r"\1###", prose(rng, 80)) for _ in range(4)]
    shout = [re.sub(r"(\w+)", r"\1!!", prose(rng, 80)).upper() for _ in range(4)]
    odd = [None, "", " \n\t ", "one two", "a b c " * 40, "\n \n", "é ü ##$ <b>\x0bx\x0cy\r\nz", "same line here\n" * 30, prose(rng, 30_000)]
    return texts, junk + shout, odd


def test_counts_and_verdicts(spark, corpus):
    texts, junk, odd = corpus
    everything = [*texts, *junk, *odd]
    rows = [(i, t, "en" if i % 7 else None, f"s{i % 3}" if i % 5 else None, "x", "y") for i, t in enumerate(everything)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    out = {r.doc_id: r for r in quality.judged(docs, min_rows=30).collect()}
    assert len(out) == len(everything)
    for i, text in enumerate(everything):
        r = out[i]
        n, chars, symbols, lines, repeated = plain(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeated)
        assert r.base_failed == (n < 50 or 100 * repeated > 50 * n)
        assert not (r.base_failed and r.kept)
    n = len(texts)
    assert all(out[i].kept for i in range(n)), "clean documents stay"
    assert not any(out[i].kept for i in range(n, n + len(junk)))
    kept = {r.doc_id for r in quality.clean(docs, min_rows=30).select("doc_id").collect()}
    assert kept == {i for i, r in out.items() if r.kept}


def test_small_groups_are_judged_and_rows_repeat(spark, corpus):
    texts, junk, _ = corpus
    # No group is large: the scatter of clean texts at large stands in.
    rows = [(None, texts[0], "en", "s", "", "")] * 2 + [(i, texts[i], f"l{i % 9}", "s", "", "") for i in range(1, 25)] + [(99, junk[0], "en", "s", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = quality.judged(docs).collect()
    assert len(out) == 27 and all(r.distance is not None for r in out)
    assert {r.doc_id for r in out if not r.kept} == {99}
    assert quality.clean(docs).columns == docs.columns and quality.clean(docs).count() == 26
    assert quality.judged(docs.filter("doc_id IS NULL")).filter("kept").count() == 2
    # One language is large: rows of small groups are held against the corpus, also where most of them are bad.
    rows = [(i, t, "en", "s", "", "") for i, t in enumerate(texts)] + [(1000, texts[3], "la", "x", "", ""), *((2000 + i, j, "fy", f"y{i}", "", "") for i, j in enumerate(junk))]
    out = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(out[i].kept for i in range(len(texts))) and out[1000].kept
    assert not any(out[2000 + i].kept for i in range(len(junk)))


def plain_determinant(points: np.ndarray, share: float, rng: np.random.Generator) -> float:
    """Smallest determinant of the scatter, floor included, over many random starts run to convergence."""
    n, p = points.shape
    h, floor, best = int(np.ceil(share * n)), np.diag(np.square(quality.FLOORS)), np.inf
    for _ in range(200):
        held = rng.choice(n, p + 1, replace=False)
        while True:
            part = points[held]
            scatter = np.cov(part.T, bias=True) + floor
            off = points - part.mean(0)
            nearest = np.argsort(np.einsum("ij,jk,ik->i", off, np.linalg.inv(scatter), off))[:h]
            if set(nearest) == set(held):
                break
            held = nearest
        best = min(best, np.linalg.det(scatter))
    return best


def test_determinants_are_those_of_many_starts(spark):
    rng = np.random.default_rng(5)
    groups, rows = {}, []
    for g in range(6):
        mix = rng.normal(size=(5, 5)) * 0.3
        points = rng.normal(size=(300, 5)) @ mix
        far = int(300 * 0.04 * g)  # up to a fifth lies elsewhere, together
        points[:far] = rng.normal(size=(far, 5)) * 0.05 + rng.normal(size=5) * 6
        groups[f"g{g}"] = points
        rows += [(f"g{g}", *map(float, x)) for x in points]
    table = saved(spark.createDataFrame(rows, "_group string, x0 double, x1 double, x2 double, x3 double, x4 double").repartition(3))
    found = {r["_group"]: r for r in quality.estimates(table).collect()}
    for g, points in groups.items():
        factor = np.zeros((5, 5))
        for j in range(5):
            for k in range(j + 1):
                factor[j, k] = found[g][f"l{j}{k}"]
        ours, best = np.prod(np.diag(factor)) ** 2, plain_determinant(points, quality.SUBSET, rng)
        assert ours <= best * 1.1, (g, ours, best)
        # Distances from centre and factor are the plain Mahalanobis distances of that scatter.
        centre = np.array([found[g][f"m{j}"] for j in range(5)])
        off = points - centre
        d2 = np.einsum("ij,jk,ik->i", off, np.linalg.inv(factor @ factor.T), off)
        assert abs(max(np.median(d2), quality.CHI2_MEDIAN) - found[g]["_scale"]) <= 0.05 * np.median(d2)


def test_an_outlier_in_each_statistic_is_rejected(spark, corpus):
    texts, _, _ = corpus
    rng = random.Random(8)
    long_words = "\n".join(" ".join("".join(rng.choice("abcdefghij") for _ in range(40)) for _ in range(12)) + "." for _ in range(8))
    head = prose(rng, 300)
    repeated = prose(rng, 60).split()
    planted = {
        "long words": long_words,
        "symbols": re.sub(r"(\w+)", r"\1###", prose(rng, 80)),
        "repeated lines": head.replace("\n", " ") + "\nShare this" * 100,
        "one line on and on": "\n".join([*head.split("\n"), *["ok"] * 80]),
        "repeated words": " ".join([*prose(rng, 220).split(), *repeated, *repeated]).replace("\n", " "),
        "marks": re.sub(r"(\w+)", r"\1!!", prose(rng, 80)),
    }
    rows = [(i, t, "en", "s", "x", "y") for i, t in enumerate([*texts, *planted.values()])]
    out = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, SCHEMA), min_rows=30).collect()}
    assert all(out[i].kept for i in range(len(texts)))
    for i, name in enumerate(planted, len(texts)):
        assert not out[i].base_failed and not out[i].kept, (name, out[i])


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.judged(empty).count() == 0 and quality.clean(empty).count() == 0
