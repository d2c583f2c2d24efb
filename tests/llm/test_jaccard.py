"""Components and links against all pairs of sets."""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import functions as F

from gleanframe.llm import jaccard

SCHEMA = "doc_id long, text string, row string, n int"


def plain_set(text: str | None, width: int = 3) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    k = min(width, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


def components(sets: list[frozenset], percent: int) -> list[int]:
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]) and root[i] != root[j]:
                old = root[i]
                root = [root[j] if r == old else r for r in root]
    return root


def texts() -> list[str | None]:
    rng = random.Random(8)
    line = "licensed under the apache license version two as is without any warranty of any kind"
    out: list[str | None] = [None, "", " \n", "one", "One", "one two", "two one", "x" * 30_000, line, line.upper()]
    for size in (4, 9, 12, 20, 40, 90, 200):
        for _ in range(3):
            base = [f"w{rng.randint(0, 400)}" for _ in range(size)]
            for _ in range(7):
                words = list(base)
                for _ in range(rng.randint(0, max(1, size // 25))):
                    at = rng.randrange(len(words))
                    words[at : at + 1] = rng.choice([[], [f"v{rng.randint(0, 9)}"], [words[at], "new"]])
                out.append(" ".join(words) + rng.choice(["", "", "\n" + line]))
    return out


def test_components(spark):
    given = texts()
    given += given[::5]
    rows = [(i if i % 11 else None, t, "clash", 1) for i, t in enumerate(given)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    sets = [plain_set(t) for t in given]
    for percent, budget in ((90, 2_000_000), (90, 700), (70, 5_000)):
        root = components(sets, percent)
        least: dict[int, int | None] = {}
        for (doc, *_), r in zip(rows, root, strict=True):
            least[r] = min((x for x in (least.get(r), doc) if x is not None), default=None)
        expected = sorted((doc or -1, len(s), -1 if least[r] is None else least[r]) for (doc, *_), s, r in zip(rows, sets, root, strict=True))
        got = jaccard.jaccard_components(docs, percent=percent, budget=budget).collect()
        assert sorted((r.doc_id or -1, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got) == expected
    kept = jaccard.without_near_copies(docs)
    n = len(set(components(sets, 90)))
    assert kept.columns == docs.columns and kept.count() == n


def test_search_and_groups_without_links():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(80)]
    lists = jaccard.Lists(sets)
    for percent in (50, 70, 90, 100):
        for a in sets:
            expected = [j for j, b in enumerate(sets) if 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b))]
            assert lists.search(a, percent).tolist() == expected
        plain = components([frozenset(s.tolist()) for s in sets], percent)
        found = jaccard.linked(sets, percent)
        assert [plain.index(r) for r in plain] == found.tolist()


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert jaccard.jaccard_components(empty).count() == 0 and jaccard.without_near_copies(empty).count() == 0


def test_no_linked_sets_miss_each_other():
    """Of the keys that two linked sets share, one stays on both sides whatever the frequencies are."""
    rng = np.random.default_rng(7)
    for percent in (60, 80, 90):
        for size in (2, 3, 5, 9, 20, 60, 150, 700):
            for _ in range(12):
                pool = np.unique(rng.integers(0, 2**62, size + 400).astype(np.uint64))
                a = pool[:size]
                out = max(0, size - -(-percent * size // 100))
                b = np.sort(np.concatenate([a[out:], pool[size : size + int(rng.integers(0, 3))]]))
                if 100 * len(np.intersect1d(a, b)) < percent * len(np.union1d(a, b)):
                    b = a[out:] if len(a) > out else a
                frequency: dict = {}
                kept = []
                for held in (a, b):
                    sigs, tags = jaccard.signatures(held, percent)
                    stays = set()
                    for tag in set(tags.tolist()):
                        keys = sigs[tags == tag].tolist()
                        for key in keys:
                            frequency.setdefault(key, int(rng.integers(1, 50)))
                        keys.sort(key=lambda x: (-frequency[x], x))
                        stays |= set(keys[tag // 64 :])
                    kept.append(stays)
                assert kept[0] & kept[1]


def test_keys_hold_shingles():
    """Unlike sets of a thousand shingles share no key at 0.8, and most keys of one set are not left out."""
    rng = np.random.default_rng(9)
    seen: set = set()
    for _ in range(60):
        sigs, tags = jaccard.signatures(np.unique(rng.integers(0, 2**62, 1_000).astype(np.uint64)), 80)
        assert not seen & set(sigs.tolist()) and (tags // 64).max() < 0.3 * len(sigs)
        seen |= set(sigs.tolist())


def test_unlike_words_of_one_polynomial(spark):
    """Words that agree in any polynomial modulo 2**64 are still unlike."""
    word = "a"
    while len(word) < 1_024:
        word += word.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{word} x y", "", 0), (2, word.translate(str.maketrans("ab", "ba")) + " x y", "", 0)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.component_id for r in got) == [1, 2]


def test_lists_of_keys_are_not_shuffled(spark):
    rows = [(i, i, [i, -i, 7], [64, 64, 65]) for i in range(1, 6)]
    sets = spark.createDataFrame(rows, "row long, n long, sigs array<long>, tags array<int>")
    named = lambda values: jaccard.BitFilter(spark.createDataFrame([(v,) for v in values], "row long").select(F.xxhash64("row").alias("place")), "place")
    got = jaccard._postings(sets, named([1, 2, 4]))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted((i, s, t) for i, _, sigs, tags in rows if i in (1, 2, 4) for s, t in zip(sigs, tags, strict=True))
    some = jaccard.BitFilter(spark.createDataFrame([(7,), (-2,)], "sig long"), "sig")
    assert sorted(map(tuple, jaccard._postings(sets, named([1, 2, 4]), some).collect())) == [(1, 7, 65), (2, -2, 64), (2, 7, 65), (4, 7, 65)]
    assert jaccard._postings(sets, named([])).count() == 0


def test_filters_that_let_all_through(spark, monkeypatch):
    """The bit filters only save work: copies that they let through change nothing."""

    class Full(jaccard.BitFilter):
        def has(self, keys):
            return np.ones(len(keys), dtype=bool)

    given = texts()
    rows = [(i, t, "", 1) for i, t in enumerate(given + given[::2] + given[::3])]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = lambda: sorted(map(tuple, jaccard.jaccard_components(docs, percent=80).collect()))
    expected = found()
    monkeypatch.setattr(jaccard, "BitFilter", Full)
    assert found() == expected
