"""The automaton against edit distances, quotations, and held-out accuracy."""

from __future__ import annotations

import random

from gleanframe.llm import toxicity
from gleanframe.llm.toxicity import Reader, Trie

SCHEMA = "doc_id long, text string, toxic string, score int"


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton():
    rng = random.Random(1)
    terms = sorted({"".join(rng.choices("abc", k=rng.randint(3, 8))) for _ in range(60)})
    trie = Trie(terms)
    for _ in range(2_000):
        word = "".join(rng.choices("abcd", k=rng.randint(1, 10)))
        near = [t for t in terms if distance(t, word) == 1 and len(t) >= toxicity.FUZZY_LENGTH]
        assert trie.find(word) == ((word, 0) if word in terms else (min(near), 1) if near else None)
    assert Trie([]).find("abc") is None


def test_quotations():
    hits = lambda text: [(d, q) for _, d, q in Reader(["vermin", "fool"]).hits(text)[1]]
    assert hits("you vermin, fool") == [(0, 0), (0, 0)]
    assert hits('they "vermin and" fool') == [(0, 1), (0, 0)]
    assert hits('open " vermin\n" fool') == [(0, 0), (0, 0)]
    assert hits("she said vermlin") == [(1, 1)] and hits("vermn fol") == [(1, 0)]
    assert Reader([]).features("") == [0.0] * 6


def made(seed: int, n: int) -> list[tuple[int, str | None, int]]:
    rng = random.Random(seed)
    bad = ["vermin", "lowlife", "imbecile"]
    rows: list[tuple[int, str | None, int]] = [(0, None, 0), (1, "", 0), (2, "x" * 50_000, 0)]
    for i in range(3, n):
        words = [f"{rng.choice('abcdefg')}{rng.randint(0, 300)}" for _ in range(rng.randint(5, 80))]
        toxic = rng.random() < 0.3
        for _ in range(rng.randint(1, 4) * toxic):
            words.insert(rng.randint(0, len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out_rows(spark):
    rows = made(3, 500)
    docs = spark.createDataFrame([(i if i else None, t, "clash", 1) for i, t, _ in rows], SCHEMA).repartition(3)
    labels = spark.createDataFrame([(i, y if i % 10 else None) for i, _, y in rows] + [(None, 1)], "doc_id long, toxic int")
    got = toxicity.scores(docs, labels).collect()
    truth = {i: y for i, _, y in rows}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    judged = [r for r in got if r.held_out and r.doc_id is not None]
    assert len(judged) > 50 and sum(r.predicted == truth[r.doc_id] for r in judged) / len(judged) > 0.97
    # Labels of held-out rows change nothing.
    flipped = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(toxicity.F.col("doc_id")), 1 - labels.toxic).otherwise(labels.toxic))
    assert sorted((r.doc_id or 0, r.score) for r in toxicity.scores(docs, flipped).collect()) == sorted((r.doc_id or 0, r.score) for r in got)


def test_no_rows_and_no_labels(spark):
    docs = spark.createDataFrame([(1, "a", "", 1)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.scores(docs, none).collect()] == [0.0]
    assert toxicity.scores(docs.limit(0), none).count() == 0


def test_misspelled_terms_count(spark):
    """Texts whose terms are all misspelled are toxic, the more so the more there are; ordinary words near a term are not."""
    rng = random.Random(4)
    rows = [(i, t or "", y) for i, t, y in made(5, 600)]
    # "vermain" is an ordinary word of clean rows, within one edit of a term.
    rows = [(i, f"{t} vermain" if not y and rng.random() < 0.3 else t, y) for i, t, y in rows]
    filler = [" ".join(f"{rng.choice('abcdefg')}{rng.randint(0, 300)}" for _ in range(30)) for _ in range(20)]
    planted = [f"{t} {bad}" for t in filler[:10] for bad in ("vermn", "lowlofe", "imbeciles")]
    many = [" ".join([filler[0], *["vermn lowlofe"] * k]) for k in range(1, 6)]
    ordinary = [f"{t} vermain" for t in filler[10:]]
    texts = planted + many + ordinary
    docs = spark.createDataFrame([(i, t, "", 1) for i, t, _ in rows] + [(10_000 + k, t, "", 1) for k, t in enumerate(texts)], SCHEMA)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.scores(docs, labels).collect()}
    judged = [got[10_000 + k] for k in range(len(texts))]
    a, b = len(planted), len(planted) + len(many)
    assert all(r.predicted == 1 and r.n_open == 0 and r.n_fuzzy == 1 for r in judged[:a])
    rising = [r.score for r in judged[a:b]]
    assert rising == sorted(rising) and all(r.predicted == 1 for r in judged[a:b])
    assert not any(r.predicted or r.n_fuzzy for r in judged[b:])


def test_weights_of_open_hits_never_fall():
    x, y = toxicity.np.array([[1.0, 0.0], [1.0, 1.0], [0.0, 1.0], [0.0, 0.0]] * 5), toxicity.np.array([1.0, 0.0, 0.0, 0.0] * 5)
    assert toxicity.logistic(x, y)[1] < 0
    assert toxicity.rising_logistic(x, y, 2)[1] == 0 < toxicity.rising_logistic(x, y, 2)[0]


def test_evidence_is_a_binomial_tail():
    import math

    for n, k, toxic, clean in ((5, 5, 1, 9), (40, 12, 3, 17), (300, 90, 1, 4), (7, 1, 1, 1)):
        q = toxic / (toxic + clean)
        tail = sum(math.comb(n, j) * q**j * (1 - q) ** (n - j) for j in range(k, n + 1))
        assert math.isclose(toxicity.evidence(k, n - k, toxic, clean), -math.log(tail) if k > n * q else 0.0, rel_tol=1e-6)


def test_chance_words_are_no_terms(spark):
    rows = spark.createDataFrame([(t or "", y) for _, t, y in made(3, 500)], "text string, toxic int")
    assert toxicity.learned(rows).terms == ["imbecile", "lowlife", "vermin"]
