"""n-grams against plain counting, the classifier's accuracy and calibration, and odd rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np

from gleanframe.llm import langid

SCHEMA = "doc_id long, text string, lang string, lang_pred string, held_out int"


def test_grams_of_pieces(monkeypatch):
    """Counts agree with plain strings, however the text is cut."""
    texts = ["abc  def, ghi!! -- x", "a", "  Ä", "ß  ", ".. a .. b", "1 2 3", "", "\ud800 x", "йцу кен 漢字 " * 40, "İstanbul ǅ"]
    for text in texts:
        plain = re.sub(" +", " ", " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " ")
        want = Counter(plain[i : i + k] for k in langid.ORDERS for i in range(len(plain) - k + 1) if i + k > 1)
        monkeypatch.setattr(langid, "PIECE", 1 << 20)
        found, counts = langid.grams(text)
        assert counts.sum() == (sum(want.values()) if any(map(str.isalpha, text.lower())) else 0)
        assert max(counts.tolist(), default=0) >= max(want.values(), default=0) * bool(len(counts))
        for piece in (1, 2, 3, 7, 50):
            monkeypatch.setattr(langid, "PIECE", piece)
            again = langid.grams(text)
            assert (again[0] == found).all() and (again[1] == counts).all()


def made(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    letters = {"en": "etaoinshrd", "xx": "qjkvwzxyßü", "ru": "оеаинтсрвл"}
    out = []
    for i in range(n):
        lang = rng.choice(list(letters))
        words = ["".join(rng.choices(letters[lang], k=rng.randint(2, 7))) for _ in range(rng.randint(3, 40))]
        out.append((i, " ".join(words), lang, "clash", 1))
    return out


def is_held(doc_id: int | None) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_held_out_rows(spark):
    rows = made(400, 2)
    odd = [(10_000, None, "en", "", 0), (10_001, "", "en", "", 0), (10_002, "123 !?", "xx", "", 0), (None, "the date", "en", "", 0), (10_003, "shared it", None, "", 0)]
    odd += [rows[3], (10_004, "ether " * 400_000, "en", "", 0)]
    docs = spark.createDataFrame(rows + odd, SCHEMA).repartition(3)
    got = langid.languages(docs)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    seen = got.collect()
    assert len(seen) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.held_out == is_held(r.doc_id) for r in seen)
    truth = {r[0]: r[2] for r in rows}
    judged = [r for r in seen if r.held_out and r.doc_id in truth]
    assert len(judged) > 80 and sum(r.lang_pred == truth[r.doc_id] for r in judged) / len(judged) > 0.99
    by_id = {r.doc_id: r for r in seen}
    assert [(by_id[k].lang_pred, by_id[k].score) for k in (10_000, 10_001, 10_002)] == [("und", 0.0)] * 3
    assert by_id[10_003].lang_pred == by_id[10_004].lang_pred == by_id[None].lang_pred == "en"
    # Languages of held-out rows change nothing, nor does the order of rows.
    other = spark.createDataFrame([(i, t, "zz" if is_held(i) else y, a, b) for i, t, y, a, b in reversed(rows + odd)], SCHEMA)
    again = langid.languages(other).collect()
    assert {(r.doc_id, r.lang_pred, round(r.score, 9)) for r in again} == {(r.doc_id, r.lang_pred, round(r.score, 9)) for r in seen}


def test_no_rows_and_no_languages(spark):
    assert langid.languages(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(i, "text", None, "", 0) for i in range(5)], SCHEMA)
    assert {(r.lang_pred, r.score) for r in langid.languages(docs).collect()} == {("und", 0.0)}
    one = spark.createDataFrame([(i, "text", "en", "", 0) for i in range(9)], SCHEMA)
    assert {(r.lang_pred, r.score) for r in langid.languages(one).collect()} == {("en", 1.0)}


def test_the_penalty_leaves_few_weights():
    model = langid.Ftrl(2)
    rng = np.random.default_rng(1)
    for k in range(300):
        found = np.array([10 + k % 2, 100 + int(rng.integers(0, 2_000))])
        model.learn(found, np.array([0.8, 0.6]), k % 2)
    weights = model.weights(slice(None))
    assert weights[0, 10] > 0 > weights[0, 11] and (weights != 0).sum() < 0.5 * (model.n != 0).sum()


def test_temperature():
    rng = np.random.default_rng(2)
    logits = rng.normal(size=(4_000, 3))
    p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    labels = np.array([rng.choice(3, p=x) for x in p])
    assert abs(langid.temperature(3 * logits, labels) - 3) < 0.3 and langid.temperature(logits[:0], labels[:0]) == 1.0
