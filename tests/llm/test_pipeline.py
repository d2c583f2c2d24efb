"""The stages on planted rows: what goes, what stays, and whole packing of the rest."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import public_tokenizers
import pytest

from gleanframe.llm import quality
from gleanframe.llm.common import saved

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def shingles(text: str) -> set:
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def planted() -> list[tuple]:
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n)) + "."
    out = [prose(rng.randint(60, 140)) for _ in range(240)]
    copies = ["  ".join(out[k].split(" ")) for k in range(10)]
    near = [re.sub(r"^\S+ \S+", "changed start", out[k]) for k in range(20, 30)]
    private = [prose(80) + f" write to user{k}@mail.example.com now" for k in range(5)]
    bad = [None, "", "too short", "spam words here " * 60]
    texts = out + copies + near + private + bad
    return [(i, t, rng.choice(["en", "de", None]), f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]


def test_stages(spark):
    rows = planted()
    text = {r[0]: r[1] for r in rows}
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, "unused"))
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after[name] = docs
    kept = {r.doc_id for r in after["quality_rules"].collect()}
    judged = {r.doc_id for r in quality.judged(spark.createDataFrame(rows, SCHEMA)).filter("kept").collect()}
    assert kept == judged and set(range(240)) <= kept and not kept & set(range(265, 269))

    same = defaultdict(list)
    for i in sorted(kept):
        same[re.sub(r"[\x20\x09-\x0D]+", " ", text[i])].append(i)
    first = {ids[0] for ids in same.values()}
    assert {r.doc_id for r in after["exact_dedup"].collect()} == first

    sets, root = {i: shingles(text[i]) for i in sorted(first)}, {i: i for i in first}
    for i in sets:
        for j in sets:
            if i < j and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                root = {k: root[i] if r == root[j] else r for k, r in root.items()}
    one_each = {min(i for i in root if root[i] == r) for r in set(root.values())}
    assert {r.doc_id for r in after["jaccard_join"].collect()} == one_each and one_each < first

    masked = after["pii"].collect()
    assert {r.doc_id for r in masked} == one_each and all(r.n_chars == len(r.text) for r in masked)
    assert not any("@mail" in r.text for r in masked) and sum("<EMAIL>" in r.text for r in masked) == 5

    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sequences, total = defaultdict(list), defaultdict(int)
    for r in after["packing"].collect():
        sequences[r.sequence_id].append((r.offset, r.length))
        total[r.doc_id] += r.length
    assert dict(total) == {r.doc_id: len(slow.encode(r.text, add_special_tokens=False).ids) + 1 for r in masked}
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024


def test_no_rows(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, "unused"))
    assert docs.count() == 0


def test_columns_with_clashing_names(spark):
    rows = planted()
    names = ["_id", "_sign", "_sign_of_row", "_sha", "_sha_of_row", "_first", "_rows", "_ID_", "kept", "row"]
    plain = spark.createDataFrame(rows, SCHEMA)
    docs = spark.createDataFrame([(*r, *map(str, range(len(names)))) for r in rows], SCHEMA + "".join(f", {n} string" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got, want = stage(spark, docs, "unused"), stage(spark, plain, "unused")
        assert got.columns == docs.columns, name
        extra = {tuple(r[5:]) for r in got.collect()}
        assert extra == {tuple(map(str, range(len(names))))}
        assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in want.collect()), name
