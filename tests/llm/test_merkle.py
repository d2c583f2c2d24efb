"""The manifest against plain hashing: ragged trees of many sizes, NULLs, repeated rows, tampering."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gleanframe.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, tree string, block int"


def h(*texts: str) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(r: tuple, text: str | None) -> str:
    doc, _, lang, source, n, *_ = r
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)])


def climb(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root, and for each leaf its siblings by level."""
    paths: list[list[tuple[str, str]]] = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, below = [], []
        for at in range(0, len(nodes), 8):
            run = nodes[at : at + 8]
            for k in range(len(run)):
                for i in under[at + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(h(*run))
            below.append([i for k in range(len(run)) for i in under[at + k]])
        nodes, under = above, below
    return nodes[0], paths


def plain(rows: list[tuple]) -> list[tuple]:
    """(doc_id, leaf, subroot, root, proof) of every row."""
    trees: dict = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1])))
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    tops = {t: climb([x[2] for x in sorted(trees[t])]) for t in order}
    root, rest = climb([tops[t][0] for t in order])
    out = []
    for k, t in enumerate(order):
        for (known, doc, own), path in zip(sorted(trees[t]), tops[t][1], strict=True):
            out.append((doc if known else None, own, tops[t][0], root, "".join(a + b for a, b in path + rest[k])))
    return out


def key(r: tuple) -> tuple:
    return tuple((x is not None, x) for x in r)


def made(sizes: dict, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    out, doc = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            doc += rng.randint(1, 3)
            out.append((doc, rng.choice(["Text Ä", "", None, "low", "B" * 50]), lang, rng.choice(["s", None]), rng.choice([1, None]), "clash", 7))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("local", [1, 2])
def test_against_plain_hashing(spark, monkeypatch, local):
    monkeypatch.setattr(merkle, "LOCAL", local)
    rows = made({None: 1, "": 2, "a": 8, "ab": 9, "de": 64, "en": 65, "fr": 200, "zz": 700})
    rows += [rows[5], rows[5], (None, "x", "de", None, None, "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = merkle.manifest(docs).select("doc_id", "leaf", "subroot", "root", merkle.proof_text()).collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain(rows), key=key)


def test_many_trees_and_one_row(spark):
    rows = made({f"l{k}": 1 + k % 3 for k in range(70)})
    for some in (rows, rows[:1]):
        docs = spark.createDataFrame(some, SCHEMA)
        got = merkle.verified(merkle.manifest(docs))
        assert sorted((r.doc_id, r.leaf, r.subroot, r.root) for r in got.collect()) == sorted(r[:4] for r in plain(some))
        assert got.filter("NOT verified").isEmpty()


def test_tampering_shows(spark):
    rows = made({"en": 30, "de": 600})
    docs = spark.createDataFrame(rows, SCHEMA)
    now = F.when(F.col("doc_id") % 2 == 0, F.lower("text")).otherwise(F.col("text"))
    got = {r.doc_id: r for r in merkle.verified(merkle.manifest(docs, changed={"text": now})).collect()}
    for r in rows:
        touched = r[0] % 2 == 0 and r[1] is not None and r[1] != r[1].lower()
        assert got[r[0]].verified != touched and (got[r[0]].folded_root == got[r[0]].root) != touched
        assert got[r[0]].leaf == leaf(r, r[1]) and got[r[0]].claimed == leaf(r, r[1].lower() if touched else r[1])


def test_no_rows(spark):
    assert merkle.verified(merkle.manifest(spark.createDataFrame([], SCHEMA))).count() == 0
