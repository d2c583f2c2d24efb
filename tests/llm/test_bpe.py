"""Chunked encoding against the library on whole texts, and the packing plan against plain best fit."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as public
import pytest
from tokenizers import Tokenizer

from gleanframe.llm import bpe, packing
from gleanframe.llm.tokens import Pieces, encoding

RANKS = public.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, ids string"


def some_texts() -> list[str | None]:
    rng = random.Random(3)
    alphabet = ["the", "Straße", "été", "don't", "it's", " ", "  ", "\n", "\n\n ", "\t", "12345", "!!", "你好", " ", "\x1c", "ꟲ", "'re", ",", "a"]
    mixed = ["".join(rng.choice([" ", ""]) + rng.choice(alphabet) for _ in range(rng.randint(1, 400))) for _ in range(60)]
    return [None, "", " ", "a", "x" * 3000, " " * 900, "word " * 500, "a b" + " " * 700 + "c d " * 200, "<|endoftext|> a", *mixed]


def test_chunks_give_the_librarys_ids(spark):
    texts = some_texts()
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], SCHEMA)
    coder = encoding(RANKS, public.PATTERN)
    for chunk, overlap in ((64, 20), (200, 100), (bpe.CHUNK, bpe.OVERLAP)):
        rows = bpe.decode(bpe.encode(docs, RANKS, public.PATTERN, chunk=chunk, overlap=overlap), RANKS, public.PATTERN).collect()
        assert len(rows) == len(texts)
        for row in rows:
            text = texts[row.doc_id] or ""
            expected = coder.encode_ordinary(text)
            assert np.frombuffer(row.ids, "<u4").tolist() == expected and row.n_tokens == len(expected)
            assert bytes(row.decoded) == text.encode()


def test_repeated_and_null_ids_and_no_rows(spark):
    rows = [(1, "a b", ""), (1, "a b", ""), (None, "z " * 300, "")]
    encoded = bpe.encode(spark.createDataFrame(rows, SCHEMA), RANKS, public.PATTERN, chunk=100, overlap=40).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in encoded)[1:] == [(1, 2), (1, 2)] and len(encoded) == 3
    assert bpe.encode(spark.createDataFrame([], SCHEMA), RANKS, public.PATTERN).count() == 0


def test_pieces_are_the_texts_ids():
    coder = encoding(RANKS, public.PATTERN)
    pieces = Pieces(coder.encode_ordinary)
    for text in some_texts():
        if text:
            assert np.frombuffer(pieces(text), "<u4").tolist() == coder.encode_ordinary(text)


def best_fit(counts: Counter, size: int) -> int:
    rooms: list[int] = []
    for length in sorted(counts.elements(), reverse=True):
        fitting = [r for r in rooms if r >= length]
        if fitting:
            rooms.remove(min(fitting))
        rooms.append((min(fitting) if fitting else size) - length)
    return len(rooms)


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit(seed):
    rng = random.Random(seed)
    size = rng.choice([16, 32, 64])
    counts = Counter({rng.randint(1, size): rng.randint(1, 30) for _ in range(rng.randint(1, 12))})
    slots: dict[int, list[tuple[int, int]]] = {}
    ranks = Counter()
    for length, first_rank, pieces, first, per, offset in packing.plan(counts, size):
        assert first_rank == ranks[length]
        ranks[length] += pieces
        for i in range(pieces):
            slots.setdefault(first + i // per, []).append((offset + i % per * length, length))
    assert ranks == counts and len(slots) == best_fit(counts, size)
    for taken in slots.values():
        at = 0
        for offset, length in sorted(taken):
            assert offset == at
            at += length
        assert at <= size


def test_packing(spark):
    tokens = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    texts = [t for t in some_texts()] + ["w " * 90, "w " * 90]
    docs = spark.createDataFrame([(i // 2, t, "clash") for i, t in enumerate(texts)], SCHEMA)
    size = 64
    rows = packing.pack(
        docs, public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN, size=size, keep_ids=True
    ).collect()
    expected, counts = Counter(), Counter()
    for i, text in enumerate(texts):
        ids = [*tokens.encode(text or "", add_special_tokens=False).ids, packing.END_ID]
        first = len(ids) % size or size
        cuts = [0, *range(min(first, len(ids)), len(ids) + 1, size)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            expected[i // 2, k, a, b - a, zlib.crc32(np.asarray(ids[a:b], "<u4").tobytes())] += 1
            counts[b - a] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    sequences: dict[int, list] = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(sequences) == best_fit(counts, size)
    for taken in sequences.values():
        at = 0
        for offset, length in sorted(taken):
            assert offset == at
            at += length
        assert at <= size
    empty = spark.createDataFrame([], SCHEMA)
    assert packing.pack(empty, public.path("byte_bpe_50k.json")).count() == 0


def test_long_texts_of_every_script_become_pieces(spark):
    rng = random.Random(9)
    letters = {"ru": "абвгдежзийклмн", "el": "αβγδεζηθικ", "hi": "कखगघचछजझ", "zh": "天地玄黃宇宙洪荒"}
    texts = {k: "".join("".join(rng.choices(v, k=rng.randint(2, 12))) + rng.choice(" ，।!") for _ in range(16_000)) for k, v in letters.items()}
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts.values())], SCHEMA)
    long = docs.selectExpr("doc_id", "doc_id AS row", "text")
    pieces = bpe.chunk_pieces(long, public.PATTERN, bpe.CHUNK, bpe.OVERLAP).collect()
    coder = encoding(RANKS, public.PATTERN)
    for i, text in enumerate(texts.values()):
        parts = [r.text for r in sorted((r for r in pieces if r.doc_id == i), key=lambda r: r.part)]
        assert len(parts) == -(-(len(text) - bpe.OVERLAP) // (bpe.CHUNK - bpe.OVERLAP)) >= 3 and "".join(parts) == text
        assert [x for p in parts for x in coder.encode_ordinary(p)] == coder.encode_ordinary(text)


def test_characters_that_the_libraries_know_differently():
    import regex

    # Every character that only one library takes for a letter, digit or space is found, in any script.
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000, 7)]))
    odd = bpe.unlike(text, public.PATTERN)
    for kind in (r"\p{L}", r"\p{N}"):
        ours = set(regex.findall(kind, text))
        theirs = bpe._members_by_encoder(kind)(text)
        assert ours ^ theirs <= odd
    assert not odd & set("aZ09 \n'é漢字яकα") and bpe.unlike("", public.PATTERN) == set()
    # No boundary next to such a character, nor after an apostrophe behind one.
    for c in sorted(odd)[:50]:
        text = f"ab {c}'s cd"
        assert all(at in (0, 2, 6) for at in bpe.boundaries(text, public.PATTERN)), (text, bpe.boundaries(text, public.PATTERN))
