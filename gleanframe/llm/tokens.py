"""Byte-level BPE inside tasks: encoders made once per process, and a cache of short pieces.

Files of vocabularies stay where they are; only their paths travel.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import tiktoken

#: Pieces whose ids are remembered per process; the cache starts anew when it is full.
CACHE_PIECES = 400_000
#: Longer pieces are encoded each time.
CACHE_CHARS = 64


@lru_cache(maxsize=2)
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def packed(ids: list[int]) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


class _Unfit(Exception):
    """A piece that is not encoded apart from its neighbours."""


class _Known(dict):
    """Ids of a single space and the word after it, by word; what is not known yet is encoded."""

    def __init__(self, encode):
        super().__init__()
        self._encode = encode

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Unfit
        ids = packed(self._encode(" " + word))
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[word] = ids
        return ids


class Pieces:
    """Encodes whole texts piece by piece: ids as little-endian unsigned 32-bit integers.

    A text is cut before every single space that stands between two other characters. The pattern
    always starts a new match there: a run of white space of length one before a letter, digit or
    symbol belongs to the match that follows. So the pieces' ids, one after another, are the text's.
    Texts with other white space next to a space, or at an end, are encoded in one go.
    """

    def __init__(self, encode):
        self._encode = encode
        self._known = _Known(encode)

    def __call__(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if rest and not first or first and first[-1].isspace():
            return packed(self._encode(text))
        try:
            tail = b"".join(map(self._known.__getitem__, rest))
        except _Unfit:
            return packed(self._encode(text))
        return packed(self._encode(first)) + tail if first else tail
