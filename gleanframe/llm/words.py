"""Words of a text as arrays: where they lie in its UTF-8 bytes, and 64-bit hashes of them and of windows.

Everything is vectorised over the bytes of one text, so memory is a small multiple of that text.
Words are maximal runs without the six ASCII white-space characters, which in UTF-8 never occur
inside another character.
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_STEP = 0xC2B2AE3D27D4EB4F
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def join(first: np.ndarray, *rest: np.ndarray) -> np.ndarray:
    """Hash of neighbouring pieces from the hashes of the pieces; order counts."""
    out = first
    for piece in rest:
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + mix(piece ^ np.uint64(0xA0761D6478BD642F)))
    return out


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 1 << 16)
        for name, base in (("_powers", _BASE), ("_inverses", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            globals()[name] = np.cumprod(steps)
    return _powers, _inverses


def bytes_of(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode(), dtype=np.uint8)


def spans(data: np.ndarray, table: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes; ``table`` marks the bytes between words."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~table[data]
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash per word: the sum over its bytes of a scrambled value of byte and place in the word.

    A polynomial in the bytes would not do: modulo 2**64 there are unlike words that agree for any base.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    steps = np.ones(len(data), dtype=np.int64)
    steps[starts] = 1 - np.diff(starts, prepend=starts[0])
    steps[starts[0]] = -starts[0]
    values = np.cumsum(steps, out=steps).view(np.uint64)  # place in the word, from 0
    values *= np.uint64(_STEP)
    values += _BYTES[data]
    values ^= values >> np.uint64(32)
    values *= np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(29)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values, out=sums[1:])
    return mix(sums[ends] - sums[starts] + (ends - starts).astype(np.uint64))


def windows(words: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
    """For each length the hashes of the windows that start at each word, from one row of prefix sums."""
    powers, inverses = _tables(len(words) + 1)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * powers[: len(words)], out=sums[1:])
    return {n: mix((sums[n:] - sums[:-n]) * inverses[: len(sums) - n]) for n in lengths}
