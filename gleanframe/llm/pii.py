"""Personal data: base patterns, and a semi-Markov conditional random field over whole spans.

Base spans come from one pattern per kind with its check (parts of an address, Luhn, digit counts). The
field reads islands, runs of neighbouring chunks that hold a digit or an at sign. An island's tokens are
cut into segments of at most MAX_TOKENS tokens, each a kind or nothing. Features look at a whole segment:
digits in it, groups, separators, checks, shape of a domain. Dynamic programming over (end, length, kind)
finds the boundaries and kinds with the largest total score; the same recursion with sums trains it.

Weights are trained here, by gradient steps on the likelihood of the base spans in SAMPLE islands with a
base span and as many without, those with the smallest hash; some are shown without the mark that the
base pattern asks for (a leading plus), so that what the field finds is more than the patterns. A corpus
without base spans trains nothing and gets base spans only.

Base spans stay. Spans of the field count where they overlap no base span. NULL counts as the empty text.
Ids may be NULL or repeated: each row is scanned. Other columns are not passed on by `find`, kept by `masked`.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, islice, takewhile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

KINDS = ("email", "ip", "card", "phone")
#: Base patterns.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: The pattern for addresses fails inside a run of digits where it fails at its start, so it is tried at starts only.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_SET = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_MARKED = re.compile(r"[0-9@]")
_CHUNK = re.compile(r"[^\x20\x09-\x0D]+")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|.", re.S)

#: Islands of each sort that the field is trained on.
SAMPLE = 300
#: Longest island, in characters, that the field is trained on; it is applied to islands of any length.
SAMPLE_CHARS = 200
EPOCHS = 4
#: Longest entity, in tokens.
MAX_TOKENS = 16


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _byte(digits: str) -> bool:
    return len(digits.lstrip("0")) <= 3 and int(digits[-3:]) <= 255


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The pattern's leftmost matches, tried only where an at sign follows."""
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_SET:
            start -= 1
        if start < at and (m := _EMAIL.match(text, start)):
            yield m.span()
            end = m.end()
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    if not _MARKED.search(text):
        return []
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(_byte(p) for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def islands(text: str) -> Iterator[tuple[int, str]]:
    """Runs of chunks with a digit or an at sign, one space apart, with their places."""
    start = end = -1
    at = 0
    while m := _MARKED.search(text, at):
        # Widen to the chunk around the mark.
        a, b = m.start(), m.end()
        while a > max(end, 0) and text[a - 1] not in " \t\n\x0b\x0c\r":
            a -= 1
        b = _CHUNK.match(text, a).end()
        if start >= 0 and a == end + 1 and text[end] == " ":
            end = b
        else:
            if start >= 0:
                yield start, text[start:end]
            start, end = a, b
        at = b
    if start >= 0:
        yield start, text[start:end]


def features(tokens: list[str], i: int, j: int) -> list[str]:
    """What a whole segment of tokens looks like."""
    text = "".join(tokens[i:j])
    digits = _digits(text)
    n = len(digits)
    out = [f"digits {min(n, 20)}", f"tokens {min(j - i, 16)}"]
    if "@" in text:
        name, _, domain = text.partition("@")
        parts = domain.split(".")
        out.append(f"at {bool(name)} {len(parts) > 1 and all(parts)} {'@' in domain} {name[-1:].isalnum() and domain[-1:].isalnum()}")
    numbers = re.split(r"[^0-9]+", text)
    if re.fullmatch(r"[0-9]+(\.[0-9]+){3}", text):
        out.append(f"quad {all(len(x) <= 3 and int(x) <= 255 for x in numbers)}")
    if not any(c.isalpha() for c in text) and n:
        out.append(f"numeric {min(n, 20)} {''.join(sorted(set(c for c in text if c not in digits)))[:6]}")
        out.append(f"luhn {13 <= n <= 19 and luhn(digits)} {text[:1] in digits and text[-1:] in digits}")
        out.append(f"groups {'-'.join(str(len(x)) for x in numbers if x)[:24]} {text[:1] in '+('}")
    out.append(f"edges {_sort(tokens[i][0])} {_sort(tokens[j - 1][-1])}")
    out.append(f"around {_sort(tokens[i - 1][-1]) if i else '^'} {_sort(tokens[j][0]) if j < len(tokens) else '$'}")
    return out


def _sort(c: str) -> str:
    return "9" if "0" <= c <= "9" else "a" if c.isalpha() else c


class Field:
    """A semi-Markov conditional random field; without weights it finds nothing."""

    def __init__(self, weights: dict[tuple[str, str], float] | None = None):
        self.weights = weights or {}

    def _segments(self, tokens: list[str]) -> list[list[tuple[int, list[str]]]]:
        return list(self._ends(tokens))

    def _ends(self, tokens: list[str]) -> Iterator[list[tuple[int, list[str]]]]:
        """For each end, from 0 on, the possible starts of entities with their features."""
        yield []
        for j in range(1, len(tokens) + 1):
            starts: list[tuple[int, list[str]]] = []
            if not tokens[j - 1].isspace():
                digit = mail = letter = False
                for i in range(j - 1, max(-1, j - 1 - MAX_TOKENS), -1):
                    digit, mail, letter = digit or tokens[i].isdigit(), mail or tokens[i] == "@", letter or tokens[i].isalpha()
                    # Letters without an at sign are none of the kinds.
                    if (mail or digit and not letter) and not tokens[i].isspace():
                        starts.append((i, features(tokens, i, j)))
            yield starts

    def _score(self, found: list[str], kind: str) -> float:
        return sum(self.weights.get((f, kind), 0.0) for f in found)

    def best(self, text: str) -> list[tuple[str, int, int]]:
        """The best segmentation's entities, as places in text."""
        tokens = _TOKEN.findall(text)
        places = [0, *accumulate(map(len, tokens))]
        return [(kind, places[i], places[j]) for kind, i, j in self._decode(tokens)]

    def _decode(self, tokens: list[str]) -> list[tuple[str, int, int]]:
        best = [0.0] * (len(tokens) + 1)
        back: list[tuple[int, str | None]] = [(0, None)] * (len(tokens) + 1)
        for j, starts in enumerate(self._ends(tokens)):
            if not j:
                continue
            best[j], back[j] = best[j - 1], (j - 1, None)
            for i, found in starts:
                for kind in KINDS:
                    score = best[i] + self._score(found, kind)
                    if score > best[j] + 1e-12:
                        best[j], back[j] = score, (i, kind)
        out, j = [], len(tokens)
        while j:
            i, kind = back[j]
            if kind:
                out.append((kind, i, j))
            j = i
        return out[::-1]

    def train(self, examples: list[tuple[str, list[tuple[str, int, int]]]], epochs: int = EPOCHS, rate: float = 0.3) -> Field:
        """Gradient steps on the log-likelihood of the given entities, one example at a time, in a fixed order."""
        prepared = []
        for text, spans in examples:
            tokens = _TOKEN.findall(text)
            starts, at = {0: 0}, 0
            for k, token in enumerate(tokens, 1):
                at += len(token)
                starts[at] = k
            gold = {(starts[a], starts[b], kind) for kind, a, b in spans if a in starts and b in starts}
            prepared.append((self._segments(tokens), gold))
        order = random.Random(0)
        for epoch in range(epochs):
            order.shuffle(prepared)
            step = rate / (1 + epoch)
            for ends, gold in prepared:
                for key, value in self._gradient(ends, gold).items():
                    self.weights[key] = self.weights.get(key, 0.0) * (1 - 1e-4) + step * value
        return self

    def _gradient(self, ends, gold) -> dict[tuple[str, str], float]:
        """Features of the given segments less their expectation, by forward and backward sums."""
        n = len(ends) - 1
        scores = [[(i, found, [self._score(found, kind) for kind in KINDS]) for i, found in starts] for starts in ends]
        forward = [0.0] * (n + 1)
        for j in range(1, n + 1):
            forward[j] = _log_sum([forward[j - 1], *(forward[i] + s for i, _, all_ in scores[j] for s in all_)])
        backward = [-math.inf] * n + [0.0]
        for j in range(n, 0, -1):
            backward[j - 1] = _log_sum([backward[j - 1], backward[j]])
            for i, _, all_ in scores[j]:
                backward[i] = _log_sum([backward[i], *(backward[j] + s for s in all_)])
        out: dict[tuple[str, str], float] = {}
        for j in range(1, n + 1):
            for i, found, all_ in scores[j]:
                for kind, s in zip(KINDS, all_, strict=True):
                    value = ((i, j, kind) in gold) - math.exp(min(0.0, forward[i] + s + backward[j] - forward[n]))
                    if abs(value) > 1e-4:
                        for f in found:
                            out[f, kind] = out.get((f, kind), 0.0) + value
        return out


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values)) if top > -math.inf else top


def _inside(spans: list[tuple[str, int, int]], at: int, end: int) -> list[tuple[str, int, int]]:
    """Spans within [at, end), first kind first where they overlap, as places in that part."""
    out: list[tuple[str, int, int]] = []
    for kind in KINDS:  # the spans of a kind are in order
        low = bisect_left(spans, (KINDS.index(kind), at), key=lambda s: (KINDS.index(s[0]), s[1]))
        for _, a, b in takewhile(lambda s: s[0] == kind and s[1] < end, islice(spans, low, None)):
            if b <= end and all(b <= at + x or at + y <= a for _, x, y in out):
                out.append((kind, a - at, b - at))
    return out


def sample(
    docs: DataFrame, text_col: str = "text", size: int = SAMPLE, chars: int = SAMPLE_CHARS
) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Training islands of up to `chars`: `size` distinct ones with base spans and as many without, by smallest hash."""

    def rows(batch: Iterator[tuple]) -> Iterator[tuple]:
        found: dict[str, tuple] = {}
        for (text,) in batch:
            if not text or not _MARKED.search(text):
                continue
            spans = base_spans(text)
            for at, island in islands(text):
                if len(island) <= chars:
                    inside = _inside(spans, at, at + len(island))
                    rank = int.from_bytes(hashlib.blake2b(island.encode(), digest_size=7).digest(), "big")
                    found[island] = (rank, bool(inside), island, [f"{k}:{a}:{b}" for k, a, b in inside])
        for marked in (True, False):  # no more than `size` of a batch can be among the smallest
            yield from sorted(x for x in found.values() if x[1] == marked)[:size]

    marked = map_rows(docs.select(text_col), "rank long, marked boolean, island string, spans array<string>", rows)
    marked = marked.groupBy("island").agg(F.min("rank").alias("rank"), F.first("marked").alias("marked"), F.first("spans").alias("spans"))
    out = []
    for flag in (True, False):
        for r in marked.filter(F.col("marked") == flag).orderBy("rank", "island").limit(size).collect():
            spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans)]
            out.append((r.island, spans))
            if spans and spans[0][0] == "phone" and spans[0][1] == 0 and "(" in r.island:
                cut = r.island.index("(")  # the number without its country
                if cut < spans[0][2]:
                    out.append((r.island[cut:], [(k, max(0, a - cut), b - cut) for k, a, b in spans]))
    return out


def trained(docs: DataFrame, text_col: str = "text", size: int = SAMPLE) -> Field:
    return Field().train(sample(docs, text_col, size))


def all_spans(text: str, field: Field) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, those and the field's), by kind as listed, then start."""
    base = base_spans(text)
    if not field.weights or not _MARKED.search(text):
        return base, base
    added = [
        (kind, at + a, at + b)
        for at, island in islands(text)
        for kind, a, b in field.best(island)
    ]
    taken: list[tuple[int, int]] = []  # the base spans' union, in order
    for a, b in sorted((a, b) for _, a, b in base):
        if taken and a < taken[-1][1]:
            taken[-1] = taken[-1][0], max(b, taken[-1][1])
        else:
            taken.append((a, b))
    added = [x for x in added if not _overlaps(taken, x[1], x[2])]
    return base, sorted(base + added, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def _overlaps(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether [start, end) meets one of the intervals, which are apart and in order."""
    at = bisect_left(taken, (end,)) - 1
    return at >= 0 and start < taken[at][1]


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans (base and the field's)."""
    field = trained(docs, text_col) if field is None else field

    def rows(batch: Iterator[tuple]) -> Iterator[tuple]:
        for doc, text in batch:
            base, spans = all_spans(text or "", field)
            counts = [sum(k == kind for k, *_ in base) for kind in KINDS]
            yield doc, *counts, hashlib.sha256(written(base).encode()).hexdigest(), written(spans)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return map_rows(docs.select(F.col(id_col).cast("long"), text_col), schema, rows)


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by the first one's kind."""
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= end:
            out += [text[end:a], f"<{kind.upper()}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def masked(docs: DataFrame, text_col: str = "text", length_col: str | None = None, field: Field | None = None) -> DataFrame:
    """docs with personal data in the text replaced by marks; NULL stays. length_col gets the new length."""
    field = trained(docs, text_col) if field is None else field
    columns = docs.columns
    at = columns.index(text_col)
    length_at = columns.index(length_col) if length_col else -1

    def rows(batch: Iterator[tuple]) -> Iterator[tuple]:
        for row in batch:
            text = row[at]
            if text and (spans := all_spans(text, field)[1]):
                row = list(row)
                row[at] = mask(text, spans)
                if length_at >= 0:
                    row[length_at] = len(row[at])
            yield tuple(row)

    return map_rows(docs, docs.schema, rows)
