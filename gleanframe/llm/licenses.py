"""License scans: exact phrases, and an exact set-similarity join of text blocks with templates.

A block is a line, or a run of words over several lines that is at most 1 / THRESHOLD times as long as the
template, as notices wrap; white space and comment marks are no words. The words of a block form a set. A
template is found in a block that holds at least THRESHOLD of the template's set; over several lines as many
words must also stand in the template's order, as a wrap keeps it and chance does not. The join orders tokens by how many blocks of the whole corpus hold them, rarest
first. A block can only qualify if it holds one of a template's first m - ceil(THRESHOLD m) + 1 tokens
(prefix filter), if enough of its words occur in templates at all (length filter), and if what follows
the first common token on both sides suffices (positional filter). Candidates are counted exactly. Runs of
every place are counted in one sweep over a text that passes the first two filters as a whole.

Templates are a parameter of the operator and travel to the tasks; documents stay where they are.
Two passes over the texts: frequencies, then the join. NULL counts as the empty text. Ids may be NULL
or repeated: each row is scanned. Other columns are not passed on.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Share of a template's words that a block must hold.
THRESHOLD = 0.8
#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices by label, as their licenses word them.
TEMPLATES = {
    "agpl-notice": "This work is licensed under the GNU Affero General Public License, version 3",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "bsd-terms": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl-terms": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
    "License as published by the Free Software Foundation",
    "mit-notice": "This work is released under the MIT License",
    "mit-terms": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files, to deal in the Software without restriction",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}

#: Bytes of words as they are in lower case; all others become spaces. Bytes above 127 belong to words.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words(text: str | bytes | None) -> list[bytes]:
    data = text if isinstance(text, bytes) else (text or "").encode()
    return data.translate(_WORDS).split()


def block_frequencies(docs: DataFrame, tokens: set[bytes], text_col: str = "text") -> dict[bytes, int]:
    """How many blocks of all documents hold each of the given tokens."""

    def rows(batch: Iterator[tuple]) -> Iterator[tuple]:
        found: Counter = Counter()
        for (text,) in batch:
            for block in (text or "").encode().split(b"\n"):
                found.update(tokens.intersection(words(block)))
        yield from ((k.decode(), n) for k, n in found.items())

    counted = map_rows(docs.select(text_col), "token string, n long", rows).groupBy("token").agg(F.sum("n").alias("n"))
    return {r.token.encode(): r.n for r in counted.collect()}  # at most one row per token of the templates


class Index:
    """Templates by the tokens of their prefixes."""

    def __init__(self, templates: dict[str, str], frequencies: dict[bytes, int], threshold: float = THRESHOLD):
        self.order = {t: i for i, t in enumerate(sorted(tokens_of(templates), key=lambda t: (frequencies.get(t, 0), t)))}
        self.templates = []
        self.sequences: list[list[bytes]] = []
        self.lengths: list[int] = []  # words of the longest run that is searched
        self.prefixes: dict[bytes, list[tuple[int, int]]] = {}
        for label, text in sorted(templates.items()):
            tokens = sorted(set(words(text)), key=self.order.__getitem__)
            need = ceil(threshold * len(tokens) - 1e-9)
            if not tokens or not need:
                raise ValueError(f"template without words: {label}")
            for place, token in enumerate(tokens[: len(tokens) - need + 1]):
                self.prefixes.setdefault(token, []).append((len(self.templates), place))
            self.templates.append((label, frozenset(tokens), need))
            self.sequences.append(words(text))
            self.lengths.append(ceil(len(self.sequences[-1]) / threshold - 1e-9))
        self.rare = frozenset(self.prefixes)

    def matches(self, block: bytes) -> list[tuple[str, float]]:
        """Labels of the templates that the block holds, with the share it holds."""
        held = self.order.keys() & words(block)
        seen: set[int] = set()
        out = []
        if held.isdisjoint(self.rare):
            return out
        for at, token in enumerate(sorted(held, key=self.order.__getitem__)):
            for number, place in self.prefixes.get(token, ()):
                label, tokens, need = self.templates[number]
                # The first common token decides: what follows it on either side bounds the overlap.
                if number in seen:
                    continue
                seen.add(number)
                if len(held) < need or 1 + min(len(tokens) - place, len(held) - at) - 1 < need:
                    continue
                if (common := len(tokens & held)) >= need:
                    out.append((label, common / len(tokens)))
        return sorted(out)


    def wrapped(self, found: list[bytes], starts: list[int]) -> list[tuple[int, int, str, float]]:
        """(first line, last line, label, share) of runs over more than one line; starts has each line's first place in found."""
        hits = [(place, token) for place, token in enumerate(found) if token in self.order]
        held = {token for _, token in hits}
        line = lambda place: bisect_right(starts, place) - 1
        out = []
        for number in sorted({n for token in held & self.rare for n, _ in self.prefixes[token]}):
            label, tokens, need = self.templates[number]
            if len(tokens & held) < need:
                continue
            last: dict[bytes, int] = {}  # last place of each token in the run, in order of places
            best: tuple[int, int, int] | None = None  # tokens, first and last place of the best of runs that overlap
            for place, token in hits:
                if token not in tokens:
                    continue
                last.pop(token, None)
                last[token] = place
                while (first := next(iter(last.values()))) <= place - self.lengths[number]:
                    del last[next(iter(last))]
                if best and first > best[2]:
                    out.append((line(best[1]), line(best[2]), label, best[0] / len(tokens)))
                    best = None
                if len(last) >= need and (best is None or len(last) > best[0]) and line(first) < line(place):
                    run = found[max(0, place + 1 - self.lengths[number]) : place + 1]
                    if in_order(self.sequences[number], run) >= need:
                        best = len(last), first, place
            if best:
                out.append((line(best[1]), line(best[2]), label, best[0] / len(tokens)))
        return out


def in_order(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        left_above = 0
        for j, y in enumerate(b, 1):
            above = row[j]
            row[j] = left_above + 1 if x == y else max(above, row[j - 1])
            left_above = above
    return row[-1]


def tokens_of(templates: dict[str, str]) -> set[bytes]:
    return {t for text in templates.values() for t in words(text)}


def license_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None,
    phrases: dict[str, str] | None = None, threshold: float = THRESHOLD,
) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks.

    score is the largest share of a found template, 1 where a phrase stands, else 0. blocks are the
    found (line, label, share); a run over several lines has its first line, and is left out where one of
    its lines holds as much by itself.
    """
    templates = TEMPLATES if templates is None else templates
    phrases = {" ".join(k.split()): v for k, v in (PHRASES if phrases is None else phrases).items()}
    index = Index(templates, block_frequencies(docs, tokens_of(templates), text_col), threshold)
    needles = [(b" " + k.encode() + b" ", v) for k, v in phrases.items()]

    def rows(batch: Iterator[tuple]) -> Iterator[tuple]:
        for doc, text in batch:
            data = (text or "").encode()
            found = words(data)
            joined = b" " + b" ".join(found) + b" "
            places, base, blocks = [], set(), []
            for needle, label in needles:
                at, seen, place = joined.find(needle), 0, 0
                while at >= 0:
                    place += joined.count(b" ", seen, at)  # words since the last hit
                    seen = at
                    places.append(place)
                    base.add(label)
                    at = joined.find(needle, at + 1)
            if not index.rare.isdisjoint(found):
                lines = data.split(b"\n")
                for line, block in enumerate(lines):
                    blocks += [(line, label, share) for label, share in index.matches(block)]
                if len(lines) > 1:
                    alone: dict[str, list[tuple[int, float]]] = {}
                    for line, label, share in blocks:
                        alone.setdefault(label, []).append((line, share))
                    starts = [0, *accumulate(len(words(x)) for x in lines[:-1])]
                    blocks += [
                        (a, label, share)
                        for a, b, label, share in index.wrapped(found, starts)
                        if not any(a <= line <= b and held >= share for line, held in alone.get(label, ()))
                    ]
                    blocks.sort()
            labels = base.union(label for _, label, _ in blocks)
            score = 1.0 if base else max((share for *_, share in blocks), default=0.0)
            yield (
                doc, len(found), len(places), min(places, default=None), max(places, default=None),
                ",".join(sorted(base)), ",".join(sorted(labels)), score,
                [{"line": a, "label": b, "share": c} for a, b, c in blocks],
            )

    schema = (
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, blocks array<struct<line: int, label: string, share: double>>"
    )
    return map_rows(docs.select(F.col(id_col).cast("long"), text_col), schema, rows)
