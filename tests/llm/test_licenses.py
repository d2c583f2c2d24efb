"""The join against all blocks times all templates; phrases against a plain search."""

from __future__ import annotations

import functools
import random
import re
import textwrap
import time

from gleanframe.llm import licenses

SCHEMA = "doc_id long, text string, labels string"


def plain_words(text: str | None) -> list[str]:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def texts() -> list[str | None]:
    rng = random.Random(5)
    vocabulary = [w for t in licenses.TEMPLATES.values() for w in t.split()]
    out: list[str | None] = [None, "", "\n", "MIT\nLicense", "mit license, Mit-License mit", "É license", "cc by by cc BY", "x" * 100_000]
    for text in licenses.TEMPLATES.values():
        kept = [w for w in text.split() if rng.random() < 0.85]
        out += [text, "Foo.\n" + text.upper() + "\nbar", " ".join(kept), " ".join(rng.sample(text.split(), len(text.split())))]
    out += ["\n".join(" ".join(rng.choices(vocabulary, k=rng.randint(3, 30))) for _ in range(6)) for _ in range(60)]
    return out * 2


def test_scan(spark):
    rows = [(i if i % 9 else None, t, "clash") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(
        (r.doc_id or -1, r.n_words, r.n_base, -1 if r.first_word is None else r.first_word, -1 if r.last_word is None else r.last_word,
         r.base_labels, r.labels, round(r.score, 9))
        for r in licenses.license_scan(docs).collect()
    )
    expected = []
    for i, text, _ in rows:
        words = plain_words(text)
        hits = [
            (at, label)
            for phrase, label in licenses.PHRASES.items()
            for at in range(len(words))
            if words[at : at + len(phrase.split())] == phrase.split()
        ]
        shares = {}
        for block in (text or "").split("\n"):
            for label, template in licenses.TEMPLATES.items():
                tokens = set(plain_words(template))
                share = len(tokens & set(plain_words(block))) / len(tokens)
                if share >= licenses.THRESHOLD - 1e-12:
                    shares[label] = max(share, shares.get(label, 0))
        base = {label for _, label in hits}
        at = [a for a, _ in hits]
        score = 1.0 if base else max(shares.values(), default=0.0)
        expected.append((i or -1, len(words), len(hits), min(at, default=-1), max(at, default=-1),
                         ",".join(sorted(base)), ",".join(sorted(base | set(shares))), round(score, 9)))
    assert got == sorted(expected)


def test_wrapped_notices(spark):
    cases = []
    for label, text in licenses.TEMPLATES.items():
        for width in (12, 40, 72):
            for mark in ("", "# ", " * ", "// "):
                body = textwrap.wrap(text, width, break_long_words=False)
                cases.append((label, len(body), "\n".join(["Some file", "", *[mark + x for x in body], "", "x = 1"])))
    docs = spark.createDataFrame([(i, t, "") for i, (*_, t) in enumerate(cases)], SCHEMA)
    got = {r.doc_id: r for r in licenses.license_scan(docs, phrases={}).collect()}
    for i, (label, n_lines, text) in enumerate(cases):
        assert label in got[i].labels.split(",") and got[i].score == 1, text
        assert n_lines == 1 or (2, label, 1.0) in [tuple(b) for b in got[i].blocks], text


def common(template: str, run: list[bytes]) -> int:
    """Longest common subsequence, from the back."""
    words = [x.encode() for x in plain_words(template)]

    @functools.cache
    def best(i: int, j: int) -> int:
        if i == len(words) or j == len(run):
            return 0
        return 1 + best(i + 1, j + 1) if words[i] == run[j] else max(best(i + 1, j), best(i, j + 1))

    return best(0, 0)


def test_runs_are_those_of_all_windows():
    rng = random.Random(6)
    index = licenses.Index(licenses.TEMPLATES, {})
    for _ in range(150):
        template = rng.choice(sorted(licenses.TEMPLATES.values())).split()
        body = [w for w in template if rng.random() < 0.93]
        for _ in range(rng.randint(0, 4)):
            body.insert(rng.randint(0, len(body)), "other")
        noise = lambda: [rng.choice(template + ["x", "y"]) for _ in range(rng.randint(0, 12))]
        lines = [[w.encode().lower()] for w in noise() + body + noise()]
        data = b"\n".join(b" ".join(x) for x in lines)
        found = licenses.words(data)
        starts = [0, *licenses.accumulate(len(licenses.words(x)) for x in data.split(b"\n")[:-1])]
        best = {}
        for _, _, label, share in index.wrapped(found, starts):
            best[label] = max(share, best.get(label, 0))
        expected = {}
        for (label, tokens, need), length in zip(index.templates, index.lengths, strict=True):
            windows = [found[k : k + length] for k in range(1 - length, len(found)) if k >= 0] + [found[:k] for k in range(length)]
            held = [len(tokens & set(x)) for x in windows if len(tokens & set(x)) >= need and common(licenses.TEMPLATES[label], x) >= need]
            if held:
                expected[label] = max(held) / len(tokens)
        assert best == expected


def test_very_many_places(spark):
    text = "mit license x " * 100_000
    start = time.monotonic()
    row = licenses.license_scan(spark.createDataFrame([(1, text, "")], SCHEMA)).first()
    assert (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels) == (300_000, 100_000, 0, 299_997, "mit")
    assert time.monotonic() - start < 30


def test_no_rows(spark):
    assert licenses.license_scan(spark.createDataFrame([], SCHEMA)).count() == 0
