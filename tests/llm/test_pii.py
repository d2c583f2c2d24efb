"""Base spans against the plain patterns, the field on held-out islands, and masks."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import time

import pytest

from gleanframe.llm import pii

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text: str) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (
                kind == "email"
                or kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))
                or kind == "card" and 13 <= len(digits) <= 19 and pii.luhn(digits)
                or kind == "phone" and 9 <= len(digits) <= 15
            ):
                out.append((kind, *m.span()))
    return out


def pieces(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    alphabet = ["a", "b.", "@", "@@", "1", "23", "255.", "4111111111111111", "+", "+1 (", "555-", " ", "  ", "\n", "-", "_", "%", ".com", "x@y.z", "é", ")", "192.168.0.1", "0" * 12]
    return ["".join(rng.choices(alphabet, k=rng.randint(0, 24))) for _ in range(n)]


def test_base_spans_and_islands():
    for text in pieces(1, 5000):
        assert pii.base_spans(text) == plain(text)
        for at, island in pii.islands(text):
            assert text[at : at + len(island)] == island


def people(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    number = lambda k: "".join(rng.choices("0123456789", k=k))
    out = []
    for _ in range(n):
        word = "".join(rng.choices("abcdefg", k=6))
        card = number(15)
        card += next(d for d in "0123456789" if pii.luhn(card + d))
        entity = rng.choice([f"{word}.{number(2)}@mail.example.com", ".".join(str(rng.randint(1, 255)) for _ in range(4)),
                             card, f"+1 ({number(3)}) 555-{number(4)}"])
        out.append(f"the {word} of {entity} and {word} {rng.choice(['', 'v2.0 ', '12 ', 'id' + number(5) + ' '])}is.")
    return out


def test_field_finds_what_patterns_miss(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), "clash") for i, t in enumerate(people(2, 400))], SCHEMA)
    field = pii.trained(docs)
    assert field.weights == pii.trained(docs.repartition(7)).weights, "the sample does not depend on partitions"
    text = "call +1 (269) 555-3296 4524132264652876 now"  # too many digits for a phone in the base pattern
    base, both = pii.all_spans(text, field)
    assert ("phone", 5, 22) not in base and ("phone", 5, 22) in both
    for held_out in people(3, 100):
        base, both = pii.all_spans(held_out, field)
        assert set(base) <= set(both) and len(both) == len(base) == 1


def test_long_islands_are_solved_whole():
    # Phones of six tokens, one space apart: an island far beyond 256 tokens with no place where all parts begin anew.
    field = pii.Field({("groups 3-3-4 True", "phone"): 5.0, ("groups 3-3-4 False", "phone"): -5.0})
    for n in (3, 100, 1_000):
        for lead in ("", "7 ", "7 7 7 "):
            text = lead + " ".join(["(269) 555 3296"] * n)
            assert [x for _, x in pii.islands(text)] == [text]
            expected = [("phone", len(lead) + 15 * k, len(lead) + 15 * k + 14) for k in range(n)]
            assert field.best(text) == expected
    # Without any white space the cut fell within an entity.
    mails = "(269)555-3296" * 200
    assert field.best(mails) == [("phone", 13 * k, 13 * k + 13) for k in range(200)]


def test_gradient_is_that_of_the_likelihood():
    field = pii.Field({("digits 2", "ip"): 0.3, ("tokens 1", "card"): -0.2})
    tokens = pii._TOKEN.findall("12 x@y 3")
    ends = field._segments(tokens)
    gold = {(0, 1, "card")}

    def likelihood() -> float:
        segments = [(i, j, k, field._score(found, k)) for j, starts in enumerate(ends) for i, found in starts for k in pii.KINDS]
        total, value = 0.0, 0.0
        for size in range(4):
            for chosen in itertools.combinations(segments, size):
                chosen = sorted(chosen)
                if all(a[1] <= b[0] for a, b in itertools.pairwise(chosen)):
                    score = math.exp(sum(c[3] for c in chosen))
                    total += score
                    value += score * ({c[:3] for c in chosen} == gold)
        return math.log(value / total)

    gradient = field._gradient(ends, gold)
    for key in [("digits 2", "card"), ("tokens 1", "card"), ("digits 1", "ip")]:
        old = field.weights.get(key, 0.0)
        field.weights[key] = old + 1e-5
        up = likelihood()
        field.weights[key] = old - 1e-5
        down = likelihood()
        field.weights[key] = old
        assert gradient.get(key, 0.0) == pytest.approx((up - down) / 2e-5, abs=1e-3)


def test_rows_and_masks(spark):
    texts = [None, "", "1" * 3_000, "a@b.co", "a@b.co", "no data", *pieces(4, 60)]
    rows = [(i if i % 5 else None, t, None, "s", 7, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = sorted((r.doc_id or 0, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.find(docs).collect())
    expected = []
    for i, text, *_ in rows:
        spans = plain(text or "")
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        expected.append((i or 0, *[sum(k == kind for k, *_ in spans) for kind in PATTERNS], hashlib.sha256(written.encode()).hexdigest()))
    assert out == sorted(expected)
    masked = pii.masked(docs, length_col="n_chars", field=pii.Field())
    assert masked.columns == docs.columns and masked.count() == len(rows)
    assert {r.text for r in masked.filter("text LIKE '<EMAIL>%'").collect()} >= {"<EMAIL>"}
    assert pii.mask("a bb c", [("email", 2, 4)]) == "a <EMAIL> c"


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pii.find(empty).count() == 0 and pii.masked(empty).count() == 0


def test_long_runs_take_seconds():
    rng = random.Random(4)
    dense = "".join(rng.choice(["1.2.3.4", "1.2.3.", "12.300.1.9", "7" * 30, ".", " ", "a@b.c", "+1 234 567 890", "x"]) for _ in range(4000))
    assert pii.base_spans(dense) == plain(dense)
    for text, n in (("7" * 1_000_000, 0), ("1.2.3." * 100_000, 75_000), ("10.0.0.1 " * 100_000, 100_000)):
        start = time.monotonic()
        assert sum(k == "ip" for k, *_ in pii.base_spans(text)) == n
        assert time.monotonic() - start < 20


def test_overlaps_and_spans_inside():
    rng = random.Random(5)
    for _ in range(300):
        spans = sorted(
            {(rng.choice(pii.KINDS), a, a + rng.randint(1, 9)) for a in (rng.randrange(60) for _ in range(8))},
            key=lambda s: (pii.KINDS.index(s[0]), s[1]),
        )
        apart = []
        for s in spans:  # spans of one kind never overlap
            if all(s[0] != t[0] or t[2] <= s[1] for t in apart):
                apart.append(s)
        at, end = sorted(rng.sample(range(70), 2))
        want = []
        for kind, a, b in apart:
            if at <= a and b <= end and all(b <= at + x or at + y <= a for _, x, y in want):
                want.append((kind, a - at, b - at))
        assert pii._inside(apart, at, end) == want
        union = []
        for a, b in sorted((a, b) for _, a, b in apart):
            if union and a < union[-1][1]:
                union[-1] = union[-1][0], max(b, union[-1][1])
            else:
                union.append((a, b))
        assert pii._overlaps(union, at, end) == any(a < end and at < b for _, a, b in apart)


def test_masked_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([("mail a.b@example.com now", 1, "x"), (None, None, None)], "text string, `a b` int, `_id` string")
    out = pii.masked(docs, field=pii.Field())
    assert out.columns == ["text", "a b", "_id"] and [tuple(r) for r in out.collect()] == [("mail <EMAIL> now", 1, "x"), (None, None, None)]
