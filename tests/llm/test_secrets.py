"""Base spans against plain patterns; judgement of values by their owners."""

from __future__ import annotations

import hashlib
import random
import re
import time

from gleanframe.llm import secrets

SCHEMA = "doc_id long, text string, source string, row string, live int"
ORDER = ("assign", "access", "hex", "token")


def plain(text: str | None) -> list[tuple[int, int, int, str]]:
    text, out = text or "", []
    words = r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    for m in re.finditer(words + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 6:
            out.append((m.start(), 0, m.end(), m[1]))
    out += [(m.start(), 1, m.end(), m[0]) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), m[0]) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def free(text: str | None, base: list) -> list[tuple[int, int, int, str]]:
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text or ""):
        if all(re.search(p, m[0]) for p in ("[0-9]", "[a-z]", "[A-Z]")) and not any(a < m.end() and m.start() < b for a, _, b, _ in base):
            out.append((m.start(), 3, m.end(), m[0]))
    return out


def texts() -> list[str | None]:
    rng = random.Random(6)
    some = lambda s, n: "".join(rng.choices(s, k=n))
    shared = "Zz09" * 6
    out: list[str | None] = [None, "", "password=token: abcdefgh", "Token = 'abc' secret:'abcdef", "AKIA" * 9, "a" * 40_000, "é漢 api_key=é", "é𝒳 API_KEY: \"a+b/c==\""]
    pieces = ["password", "Secret", "token", "apikey", "=", ":", " ", "'", '"', "abc", "abcdef", "AKIA", "é", "\n"]
    for _ in range(120):
        words = rng.choices(pieces, k=rng.randint(1, 9)) + [some("abcdef0123", rng.randint(20, 30)), " ", "AKIA" + some("ABC123", rng.randint(13, 19)), " "]
        if rng.random() < 0.4:
            words += [" ", some("abcXYZ123_", 26), " "]
        if rng.random() < 0.3:
            words += [" ", shared, " "]
        rng.shuffle(words)
        out.append("".join(words))
    return out


def test_scan(spark):
    rows = [(i if i % 9 else None, t, f"s{i % 5}" if i % 4 else None, "clash", 1) for i, t in enumerate(texts() + texts()[:20])]
    got = secrets.find(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    base = [plain(t) for _, t, *_ in rows]
    more = [free(t, b) for (_, t, *_), b in zip(rows, base, strict=True)]
    owners: dict[str, set] = {}
    bodies: dict[str, set] = {}
    for (_, text, source, *_), a, b in zip(rows, base, more, strict=True):
        for *_, value in a + b:
            owners.setdefault(value, set()).add(source)
            bodies.setdefault(value, set()).add(text)
    live = {v for v in owners if len(owners[v]) <= 2 and len(bodies[v]) <= 20}
    assert 0 < len(live) < len(owners)
    written = lambda spans: ",".join(f"{ORDER[k]}:{a}:{b}" for a, k, b, _ in sorted(spans))
    expected = []
    for (doc, *_), a, b in zip(rows, base, more, strict=True):
        values = {v for *_, v in a + b}
        spans = written(a + [x for x in b if x[3] in live])
        counts = [sum(k == n for _, k, *_ in a) for n in range(3)]
        expected.append((doc or -1, *counts, hashlib.sha256(written(a).encode()).hexdigest(), spans, len(values & live), len(values - live)))
    assert sorted((r.doc_id or -1, *r[1:]) for r in got) == sorted(expected)


def test_dense_texts_take_seconds(spark):
    rng = random.Random(7)
    some = lambda n: "".join(rng.choices("abcXYZ0189", k=n))
    words = [rng.choice([f"token={some(8)}", "AKIA" + "A1" * 9, "0a" * 14, f"z9Q{some(24)}", f"password: {some(25)}"]) for _ in range(100_000)]
    rows = [(1, " ".join(words), "s", "", 0), (2, " ".join(words[:9]), "t", "", 0)]
    secrets.find(spark.createDataFrame(rows[1:], SCHEMA)).collect()  # code is compiled
    start = time.monotonic()
    got = {r.doc_id: r for r in secrets.find(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert time.monotonic() - start < 60
    for doc, text, *_ in rows:
        base = plain(text)
        assert got[doc].base_sha256 == hashlib.sha256(",".join(f"{ORDER[k]}:{a}:{b}" for a, k, b, _ in base).encode()).hexdigest()
        assert got[doc].n_assign + got[doc].n_access + got[doc].n_hex == len(base)
        spans = {x for x in got[doc].spans.split(",")}
        loose = re.finditer(r"(?<![A-Za-z0-9+/_=-])z9Q[A-Za-z0-9]{24}(?![A-Za-z0-9+/_=-])", text)
        # All but those that hold a run of hex digits, which is a base span.
        assert all((f"token:{m.start()}:{m.end()}" in spans) != bool(re.search("[0-9a-f]{24}", m[0])) for m in loose)


def test_no_rows(spark):
    assert secrets.find(spark.createDataFrame([], SCHEMA)).count() == 0


def test_main_path_is_built_in(spark, capsys):
    secrets.find(spark.createDataFrame([], SCHEMA)).explain("formatted")
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)
