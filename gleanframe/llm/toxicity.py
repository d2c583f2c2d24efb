"""Toxicity: a lexicon trie met by Levenshtein automata, and scores of context windows.

The lexicon is learned: words that stand in many different contexts (word before, word after) of rows
labelled toxic and in few clean rows, in so few that chance does not explain it, given how many words were
tried. Copies share contexts, so copied rows count once. A word of a text
is looked up by running its Levenshtein automaton over the trie, which finds exact and misspelled terms
at once. A misspelled hit counts as FUZZY_WEIGHT of an exact one, in the window, the rate and the sum alike.
A word that clean rows hold about as often as toxic ones is ordinary and no misspelling, and a term with
several ordinary neighbours stands in a family of words and is met exactly only. A hit is quoted if it lies
between quotation marks of one line or after a word of saying in its window; quoted and open hits are
counted apart, and the window with most open ones counts by itself. A logistic model over these counts gives
the score; its weights of open hits are never negative, so one more hit does not make a text cleaner.

Lexicon and model are fitted on at most `sample` labelled rows, those with the smallest hash of the id;
of these none whose crc32 of the id is divisible by HOLD_OUT. Everything else reads every row and whole
texts. Without labelled rows of both kinds, every score is 0. NULL counts as the empty text; rows with a NULL
id are held out. Ids may be repeated: each row is scored. Other columns are not read and not passed on.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, saved

HOLD_OUT = 5
SAMPLE = 20_000
#: A term stands in this many contexts, and in as many as this share of the toxic rows.
MIN_CONTEXTS = 5
MIN_SHARE = 0.01
#: A term's rate in toxic rows is at least this many times its rate in clean ones.
MIN_RATIO = 8.0
#: Chance, over all words tried, that one of them passes without being more frequent in toxic rows.
CHANCE = 0.05
#: Words on each side of a hit.
WINDOW = 8
#: Shorter terms are met exactly only.
FUZZY_LENGTH = 5
#: What a misspelled hit counts, next to 1 for an exact one.
FUZZY_WEIGHT = 0.8
#: A term with this many ordinary neighbours is met exactly only.
FAMILY = 2
#: Words of saying, as they announce a quotation.
SAYING = frozenset("said says wrote writes called calls quote quoted dit sagte dijo".split())
_WORD = re.compile(r"[^\W_]+")
_QUOTED = re.compile(r'"[^"\n]*"|“[^”\n]*”|«[^»\n]*»|„[^“\n]*“')
#: Words remembered with their terms in one task.
_REMEMBERED = 200_000


class Trie:
    """Terms as nested dicts; None marks the end of a term."""

    def __init__(self, terms: list[str]):
        self.root: dict = {}
        self.terms = frozenset(terms)
        for term in self.terms:
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[None] = term
        # One edit leaves the first or the second half of a term alone.
        self._starts = frozenset(t[: len(t) // 2] for t in terms if len(t) >= FUZZY_LENGTH)
        self._ends = frozenset(t[len(t) // 2 :] for t in terms if len(t) >= FUZZY_LENGTH)
        self._halves = sorted({len(x) for x in self._starts | self._ends})
        self._longest = max(map(len, terms), default=0)

    def find(self, word: str) -> tuple[str, int] | None:
        """The nearest term within one edit and that distance; of equally near ones the first by alphabet."""
        if word in self.terms:
            return word, 0
        if not FUZZY_LENGTH - 1 <= len(word) <= self._longest + 1:
            return None
        if not any(word[:k] in self._starts or word[-k:] in self._ends for k in self._halves):
            return None
        found = [t for t in self._walk(word) if len(t) >= FUZZY_LENGTH]
        return (min(found), 1) if found else None

    def _walk(self, word: str) -> Iterator[str]:
        """Runs the word's automaton for one edit over the trie. A state is the set of (place, edits left)."""
        stack = [(self.root, frozenset({(0, 1), (1, 0)}))]
        while stack:
            node, state = stack.pop()
            for c, below in node.items():
                if c is None:
                    if any(len(word) - place <= left for place, left in state):
                        yield below
                elif after := self._step(word, state, c):
                    stack.append((below, after))

    @staticmethod
    def _step(word: str, state: frozenset, c: str) -> frozenset:
        out = set()
        for place, left in state:
            if place < len(word) and word[place] == c:
                out.add((place + 1, left))
            if left:
                out.add((place + 1, left - 1))  # another letter
                out.add((place, left - 1))  # a letter that the word lacks
        for place, left in list(out):
            if left:
                out.add((place + 1, left - 1))  # a letter too many
        return frozenset(x for x in out if x[0] <= len(word))


class Lexicon(NamedTuple):
    """Terms, those of them that are met exactly only, and words near a term that are no misspellings."""

    terms: list[str]
    exact: frozenset[str] = frozenset()
    ordinary: frozenset[str] = frozenset()


class Reader:
    """Features of texts for one lexicon."""

    #: The last one is a count for the result and has no weight of its own.
    NAMES = ("open", "rate", "window", "any", "quoted", "fuzzy")
    #: Features of open hits, whose weights are never negative.
    RISING = 4

    def __init__(self, terms: list[str] | Lexicon):
        lexicon = terms if isinstance(terms, Lexicon) else Lexicon(terms)
        self.trie = Trie(lexicon.terms)
        self.loose = Trie([t for t in lexicon.terms if t not in lexicon.exact]) if lexicon.exact else self.trie
        self.ordinary = lexicon.ordinary
        self._seen: set[str] = set()
        self._found: dict[str, int] = {}  # words near a term, with their distance

    def _distance(self, word: str) -> int | None:
        if word in self.trie.terms:
            return 0
        return None if word in self.ordinary or not self.loose.find(word) else 1

    def near(self, words: set[str]) -> dict[str, int]:
        """Those of the words that are a term or near one."""
        if len(self._seen) >= _REMEMBERED:
            self._seen, self._found = set(), {}
        new = words - self._seen
        self._seen |= new
        for word in new:
            if (distance := self._distance(word)) is not None:
                self._found[word] = distance
        return {w: self._found[w] for w in words & self._found.keys()}

    def hits(self, text: str) -> tuple[int, list[tuple[int, int, int]]]:
        """Number of words, and for each hit (place, distance, 1 if quoted)."""
        low = text.lower()
        words = _WORD.findall(low)
        terms = self.near(set(words))
        if not terms:
            return len(words), []
        quoted = [m.span() for m in _QUOTED.finditer(low)]
        starts = [a for a, _ in quoted]
        out = []
        for k, m in enumerate(_WORD.finditer(low)):
            if m[0] in terms:
                at = bisect_right(starts, m.start()) - 1
                inside = at >= 0 and m.end() <= quoted[at][1]
                out.append((k, terms[m[0]], int(inside or not SAYING.isdisjoint(words[max(0, k - WINDOW) : k]))))
        return len(words), out

    def counts(self, text: str) -> tuple[int, int, int, int, float]:
        """Words; exact open, quoted and misspelled open hits; the weight of the window with most open ones."""
        n, hits = self.hits(text)
        open_ = [(k, FUZZY_WEIGHT if distance else 1.0) for k, distance, quoted in hits if not quoted]
        exact = sum(1 for _, distance, quoted in hits if not quoted and not distance)
        first, inside, window = 0, 0.0, 0.0
        for k, weight in open_:
            inside += weight
            while k - open_[first][0] > 2 * WINDOW:
                inside -= open_[first][1]
                first += 1
            window = max(window, inside)
        return n, exact, sum(q for *_, q in hits), len(open_) - exact, window

    @staticmethod
    def weighed(n: int, exact: int, quoted: int, fuzzy: int, window: float) -> list[float]:
        total = exact + FUZZY_WEIGHT * fuzzy
        return [
            math.log1p(total), math.log1p(100 * total / max(n, 1)), min(window, 4.0), float(total > 0), math.log1p(quoted), float(fuzzy),
        ]

    def features(self, text: str) -> list[float]:
        return self.weighed(*self.counts(text))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 30) -> np.ndarray:
    """Weights, the last one for the constant, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + np.clip(step, -5, 5)
    return w


def rising_logistic(x: np.ndarray, y: np.ndarray, rising: int) -> np.ndarray:
    """As logistic, but none of the first `rising` weights is negative: the lowest negative one becomes 0 and the rest is fitted again."""
    used = list(range(x.shape[1]))
    while True:
        w = logistic(x[:, used], y)
        low = min((k for k in range(len(used)) if used[k] < rising), key=lambda k: w[k], default=None)
        if low is None or w[low] >= 0:
            out = np.zeros(x.shape[1] + 1)
            out[[*used, -1]] = w
            return out
        del used[low]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HOLD_OUT == 0, F.lit(True))


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> DataFrame:
    """(text, toxic) of the sample: its ids and labels are `sample` rows at most, so they are sent to the documents."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("toxic")).filter("toxic IS NOT NULL")
    known = known.filter(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("toxic").alias("toxic"))
    chosen = saved(known.orderBy(F.xxhash64("_id"), "_id").limit(sample))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return saved(rows.join(F.broadcast(chosen), "_id").select("text", "toxic"))


def evidence(in_toxic: int, in_clean: int, toxic: int, clean: int) -> float:
    """Minus the logarithm of the chance that so many or more of the rows that hold a word are toxic ones (binomial tail)."""
    n, q = in_toxic + in_clean, toxic / (toxic + clean)
    if in_toxic <= n * q:
        return 0.0
    # Beyond the mean the terms fall, by a ratio that falls too.
    term = math.lgamma(n + 1) - math.lgamma(in_toxic + 1) - math.lgamma(in_clean + 1) + in_toxic * math.log(q) + in_clean * math.log(1 - q)
    total, part = 1.0, 1.0
    for k in range(in_toxic, n):
        part *= (n - k) / (k + 1) * q / (1 - q)
        total += part
        if part < 1e-12:
            break
    return -(term + math.log(total))


def learned(rows: DataFrame) -> Lexicon:
    """The lexicon of labelled rows (text, toxic)."""
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Lexicon([])

    def contexts(batch: Iterator[tuple]) -> Iterator[tuple]:
        for (text,) in batch:
            words = ["", *_WORD.findall(text.lower()), ""]
            yield from {(b, f"{a} {c}") for a, b, c in zip(words, words[1:], words[2:], strict=False)}

    least = max(MIN_CONTEXTS, MIN_SHARE * toxic)
    found = map_rows(rows.filter("toxic = 1").select("text"), "word string, context string", contexts)
    found = found.select("word", F.xxhash64("context").alias("c")).distinct().groupBy("word").count().filter(F.col("count") >= least)
    frequent = frozenset(r.word for r in found.select("word").collect())  # no more than the sample's words over `least`

    def counted(wanted: Callable[[], Callable[[set[str]], Iterable[str]]]) -> dict[str, dict[int, int]]:
        """Rows by label that hold each of the words that wanted() picks."""

        def held(batch: Iterator[tuple]) -> Iterator[tuple]:
            counts: Counter = Counter()
            pick = wanted()
            for text, label in batch:
                counts.update((w, label) for w in pick(set(_WORD.findall(text.lower()))))
            for (word, label), n in counts.items():
                yield word, label, n

        out: dict[str, dict[int, int]] = {}
        for r in map_rows(rows.select("text", "toxic"), "word string, toxic int, n long", held).groupBy("word", "toxic").agg(F.sum("n").alias("n")).collect():
            out.setdefault(r.word, {})[r.toxic] = r.n
        return out

    ratio = lambda c: ((c.get(1, 0) + 0.5) / toxic) / ((c.get(0, 0) + 0.5) / clean)
    tried = counted(lambda: frequent.intersection)
    least_evidence = math.log(max(1, len(tried)) / CHANCE)
    terms = sorted(w for w, c in tried.items() if ratio(c) >= MIN_RATIO and evidence(c.get(1, 0), c.get(0, 0), toxic, clean) >= least_evidence)
    # Words near a term that clean rows hold, no more than the sample's words.
    near = {w: c for w, c in counted(lambda: Reader(terms).near).items() if w not in set(terms) and c.get(0, 0)}
    ordinary = frozenset(w for w, c in near.items() if ratio(c) < MIN_RATIO)
    alone = [Trie([t]) for t in terms]
    family = Counter(t for trie in alone for w in ordinary if trie.find(w) for t in trie.terms)
    return Lexicon(terms, frozenset(t for t, n in family.items() if n >= FAMILY), ordinary)


def trained(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE
) -> tuple[Lexicon, np.ndarray | None]:
    """Lexicon and weights; no weights where the sample lacks a kind of rows."""
    rows = _labelled(docs, labels, id_col, text_col, label_col, sample)
    lexicon = learned(rows)

    def features(batch: Iterator[tuple]) -> Iterator[tuple]:
        reader = Reader(lexicon)
        for text, toxic in batch:
            yield reader.features(text)[:-1], toxic

    read = map_rows(rows.select("text", "toxic"), "x array<double>, y int", features).collect()  # the sample's rows
    read = sorted((tuple(r.x), r.y) for r in read)
    if len({y for _, y in read}) < 2:
        return lexicon, None
    return lexicon, rising_logistic(np.array([x for x, _ in read]), np.array([y for _, y in read], dtype=float), Reader.RISING)


def scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE
) -> DataFrame:
    """Per row: id, held_out, score, predicted, n_open, n_quoted, n_fuzzy (hits by sort)."""
    lexicon, weights = trained(docs, labels, id_col, text_col, label_col, sample)

    def score(batch: Iterator[tuple]) -> Iterator[tuple]:
        reader = Reader(lexicon)
        for doc, out, text in batch:
            n, exact, quoted, fuzzy, window = reader.counts(text or "")
            x = reader.weighed(n, exact, quoted, fuzzy, window)[:-1]
            value = 0.0 if weights is None else float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(weights, [*x, 1.0])))))))
            yield doc, out, value, int(value >= 0.5), exact, quoted, fuzzy

    rows = docs.select(F.col(id_col).cast("long"), held_out(F.col(id_col)), F.col(text_col).cast("string"))
    return map_rows(rows, f"`{id_col}` long, held_out boolean, score double, predicted int, n_open long, n_quoted long, n_fuzzy long", score)
