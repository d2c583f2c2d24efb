"""Language of texts: sparse multinomial logistic regression on TF-IDF character n-grams, with calibrated scores.

A text is lower-cased, everything between its letters becomes one blank, and its n-grams of ORDERS characters are
hashed into BUCKETS. Document frequencies are counted over all rows to learn from; a feature is (1 + log count) times
its inverse document frequency, and vectors have length 1.

The classifier is fitted on a bounded sample, at most `per_lang` ids of each language, those with the smallest hash.
It is trained by follow-the-regularised-leader: each weight follows from its sums of gradients and of squared
gradients, with an L1 penalty that keeps most weights at zero and an L2 penalty. SHARDS parts of the sample are
trained side by side and their sums averaged after each pass. One further part is not trained on: the temperature
that fits its rows best divides the logits, so a score is an estimate of the chance to be right.

Learning reads the text and the language of rows that are not held out (crc32 of the id modulo FOLDS is HELD);
predictions read the text alone, whole, at any length, in pieces of bounded size. A NULL text and one without a letter
are `und` with score 0, and so is everything where no row can be learned from. NULL languages teach nothing; rows with a NULL id are
held out; rows that repeat an id are predicted each, and count once in the sample, by their smallest text. Equal scores
go to the language that sorts first. Other columns are neither read nor passed on.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, saved

FOLDS, HELD = 3, 1
ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
#: Ids of the sample for each language.
PER_LANG = 1_500
#: Parts of the sample that are trained, and passes over each.
SHARDS, PASSES = 4, 3
#: Learning rate, its offset, and the two penalties.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.01
#: Characters of a text that are hashed at a time.
PIECE = 1 << 20
UNKNOWN = "und"

_letters: np.ndarray | None = None


def _is_letter(codes: np.ndarray) -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _letters[codes]


def _buckets(kept: np.ndarray, first: int) -> list[np.ndarray]:
    """Buckets of the n-grams that end at place `first` or later, for each order."""
    out, held = [], np.zeros(len(kept), np.uint32)
    for order in ORDERS:
        # held has one value per start of an n-gram.
        held = held[: len(kept) - order + 1] * np.uint32(0x9E3779B1) + kept[order - 1 :]
        fresh = held[max(0, first - order + 1) :] ^ np.uint32(order << 28)
        fresh = (fresh ^ (fresh >> np.uint32(15))) * np.uint32(0x85EBCA77)
        out.append(fresh >> np.uint32(32 - BUCKETS.bit_length() + 1))
    return out


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's n-grams in ascending order, and how often each occurs; none without a letter."""
    counts, any_letter = np.zeros(BUCKETS, dtype=np.int64), False
    tail, low = np.array([32], np.uint32), text.lower()
    for at in range(0, len(low) + 1, PIECE):
        end = " " if at + PIECE > len(low) else ""
        codes = np.frombuffer((low[at : at + PIECE] + end).encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _is_letter(codes)
        any_letter = any_letter or bool(letter.any())
        # Of what lies between two letters one blank stays.
        stays = letter.copy()
        stays[1:] |= letter[:-1]
        stays[0] |= tail[-1] != 32
        kept = np.concatenate([tail, np.where(letter, codes, np.uint32(32))[stays]])
        counts += np.bincount(np.concatenate(_buckets(kept, len(tail))), minlength=BUCKETS)
        tail = kept[1 - max(ORDERS) :]
    found = np.flatnonzero(counts) if any_letter else np.zeros(0, np.int64)
    return found, counts[found]


class Model(NamedTuple):
    """Languages in order, inverse document frequencies, weights (language x bucket, and one constant each), temperature."""

    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.weights[:, found] @ tfidf(self.idf, found, counts) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        found, counts = grams(text or "")
        if not len(found) or not self.langs:
            return UNKNOWN, 0.0
        p = softmax(self.logits(found, counts) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(min(1.0, p[best]))


def tfidf(idf: np.ndarray, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[found]
    return x / max(1e-12, math.sqrt(float(x @ x)))


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max())
    return e / e.sum()


class Ftrl:
    """Sums z and n of each weight; the weights follow from them. The last bucket holds the constants."""

    def __init__(self, langs: int, z: np.ndarray | None = None, n: np.ndarray | None = None):
        self.z = np.zeros((langs, BUCKETS + 1)) if z is None else z.copy()
        self.n = np.zeros((langs, BUCKETS + 1)) if n is None else n.copy()

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[:, at], self.n[:, at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0.0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, found: np.ndarray, x: np.ndarray, label: int) -> None:
        at = np.append(found, BUCKETS)
        x = np.append(x, 1.0)
        w = self.weights(at)
        p = softmax(w @ x)
        p[label] -= 1.0
        g = p[:, None] * x
        n = self.n[:, at]
        more = n + g * g
        self.z[:, at] += g - (np.sqrt(more) - np.sqrt(n)) / ALPHA * w
        self.n[:, at] = more


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits that gives the labels the highest likelihood, by golden section."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        a = logits / math.exp(log_t)
        a = a - a.max(axis=1, keepdims=True)
        return float((np.log(np.exp(a).sum(axis=1)) - a[np.arange(len(labels)), labels]).mean())

    low, high, ratio = math.log(0.05), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return math.exp((low + high) / 2)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD, F.lit(True))


def _frequencies(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Texts with a letter, and in how many of them each bucket occurs: each task adds up its own."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                found, _ = grams(text.as_py() or "")
                held[found] += 1
                total += len(found) > 0
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(held[used], total))], ["bucket", "n"])

    sums = rows.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # BUCKETS + 1 rows at most
    out, total = np.zeros(BUCKETS, np.int64), 0
    for r in sums:
        if r.bucket < 0:
            total = r.n
        else:
            out[r.bucket] = r.n
    return total, out


def _sample(rows: DataFrame, per_lang: int) -> DataFrame:
    """(lang, shard, mark, buckets, counts) of the sample; shard SHARDS is kept for calibration."""
    ids = rows.select("id", "lang", F.xxhash64("id").alias("mark")).distinct()
    order = Window.partitionBy("lang").orderBy("mark", "id")
    ids = ids.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= per_lang).drop("k")
    chosen = rows.join(F.broadcast(saved(ids)), ["id", "lang"]).groupBy("id", "lang", "mark").agg(F.min("text").alias("text"))

    def read(batch: Iterator[tuple]) -> Iterator[tuple]:
        for lang, mark, text in batch:
            found, counts = grams(text)
            if len(found):
                yield lang, mark % (SHARDS + 1), mark, found, counts

    return saved(map_rows(chosen.select("lang", "mark", "text"), "lang string, shard int, mark long, buckets array<int>, counts array<int>", read))


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [x.values.to_numpy() for chunk in column.chunks for x in chunk]


def _training(state: Ftrl, idf: np.ndarray, place: dict[str, int]) -> Callable[[pa.Table], pa.Table]:
    """One pass over one shard, in order of hashes, from the given sums."""

    def train(part: pa.Table) -> pa.Table:
        model = Ftrl(len(place), state.z, state.n)
        marks, labels = part.column("mark").to_numpy(), [place[x] for x in part.column("lang").to_pylist()]
        buckets, counts = _lists(part.column("buckets")), _lists(part.column("counts"))
        for k in np.lexsort((labels, marks)).tolist():
            model.learn(buckets[k], tfidf(idf, buckets[k], counts[k]), labels[k])
        return pa.table({"z": pa.array([model.z.tobytes()], pa.binary()), "n": pa.array([model.n.tobytes()], pa.binary())})

    return train


def trained(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> Model:
    """The model of the rows that are not held out."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    total, frequency = _frequencies(rows)
    idf = np.log((1 + total) / (1 + frequency)) + 1
    sample = _sample(rows, per_lang)
    langs = sorted(r.lang for r in sample.select("lang").distinct().collect())  # the classes of the model
    place = {lang: k for k, lang in enumerate(langs)}
    state = Ftrl(len(langs))
    for _ in range(PASSES if langs else 0):
        train = _training(state, idf, place)
        parts = sample.filter(F.col("shard") < SHARDS).groupBy("shard").applyInArrow(train, "z binary, n binary").collect()  # SHARDS rows
        if parts:
            mean = [sum(np.frombuffer(p[c]).reshape(state.z.shape) for p in sorted(parts)) / len(parts) for c in ("z", "n")]
            state = Ftrl(len(langs), *mean)
    weights = state.weights(slice(None))
    model = Model(langs, idf, weights[:, :-1], weights[:, -1], 1.0)

    def logits(batch: Iterator[tuple]) -> Iterator[tuple]:
        for lang, buckets, counts in batch:
            yield model.logits(np.array(buckets), np.array(counts)).tolist(), place[lang]

    kept = sample.filter(F.col("shard") == SHARDS).select("lang", "buckets", "counts")
    seen = map_rows(kept, "logits array<double>, label int", logits).collect()  # a part of the sample
    seen = sorted((tuple(r.logits), r.label) for r in seen)
    fitted = temperature(np.array([x for x, _ in seen]), np.array([y for _, y in seen], dtype=int))
    return model._replace(temperature=fitted)


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> DataFrame:
    """Per row: id, held_out, lang_pred, score."""
    sent = docs.sparkSession.sparkContext.broadcast(trained(docs, id_col, text_col, lang_col, per_lang))  # languages x BUCKETS weights

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            found = [model.predict(text.as_py()) for text in batch.column(2)]
            langs, values = pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], langs, values], [id_col, "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long"), held_out(F.col(id_col)), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"`{id_col.replace('`', '``')}` long, held_out boolean, lang_pred string, score double")
