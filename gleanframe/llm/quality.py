"""Quality rules: text statistics, and robust multivariate outliers per language and source.

Every document gets counts from its whole text. Documents that pass the base rules are judged by a
minimum-covariance-determinant estimate: per group, centre and scatter of the share of rows that lie
together most tightly, found by concentration steps from a start at medians; the Mahalanobis distance
of the transformed statistics, scaled so that its median is that of the chi-square law, must stay
within a cutoff. Scatter has a floor, as clean groups often have no variance in a statistic.

Of several starts the one that leads to the smallest determinant counts. A group is a language and source
with `min_rows` documents; smaller ones form one group per language, and what is still too small one group
of all. That one's estimate is drawn towards the corpus (PRIOR_ROWS), so every document is judged.
NULL language or source is a value of its own. NULL and texts without words fail the base rules.
Ids may be NULL or repeated: each row is judged. Extra columns are ignored by `judged`, kept by `clean`.

Everything is built-in functions. Estimates travel as one row per group, and rows of hot groups are
joined where they lie.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, fresh, join_hot, once, saved, words

SYMBOLS = "#*$%&|<>"
#: Share of a group's rows in the tight subset.
SUBSET = 0.75
#: Concentration steps; the determinant falls at each and settles within a few.
STEPS = 3
MIN_ROWS = 200
#: Name of the group of all that is small, and how many rows the corpus counts for in its estimate.
REST = "all"
PRIOR_ROWS = 50
#: Variance of clean texts at large, in squared floors; stands in for the corpus where no group is large.
WIDE = 9.0
_APART = "\x02"
#: Median of the chi-square law with as many degrees of freedom as there are statistics.
CHI2_MEDIAN = 4.351
#: Largest scaled squared distance that passes: far beyond chi-square's 1 - 1e-9 quantile, as statistics of
#: clean texts have heavier tails than the normal law.
CUTOFF = 60.0
#: Smallest standard deviation of each transformed statistic: what clean texts vary by, such as a line or two said twice.
FLOORS = (0.05, 0.03, 0.3, 0.3, 0.04)
#: Added to the shares of repeated lines and of repeated words, and to their rests, before the logit is taken.
#: Next to a group without repeats and with the floor as scatter, either share alone passes the cutoff: lines
#: from 0.6 on (squared distance 172 at 0.98), words from 0.35 on (142 at 0.5).
SMOOTH = (0.15, 0.2)
#: Largest share of repeated words that the base rules let pass.
MAX_REPEATED = 0.5
_P = len(FLOORS)
_X = [f"x{j}" for j in range(_P)]
_PAIRS = [(j, k) for j in range(_P) for k in range(j + 1)]


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs (with no column of these names) plus n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_marks, n_upper."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    df = once(docs.withColumn("_t", whole), _w=words(whole), _lines=lines)
    n = F.size("_w")
    triples = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))),
            lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)),
        )
    )
    # Windows in order of (hash, place): equal ones stand next to each other.
    df = once(df, _sorted=F.sort_array(F.transform(triples, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    again = F.filter(
        "_sorted",
        lambda x, j: (F.get("_sorted", j - 1)["h"].eqNullSafe(x["h"])) | (F.get("_sorted", j + 1)["h"].eqNullSafe(x["h"])),
    )
    df = once(df, _places=F.sort_array(F.transform(again, lambda x: x["i"])))
    # Each place covers three words, less what the next one covers too.
    covered = F.aggregate(
        F.transform("_places", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_places", k + 1) - p, F.lit(3)))),
        F.lit(0),
        lambda a, b: a + b,
    )
    solid = F.regexp_replace("_t", SPACES, "")
    count = lambda c: c.cast("long")
    df = once(
        df,
        n_words=count(n),
        word_chars=count(F.length(solid)),
        n_symbols=count(F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))),
        n_lines=count(F.size("_lines")),
        n_dup_lines=count(F.size("_lines") - F.size(F.array_distinct("_lines"))),
        n_repeat_words=count(covered),
        n_marks=count(F.length(F.regexp_replace("_t", r"[^!?:;=_~^@\\/+]", ""))),
        n_upper=count(F.length(F.regexp_replace("_t", r"[^A-Z]", ""))),
    )
    return df.drop("_t", "_w", "_lines", "_sorted", "_places")


def transformed() -> list[Column]:
    """Statistics on scales where clean texts lie in one round cloud."""
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))

    def logit(a: str, b: str, smooth: float, most: float = 1.0) -> Column:
        part = F.least(F.col(a) / F.greatest(F.col(b), F.lit(1)) / most, F.lit(1.0))
        return F.log((part + smooth) / (1 - part + smooth))

    return [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
        share("n_symbols", "word_chars"),
        logit("n_dup_lines", "n_lines", SMOOTH[0]),
        logit("n_repeat_words", "n_words", SMOOTH[1], MAX_REPEATED),
        F.sqrt((F.col("n_marks") + F.greatest(F.col("n_upper") - 2 * F.col("n_lines"), F.lit(0)) / 4) / F.greatest(F.col("word_chars"), F.lit(1))),
    ]


def _grouped(rows: DataFrame, min_rows: int) -> DataFrame:
    """rows with _group: the cell, the language's small cells together, or all that is still small."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    rows = rows.withColumn("_cell", F.concat_ws("\x01", part("_lang"), part("_source")))
    cells = rows.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"), F.first("_lang").alias("_l"))
    cells = cells.withColumn("_small", F.col("_n") < min_rows).withColumn("_l", F.coalesce(F.concat(F.lit("="), "_l"), F.lit("-")))
    pools = cells.filter("_small").groupBy("_l").agg(F.sum("_n").alias("_pool"))
    cells = cells.join(pools, "_l", "left")
    group = (
        F.when(~F.col("_small"), F.concat(F.lit("cell "), "_cell"))
        .when(F.col("_pool") >= min_rows, F.concat(F.lit("lang "), "_l"))
        .otherwise(F.lit(REST))
    )
    return join_hot(rows, saved(cells.select("_cell", "_n", group.alias("_group"))), "_cell", "_n").drop("_n", "_cell")


def _cholesky(moments: DataFrame) -> DataFrame:
    """Means m_j and sums s_jk of products to means and the lower factor l_jk of the scatter with its floor."""
    df = moments
    for j in range(_P):
        for k in range(j + 1):
            cov = F.col(f"s{j}{k}") / F.col("_n") - F.col(f"m{j}") * F.col(f"m{k}")
            if j == k:
                cov = F.greatest(cov, F.lit(0.0)) + FLOORS[j] ** 2
            for i in range(k):
                cov = cov - F.col(f"l{j}{i}") * F.col(f"l{k}{i}")
            # The floor keeps the pivots away from 0, also after rounding.
            value = F.sqrt(F.greatest(cov, F.lit(FLOORS[j] ** 2 / 4))) if j == k else cov / F.col(f"l{k}{k}")
            df = df.withColumn(f"l{j}{k}", value)
    return df.select("_group", "_n", *[f"m{j}" for j in range(_P)], *[f"l{j}{k}" for j in range(_P) for k in range(j + 1)])


def _whitened() -> list[Column]:
    """Forward substitution through the factor: y0, then y1 from y0, and so on."""
    y: list[Column] = []
    for j in range(_P):
        rest = F.col(_X[j]) - F.col(f"m{j}")
        for k in range(j):
            rest = rest - F.col(f"l{j}{k}") * F.col(f"y{k}")
        y.append(rest / F.col(f"l{j}{j}"))
    return y


def _distances(rows: DataFrame, estimate: DataFrame, *more: str) -> DataFrame:
    """rows with _d2, and more columns of the estimate."""
    df = join_hot(rows, estimate, "_group", "_n")
    for j, y in enumerate(_whitened()):
        df = df.withColumn(f"y{j}", y)
    total = sum((F.col(f"y{j}") * F.col(f"y{j}") for j in range(1, _P)), F.col("y0") * F.col("y0"))
    return df.select(*rows.columns, *more, total.alias("_d2"))


def _concentrated(rows: DataFrame, estimate: DataFrame, steps: int, subset: float) -> DataFrame:
    """Moments per _group of the rows nearest to the estimate, each step by the scatter of the one before."""
    for step in range(1, steps + 1):
        far = _distances(rows, estimate)
        radius = far.groupBy("_group").agg(F.percentile_approx("_d2", subset, 1000).alias("_r"), F.count(F.lit(1)).alias("_all"))
        tight = join_hot(far, saved(radius), "_group", "_all").filter("_d2 <= _r")
        moments = tight.groupBy("_group").agg(
            F.count(F.lit(1)).alias("_n"),
            *[F.avg(x).alias(f"m{j}") for j, x in enumerate(_X)],
            *[F.sum(F.col(_X[j]) * F.col(_X[k])).alias(f"s{j}{k}") for j, k in _PAIRS],
        )
        if step < steps:
            estimate = saved(_cholesky(moments))
    return saved(moments)


def starts(rows: DataFrame) -> DataFrame:
    """Per _group and _start an estimate: medians, and scatter by absolute deviations, by tanh scores, by spatial signs.

    Far rows have little or no weight in either, so some start lies within the bulk of the rows.
    """
    middle = lambda c: F.percentile_approx(c, 0.5, 1000)
    centre = saved(rows.groupBy("_group").agg(F.count(F.lit(1)).alias("_n"), *[middle(x).alias(f"m{j}") for j, x in enumerate(_X)]))
    same = [F.first("_n").alias("_n"), *[F.first(f"m{j}").alias(f"m{j}") for j in range(_P)]]
    width = [(middle(F.abs(F.col(x) - F.col(f"m{j}"))) * 1.4826 + FLOORS[j]).alias(f"a{j}") for j, x in enumerate(_X)]
    near = saved(join_hot(rows, centre, "_group", "_n").groupBy("_group").agg(*same, *width))
    scaled = join_hot(rows, near, "_group", "_n").select(
        "_group", "_n", *[f"m{j}" for j in range(_P)], *[f"a{j}" for j in range(_P)],
        *[((F.col(x) - F.col(f"m{j}")) / F.col(f"a{j}")).alias(f"z{j}") for j, x in enumerate(_X)],
    )
    z = [F.col(f"z{j}") for j in range(_P)]
    norm = F.sqrt(sum((c * c for c in z[1:]), z[0] * z[0]) + 1e-12)
    scaled = scaled.withColumn("z", norm)
    kept = [F.first(f"a{j}").alias(f"a{j}") for j in range(_P)]
    sums = saved(
        scaled.groupBy("_group").agg(
            *same, *kept,
            *[F.avg(F.tanh(z[j]) * F.tanh(z[k])).alias(f"t{j}{k}") for j, k in _PAIRS],
            *[F.avg(z[j] * z[k] / (F.col("z") * F.col("z"))).alias(f"u{j}{k}") for j, k in _PAIRS],
        )
    )

    def start(number: int, scatter: dict[tuple[int, int], Column]) -> DataFrame:
        products = [((scatter[j, k] * F.col(f"a{j}") * F.col(f"a{k}") + F.col(f"m{j}") * F.col(f"m{k}")) * F.col("_n")).alias(f"s{j}{k}") for j, k in _PAIRS]
        moments = sums.select("_group", "_n", *[f"m{j}" for j in range(_P)], *products)
        return _cholesky(moments).withColumn("_start", F.lit(number))

    found = start(0, {(j, k): F.lit(1.0 if j == k else 0.0) for j, k in _PAIRS})
    found = found.unionByName(start(1, {(j, k): F.col(f"t{j}{k}") * 2 for j, k in _PAIRS}))
    return found.unionByName(start(2, {(j, k): F.col(f"u{j}{k}") * _P for j, k in _PAIRS}))


def estimates(rows: DataFrame, subset: float = SUBSET, steps: int = STEPS) -> DataFrame:
    """Per _group: centre, scatter factor, and _scale, the median squared distance or that of the chi-square law if it is smaller.

    rows is a written table.

    Every start takes two concentration steps; the one with the smallest determinant takes ``steps`` more.
    """
    first = starts(rows).withColumn("_group", F.concat_ws(_APART, "_group", "_start")).drop("_start")
    number = F.explode(F.array(*[F.lit(n) for n in range(3)]))
    copies = rows.select("_group", *_X, number.alias("_start"))
    copies = copies.select(F.concat_ws(_APART, "_group", "_start").alias("_group"), *_X)
    tried = _cholesky(_concentrated(copies, saved(first), 2, subset))
    names = [c for c in tried.columns if c not in ("_group", "_n")]
    size = sum((F.log(F.col(f"l{j}{j}")) for j in range(1, _P)), F.log(F.col("l00")))
    tried = tried.select(F.substring_index("_group", _APART, 1).alias("_group"), F.substring_index("_group", _APART, -1).alias("_start"), "_n", size.alias("_size"), *names)
    best = tried.groupBy("_group").agg(F.min_by(F.struct("_n", *names), F.struct("_size", "_start")).alias("b")).select("_group", "b.*")
    moments = _blended(_concentrated(rows, saved(best), steps, subset))
    estimate = saved(_cholesky(moments))
    scale = _distances(rows, estimate).groupBy("_group").agg(F.percentile_approx("_d2", 0.5, 1000).alias("_scale"), F.count(F.lit(1)).alias("_rows"))
    scale = saved(scale.withColumn("_scale", F.greatest("_scale", F.lit(CHI2_MEDIAN))))
    # The small group's scale is drawn towards the others' in the same way, as most of its rows may lie far off.
    usual = scale.filter(F.col("_group") != REST).agg(F.avg(F.log("_scale"))).first()[0] or math.log(CHI2_MEDIAN)  # one number
    drawn = F.exp((F.col("_rows") * F.log("_scale") + PRIOR_ROWS * usual) / (F.col("_rows") + PRIOR_ROWS))
    scale = scale.select("_group", F.when(F.col("_group") == REST, drawn).otherwise(F.col("_scale")).alias("_scale"))
    return saved(estimate.join(scale, "_group"))


def _blended(moments: DataFrame) -> DataFrame:
    """Moments where the group of all that is small is drawn towards the corpus by PRIOR_ROWS rows.

    The corpus is all other groups together; without any, the scatter of clean texts at large stands in.
    """
    names = [f"m{j}" for j in range(_P)]
    totals = [F.sum(F.col("_n") * F.col(m)).alias(m) for m in names] + [F.sum(f"s{j}{k}").alias(f"s{j}{k}") for j, k in _PAIRS]
    corpus = moments.filter(F.col("_group") != REST).agg(F.sum("_n").alias("_n"), *totals).first()  # one row
    n, k = F.col("_n"), F.lit(float(PRIOR_ROWS))
    if corpus["_n"]:
        centre = [F.lit(corpus[m] / corpus["_n"]) for m in names]
        spread = {(i, j): F.lit(corpus[f"s{i}{j}"] / corpus["_n"]) - centre[i] * centre[j] for i, j in _PAIRS}
    else:
        centre = [F.col(m) for m in names]
        spread = {(i, j): F.lit(WIDE * FLOORS[i] ** 2 if i == j else 0.0) for i, j in _PAIRS}
    mean = [(n * F.col(m) + k * c) / (n + k) for m, c in zip(names, centre, strict=True)]
    products = [
        ((n * (F.col(f"s{i}{j}") / n - F.col(f"m{i}") * F.col(f"m{j}")) + k * spread[i, j]) + (n + k) * mean[i] * mean[j]).alias(f"s{i}{j}")
        for i, j in _PAIRS
    ]
    rest = moments.filter(F.col("_group") == REST)
    rest = rest.select("_group", (n + k).alias("_n"), *[c.alias(m) for c, m in zip(mean, names, strict=True)], *products)
    return moments.filter(F.col("_group") != REST).withColumn("_n", n.cast("double")).unionByName(rest)


def judged(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    min_rows: int = MIN_ROWS, cutoff: float = CUTOFF,
) -> DataFrame:
    """Per row: id, the counts, base_failed, kept, and distance (scaled and squared, NULL where base rules failed)."""
    rows = docs.select(
        F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang"),
        F.col(source_col).cast("string").alias("_source"), F.xxhash64(F.col(text_col)).alias("_sign"),
    )
    rows = statistics(rows, "_text").drop("_text")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = saved(rows.withColumn("base_failed", failed).select("*", *[x.alias(n) for n, x in zip(_X, transformed(), strict=True)]))
    passing = saved(_grouped(rows.filter("NOT base_failed"), min_rows))
    df = _distances(passing, estimates(passing), "_scale")
    distance = F.col("_d2") * CHI2_MEDIAN / F.col("_scale")
    columns = [
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
    ]
    measured = df.withColumn("distance", distance).select(*columns, (F.col("distance") <= cutoff).alias("kept"), "distance", "_sign")
    out = rows.filter("base_failed").select(*columns, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance"), "_sign")
    return measured.unionByName(out)


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    key, sign, own = fresh(docs, "_id", "_sign", "_sign_of_row")
    rejected = judged(docs, id_col, text_col, **options).filter("NOT kept").select(F.col(id_col).alias(key), F.col("_sign").alias(sign)).distinct()
    rows = docs.withColumn(own, F.xxhash64(F.col(text_col)))
    same = F.col(id_col).eqNullSafe(F.col(key)) & (F.col(own) == F.col(sign))
    return rows.join(rejected, same, "left_anti").drop(own)
