"""Secrets: base patterns, and candidates judged by who owns them across the corpus.

Candidates are the values of base spans and free tokens: runs of 20 and more characters that mix cases
and digits. A value is known by its hash; the corpus says in how many sources (its owners) and in how
many distinct texts (its repositories) it stands. One that few owners have looks live; one that many
have is a copied example. Free tokens outside the base spans become spans (kind token) if they look
live; base spans stay whatever their count, and n_live and n_copied say how the document's candidates
were judged.

Places come from the pieces between the matches: their lengths add up. Everything is built-in
functions; the counts combine on the map side, hot values are joined where they lie, and texts are never
shuffled. NULL counts as the empty text, a NULL source as an owner of its own; ids may be NULL or
repeated, each row is scanned. Other columns are not passed on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, once, saved

#: Base patterns. Java's (?i) changes ASCII letters only.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: Runs are maximal, so a run of 24 is what is left of all runs.
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
#: A value that at most this many owners and texts hold is theirs; beyond either it is a copied example.
MOST_OWNERS = 2
MOST_TEXTS = 20

_NONE = "array<struct<start: int, end: int, value: string>>"


def _running(values: Column, step: Callable[[Column, Column], Column], first: int) -> Column:
    """Running results of a short array of whole numbers; the work grows with the square of its length."""
    acc = F.aggregate(
        values,
        F.struct(F.lit(first).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, x: F.struct(step(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(step(acc["at"], x))).alias("out")),
    )
    return acc["out"]


def with_running(df: DataFrame, step: Callable[[Column, Column], Column], first: int, *names: str) -> DataFrame:
    """df with each array of whole numbers replaced by its running results (sums, largest values).

    Arrays are cut into blocks of about the square root of their length, so that no long list is
    copied for each of its members; a block then starts from the result of those before it.
    """

    def blocks(name: str) -> Column:
        long = F.greatest(F.ceil(F.sqrt(F.size(name))), F.lit(1)).cast("int")
        count = F.ceil(F.size(name) / long).cast("int")
        numbers = F.when(count > 0, F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        return F.transform(numbers, lambda b: _running(F.slice(name, b * long + 1, long), step, first))

    df = once(df, **{n: blocks(n) for n in names})
    df = once(df, **{f"_{n}": _running(F.transform(n, lambda b: F.element_at(b, -1)), step, first) for n in names})

    def joined(n: str) -> Column:
        before = lambda i: F.coalesce(F.get(f"_{n}", i - 1), F.lit(first))
        return F.flatten(F.transform(n, lambda block, i: F.transform(block, lambda x: step(before(i), x))))

    return once(df, **{n: joined(n) for n in names}).drop(*[f"_{n}" for n in names])


def with_spans(df: DataFrame, text: str, **patterns: tuple[str, int]) -> DataFrame:
    """df with, per pattern, all leftmost non-overlapping matches as (start, end, value of the group); code points, end exclusive.

    A match ends where the lengths of the pieces between matches and of the matches add up to.
    """
    found = {}
    for name, (pattern, group) in patterns.items():
        there = F.col(text).rlike(pattern)
        found[f"{name}_value"] = F.when(there, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))
        found[f"{name}_long"] = F.when(there, F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.length(m)))
        found[f"{name}_gap"] = F.when(there, F.transform(F.split(text, pattern, -1), lambda p: F.length(p)))
    df = once(df, **found)

    def steps(n: str) -> Column:  # the piece before a match, and the match; one more piece follows the last match
        return F.coalesce(F.transform(f"{n}_long", lambda m, i: m + F.get(f"{n}_gap", i)), F.array().cast("array<int>"))

    def spans(n: str) -> Column:
        end = lambda i: F.get(f"{n}_end", i)
        named = lambda v, i: F.struct((end(i) - F.get(f"{n}_long", i)).alias("start"), end(i).alias("end"), v.alias("value"))
        return F.coalesce(F.transform(f"{n}_value", named), F.array().cast(_NONE))

    df = with_running(once(df, **{f"{n}_end": steps(n) for n in patterns}), lambda a, x: a + x, 0, *[f"{n}_end" for n in patterns])
    return once(df, **{n: spans(n) for n in patterns}).drop(*[f"{n}_{x}" for n in patterns for x in ("value", "long", "gap", "end")])


def _scanned(docs: DataFrame, id_col: str, text_col: str, owner_col: str) -> DataFrame:
    """Per row: row, doc_id, owner, sign (hash of the text), and the spans of each kind."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(owner_col).cast("string").alias("owner"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    rows = with_spans(rows.withColumn("sign", F.xxhash64("text")), "text", assign=(ASSIGN, 1), access=(ACCESS, 0), hex=(HEX, 0), free=(TOKEN, 0))
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]")
    return rows.select(
        "row", "doc_id", "owner", "sign",
        F.filter("assign", lambda s: F.length(s["value"]) >= 6).alias("assign"),
        F.filter("access", lambda s: F.length(s["value"]) >= 20).alias("access"),
        "hex",
        F.filter("free", lambda s: mixed(s["value"])).alias("free"),
    )


def with_outside(rows: DataFrame) -> DataFrame:
    """rows with more: the free tokens that meet no base span.

    By start, base spans first, a token meets one if an earlier base span reaches beyond its start, or if
    the next span starts before its end; free tokens do not overlap, so that one is a base span.
    """
    rows = once(rows, _all=F.array_sort(F.concat("base", "free")))
    rows = once(rows, _reach=F.transform("_all", lambda s: F.when(s["place"] < 3, s["end"]).otherwise(F.lit(0))))
    rows = with_running(rows, lambda a, x: F.greatest(a, x), 0, "_reach")
    apart = lambda s, i: (
        (s["place"] == 3) & (F.get("_reach", i) <= s["start"]) & (F.coalesce(F.get("_all", i + 1)["start"], s["end"]) >= s["end"])
    )
    return once(rows, more=F.filter("_all", apart)).drop("_all", "_reach")


def _kinds() -> list[Column]:
    def named(kind: str, order: int, column: str) -> Column:
        return F.transform(
            column,
            lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("place"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value")),
        )

    return [named("assign", 0, "assign"), named("access", 1, "access"), named("hex", 2, "hex"), named("token", 3, "free")]


def _written(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def find(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
    most_owners: int = MOST_OWNERS, most_texts: int = MOST_TEXTS,
) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied."""
    rows = saved(_scanned(docs, id_col, text_col, owner_col))
    kinds = _kinds()
    rows = saved(with_outside(once(rows, base=F.concat(*kinds[:3]), free=kinds[3])))
    # Values stand for a document once; all that travels is hashes, and the places of the free tokens.
    values = F.array_distinct(F.transform(F.concat("base", "more"), lambda s: F.xxhash64(s["value"])))
    held = rows.select("row", "owner", "sign", F.explode(values).alias("value"))
    owners = held.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("n"))
    owners = owners.groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("copies"))
    # Distinct texts matter only for values that few owners hold.
    texts = held.groupBy("value", "sign").agg(F.lit(1).alias("_")).groupBy("value").agg(F.count(F.lit(1)).alias("texts"))
    known = saved(owners.join(texts, "value"))
    live = (F.col("owners") <= most_owners) & (F.col("texts") <= most_texts)
    judged = join_hot(held.select("row", "value"), known.select("value", "copies", live.alias("live")), "value", "copies")
    judged = judged.groupBy("row").agg(
        F.collect_set(F.when(F.col("live"), F.col("value"))).alias("live"), F.sum(F.when(~F.col("live"), 1).otherwise(0)).alias("copied")
    )
    out = rows.join(judged, "row", "left")
    out = once(out, live=F.array_sort(F.coalesce("live", F.array().cast("array<bigint>"))))
    # Live values and free tokens in one order: a token that follows its live value, or another such token, is live.
    marks = F.transform("live", lambda v: F.struct(v.alias("hash"), F.lit(-1).alias("at")))
    tokens = F.transform("more", lambda s, i: F.struct(F.xxhash64(s["value"]).alias("hash"), i.alias("at")))
    out = once(out, _order=F.array_sort(F.concat(marks, tokens)))
    out = once(out, _mark=F.transform("_order", lambda x, i: F.when(x["at"] < 0, i + 1).otherwise(F.lit(0))))
    out = with_running(out, lambda a, x: F.greatest(a, x), 0, "_mark")
    held_live = lambda x, i: (x["at"] >= 0) & F.get("_order", F.get("_mark", i) - 1)["hash"].eqNullSafe(x["hash"])
    added = F.transform(F.filter("_order", held_live), lambda x: F.get("more", x["at"]))
    return out.select(
        F.col("doc_id").alias(id_col),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.concat("base", added)).alias("spans"),
        F.size("live").cast("long").alias("n_live"),
        F.coalesce("copied", F.lit(0)).cast("long").alias("n_copied"),
    )
