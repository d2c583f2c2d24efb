"""Text fallback: readable text, prompts out, completions in, merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DONE, ESCALATE, PROMPT
from ..functions.joins import attach
from ..functions.json import as_object, strict_json
from ..functions.text import cut_utf8, let, trim_space
from ..options import Options
from ..schemas import FIELDS

SOURCE, PRIORITY = "llm", 11
# A block is article text when it is long enough and not mostly links.
_MIN_BLOCK_CHARS = 25
_MAX_LINK_SHARE = 0.5


def clean_text(blocks: str, max_bytes: int) -> Column:
    """Readable text of a page's text blocks, trimmed and cut to a number of bytes; '' when there is none.

    Keeps headings and blocks of sufficient length and low link share outside boilerplate. A page
    without such a block gives all its text outside boilerplate.
    """

    def joined(bs: str) -> str:
        return trim_space(f"array_join(transform({bs}, b -> b.text), '\\n')")

    length = "char_length(b.text)"
    article = f"rlike(b.tag, '^h[1-6]$') OR ({length} >= {_MIN_BLOCK_CHARS} AND b.link_chars < {length} * {_MAX_LINK_SHARE}D)"
    own = f"filter({blocks}, b -> NOT b.boilerplate)"
    chosen = let(
        own,
        "bs",
        let(f"filter(bs, b -> {article})", "kept", f"CASE WHEN size(kept) > 0 THEN {joined('kept')} ELSE {joined('bs')} END"),
    )
    return F.expr(let(f"coalesce({chosen}, '')", "t", cut_utf8("t", max_bytes)))


def is_eligible(decision: Column, fields: Column, page_type: Column) -> Column:
    """Escalated without a field. Gated, walled and unparseable pages have no page type and never get here."""
    return (decision == ESCALATE) & (F.size(fields) == 0) & (page_type != "")


def prompt_text(text: Column) -> Column:
    head, tail = PROMPT.split("%s")
    return F.concat(F.lit(head), text, F.lit(tail))


def strip_fence(completion: str) -> str:
    """Trimmed completion without its Markdown fence: first and last line, if there are three or more."""
    inner = "array_join(slice(lines, 2, size(lines) - 2), '\\n')"
    body = f"CASE WHEN startswith(r, '```') AND size(lines) >= 3 THEN {inner} ELSE r END"
    return let(trim_space(completion), "r", let("split(r, '\\n')", "lines", body))


def completion_result(completion: str, error: str) -> Column:
    """struct<fields map<string,string>, err>: a strict string-to-string object; blank values are dropped."""
    values = "transform_values(m, (k, x) -> named_struct('text', try_cast(x AS string), 'json', to_json(x)))"
    ok = "is_variant_null(v) OR forall(map_values(vs), x -> startswith(x.json, '\"') OR x.json = 'null')"
    kept = f"map_filter(vs, (k, x) -> coalesce({trim_space('x.text')} <> '', false))"
    fields = f"CASE WHEN ok THEN transform_values({kept}, (k, x) -> x.text) END"
    result = f"named_struct('fields', {fields}, 'err', NOT coalesce(ok, false))"
    parsed = let(strict_json("c"), "v", let(as_object("v"), "m", let(values, "vs", let(ok, "ok", result))))
    usable = f"CASE WHEN {error} IS NULL THEN {strip_fence(completion)} END"
    fields = "coalesce(o.fields, CAST(map() AS map<string,string>))"
    return F.expr(let(let(usable, "c", parsed), "o", f"named_struct('fields', {fields}, 'err', coalesce(o.err, true))"))


def fallback_fields(fields: Column, options: Options) -> Column:
    return F.transform_values(
        fields,
        lambda k, v: F.struct(
            v.alias("value"),
            F.lit(SOURCE).alias("source"),
            F.lit(float(options.fallback_confidence)).alias("confidence"),
            F.lit(PRIORITY).alias("priority"),
        ),
    ).cast(FIELDS)


def apply_completions(
    analysis: DataFrame, completions: DataFrame, options: Options | None = None, key: str = "page_id", salts: int = 1
) -> DataFrame:
    """Replaces the fields of eligible rows by those of their completion and sets them Done.

    The minimum confidence does not apply here. Several completions of a page count as one: of those
    without an error, else of all, the smallest by text, so that the result is the same on every run. For ``salts`` see ``attach``.
    """
    options = options or Options()
    if not options.fallback_enabled:
        return analysis
    one = completions.groupBy(key).agg(F.min(F.struct(F.col("error").isNotNull().alias("failed"), "completion", "error")).alias("c"))
    parsed = one.select(key, completion_result("c.completion", "c.error").alias("_result"))
    eligible = is_eligible(F.col("decision"), F.col("fields"), F.col("page_type"))
    joined = attach(analysis, parsed, key, eligible, salts)
    found = F.coalesce(F.size(F.col("_result.fields")) > 0, F.lit(False))
    return joined.withColumns(
        {
            "fields": F.when(found, fallback_fields(F.col("_result.fields"), options)).otherwise(F.col("fields")),
            "decision": F.when(found, F.lit(DONE)).otherwise(F.col("decision")),
        }
    ).drop("_result")
