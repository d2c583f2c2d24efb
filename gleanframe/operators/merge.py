"""Priority merge of extractor results and the page decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DONE, ESCALATE
from ..functions.text import quote
from ..options import Options
from ..schemas import FIELD, FIELDS
from .extractors import Extractor

_NO_FIELDS = f"CAST(array() AS array<struct<key:string,value:{FIELD}>>)"
_NO_TEXTS = "CAST(map() AS map<string,string>)"


def any_fields(results: list[str]) -> str:
    """Whether some extractor wrote a field; error flags do not matter here."""
    return " OR ".join(f"coalesce(size(`{r}`.entries) > 0, false)" for r in results)


def _is_valid(result: str, extractor: Extractor, options: Options) -> str:
    if extractor.confidence < options.min_confidence:
        return "false"
    return f"coalesce(NOT `{result}`.err AND size(`{result}`.entries) > 0, false)"


def merge_fields(results: dict[Extractor, str], options: Options) -> Column:
    """Field map in which the smallest priority number wins a key, from the result columns.

    One map is built from all entries, the weakest source first, so that later entries win.
    """

    def tagged(e: Extractor, result: str) -> str:
        field = (
            f"named_struct('value', x.value, 'source', {quote(e.name)}, "
            f"'confidence', {e.confidence!r}D, 'priority', {e.priority})"
        )
        entries = f"transform(`{result}`.entries, x -> named_struct('key', x.key, 'value', {field}))"
        return f"CASE WHEN {_is_valid(result, e, options)} THEN {entries} ELSE {_NO_FIELDS} END"

    weakest_first = sorted(results.items(), key=lambda r: -r[0].priority)
    merged = f"map_from_entries(concat({', '.join([_NO_FIELDS, *(tagged(e, r) for e, r in weakest_first)])}))"
    some = " OR ".join(["false", *(_is_valid(r, e, options) for e, r in results.items())])
    return F.expr(f"CASE WHEN {some} THEN {merged} ELSE CAST(map() AS {FIELDS}) END")


def has_script_data(results: dict[Extractor, str], options: Options) -> Column:
    """Whether a valid result came from script tags (priorities 1 to 4); it does not change the decision."""
    flags = [_is_valid(r, e, options) for e, r in results.items() if e.priority <= 4]
    return F.expr(" OR ".join(["false", *flags]))


def decide(is_hollow: Column, fields: Column, options: Options) -> Column:
    empty = F.size(fields) == 0
    escalate = empty if options.escalate_empty else is_hollow & empty
    return F.when(escalate, F.lit(ESCALATE)).otherwise(F.lit(DONE))


def candidate_rows(analysis: DataFrame, key: str, results: dict[Extractor, str]) -> DataFrame:
    """One row per page, source and field: (key, source, priority, confidence, err, field, value)."""
    sources = ", ".join(
        f"named_struct('source', {quote(e.name)}, 'priority', {e.priority}, 'confidence', {e.confidence!r}D, "
        f"'err', `{c}`.err, 'fields', coalesce(map_from_entries(`{c}`.entries), {_NO_TEXTS}))"
        for e, c in results.items()
    )
    by_source = analysis.select(key, F.explode(F.expr(f"array({sources})")).alias("r"))
    return explode_fields(by_source.select(key, "r.*"), "value")


def explode_fields(rows: DataFrame, *value_columns: str) -> DataFrame:
    """One row per entry of the map ``fields``: its key, and its value as one column or as those of a struct.

    Explodes the entries and not the column: of a bare column the optimizer pushes a size test down,
    which computes the whole map twice.
    """
    keep = [c for c in rows.columns if c != "fields"]
    value = "_f.value" if value_columns == ("value",) else "_f.value.*"
    return rows.select(*keep, F.explode(F.map_entries("fields")).alias("_f")).select(*keep, "_f.key", value)


def merge_candidates(candidates: DataFrame, page_key: str, options: Options | None = None) -> DataFrame:
    """The same merge on long rows: candidates from any table, one row per page and field out.

    An aggregate, not a window: partial results shrink a hot page before the shuffle.
    """
    options = options or Options()
    valid = candidates.filter(~F.col("err") & (F.col("confidence") >= options.min_confidence))
    best = F.min_by(F.struct("value", "source", "confidence", "priority"), F.struct("priority", "source", "value"))
    return valid.groupBy(page_key, "key").agg(best.alias("best")).select(page_key, "key", "best.*")
