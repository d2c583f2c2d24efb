"""Extractors, JSON flattening, key rules and error flags, on pages with known answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalise_key
from ..operators.merge import explode_fields
from ..options import CustomExtractor, Options
from ..plans.analyze import analyze, candidates, extract_pages
from .inputs import Col, as_pages, choose, page, prose, table, text, variant
from .registry import query

KEY = Col("p_partkey")
NAME, BRAND, KIND, SIZE, PRICE = (Col(c) for c in ("p_name", "p_brand", "p_type", "p_size", "p_retailprice"))
_PRICE_SQL = "regexp_replace(CAST(p_retailprice AS VARCHAR), '\\.0$', '')"


def _parts(spark: SparkSession, folder: str, html: Column) -> DataFrame:
    return as_pages(table(spark, folder, "part"), "p_partkey", html)


def _of_source(responses: DataFrame, source: str, options: Options | None = None) -> DataFrame:
    rows = candidates(responses, options).filter(F.col("source") == source)
    return rows.select("page_id", "key", "value")


def _rows_sql(table_name: str, key: str, fields: dict[str, str], where: str = "true") -> str:
    """Long rows of (page_id, key, value); a NULL value is no row."""
    selects = [f"SELECT {key} AS page_id, '{k}' AS key, {v} AS value FROM {table_name} WHERE {where}" for k, v in fields.items()]
    return f"SELECT * FROM ({' UNION ALL '.join(selects)}) WHERE value IS NOT NULL"


def _ld(*parts: Column | str) -> Column:
    return text('<script type="application/ld+json">', *parts, "</script>")


def _product_json() -> Column:
    return text(
        '{"@type":"Product","name":"', NAME, '","brand":"', BRAND, '","size":', SIZE, ',"price":', PRICE, ',"offer":{"z":', SIZE,
        ',"price":', PRICE, ',"tag":"<b>&"},"gone":null,"blank":"","stock":true,"far":1e30,"near":1.5e-7,"mid":2.5E3,"list":[1,"a"]}',
    )


_PRODUCT_SQL = {
    "@type": "'Product'",
    "name": "p_name",
    "brand": "p_brand",
    "size": "CAST(p_size AS VARCHAR)",
    "price": _PRICE_SQL,
    "offer": f"'{{\"price\":' || {_PRICE_SQL} || ',\"tag\":\"\\u003cb\\u003e\\u0026\",\"z\":' || p_size || '}}'",
    "gone": "'null'",
    "stock": "'true'",
    "far": "'1e+30'",
    "near": "'1.5e-7'",
    "mid": "'2500'",
    "list": "'[1,\"a\"]'",
}


@query("e1_json_ld", _rows_sql("part", "p_partkey", _PRODUCT_SQL))
def e1_json_ld(spark: SparkSession, folder: str) -> DataFrame:
    return _of_source(_parts(spark, folder, page(text(_ld(_product_json()), prose()))), "json-ld")


def _cut_zeros(x: str) -> str:
    return f"rtrim(rtrim({x}, '0'), '.')"


@query(
    "x1_legacy_numbers",
    _rows_sql(
        "part",
        "p_partkey",
        _PRODUCT_SQL
        | {
            "size": _cut_zeros("CAST(p_size AS VARCHAR)"),
            "price": _cut_zeros(_PRICE_SQL),
            "far": "'1e+3'",
            "mid": "'25'",
        },
    ),
)
def x1_legacy_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """The option that cuts trailing zeros of whole numbers too."""
    html = page(text(_ld(_product_json()), prose()))
    return _of_source(_parts(spark, folder, html), "json-ld", Options(legacy_numbers=True))


@query(
    "x1_nested_json",
    _rows_sql(
        "part",
        "p_partkey",
        {"spec": f"""'{{"far":1e+30,"mid":2500,"near":1e-7,"note":"1E2 \\u003cb\\u003e","price":[' || {_PRICE_SQL} || ',100],"size":' || p_size || '}}'"""},
    ),
)
def x1_nested_json(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers inside nested JSON have one spelling; text that looks like a number stays as it is."""
    spec = _ld('{"spec":{"size":', SIZE, '.0,"price":[', PRICE, ',1E2],"far":1e30,"near":1e-7,"mid":2.5E3,"note":"1E2 <b>"}}')
    return _of_source(_parts(spark, folder, page(text(spec, prose()))), "json-ld")


def _json_blocks() -> Column:
    """Array / two blocks / a broken second block / text after the value / single quotes / null and duplicate keys."""
    one = text('{"name":"', NAME, '","size":', SIZE, "}")
    return choose(
        variant("p_partkey", 6),
        _ld("[", one, ',null,{"name":"second"}]'),
        text(_ld(one), _ld('{"name":"', BRAND, '"}')),
        text(_ld(one), _ld('{"name":')),
        _ld(one, " trailing"),
        _ld("{'name':'", NAME, "'}"),
        text(_ld("null"), _ld("  "), _ld('{"name":"first","name":"', BRAND, '"}')),
    )


@query(
    "x4_error_flag",
    """SELECT p_partkey AS page_id, p_partkey % 6 IN (2, 3, 4) AS err,
              CASE p_partkey % 6 WHEN 3 THEN 0 WHEN 4 THEN 0 WHEN 5 THEN 1 ELSE 2 END AS n_entries_kept FROM part""",
)
def x4_error_flag(spark: SparkSession, folder: str) -> DataFrame:
    """A bad block sets the flag, and the fields of the good blocks stay."""
    extracted = extract_pages(_parts(spark, folder, page(text(_json_blocks(), prose()))))
    kept = F.size(F.map_from_entries("x_json-ld.entries"))
    return extracted.select("page_id", F.col("x_json-ld.err").alias("err"), kept.alias("n_entries_kept"))


@query(
    "m4_validity_filter",
    """SELECT p_partkey AS page_id, 'name' AS key, CASE p_partkey % 6 WHEN 0 THEN 'second' ELSE p_brand END AS value,
              'json-ld' AS source FROM part WHERE p_partkey % 6 IN (0, 1, 5)
       UNION ALL SELECT p_partkey, 'size', CAST(p_size AS VARCHAR), 'json-ld' FROM part WHERE p_partkey % 6 IN (0, 1)
       UNION ALL SELECT p_partkey, 'title', 'Part ' || p_partkey, 'meta-tags' FROM part""",
)
def m4_validity_filter(spark: SparkSession, folder: str) -> DataFrame:
    html = page(text(_json_blocks(), prose()), text("<title>Part ", KEY, "</title>"))
    rows = explode_fields(analyze(_parts(spark, folder, html)).select("page_id", "fields"), "*")
    return rows.select("page_id", "key", "value", "source")


@query(
    "x3_last_and_first_write",
    """SELECT p_partkey AS page_id, 'json-ld' AS source, 'name' AS key, p_brand AS value FROM part
       UNION ALL SELECT p_partkey, 'hidden-inputs', 'name', p_name FROM part""",
)
def x3_last_and_first_write(spark: SparkSession, folder: str) -> DataFrame:
    """The same two values twice: the last one wins in JSON-LD, the first one in hidden inputs."""
    blocks = text(_ld('{"name":"', NAME, '"}'), _ld('{"name":"', BRAND, '"}'))
    inputs = text('<input type="hidden" name="Name" value="', NAME, '"><input type="hidden" name="name" value="', BRAND, '">')
    rows = candidates(_parts(spark, folder, page(text(blocks, inputs, prose()))))
    return rows.select("page_id", "source", "key", "value")


@query(
    "x2_normalise_key",
    "SELECT DISTINCT p_type || '-' || p_name AS name, replace(replace(lower(p_type || '-' || p_name), '-', '_'), ' ', '_') AS key FROM part",
)
def x2_normalise_key(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "part").select(text(KIND, "-", NAME).alias("name")).distinct()
    return names.select("name", F.expr(normalise_key("name")).alias("key"))


@query(
    "e2_next_data",
    _rows_sql(
        "part",
        "p_partkey",
        {
            "name": "p_name",
            "size": "CASE WHEN p_partkey % 2 = 0 THEN '\"top\"' ELSE CAST(p_size AS VARCHAR) END",
            "page": "'/part'",
            "props": "'{\"pageProps\":{\"name\":\"' || p_name || '\",\"size\":' || p_size || '}}'",
        },
    ).replace("'\"top\"'", "'top'"),
)
def e2_next_data(spark: SparkSession, folder: str) -> DataFrame:
    """Page properties first, then all top-level keys, which override them."""
    top = F.when(variant("p_partkey", 2) == 0, F.lit(',"size":"top"')).otherwise(F.lit(""))
    script = text(
        '<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"name":"', NAME, '","size":', SIZE, '}},"page":"/part"',
        top, "}</script>",
    )
    return _of_source(_parts(spark, folder, page(text(script, prose()))), "next-data")


_GLOBALS_SQL = ["__NUXT__", "__REDUX_STATE__", "__INITIAL_STATE__", "__APP_STATE__", "__PRELOADED_STATE__", "__SERVER_DATA__", "__STORE__"]


@query(
    "e3_state_globals",
    """SELECT p_partkey AS page_id, 'sku' AS key, 'P' || p_partkey AS value FROM part WHERE p_partkey % 8 < 7
       UNION ALL SELECT p_partkey, 'brand', p_brand FROM part WHERE p_partkey % 8 < 7""",
)
def e3_state_globals(spark: SparkSession, folder: str) -> DataFrame:
    """One of the known names, twice in a script (the first counts), once in another; an unknown name counts nowhere."""
    name = choose(variant("p_partkey", 8), *_GLOBALS_SQL, "__OTHER__")
    script = text("<script>window.", name, ' = {"sku":"P', KEY, '"} ; window.', name, '={"sku":"late"};</script>')
    other = text("<script>window.", name, '={"brand":"', BRAND, '"};</script><script src="/x.js">window.', name, '={"no":1};</script>')
    return _of_source(_parts(spark, folder, page(text(script, other, prose()))), "state-globals")


@query(
    "e4_inline_vars",
    """SELECT p_partkey AS page_id, 'sku' AS key, 'P' || p_partkey AS value FROM part
       UNION ALL SELECT p_partkey, 'brand', p_brand FROM part WHERE p_partkey % 3 <> 2""",
)
def e4_inline_vars(spark: SparkSession, folder: str) -> DataFrame:
    """All upper-case variables count; a lower-case name does not."""
    second = choose(variant("p_partkey", 3), "let ITEM_2", "const _X", "let item")
    script = text('<script>var PART = {"sku":"P', KEY, '"};', second, ' = {"brand":"', BRAND, '"} ;</script>')
    return _of_source(_parts(spark, folder, page(text(script, prose()))), "inline-vars")


@query(
    "e5_meta_tags",
    _rows_sql(
        "part",
        "p_partkey",
        {
            "title": "CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'T & ' || p_partkey END",
            "canonical_url": "'https://example.com/p/' || p_partkey",
            "price_amount": "CAST(p_size AS VARCHAR)",
            "card": "p_brand",
            "description": "p_type",
            "robots": "'index'",
            "type": "'product'",
        },
    ),
)
def e5_meta_tags(spark: SparkSession, folder: str) -> DataFrame:
    og_title = F.when(variant("p_partkey", 2) == 0, text('<meta property="og:title" content=" ', NAME, ' ">')).otherwise(F.lit(""))
    head = text(
        "<title> T &amp; ", KEY, ' </title><link rel="canonical" href="/old"><link rel=canonical href="https://example.com/p/', KEY,
        '"><link rel="canonical" href="">', og_title, '<META PROPERTY="og:Price:Amount" content="', SIZE,
        '"><meta property="twitter:card" content="', BRAND, '"><meta name="twitter:title" content="dropped">',
        '<meta name="twitter:description" content="', KIND, '"><meta name="Robots" content="index"><meta name="viewport" content="x">',
        '<meta name="og:type" content="product"><meta name="author" content="  "><meta property="" name="keywords" content="hidden">',
    )
    return _of_source(_parts(spark, folder, page(prose(), head)), "meta-tags")


@query(
    "e6_microdata",
    _rows_sql(
        "part",
        "p_partkey",
        {
            "name": "CASE p_partkey % 3 WHEN 0 THEN 'c ' || p_name WHEN 1 THEN 'd ' || p_name ELSE p_name END",
            "brand_name": "p_brand",
            "price:amount": "CAST(p_size AS VARCHAR)",
            "kind": "p_type",
        },
    ),
)
def e6_microdata(spark: SparkSession, folder: str) -> DataFrame:
    """Value from content, else datetime, else text; RDFa prefixes are stripped, inner colons stay."""
    attrs = choose(
        variant("p_partkey", 3),
        text('content=" c ', NAME, '" datetime="no"'),
        text('content=" " datetime="d ', NAME, '"'),
        "",
    )
    body = text(
        '<span itemprop=" name " ', attrs, "> ", NAME, ' </span><b itemprop="Brand-Name">', BRAND, '</b><i itemprop="">no</i>',
        '<meta property="og:price:amount" content="', SIZE, '"><i property="schema:dc:kind">', KIND, "</i><u itemprop=empty> </u>",
        prose(),
    )
    return _of_source(_parts(spark, folder, page(body)), "microdata")


@query(
    "e7_data_attrs",
    _rows_sql("part", "p_partkey", {"sku": "'P' || p_partkey", "in_stock": "'yes'", "brand": "p_brand", "price": "CAST(p_size AS VARCHAR)"}),
)
def e7_data_attrs(spark: SparkSession, folder: str) -> DataFrame:
    """The first container wins a key; blank values and elements that are no containers do not count."""
    body = text(
        '<div class="plain" data-color="red"></div><div class="my-card" data-sku=" P', KEY, ' " data-in-stock="yes" data-note=" ">x</div>',
        '<div data-price="', SIZE, '" data-sku="late"></div><p class="listing-row" data-brand="', BRAND, '" id="data-x">', prose(),
    )
    return _of_source(_parts(spark, folder, page(body)), "data-attrs")


_TOKENS = ["csrf_token", "_token", "authenticity_token", "_csrf", "csrfmiddlewaretoken", "__requestverificationtoken"]


@query(
    "e8_hidden_inputs",
    _rows_sql(
        "customer",
        "c_custkey",
        {"customer_id": "CAST(c_custkey AS VARCHAR)", "segment": "c_mktsegment", "name": "c_name"},
    ),
)
def e8_hidden_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """Each security token in two spellings is left out."""
    token = choose(variant("c_custkey", 6), *_TOKENS)
    spelled = F.when(variant("c_custkey", 2) == 0, F.upper(token)).otherwise(F.translate(token, "_", "-"))
    body = text(
        '<form><input type="hidden" name="Customer-Id" value="', F.col("c_custkey"), '"><input type=hidden name="', spelled,
        '" value="secret"><input TYPE="hidden" name="segment" value=" ', F.col("c_mktsegment"), ' "><input type="hidden" name="segment" value="late">',
        '<input type="text" name="visible" value="no"><input type="hidden" name="empty" value=" "><input type="hidden" value="nameless">',
        '<input type="hidden" name="name" value="', F.col("c_name"), '"></form>', prose(),
    )
    return _of_source(as_pages(table(spark, folder, "customer"), "c_custkey", page(body)), "hidden-inputs")


@query(
    "e9_css_hidden",
    _rows_sql(
        "customer",
        "c_custkey",
        {"first_id": "'style ' || c_custkey", "price_old": "c_mktsegment", "by_aria": "c_name", "note": "'n' || c_nationkey"},
    ),
)
def e9_css_hidden(spark: SparkSession, folder: str) -> DataFrame:
    """Style before class; the key is the id or the first telling class; elements with neither do not count."""
    body = text(
        '<i class="hidden" id="first-id">class</i><b style="color:red; Display: None" id="First-Id">style ', F.col("c_custkey"), "</b>",
        '<span class="hidden price-old x">', F.col("c_mktsegment"), '</span><span class="sr-only hidden">no key</span>',
        '<u aria-hidden="true" id="by aria">', F.col("c_name"), '</u><u aria-hidden="false" id="shown">no</u>',
        '<p style="visibility:hidden" class="Note">n', F.col("c_nationkey"), '</p><p class="hiddenish" id="no">no</p><i class="hidden" id="blank"> </i>',
        prose(),
    )
    return _of_source(as_pages(table(spark, folder, "customer"), "c_custkey", page(body)), "css-hidden")


@query("e10_dom_text", _rows_sql("part", "p_partkey", {"price": "CAST(p_size AS VARCHAR)", "headline": "p_name"}))
def e10_dom_text(spark: SparkSession, folder: str) -> DataFrame:
    """A caller's selector map: text of the first match; without a map there are no fields."""
    body = text('<h2 id="head"> ', NAME, ' </h2><b class="amount big">', SIZE, '</b><b class="amount">late</b>', prose())
    selectors = {"price": ".amount", "headline": "h2#head", "none": "table[data-x]"}
    return _of_source(_parts(spark, folder, page(body)), "dom-text", Options(dom_text_selectors=selectors))


@query(
    "custom_extractor",
    """SELECT p_partkey AS page_id, 'name' AS key, p_name AS value, 'times' AS source, 0 AS priority FROM part
       UNION ALL SELECT p_partkey, 'title', 'T' || p_partkey, 'meta-tags', 5 FROM part""",
)
def custom_extractor(spark: SparkSession, folder: str) -> DataFrame:
    """A caller's own extractor with the strongest priority."""
    times = CustomExtractor(
        name="times",
        priority=0,
        confidence=0.99,
        selectors={"time": True},
        entries=lambda nodes: F.transform(
            F.filter(nodes, lambda n: n["tag"] == "time"), lambda n: F.struct(F.lit("name").alias("key"), n["text"].alias("value"))
        ),
    )
    html = page(text("<time>", NAME, '</time><b itemprop="name">weaker</b>', prose()), text("<title>T", KEY, "</title>"))
    result = analyze(_parts(spark, folder, html), Options().register(times))
    rows = explode_fields(result.select("page_id", "fields"), "*")
    return rows.select("page_id", "key", "value", "source", "priority")
