"""Semantic traps on hand-written pages."""

from __future__ import annotations

import pytest

from gleanframe.operators import signals
from gleanframe.options import ExtractorOption, Options
from gleanframe.plans.analyze import analyze, extract_pages, unparsed
from gleanframe.schemas import RESPONSES

PROSE = "<p>" + "Some text of a page that is long enough. " * 20 + "</p>"


def ld(*blocks):
    return "".join(f'<script type="application/ld+json">{b}</script>' for b in blocks)


def test_bad_block_drops_the_whole_extractor(analyzed):
    row, fields = analyzed(ld('{"name":"a"}', "{oops") + "<title>t</title>" + PROSE)
    assert fields == {"title": ("t", "meta-tags")}
    assert row.decision == "Done"


def test_bad_block_still_skips_the_second_phase_of_a_hollow_page(analyzed):
    row, fields = analyzed(ld('{"name":"a"}', "{oops") + '<title>t</title><div id="root"></div>')
    assert fields == {} and row.decision == "Escalate" and row.page_type == "app-shell"


def test_numbers_keep_their_zeros_unless_legacy(analyzed):
    page = ld('{"a":100,"b":10.50,"c":0,"d":1e30,"e":9007199254740993,"f":"100","g":-0.0000001,"h":1e21,"i":123456789.5e3}') + PROSE
    _, fields = analyzed(page)
    assert {k: v for k, (v, _) in fields.items()} == {
        "a": "100", "b": "10.5", "c": "0", "d": "1e+30", "e": "9007199254740993", "f": "100", "g": "-1e-7",
        "h": "1e+21", "i": "123456789500",
    }
    _, fields = analyzed(page, Options(legacy_numbers=True))
    assert fields["a"][0] == "1" and fields["c"][0] == "" and fields["d"][0] == "1e+3" and fields["f"][0] == "100"


def test_json_values(analyzed):
    _, fields = analyzed(ld('{"n":null,"t":true,"f":false,"e":"","o":{"b":1,"a":["<"]},"u":"\\u00e9"}') + PROSE)
    assert {k: v for k, (v, _) in fields.items()} == {"n": "null", "t": "true", "f": "false", "o": '{"a":["\\u003c"],"b":1}', "u": "é"}


@pytest.mark.parametrize(
    "block", ['{"a":"x"} trailing', "{'a':'x'}", '[{"a":"x"},1]', '"text"', "1", '{"a":"x"},{"a":"y"}', '{"a":01}', '{"a":"x"}]', '{"a":"x",}']
)
def test_strict_json(analyzed, block):
    assert analyzed(ld(block) + PROSE)[1] == {}


@pytest.mark.parametrize("block", ['[{"a":"x"},null]', '{"a":"y","a":"x"}', ' \n{"a":"x"}\t'])
def test_accepted_json(analyzed, block):
    assert analyzed(ld(block) + PROSE)[1] == {"a": ("x", "json-ld")}


def test_disabled_first_phase_extractor_pulls_meta_tags_forward(analyzed):
    page = '<title>t</title><div id="root"></div><b itemprop="x">y</b>'
    assert set(analyzed(page)[1]) == {"title", "x"}
    options = Options(extractors={"globals": ExtractorOption()})
    assert set(analyzed(page, options)[1]) == {"title"}


def test_four_extractors_run_in_one_phase(analyzed):
    off = {n: ExtractorOption() for n in ("next-data", "globals", "inline-var", "meta-tags", "data-attr", "hidden-input")}
    page = ld('{"a":"x"}') + '<div id="root"></div><b itemprop="x">y</b>'
    assert set(analyzed(page, Options(extractors=off))[1]) == {"a", "x"}


def test_meta_prefixes(analyzed):
    head = (
        '<meta property="og:Title" content="a"><meta property="OG:x" content="b"><meta property="Twitter:card" content="c">'
        '<meta name="twitter:title" content="no"><meta name="twitter:description" content="d"><meta name="og:a:b" content="e">'
    )
    _, fields = analyzed(head + PROSE)
    meta = {k: v for k, (v, s) in fields.items() if s == "meta-tags"}
    assert meta == {"title": "a", "og_x": "b", "card": "c", "description": "d", "a_b": "e"}


def test_microdata_sees_meta_properties_with_inner_colons(analyzed):
    _, fields = analyzed('<meta property="og:price:amount" content="9">' + PROSE)
    assert fields == {"price_amount": ("9", "meta-tags"), "price:amount": ("9", "microdata")}


def test_page_without_fields(analyzed):
    assert analyzed(PROSE)[0].decision == "Done"
    assert analyzed(PROSE, Options(escalate_empty=True))[0].decision == "Escalate"


def test_size_boundaries(analyzed):
    def page(size):
        return "<p>" + "x" * (size - 3)

    assert analyzed(page(5119))[0].page_type == "mixed"
    assert analyzed(page(5120))[0].page_type == "content-rich"
    links = '<a href="/">x</a>'
    assert analyzed(links * 10)[0].page_type == "link-rich"
    assert analyzed(links * 9 + "<a> </a>")[0].page_type == "mixed"
    row = analyzed(links * 30)[0]
    assert row.page_type_confidence == 0.95


def test_empty_body_is_tiny_but_has_no_density(analyzed):
    row, _ = analyzed("")
    assert (row.hollow_score, row.page_type, row.decision) == (0.5, "mixed", "Done")


def test_density_counts_bytes(analyzed):
    filler = "<!--" + "x" * 6000 + "-->"
    assert analyzed(filler + "<p>" + "é" * 160)[0].page_type == "content-rich"
    assert analyzed(filler + "<p>" + "e" * 160)[0].page_type == "app-shell"


def test_body_is_capped(analyzed):
    page = "<p>" + "x" * 100 + "</p><b itemprop=late>y</b>"
    assert analyzed(page, Options(max_body_bytes=60))[1] == {}


def test_unparseable_page_escalates(analyzed):
    row, fields = analyzed("<div>" * 600)
    assert (row.decision, row.page_type, row.hollow_score, fields) == ("Escalate", "", 0.0, {})


def test_invalid_utf8(analyzed):
    _, fields = analyzed(b"<title>a\xff</title>" + PROSE.encode())
    assert fields["title"][0] == "a�"


def test_unicode_space_is_trimmed(analyzed):
    _, fields = analyzed("<title>   t 　\x0b</title>" + PROSE)
    assert fields["title"][0] == "t"


def test_gated_response_is_not_parsed(analyzed):
    row, fields = analyzed("<title>t</title>", status=404)
    assert (row.decision, row.page_type, row.hollow_score, fields) == ("Abort", "", 0.0, {})
    row, fields = analyzed("<title>t</title>" + PROSE, status=503)
    assert row.decision == "Done" and "title" in fields
    row, _ = analyzed("", status=429, headers={"Retry-After": ["-1"]})
    assert (row.decision, row.retry_after_s) == ("Backoff", 0.0)
    for text, seconds in (("1e2", 100.0), (".5", 0.5), (" 5", 0.0), ("5s", 0.0), ("1_0", 0.0)):
        assert analyzed("", status=429, headers={"retry-AFTER": [text]})[0].retry_after_s == seconds


def test_script_with_src_is_no_inline_script(analyzed):
    assert analyzed('<script src="x">window.__NUXT__={"a":"b"};var A={"c":"d"};</script>' + PROSE)[1] == {}
    _, fields = analyzed('<script>window.__NUXT__={"a":"b"};var A={"c":"d"};</script>' + PROSE)
    assert fields == {"a": ("b", "state-globals"), "c": ("d", "inline-vars")}


def test_lazy_object_stops_at_the_first_brace_with_semicolon(analyzed):
    assert analyzed('<script>var A={"a":"};"};</script>' + PROSE)[1] == {}


def test_options_mapping():
    options = Options.from_mapping({"tier2": {"hollow": {"threshold": 0}, "extractors": {"json-ld": {"confidence": 0.4}}}})
    assert options.threshold == 0.70
    assert options.extractors["json-ld"] == ExtractorOption(False, 0.4)
    assert Options(penalties={"cf-challenge": 0}).penalty("cf-challenge") == 1.0
    assert Options(penalties={"captcha": 0}).penalty("captcha") == 0


def test_options_of_a_missing_file(tmp_path):
    pytest.importorskip("yaml")
    assert Options.from_yaml(str(tmp_path / "none.yaml")) == Options()
    file = tmp_path / "options.yaml"
    file.write_text("tier2:\n  hollow:\n    tiny_body_bytes: 7\n  llm:\n    max_text_bytes: 9\n")
    options = Options.from_yaml(str(file))
    assert (options.tiny_body_bytes, options.max_text_bytes) == (7, 9)


def test_large_script_state(analyzed):
    big = '{"a":"' + "x" * 1_000_000 + '"}'
    _, fields = analyzed(f"<script>window.__NUXT__={big};var A={big};</script>" + PROSE)
    assert len(fields["a"][0]) == 1_000_000


def test_text_repeated_by_nested_nodes(analyzed):
    row, fields = analyzed("".join(f"<div itemprop=p{i}>" for i in range(400)) + PROSE + "<b itemprop=q> Ä </b>")
    assert len(fields) == 401 and row.decision == "Done"
    assert {v for k, (v, _) in fields.items() if k != "q"} == {fields["p0"][0]} and fields["q"][0] == "Ä"
    assert fields["p0"][0].endswith(" Ä")


def test_numbers_in_nested_json(analyzed):
    spec = '{"n":{"a":2500.0,"b":1E30,"c":[1E2,0.10],"d":1E-7,"s":"2.50 \\\\\\" 1E2 & \u2028","e":{},"f":[true,null]}}'
    want = '{"a":2500,"b":1e+30,"c":[100,0.1],"d":1e-7,"e":{},"f":[true,null],"s":"2.50 \\\\\\" 1E2 \\u0026 \\u2028"}'
    assert analyzed(ld(spec) + PROSE)[1]["n"][0] == want


def test_parse_errors_have_a_reason(spark):
    rows = [(1, b"<div>" * 600), (2, b"<p>fine"), (3, None), (4, b"&#" + b"0" * 5_000 + b"65; &#" + b"9" * 5_000 + b";")]
    pages = spark.createDataFrame([(i, f"u{i}", 200, {}, b and bytearray(b), "", "text/html", 0, None) for i, b in rows], RESPONSES)
    assert [tuple(r) for r in unparsed(pages).select("page_id", "error").collect()] == [(1, "open elements nest too deeply")]
    types = {r.page_id: (r.decision, r.page_type) for r in analyze(pages).collect()}
    assert types == {1: ("Escalate", ""), 2: ("Done", "mixed"), 3: ("Done", "mixed"), 4: ("Escalate", "app-shell")}


def test_text_of_other_encodings_counts_its_bytes(analyzed):
    filler, prose = b"<!--" + b"x" * 6000 + b"-->", "Größe ".encode("latin-1")
    assert analyzed(filler + b"<p>" + prose * 60)[0].page_type == "content-rich"
    assert analyzed(filler + b"<p>" + prose * 45)[0].page_type == "app-shell"
    _, fields = analyzed(filler + b"<b itemprop=a title=\xe9>" + prose + b"</b><i itemprop=\xe9>x</i>" + prose * 60)
    assert fields == {"a": ("Gr\ufffd\ufffde", "microdata"), "\ufffd": ("x", "microdata")}


def test_scripts_are_searched_once(analyzed):
    """Declarations that never end, and ends without declarations, by the ten thousand."""
    many = "var A = { " * 200_000
    assert analyzed(f"<script>{many}</script>" + PROSE)[1] == {}
    assert analyzed(f"<script>{'window.__NUXT__={' * 100_000}</script>" + PROSE)[1] == {}
    _, fields = analyzed(f'<script>{"};" * 200_000}var A={{"a":"b"}} \t;let B_1 = {{"c":{{"d":1}}}};var C={{"e":1}}</script>' + PROSE)
    assert fields == {"a": ("b", "inline-vars"), "c": ('{"d":1}', "inline-vars")}


def scored(spark, *pages, options=None):
    """The struct page of each page, in order."""
    rows = [(i, f"u{i}", 200, {}, bytearray(p.encode()), f"u{i}", "text/html", 1, None) for i, p in enumerate(pages)]
    extracted = extract_pages(spark.createDataFrame(rows, RESPONSES), options).select("page_id", "page")
    return [r.page for r in sorted(extracted.collect(), key=lambda r: r.page_id)]


def test_extracted_pages_have_the_penalties_that_fired(spark):
    shells = '<div id="app"></div><div id="root"> </div>'
    pages = (f"<i data-sitekey></i><noscript>Enable JavaScript</noscript>{shells}", f"{shells}<!--{'x' * 6000}-->", PROSE * 9)
    every = {"captcha": 0.95, "noscript-message": 0.9, "empty-app-shell": 0.85, "tiny-body": 0.5}
    assert [p.penalties for p in scored(spark, *pages)] == [every, {"empty-app-shell": 0.85, "low-text-density": 0.7}, {}]
    own = scored(spark, *pages, options=Options(penalties={"captcha": 0.0, "empty-app-shell": 0.2}))
    assert [p.penalties for p in own] == [every | {"captcha": 0.0, "empty-app-shell": 0.2}, {"empty-app-shell": 0.2, "low-text-density": 0.7}, {}]
    assert [p.total for p in own[1:]] == [1.0, 0.0]


def test_extracted_pages_have_all_columns_of_the_score_unless_named(spark):
    empty = spark.createDataFrame([], RESPONSES)
    assert tuple(extract_pages(empty).schema["page"].dataType.names) == signals.COLUMNS
    assert tuple(extract_pages(empty, None, signals.DECIDING).schema["page"].dataType.names) == signals.DECIDING


def test_signal_of_a_captcha(spark):
    widgets = ('<div class="g-recaptcha">', '<b class="x-hcaptcha-y">', '<div class="a cf-turnstile">', "<i data-sitekey>")
    others = ("<p>recaptcha", '<div id="recaptcha">', "")
    found = scored(spark, *[PROSE * 9 + p for p in widgets + others])
    assert [p.signals for p in found] == [["captcha"]] * 4 + [[]] * 3
    shell = '<div id="app"></div>'
    assert scored(spark, f"{shell}{shell}{widgets[0]}</div>{PROSE * 9}")[0].signals == ["captcha", "empty-app-shell"]


def test_signal_of_a_noscript_message(spark):
    says = ("Please ENABLE JavaScript", "JavaScript required", "javascript is disabled.", "JAVASCRIPT IS REQUIRED")
    pages = [f"<noscript>{t}</noscript>" for t in says] + ["<noscript>x</noscript><noscript>enable java</noscript><noscript>script</noscript>"]
    others = ["<noscript>Use scripts</noscript>", "<p>enable javascript</p>", "<noscript></noscript>"]
    found = scored(spark, *[p + PROSE * 9 for p in pages + others])
    assert [p.signals for p in found] == [["noscript-message"]] * 5 + [[]] * 3


def test_signal_of_low_text_density(spark):
    def page(size, chars, more=""):
        rest = f"{more}<p>{'x' * chars}</p>"
        return f"<!--{'-' * (size - len(rest) - 7)}-->{rest}"

    links = '<a href="/">l</a>'
    pages = (page(8000, 400), page(8000, 399), page(8000, 20, links * 9), page(8000, 20, links * 10), page(8000, 20, links * 9 + "<a> </a>"))
    fired = [["low-text-density"], []]
    assert [p.signals for p in scored(spark, *pages)] == [fired[i] for i in (1, 0, 0, 1, 0)]
    assert [p.signals for p in scored(spark, *pages[:2], options=Options(text_density_ratio=0.051))] == [fired[0]] * 2


def test_signal_of_a_tiny_body(spark):
    links = '<a href="/">l</a>'
    pages = ("<p>" + "x" * 5116, "<p>" + "x" * 5117, "<p>" + "é" * 2559, links * 9, links * 10, "")
    fired = [["tiny-body"], []]
    assert [p.signals for p in scored(spark, *pages)] == [fired[i] for i in (0, 1, 1, 0, 1, 0)]
    assert [p.signals for p in scored(spark, *pages[:2], options=Options(tiny_body_bytes=5121))] == [fired[0]] * 2
