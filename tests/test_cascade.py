"""Text fallback, cascade, job store, stream and plans."""

from __future__ import annotations

import re
import uuid

import pytest
from pyspark.sql import functions as F

from gleanframe.options import Options
from gleanframe.plans import jobs
from gleanframe.plans.analyze import analyze, analyze_rendered, candidates, classify
from gleanframe.plans.cascade import run_cascade
from gleanframe.plans.prompts import prompts, readable_text
from gleanframe.operators.fallback import apply_completions, completion_result
from gleanframe.schemas import COMPLETIONS, RENDERED_PAGES, RESPONSES
from gleanframe.plans.batch import _todo as batch_todo
from gleanframe.plans.batch import batch_prompts, run_batch, to_fetch
from gleanframe.plans.links import followable_links, link_table
from gleanframe.sources.tables import pages_as_responses, read_rendered_pages, read_responses, rendered_as_responses
from gleanframe.queries import QUERIES
from gleanframe.streaming.stream import write_analysis_stream

SHELL = '<nav>Menu of the site</nav><div id="root"></div><p>A paragraph that is long enough to be read.</p>'


def responses(spark, pages):
    rows = [
        (i, f"https://example.com/{i}", 200, {}, bytearray(html.encode()), f"https://example.com/{i}", "text/html", 1, None)
        for i, html in enumerate(pages)
    ]
    return spark.createDataFrame(rows, RESPONSES)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def folder(spark):
    return f"{spark.conf.get('spark.checkpoint.dir')}/test-{uuid.uuid4().hex}"


def clean(spark, html, limit=4000):
    return readable_text(responses(spark, [html]), Options(max_text_bytes=limit)).first().clean_text


def test_clean_text(spark):
    assert clean(spark, "<html><body></body></html>") == ""
    assert clean(spark, "<html><body><p>" + "a" * 200 + "</p></body></html>", 50) == "a" * 50
    assert clean(spark, "<nav>no</nav>" + SHELL) == "A paragraph that is long enough to be read."
    assert clean(spark, "<p>short</p><footer>no</footer>") == "short"
    assert clean(spark, "<script>no</script><h2>Head</h2><p>Some <b>bold</b> words\n that   make a paragraph.</p>") == (
        "Head\nSome bold words that make a paragraph."
    )
    # A cut inside a character.
    assert clean(spark, "<p>" + "é" * 100, 51) == "é" * 25 + "�"


@pytest.mark.parametrize(
    ("completion", "error", "fields", "err"),
    [
        ('{"title":"Oak table","price":"310 kr"}', None, {"title": "Oak table", "price": "310 kr"}, False),
        ('```json\n{"title":"Lamp"}\n```', None, {"title": "Lamp"}, False),
        ("not json at all", None, {}, True),
        ('{"title":"x"}', "network failure", {}, True),
        (None, None, {}, True),
        ('{"title":"x","n":1}', None, {}, True),
        ('{"title":" ","n":null}', None, {}, False),
        ("null", None, {}, False),
        ("[]", None, {}, True),
    ],
)
def test_completions(spark, completion, error, fields, err):
    row = spark.createDataFrame([(1, completion, error)], COMPLETIONS).select(completion_result("completion", "error").alias("r")).first().r
    assert (row.fields, row.err) == (fields, err)


def test_prompts_and_fallback(spark):
    pages = responses(spark, [SHELL, "<title>t</title>" + SHELL, '<div id="root"></div>'])
    asked = prompts(pages).collect()
    assert [r.page_id for r in asked] == [0]
    assert asked[0].prompt.endswith("Webpage text:\nA paragraph that is long enough to be read.")
    done = spark.createDataFrame([(i, '{"title":"from text"}', None) for i in (0, 1)] + [(0, None, "timeout")], COMPLETIONS)
    rows = {r.page_id: r for r in apply_completions(analyze(pages), done).collect()}
    assert rows[0].decision == "Done" and rows[0].fields["title"].source == "llm" and rows[0].fields["title"].priority == 11
    assert rows[1].fields["title"].value == "t"
    assert rows[2].decision == "Escalate"


def rendered(spark, rows):
    return spark.createDataFrame([(i, f"https://example.com/{i}", tier, url, html, 40 + i) for i, tier, url, html in rows], RENDERED_PAGES)


FULL = "<title>rendered</title><p>" + "Text of the rendered page. " * 20


def test_rendered_page_with_injected_data(spark):
    """A rendered page with JSON-LD and a filled root is done."""
    html = (
        '<div id="root"><h1>Dyn</h1></div><script type="application/ld+json">'
        '{"@type":"Product","name":"Kettle","price":"48.50"}</script>' + FULL
    )
    pages = rendered(spark, [(1, 3, "https://example.com/1", html)])
    row = analyze_rendered(rendered_as_responses(pages), 3).first()
    assert row.decision == "Done" and row.fields["name"].value == "Kettle" and row.fields["price"].source == "json-ld"


def test_login_wall(spark):
    pages = rendered(spark, [(1, 3, "https://example.com/login", '<input type="password">')])
    row = analyze_rendered(rendered_as_responses(pages), 3).first()
    assert (row.decision, row.escalation_reason, row.fields, row.page_type) == ("Escalate", "login wall detected in URL", {}, "")


def test_cascade_paths(spark):
    shell = '<div id="root"></div>'
    base = responses(spark, [FULL, shell, shell, shell, shell])
    renders = rendered(
        spark,
        [
            (0, 3, "u", FULL),  # not reached
            (1, 3, "u", FULL),
            (2, 3, "u", shell),
            (2, 4, "u", FULL),
            (3, 3, "u", '<input type="password">'),
            (3, 4, "u", '<i data-sitekey="x"></i>'),
            (1, 3, "u", FULL),  # a second copy
        ],
    )
    rows = {r.page_id: r for r in run_cascade(base, renders).collect()}
    assert {i: (r.tier, r.decision) for i, r in rows.items()} == {
        0: (2, "Done"),
        1: (3, "Done"),
        2: (4, "Done"),
        3: (4, "Escalate"),
        4: (2, "Escalate"),
    }
    assert rows[3].escalation_reason == "captcha detected: [data-sitekey]"
    # Written tier by tier: the same results, and only renders that are reached are analysed.
    work = f"{spark.conf.get('spark.checkpoint.dir')}/test-{uuid.uuid4().hex}"
    routed = {r.page_id: r for r in run_cascade(base, renders, work=work).collect()}
    assert routed == rows
    assert {t: sorted(r.page_id for r in spark.read.parquet(f"{work}/tier{t}").collect()) for t in (3, 4)} == {3: [1, 1, 2, 3], 4: [2, 3]}
    rows = {r.page_id: r.tier for r in run_cascade(base).collect()}
    assert set(rows.values()) == {2}


def test_cascade_with_completions_per_tier(spark):
    base = responses(spark, [SHELL, SHELL])
    renders = rendered(spark, [(0, 3, "u", SHELL), (1, 3, "u", '<b class="cmp-popup"></b>' + SHELL)])
    completions = spark.createDataFrame(
        [(0, '{"title":"x"}', None, 3), (1, '{"title":"y"}', None, 3)], COMPLETIONS + ", tier int"
    )
    rows = {r.page_id: r for r in run_cascade(base, renders, completions=completions).collect()}
    assert (rows[0].tier, rows[0].decision, rows[0].fields["title"].source) == (3, "Done", "llm")
    assert (rows[1].decision, rows[1].fields) == ("Escalate", {})
    off = Options.from_mapping({"tier4": {"block_domains": ["*x*"]}})
    assert (off.fallback_enabled, off.blocked_in(4), off.blocked_in(3)) == (False, ("*x*",), Options().block_domains)
    assert [r.decision for r in run_cascade(base, renders, off, completions=completions).collect()] == ["Escalate", "Escalate"]
    assert prompts(base, off).isEmpty()


def test_job_round_trip_and_resume(spark, folder):
    path = f"{folder}/jobs"
    base = responses(spark, [FULL, '<div id="root"></div>']).withColumn("batch_id", F.lit("b"))
    base = base.withColumn("job_id", jobs.job_id(F.col("url"), F.col("batch_id")))
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    jobs.write_stage(jobs.created_rows(base, now), path)
    jobs.write_stage(jobs.tier1_rows(base, now + F.expr("INTERVAL 1 MINUTE")), path)
    stages = jobs.read_stages(spark, path)
    assert jobs.pending(base, stages, 1).count() == 0
    assert jobs.pending(base, stages, 2).count() == 2
    first = base.filter("page_id = 0")
    jobs.write_stage(jobs.tier2_rows(analyze(first), now + F.expr("INTERVAL 2 MINUTES")), path)
    spark.catalog.refreshByPath(path)
    stages = jobs.read_stages(spark, path)
    todo = jobs.pending(base, stages, 2)
    assert [r.page_id for r in todo.collect()] == [1]
    both = jobs.resume_analysis(base, stages, analyze(todo))
    assert sorted(r.decision for r in both.collect()) == ["Done", "Escalate"]
    job = first.first().job_id
    view = jobs.get_job(stages, job).first()
    assert (view.status, view.tier2.decision, view.final_decision) == ("tier2_complete", "Done", None)
    assert bytes(view.tier1.body).startswith(b"<title>rendered")
    assert view.tier2.fields["title"].value == "rendered"
    with pytest.raises(jobs.JobNotFound):
        jobs.get_job(stages, "none")


def test_job_view_does_not_read_bodies(spark, folder):
    path = f"{folder}/bodies"
    base = responses(spark, [FULL]).withColumn("batch_id", F.lit("b")).withColumn("job_id", F.lit("j"))
    jobs.write_stage(jobs.tier1_rows(base, F.current_timestamp()), path)
    plan = plan_of(jobs.job_view(jobs.read_stages(spark, path)))
    scan = plan[plan.index("ReadSchema") :]
    assert "body" not in scan


def test_stream_equals_batch(spark, folder):
    source = f"{folder}/responses"
    base = responses(spark, [FULL, SHELL, '<div id="root"></div>'])
    base.write.parquet(source)
    from gleanframe.sources.tables import stream_responses

    for _ in range(2):  # the second start finds nothing new
        stream = stream_responses(spark, source)
        write_analysis_stream(stream, f"{folder}/out", f"{folder}/ckpt").awaitTermination()
    columns = ("url", "decision", "page_type", "hollow_score", "fields")
    got = jobs.read_stages(spark, f"{folder}/out").select("url", *[F.col(f"tier2.{c}").alias(c) for c in columns[1:]])
    want = analyze(spark.read.schema(RESPONSES).parquet(source)).select(*columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_one_parse_and_pruned_scan(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    result = analyze(pages_as_responses(pages)).filter("decision = 'Done' AND page_id > 3").select("page_id", "fields")
    plan = plan_of(result)
    assert plan.count("ArrowEvalPython") == 1
    assert "PushedFilters: [IsNotNull(page_id), GreaterThan(page_id,3)]" in plan
    assert "ReadSchema: struct<page_id:bigint,html:string>" in plan
    assert "Exchange" not in plan


@pytest.mark.parametrize("build", [analyze, candidates, classify, prompts])
def test_no_shuffle(spark, build):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = plan_of(build(pages_as_responses(pages)))
    assert "Exchange" not in plan
    assert plan.count("ArrowEvalPython") == (2 if build is prompts else 1)


def test_cascade_shuffles_results_and_not_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    tier = (F.length("url") % 2 + 3).cast("int")
    renders = pages.select("page_id", "url", tier.alias("tier"), F.col("url").alias("rendered_url"), "html")
    plan = plan_of(run_cascade(pages_as_responses(pages), renders))
    for line in plan.splitlines():
        if "Exchange" in line:
            assert "html" not in line and "body" not in line
    assert plan.count("ArrowEvalPython") == 2


def test_batch_is_picked_up(spark, folder):
    path = f"{folder}/batch"
    shell = '<div id="root"></div>'
    base = responses(spark, [FULL, shell, shell])
    renders = rendered(spark, [(1, 3, "u", FULL), (2, 3, "u", shell), (2, 4, "u", '<i data-sitekey="x"></i>'), (0, 3, "u", FULL)])
    first = run_batch(base.filter("page_id < 2"), None, path, "b", "1")
    assert sorted((r.tier, r.decision) for r in first.collect()) == [(2, "Done"), (2, "Escalate")]
    stored = jobs.read_stages(spark, path).count()
    again = run_batch(base.filter("page_id < 2"), None, path, "b", "2")
    assert again.count() == 2 and jobs.read_stages(spark, path).count() == stored
    rows = {r.url[-1]: r for r in run_batch(base, renders, path, "b", "3").collect()}
    assert {k: (r.tier, r.decision, r.status) for k, r in rows.items()} == {
        "0": (2, "Done", "tier2_complete"),
        "1": (3, "Done", "tier3_complete"),
        "2": (4, "Escalate", "tier4_complete"),
    }
    assert rows["2"].escalation_reason == "captcha detected: [data-sitekey]"
    assert rows["1"].fields["title"].value == "rendered"
    # The same run again replaces its own part.
    stored = jobs.read_stages(spark, path).count()
    again = {r.url[-1]: (r.tier, r.decision) for r in run_batch(base, renders, path, "b", "3").collect()}
    assert again == {k: (r.tier, r.decision) for k, r in rows.items()}
    assert jobs.read_stages(spark, path).count() == stored
    # Another batch does not see these jobs, also if its name starts the same way.
    assert {r.tier for r in run_batch(base, None, path, "c", "1").collect()} == {2}
    assert run_batch(base.filter("page_id < 2"), None, path, "b.3", "1").count() == 2
    assert run_batch(base, None, path, "b", "4").count() == 3
    with pytest.raises(ValueError):
        run_batch(base, None, path, "b", "3.1")


def test_two_streams_keep_their_rows(spark, folder):
    from gleanframe.sources.tables import stream_responses

    for name, pages in (("a", [FULL]), ("b", [FULL, SHELL])):
        responses(spark, pages).write.parquet(f"{folder}/{name}")
        write_analysis_stream(stream_responses(spark, f"{folder}/{name}"), f"{folder}/two", f"{folder}/ckpt-{name}").awaitTermination()
    assert jobs.read_stages(spark, f"{folder}/two").count() == 3


def test_rendered_pages_are_not_cut(spark):
    long = "<p>" + "x " * 200 + "</p><meta name=description content=behind>"
    pages = rendered(spark, [(1, 3, "https://example.com/1", long)])
    row = analyze_rendered(rendered_as_responses(pages), 3, Options(max_body_bytes=100)).first()
    assert "behind" in {f.value for f in row.fields.values()}


def test_salts_split_one_key_in_one_partition(spark):
    from gleanframe.functions.joins import attach

    left = spark.range(200).select(F.lit("k").alias("key"), "id").coalesce(1)
    right = spark.createDataFrame([("k", 1)], "key string, v int")
    assert attach(left, right, "key", salts=8).filter("v = 1").count() == 200
    from gleanframe.functions.joins import _salted

    assert _salted(left, right, 8)[0].select("_salt").distinct().count() == 8


def test_sources_read_their_files(spark, folder):
    responses(spark, [FULL]).write.parquet(f"{folder}/in")
    assert analyze(read_responses(spark, f"{folder}/in")).first().fields["title"].value == "rendered"
    rendered(spark, [(1, 4, "u", FULL)]).write.parquet(f"{folder}/rendered")
    assert read_rendered_pages(spark, f"{folder}/rendered").first().tier == 4


def test_links(spark):
    page = '<a href="/a"> A </a><a>no address</a><a href="https://www.google-analytics.com/x">t</a><a href="/b"> </a>'
    rows = link_table(responses(spark, [page])).collect()
    assert [(r.href, r.text) for r in rows] == [("/a", "A"), (None, "no address"), ("https://www.google-analytics.com/x", "t")]
    assert [r.href for r in followable_links(responses(spark, [page])).collect()] == ["/a"]


def test_salted_joins_agree(spark):
    from gleanframe.functions.joins import attach, drop_matching

    left = spark.range(0, 2000, numPartitions=7).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(0, 1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plain, salted = (sorted(map(tuple, attach(left, right, "k", F.col("id") > 5, n).collect()), key=str) for n in (1, 4))
    assert plain == salted and len(plain) == 2000
    plain, salted = (sorted(map(tuple, drop_matching(left, right.select("k"), "k", n).collect())) for n in (1, 4))
    assert plain == salted and all(k >= 1000 for k, _ in plain)


def test_first_run_shuffles_no_bodies(spark, folder):
    from gleanframe.plans.batch import _stored, _todo

    base = responses(spark, [FULL]).withColumn("job_id", F.lit("j"))
    assert "Exchange" not in plan_of(_todo(base, _stored(base, f"{folder}/nothing"), 1, 1))


def test_challenged_page_takes_no_completion(spark):
    base = responses(spark, [SHELL]).withColumn("headers", F.expr("map('CF-Mitigated', array('challenge'))"))
    done = spark.createDataFrame([(0, '{"title":"x"}', None)], COMPLETIONS)
    row = apply_completions(analyze(base), done).first()
    assert (row.decision, row.fields) == ("Escalate", {})
    assert prompts(base).count() == 0


def test_due_backoffs(spark):
    from gleanframe.operators.gate import due_backoffs

    base = responses(spark, ["", ""]).withColumns(
        {
            "status": F.lit(429),
            "fetched_at": F.lit("2024-01-01 00:00:00").cast("timestamp"),
            "headers": F.expr("map('Retry-After', array(CASE page_id WHEN 0 THEN '1.5' ELSE '1e300' END))"),
        }
    )
    rows = due_backoffs(analyze(base), F.lit("2024-01-01 00:00:01").cast("timestamp")).collect()
    assert [(r.page_id, r.retry_after_s) for r in rows] == [(1, 0.0)]
    assert due_backoffs(analyze(base), F.lit("2024-01-01 00:00:02").cast("timestamp")).count() == 2


def test_a_stage_without_rows_replaces_what_was_stored(spark, folder):
    path = f"{folder}/replaced"
    shell = '<div id="root"></div>'
    base = responses(spark, [shell, shell])
    run_batch(base, rendered(spark, [(0, 3, "u", FULL), (1, 3, "u", FULL)]), path, "b", "1")
    assert jobs.read_stages(spark, path).filter("stage = 3").count() == 2
    # The same run again, now without renders of these pages.
    rows = run_batch(base, rendered(spark, []), path, "b", "1").collect()
    assert {(r.tier, r.decision) for r in rows} == {(2, "Escalate")} and len(rows) == 2
    assert jobs.read_stages(spark, path).filter("stage = 3").count() == 0
    finished = jobs.finished_stages(spark, path).select("stage", "batch_id").collect()
    assert sorted(map(tuple, finished)) == [(s, "b.1") for s in range(5)]
    # Other input under the same name would lose the first input's rows.
    with pytest.raises(ValueError, match="new name"):
        run_batch(base.filter("page_id = 0"), None, path, "b", "1")
    assert jobs.read_stages(spark, path).filter("stage = 2").count() == 2


def test_requests_without_a_response_stay_created(spark, folder):
    path = f"{folder}/requests"
    base = responses(spark, [FULL, FULL, FULL])
    requests = base.select("url", F.expr("IF(page_id = 2, 'https://api.example.com/2', '')").alias("api_endpoint"))
    assert to_fetch(requests, path, "b").count() == 3
    answered = base.withColumn("status", F.expr("IF(page_id = 1, NULL, status)")).filter("page_id < 2")
    answered = answered.withColumn("content_type", F.lit("text/html; charset=utf-8"))
    results = run_batch(answered, None, path, "b", "1", requests=requests.unionByName(requests))
    assert [(r.url[-1], r.decision) for r in results.collect()] == [("0", "Done")]
    view = {r.url[-1]: r for r in jobs.job_view(jobs.read_stages(spark, path)).collect()}
    assert {k: r.status for k, r in view.items()} == {"0": "tier2_complete", "1": "created", "2": "created"}
    assert view["0"].tier1.content_type == "text/html"
    targets = {r.url[-1]: r.target for r in to_fetch(requests, path, "b").collect()}
    assert targets == {"1": "https://example.com/1", "2": "https://api.example.com/2"}
    run_batch(base.filter("page_id > 0"), None, path, "b", "2", requests=requests)
    assert to_fetch(requests, path, "b").isEmpty()
    assert {r.status for r in jobs.job_view(jobs.read_stages(spark, path)).collect()} == {"tier2_complete"}


def test_completions_are_a_stored_stage(spark, folder):
    path = f"{folder}/completions"
    base = responses(spark, [SHELL, SHELL, SHELL, FULL])
    renders = rendered(spark, [(1, 3, "u", SHELL), (2, 3, "u", SHELL), (2, 4, "u", SHELL)])
    run_batch(base, renders, path, "b", "1")
    asked = {(r.url[-1], r.tier) for r in batch_prompts(renders, path, "b", spark).collect()}
    assert asked == {("0", 2), ("1", 2), ("2", 2), ("1", 3), ("2", 3), ("2", 4)}
    given = [(0, 2, '{"title":"x"}', None), (1, 3, '{"title":"y"}', None), (2, 3, '{"title":"z"}', None), (2, 4, None, "failed"), (3, 2, '{"title":"no"}', None)]
    completions = spark.createDataFrame(
        [(f"https://example.com/{i}", *rest) for i, *rest in given], "url string, tier int, completion string, error string"
    )
    off = run_batch(base, renders, path, "b", "2", Options(fallback_enabled=False), completions=completions)
    assert {r.decision for r in off.filter("url NOT LIKE '%3'").collect()} == {"Escalate"}
    for run in ("3", "3", "4"):  # the same run again, then one that has nothing left to do
        rows = {r.url[-1]: r for r in run_batch(base, renders, path, "b", run, completions=completions).collect()}
        # A completion of tier 3 that comes after tier 4 ran ends the job in tier 3.
        assert {k: (r.tier, r.decision) for k, r in rows.items()} == {
            "0": (2, "Done"), "1": (3, "Done"), "2": (3, "Done"), "3": (2, "Done")
        }
        assert [(rows[k].fields["title"].value, rows[k].fields["title"].source) for k in "012"] == [("x", "llm"), ("y", "llm"), ("z", "llm")]
        stored = jobs.read_stages(spark, path).groupBy("stage", "batch_id").count().filter("stage > 10").collect()
        assert sorted(map(tuple, stored)) == [(12, "b.3", 1), (13, "b.3", 2)]
    assert {(r.url[-1], r.tier) for r in batch_prompts(renders, path, "b", spark).collect()} == {("1", 2), ("2", 2), ("2", 4)}
    # The tier itself, run again, does not undo its completions.
    rows = {r.url[-1]: r.decision for r in run_batch(base, renders, path, "b", "1").collect()}
    assert set(rows.values()) == {"Done"}
    view = jobs.job_view(jobs.read_stages(spark, path)).filter("url LIKE '%0'").first()
    assert (view.status, view.tier2.decision, view.tier2.page_type != "") == ("tier2_complete", "Done", True)
    assert {r.decision for r in jobs.stored_analysis(jobs.read_stages(spark, path)).filter("url LIKE '%0'").collect()} == {"Done"}


def test_stream_and_batch_share_jobs(spark, folder):
    from gleanframe.sources.tables import stream_responses

    path, source = f"{folder}/shared", f"{folder}/shared-in"
    base = responses(spark, [FULL, '<div id="root"></div>'])
    base.write.parquet(source)
    write_analysis_stream(stream_responses(spark, source), path, f"{folder}/shared-ckpt", batch="b").awaitTermination()
    streamed = {r.job_id for r in jobs.read_stages(spark, path).collect()}
    rows = run_batch(base, rendered(spark, [(1, 3, "u", FULL)]), path, "b", "1").collect()
    assert {r.job_id for r in rows} == streamed and sorted((r.tier, r.decision) for r in rows) == [(2, "Done"), (3, "Done")]
    assert {r.batch_id.split(".")[1][:6] for r in jobs.read_stages(spark, path).filter("stage = 2").collect()} == {"stream"}


@pytest.mark.parametrize("parts", [1, 3])
def test_stream_reads_a_table_of_part_files(spark, tmp_path, parts):
    """The pages table may be a folder; a stream over its parent finds no file of that name."""
    pages = [(i, f"https://example.com/{i}", "<p>" + "x" * (9000 if i % 2 else 9)) for i in range(8)]
    rows = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    rows.repartition(parts).write.parquet(f"{tmp_path}/pages.parquet")
    found = {r.url: (r.page_type, r.decision, r.status) for r in QUERIES["stream_analysis"](spark, str(tmp_path)).collect()}
    kinds = {url: ("content-rich" if i % 2 else "mixed", "Done", "tier2_complete") for i, url, _ in pages}
    assert found == kinds


def test_equal_renders_of_a_hot_address_are_parsed_once_a_salt_group(spark, folder):
    """An address with many responses and many equal renders: the results are those of the lazy plan."""
    pages = [(i, f"https://example.com/{i if i % 2 else 'hot'}", SHELL) for i in range(60)]
    hot = responses(spark, [p[2] for p in pages]).drop("url").join(
        spark.createDataFrame(pages, "page_id bigint, url string, html string").drop("html"), "page_id"
    )
    full = '<meta name="description" content="{}"><p>' + "text " * 60
    renders = [(i, url, tier, url, full.format(f"{i % 2}{tier}"), 0) for i, url, _ in pages for tier in (3, 4)]
    renders += [(99, "https://example.com/hot", 3, "https://example.com/login", full.format("other"), 0)]
    rendered = spark.createDataFrame(renders, RENDERED_PAGES)

    def rows(result):
        return sorted((r.page_id, r.tier, r.decision, str(r.fields)) for r in result.select("page_id", "tier", "decision", "fields").collect())

    work = f"{folder}/hot"
    assert rows(run_cascade(hot, rendered, key="url", salts=4, work=work)) == rows(run_cascade(hot, rendered, key="url", salts=4))
    parsed = spark.read.parquet(f"{work}/tier3").groupBy("url").count().collect()
    assert {r.url: r["count"] <= 5 if r.url.endswith("hot") else r["count"] == 1 for r in parsed} == {p[1]: True for p in pages}


def test_a_run_with_nothing_left_shuffles_no_bodies(spark, folder):
    """A second run asks by the ids alone, and its stages are written empty."""
    path = f"{folder}/nothing-left"
    todo = responses(spark, [SHELL] * 3)
    rendered = spark.createDataFrame([(0, "https://example.com/0", 3, "https://example.com/0", "<p>" + "text " * 80, 0)], RENDERED_PAGES)
    first = run_batch(todo, rendered, path, "b", "1")
    expected = sorted(first.select("job_id", "tier", "decision").collect())
    stored = jobs.read_stages(spark, path).withColumn("batch_id", F.lit("b.2"))
    pending = batch_todo(todo.withColumn("job_id", jobs.job_id(F.col("url"), F.lit("b"))), stored, 1, 1)
    assert "Exchange" not in plan_of(pending) and pending.isEmpty()
    again = run_batch(todo, rendered, path, "b", "2")
    assert sorted(again.select("job_id", "tier", "decision").collect()) == expected
    assert jobs.read_stages(spark, path).filter(F.col("batch_id") == "b.2").isEmpty()


def test_elements_a_page_lacks_cost_no_expression(spark):
    """Extractors whose selectors match nothing are not evaluated: the plan asks for their elements first."""
    plan = plan_of(analyze(responses(spark, ["<p>x"])))
    assert not re.search(r"slice\([^,()]*nodes, 1, 0\)", plan)
