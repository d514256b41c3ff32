"""Requests, fetches, rules, responses and streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from galley.functions.flags import FEATURES
from galley.operators.alarms import duration_alarm, error_alarm, exact_percentile, rolling_duration_alarm, rolling_error_alarm
from galley.operators.fetches import resolve_fetches
from galley.plans.articles import extract_articles
from galley.plans.requests import process_requests
from galley.operators.responses import response_json
from galley.session import work_folder
from galley.sources.pages import PAGES, read_pages
from galley.sources.requests import read_requests
from galley.sources.rules import UNSUPPORTED, built_in_rules, load_site_rules, site_table, supported_domains, validate_site_rules
from galley.sources.sinks import write_articles
from galley.streaming.jobs import read_alarms, stream_alarms, stream_pages

LINE = "The council met on Monday evening and talked for hours about a good new bridge."


def requests(spark, *bodies):
    return spark.createDataFrame(list(enumerate(bodies)), "request_id LONG, body STRING")


def test_request_bodies(spark):
    rows = read_requests(
        requests(
            spark,
            '{"url": " https://a.org/x ", "features": {"sentiment": true, "pii": "YES", "topics": "2", "summary": 2, "external_api": 0}}',
            json.dumps({"body": json.dumps({"url": "https://a.org"})}),
            '{"body": {"url": "https://b.org"}, "other": 1}',
            "{}", '{"url": "  "}', '{"url": 5}', "{bad", "[]", '{"url": "u", "features": [1]}',
        )
    ).collect()
    assert rows[0].url == "https://a.org/x" and rows[0].enabled == ["sentiment", "pii", "summary"]
    assert [r.url for r in rows[1:3]] == ["https://a.org", "https://b.org"]
    assert [r.message for r in rows[3:]] == [
        "Missing required field: url", "URL must be a non-empty string", "URL must be a non-empty string",
        "Invalid JSON in request body", "Failed to parse request", "Failed to parse request",
    ]
    assert all(r.error_type == "VALIDATION_ERROR" and not any(r[f] for f in FEATURES) for r in rows[3:])


def test_bodies_are_parsed_once(spark):
    """However many flags and filters use a body, the plan parses it, and one inside it, once."""
    rows = read_requests(requests(spark, "{}")).filter("error_type IS NULL AND url > 'a' AND (sentiment OR pii)")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 2


def test_fetch_policy(spark):
    log = spark.createDataFrame(
        [("ok", 1, 200, None, 5.0), ("gone", 1, 404, None, 5.0), ("gone", 2, 200, None, 5.0), ("later", 1, 503, None, 5.0), ("later", 2, 200, None, 7.0),
         ("slow", 1, None, "Timeout", 1.0), ("slow", 2, None, "Timeout", 1.0), ("slow", 3, 429, None, 1.0), ("slow", 4, None, "Timeout", 1.0),
         ("slow", 5, 408, None, 1.0), ("loop", 1, None, "TooManyRedirects", 2.0), ("loop", 2, 200, None, 2.0)],
        "url STRING, attempt INT, status_code INT, exception STRING, duration_ms DOUBLE",
    )
    rows = {r.url: r for r in resolve_fetches(log).collect()}
    assert (rows["ok"].success, rows["ok"].attempts) == (True, 1)
    assert (rows["gone"].attempts, rows["gone"].error_message) == (1, "Page not found (404)")
    assert (rows["later"].success, rows["later"].attempts, rows["later"].fetch_time_ms) == (True, 2, 12.0)
    assert (rows["slow"].success, rows["slow"].attempts, rows["slow"].error_message) == (False, 5, "HTTP 408")
    assert (rows["loop"].attempts, rows["loop"].error_message) == (1, "Too many redirects")


def test_rules(spark, tmp_path):
    base = built_in_rules(spark)
    assert validate_site_rules(base).count() == 0
    assert supported_domains(base).count() == 4
    assert sorted(r.site for r in site_table(base).collect()) == ["*", "theguardian.com", "timesofindia.indiatimes.com"]
    good = {"title_selector": "h1", "content_selector": "main p"}
    path = tmp_path / "custom.json"
    path.write_text(json.dumps({"a.org": good, "theguardian.com": good, "b.org": {"title_selector": "h1"}}))
    rows = {r.domain: r for r in load_site_rules(spark, str(path)).collect()}
    assert rows["theguardian.com"].content_selector == "main p" and "b.org" not in rows and rows["a.org"].fallback_selectors == []
    path.write_text("{not json")
    assert load_site_rules(spark, str(path)).count() == 5
    bad = spark.createDataFrame(
        [("", "h1", " ", "a{b}", None, ["p", "", "x>y"])],
        "domain STRING, title_selector STRING, content_selector STRING, author_selector STRING, date_selector STRING, fallback_selectors ARRAY<STRING>",
    )
    faults = validate_site_rules(bad).collect()
    assert sorted(r.field for r in faults if r.message == UNSUPPORTED) == ["author_selector"]  # a child step is no longer left out
    assert sorted(r.field for r in faults if r.message != UNSUPPORTED) == [
        "author_selector", "content_selector", "content_selector", "domain", "fallback_selectors[1]", "fallback_selectors[2]",
    ]


def test_request_job(spark):
    body = "".join(f"<p>{LINE} Part {i} of it.</p>" for i in range(8))
    pages = spark.createDataFrame(
        [(1, "https://a.org/1", f"<article><h1>A long enough title</h1>{body}</article>"), (2, "https://a.org/2", None)], PAGES
    )
    asks = requests(
        spark,
        '{"url": "https://a.org/1", "features": {"sentiment": true, "summary": true, "external_api": true}}',
        '{"url": "https://a.org/1"}', '{"url": "https://a.org/2"}', '{"url": "https://nowhere.org"}', "{}",
    )
    results = process_requests(asks, pages, "2024-02-01T00:00:00Z")
    rows = {r.request_id: r for r in response_json(results.responses).collect()}
    full, basic = json.loads(rows[0].response), json.loads(rows[1].response)
    assert rows[0].status_code == rows[1].status_code == 200
    assert full["sentiment_analysis"]["sentiment"] == "POSITIVE" and full["summary"].endswith(".")
    assert full["article_metadata"]["title"] == "A long enough title"
    assert "sentiment_analysis" not in basic and "summary" not in basic
    errors = {r.request_id: (r.error_type, r.message, r.status_code) for r in results.errors.collect()}
    assert errors == {
        2: ("SCRAPING_ERROR", "HTML input is None", 400),
        3: ("SCRAPING_ERROR", "Scraping failed", 400),
        4: ("VALIDATION_ERROR", "Missing required field: url", 400),
    }
    sent = results.outbox.collect()
    assert [r.request_id for r in sent] == [0]


def test_article_sink(spark, sf_dir, tmp_path):
    articles = extract_articles(read_pages(spark, f"{sf_dir}/pages.parquet"))
    write_articles(articles, str(tmp_path / "articles"))
    back = spark.read.parquet(str(tmp_path / "articles"))
    assert back.count() == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    plan = back.filter(F.col("domain") == "x")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(domain" in plan


def test_stream_in_batches_equals_batch(spark, sf_dir, tmp_path):
    pages = read_pages(spark, f"{sf_dir}/pages.parquet")
    pages.repartition(3).write.parquet(str(tmp_path / "in"))
    query = stream_pages(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), files_per_batch=1)
    query.awaitTermination()
    columns = ["page_id", "title", "clean_content", "word_count"]
    streamed = spark.read.parquet(str(tmp_path / "out"))
    assert streamed.select("batch").distinct().count() == 3
    a = sorted(map(tuple, streamed.select(*columns).collect()), key=lambda r: r[0])
    b = sorted(map(tuple, extract_articles(pages).select(*columns).collect()), key=lambda r: r[0])
    assert a == b


def test_fetches_count_all_attempts(spark):
    log = spark.createDataFrame(
        [("zero", 0, 503, None, 1.0), ("zero", 1, 200, None, 2.0), ("late", 5, 503, None, 3.0), ("none", None, 404, None, 4.0),
         ("twice", 1, 503, None, 1.0), ("twice", 1, 502, None, 1.0), ("twice", 6, 200, None, 5.0)],
        "url STRING, attempt INT, status_code INT, exception STRING, duration_ms DOUBLE",
    )
    rows = {r.url: r for r in resolve_fetches(log).collect()}
    assert (rows["zero"].success, rows["zero"].attempts, rows["zero"].fetch_time_ms) == (True, 1, 3.0)
    assert (rows["late"].success, rows["late"].error_message) == (False, "HTTP 503")
    assert (rows["none"].success, rows["none"].error_message) == (False, "Page not found (404)")
    assert (rows["twice"].success, rows["twice"].attempts, rows["twice"].fetch_time_ms) == (True, 6, 6.0)
    assert set(rows) == {"zero", "late", "none", "twice"}
    limited = {r.url: r for r in resolve_fetches(log, max_attempt=4).collect()}
    assert not limited["twice"].success and "late" not in limited


def test_percentile_is_exact(spark):
    values = [(("a", "b", None)[k % 3], float((k * 7919) % 30_011) if k % 11 else None) for k in range(40_000)]
    found = {r.step: r.v for r in exact_percentile(spark.createDataFrame(values, "step STRING, v DOUBLE"), "step", "v", 95).collect()}
    for step in ("a", "b", None):
        own = sorted(v for s, v in values if s == step and v is not None)
        assert found[step] == own[-(-95 * len(own) // 100) - 1]


def test_a_cluster_needs_a_shared_folder():
    class Context:
        class _jsc:
            @staticmethod
            def sc():
                class Cluster:
                    @staticmethod
                    def isLocal():
                        return False

                return Cluster

    class Conf:
        @staticmethod
        def get(name, default=None):
            return default

    class Session:
        sparkContext, conf = Context, Conf

    with pytest.raises(ValueError):
        work_folder(Session)
    assert work_folder(Session, "hdfs://shared/work/") == "hdfs://shared/work"


EVENTS = "ts TIMESTAMP, event_type STRING, value DOUBLE, owner STRING"


def events(spark, *rows):
    """(minute of the day, type, value, owner)"""
    at = [(f"2024-03-01 {m // 60:02d}:{m % 60:02d}:30", kind, value, owner) for m, kind, value, owner in rows]
    frame = spark.createDataFrame(at, EVENTS.replace("TIMESTAMP", "STRING"))
    return frame.withColumn("ts", F.col("ts").cast("timestamp"))


def random_events(spark, seed):
    draw = random.Random(seed)
    rows = [
        (draw.randint(0, 200), draw.choice(["error", "error", "view", None]), draw.choice([None, 10.0, 400_000.0]), draw.choice(["a", "b"]))
        for _ in range(300)
    ]
    return events(spark, *sorted(rows, key=lambda r: r[0]))


def alarm_rows(frame):
    return sorted((tuple(str(v) for v in r) for r in frame.collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_rolling_alarms_equal_joined_ones(spark, seed):
    rows = random_events(spark, seed)
    assert alarm_rows(rolling_error_alarm(rows, 3)) == alarm_rows(error_alarm(rows, 3))
    assert alarm_rows(rolling_duration_alarm(rows, 150_000.0)) == alarm_rows(duration_alarm(rows, 150_000.0))
    assert {r.alarm for r in rolling_error_alarm(rows, 3).collect()} == {True, False}
    one = rolling_error_alarm(rows, 3, by=("owner",))
    for owner in "ab":
        own = rows.filter(F.col("owner") == owner)
        assert alarm_rows(one.filter(F.col("owner") == owner).drop("owner")) == alarm_rows(error_alarm(own, 3))
    single = rolling_error_alarm(rows, 3, periods=1)
    assert all(r.alarm == r.breach for r in single.collect())
    assert rolling_error_alarm(rows.limit(0)).count() == rolling_duration_alarm(rows.limit(0)).count() == 0


def write_files(frame, folder, minutes):
    """One file per stretch of minutes, in order of time."""
    minute = F.hour("ts") * 60 + F.minute("ts")
    for k in range(0, 240, minutes):
        part = frame.filter((minute >= k) & (minute < k + minutes))
        part.coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("alarm, threshold", [(rolling_error_alarm, 3), (rolling_duration_alarm, 150_000.0)])
def test_streamed_alarms_are_whole(spark, tmp_path, alarm, threshold):
    """Many batches, closed state, a run that stops and goes on: the same windows as a table gives."""
    rows = random_events(spark, 3)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)
        query = stream_alarms(alarm(stream, threshold, lateness_seconds=600), out, str(tmp_path / "state"))
        query.awaitTermination()
        return query.recentProgress

    early = rows.filter(F.hour("ts") < 2)
    write_files(early, folder, 7)
    run()
    assert alarm_rows(read_alarms(spark, out)) == alarm_rows(alarm(early, threshold))
    write_files(rows.filter(F.hour("ts") >= 2), folder, 7)
    progress = run()
    assert alarm_rows(read_alarms(spark, out)) == alarm_rows(alarm(rows, threshold))
    # state goes when the watermark passes: 200 minutes have 41 windows, the last of which stay
    assert progress[-1].stateOperators[0].numRowsTotal < 12


def test_late_events_are_dropped(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([(0, "error", 1.0, "a")], [(60, "error", 1.0, "a")], [(61, "error", 1.0, "a")], [(1, "error", 1.0, "a"), (55, "error", 1.0, "a")]):
        events(spark, *rows).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)
    stream_alarms(rolling_error_alarm(stream, 0, lateness_seconds=600), out, str(tmp_path / "state")).awaitTermination()
    found = {r.window_start.minute + 60 * r.window_start.hour: (r.errors, r.alarm) for r in read_alarms(spark, out).collect()}
    assert found == {0: (1, False), 55: (1, False), 60: (2, True)}


def test_streamed_table_may_be_one_file_or_a_folder(spark, tmp_path):
    """A table of a few part files has no file of the table's name."""
    from checks import inputs, jobs

    rows = [(i, f"https://a.org/{i}", f"<article><h1>T {i}</h1><p>{LINE}</p></article>") for i in range(6)]
    spark.createDataFrame(rows, PAGES).repartition(3).write.parquet(str(tmp_path / "many/pages.parquet"))
    assert {r.page_id for r in jobs.s7_stream_pages(spark, str(tmp_path / "many")).collect()} == set(range(6))
    spark.createDataFrame(rows, PAGES).coalesce(1).write.parquet(str(tmp_path / "one"))
    part = next((tmp_path / "one").glob("part-*.parquet"))
    part.rename(tmp_path / "pages.parquet")
    read = spark.readStream.schema(PAGES).parquet(inputs.arriving(str(tmp_path), "pages"))
    query = read.writeStream.format("memory").queryName("one_file").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("one_file").count() == 6
