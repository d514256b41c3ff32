"""Text functions and enrichment operators."""

import math
import random
import re
import uuid

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from galley.functions import text as t
from galley.functions.dates import parse_date
from galley.functions.scores import extraction_confidence, parse_confidence
from galley.functions.urls import domain_of, is_valid_url, site_key
from galley.operators.enrichment import enrich
from galley.operators.normalization import normalize_corpus
from galley.operators.normalized_store import NormalizedStore
from galley.operators.phrases import key_phrases, topics
from galley.operators.pii import pii_entities, redact
from galley.operators.scoring import score_with
from galley.operators.sentiment import sentiment
from galley.operators.skew import balanced_lookup, salted_join
from galley.operators.summary import summarize
from galley.streaming.jobs import stream_normalized

FUZZ = settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id LONG, text STRING")


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_urls(spark):
    rows = spark.createDataFrame(
        [("https://www.Example.com:80/a?b", True, "www.example.com:80", "example.com:80"),
         ("ftp://example.com", False, "example.com", "example.com"), ("example.com", False, "", ""), ("http://", False, "", "")],
        "url STRING, ok BOOLEAN, domain STRING, site STRING",
    )
    for r in rows.select("*", is_valid_url(F.col("url")).alias("a"), domain_of(F.col("url")).alias("b"), site_key(domain_of(F.col("url"))).alias("c")).collect():
        assert (r.a, r.b, r.c) == (r.ok, r.domain, r.site)


def test_clean_text(spark):
    cases = {
        "Advertisement Hello\n world": "Hello world",
        "By Ann The story goes on. Read more about it": "Ann The story goes on.",
        "Some text   Share on everything": "Some text",
        "Written by  Joe": "Joe",
    }
    for raw, clean in cases.items():
        assert one(spark, t.clean_text(F.lit(raw))) == clean
    assert one(spark, t.clean_block(F.lit(" Related:  more"))) == " more"


def test_quality_gate(spark):
    good = "Words of fair length make sentences. " * 10
    for text, expected in ((good, True), ("Short", False), ("", False), (None, False), ("word " * 60, False), ("a b. c! " * 40, False)):
        assert one(spark, t.is_good_content(F.lit(text).cast("string"))) is expected


def test_confidence(spark):
    high = parse_confidence(F.lit("A title of length"), F.lit("text"), F.lit("Ann"), F.current_timestamp(), F.lit(150))
    low = parse_confidence(F.lit(None).cast("string"), F.lit("x"), F.lit(None).cast("string"), F.lit(None).cast("timestamp"), F.lit(1))
    assert one(spark, high) == 1.0 and one(spark, low) == 0.0
    assert one(spark, extraction_confidence(F.lit(""), F.lit("readability"))) == 0.0
    assert one(spark, extraction_confidence(F.lit("word " * 210), F.lit("readability"))) == 0.8


def test_dates(spark):
    cases = {
        "2024-01-02T10:20:30+02:00": "2024-01-02 08:20:30", "2024-01-02T10:20:30Z": "2024-01-02 10:20:30",
        "2024-01-02 10:20:30": "2024-01-02 10:20:30", "2024-1-2": "2024-01-02 00:00:00", "03/04/2024": "2024-04-03 00:00:00",
        "01/15/2024": "2024-01-15 00:00:00", "january 5, 2024": "2024-01-05 00:00:00", "5 January 2024": "2024-01-05 00:00:00",
        "31/02/2024": None, "soon": None, "2024-01-02T10:20:30.123Z": None,
    }
    for raw, expected in cases.items():
        got = one(spark, F.date_format(parse_date(F.lit(raw)), "yyyy-MM-dd HH:mm:ss"))
        assert got == expected, raw


@FUZZ
@given(st.lists(st.text(alphabet="aé你😀 ", max_size=30), min_size=1, max_size=20), st.integers(0, 40))
def test_truncation(spark, values, limit):
    rows = texts(spark, *values).select("text", t.truncate_bytes(F.col("text"), limit).alias("cut")).collect()
    for r in rows:
        assert r.text.startswith(r.cut) and len(r.cut.encode()) <= limit
        rest = r.text[len(r.cut) :]
        assert not rest or len((r.cut + rest[0]).encode()) > limit


@FUZZ
@given(st.lists(st.lists(st.sampled_from(["a@b.org", "10.0.0.1", "1" * 16, "+1 (487) 555-7209", "é ", " x", ",", "9"]), max_size=12).map("".join), min_size=1, max_size=15))
def test_entity_offsets(spark, values):
    by_id = dict(enumerate(values))
    rows = pii_entities(texts(spark, *values)).collect()
    for r in rows:
        assert by_id[r.doc_id][r.begin_offset : r.end_offset] == r.text
    spans = sorted((r.doc_id, r.begin_offset, r.end_offset) for r in rows)
    for a, b in zip(spans, spans[1:]):
        assert a[0] != b[0] or a[2] <= b[1]
    flagged = {r.doc_id for r in redact(texts(spark, *values)).filter("has_pii").collect()}
    assert flagged == {r.doc_id for r in rows}


def test_sentiment(spark):
    rows = {r.doc_id: r for r in sentiment(texts(spark, "good great day", "bad bad", "good bad", "plain words", "123")).collect()}
    assert {k: r.sentiment for k, r in rows.items()} == {0: "POSITIVE", 1: "NEGATIVE", 2: "MIXED", 3: "NEUTRAL"}
    for r in rows.values():
        assert math.isclose(r.positive + r.negative + r.neutral + r.mixed, 1.0, abs_tol=1e-5)


def test_key_phrases(spark):
    docs = texts(spark, "River bridge opens. River bridge!", "The river floods", "A quiet town")
    rows = key_phrases(docs).collect()
    first = {r.text: r for r in rows if r.doc_id == 0}
    assert set(first) == {"river", "bridge", "opens", "river bridge", "bridge opens", "river bridge opens"}
    assert first["river bridge"].confidence == 1.0 and first["river bridge"].begin_offset == 0
    assert first["bridge opens"].begin_offset == 6 and first["bridge opens"].end_offset == 18
    assert all(0 < r.confidence <= 1 for r in rows)
    labels = [r.topic for r in topics(key_phrases(docs)).filter("doc_id = 0").orderBy("rank").collect()]
    assert labels[0] == "River Bridge" and len(labels) <= 5


def test_normalization(spark):
    rows = [(i, f"Own line {i}\nFooter of the site\nOwn line {i}", "s") for i in range(6)] + [(9, "Footer of the site", "s"), (10, "Footer of the site\nb", "t")]
    out = normalize_corpus(spark.createDataFrame(rows, "doc_id LONG, text STRING, source STRING")).collect()
    found = {r.doc_id: r.normalized_text for r in out}
    assert found[0] == "Own line 0" and 9 not in found and found[10] == "Footer of the site\nb"


def test_summary_of_text_without_sentences(spark):
    row = summarize(texts(spark, "too short. also short.")).first()
    assert (row.summary, row.summary_length, row.compression_ratio) == ("", 0, 0.0)


def test_scoring_survives_bad_rows(spark):
    def fn(part):
        if (part["text"] == "bad").any():
            raise ValueError("refused")
        return part.assign(n=part["text"].str.len())

    rows = {r.doc_id: r for r in score_with(texts(spark, "abc", "bad", "de"), fn, "n LONG").collect()}
    assert rows[0].n == 3 and rows[2].n == 2 and rows[0].error_type is None
    assert rows[1].n is None and rows[1].error_type == "ValueError" and rows[1].error_message == "refused"


@pytest.fixture
def counted_calls():
    """Makes a model that leaves a file for each call, named by the number of its rows."""

    def make(folder, fn):
        def call(part):
            (folder / f"{len(part)}-{uuid.uuid4().hex}").touch()
            return fn(part)

        return call

    return make


def test_one_bad_row_costs_few_calls(spark, tmp_path, counted_calls):
    def fn(part):
        if (part["doc_id"] == 7_321).any():
            raise ValueError("refused")
        return part.assign(n=part["doc_id"] * 2)

    frame = spark.range(10_000, numPartitions=1).withColumnRenamed("id", "doc_id")
    rows = score_with(frame, counted_calls(tmp_path, fn), "n LONG").collect()
    assert [r.doc_id for r in rows] == list(range(10_000))
    assert [r.doc_id for r in rows if r.error_type] == [7_321] and rows[7_322].n == 14_644
    assert len(list(tmp_path.iterdir())) <= 1 + 2 * 14


def test_models_that_lose_rows_or_fail_on_all(spark):
    def short(part):
        return part.assign(n=1).iloc[: max(1, len(part) - 1)]

    frame = spark.range(9, numPartitions=1).withColumnRenamed("id", "doc_id")
    assert [(r.doc_id, r.n) for r in score_with(frame, short, "n LONG").collect()] == [(k, 1) for k in range(9)]

    def broken(part):
        raise KeyError("n")

    rows = score_with(frame, broken, "n LONG").collect()
    assert [(r.doc_id, r.n, r.error_type) for r in rows] == [(k, None, "KeyError") for k in range(9)]
    assert score_with(frame.limit(0), broken, "n LONG").count() == 0


def test_batches_by_text_size(spark, tmp_path, counted_calls):
    calls, opened = tmp_path / "calls", tmp_path / "opened"
    calls.mkdir(), opened.mkdir()

    def load():
        (opened / uuid.uuid4().hex).touch()
        return counted_calls(calls, lambda part: part.assign(n=part["text"].str.len()))

    frame = texts(spark, "x" * 40, None, "x" * 50, "x" * 500, "", "x" * 60, "x" * 41, "x" * 10).coalesce(1)
    frame = frame.unionByName(frame).coalesce(1)
    scored = score_with(frame, schema="n LONG", load=load, text="text", batch_chars=100)
    assert [r.n for r in scored.collect()] == [40, None, 50, 500, 0, 60, 41, 10] * 2
    # 40 + 0 + 50, 500, 0 + 60, 41 + 10 + 40 + 0, 50, 500, 0 + 60, 41 + 10
    sizes = sorted(int(f.name.split("-")[0]) for f in calls.iterdir())
    assert sizes == [1, 1, 1, 2, 2, 2, 3, 4]
    assert len(list(opened.iterdir())) == 1
    by_rows = score_with(frame, lambda part: part.assign(n=len(part)), "n LONG", batch_rows=5).collect()
    assert [r.n for r in by_rows] == [5] * 15 + [1]
    with pytest.raises(ValueError):
        score_with(frame, schema="n LONG")


def test_enrichment_by_flag(spark):
    docs = spark.createDataFrame(
        [(1, "A good day for a@b.org and friends of the park.", True, True, False, True), (2, " ", True, True, True, True),
         (3, "Plain text stands here", False, False, True, False)],
        "doc_id LONG, text STRING, sentiment BOOLEAN, pii BOOLEAN, topics BOOLEAN, summary BOOLEAN",
    )
    rows = {r.doc_id: r for r in enrich(docs).collect()}
    assert rows[1].features_processed == ["sentiment", "pii", "summary"] and rows[1].topic_analysis is None
    assert rows[1].personal.redacted_text.startswith("A good day for [EMAIL]")
    assert rows[2].features_processed == [] and len(rows[2].features_requested) == 4
    assert rows[3].features_processed == ["topics"] and rows[3].mood is None


def test_joins_with_a_hot_key(spark):
    rows = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE CONCAT('k', id % 700) END AS k")
    lookup = rows.groupBy("k").agg(F.count("*").alias("n")).filter("k <> 'k5'")
    expected = sorted((r.id, r.n) for r in rows.join(lookup, "k", "left").select("id", "n").fillna(-1).collect())
    got = balanced_lookup(rows, lookup, ["k"], "n", "id", ["n"]).fillna(-1).collect()
    assert sorted((r.id, r.n) for r in got) == expected
    got = salted_join(rows, lookup, ["k"], "id").select("id", "n").fillna(-1).collect()
    assert sorted((r.id, r.n) for r in got) == expected


TEXTS = "doc_id LONG, text STRING, source STRING"


def forms(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "normalized_text", "original_length", "compression_ratio").collect()), key=repr)


def store_texts(spark, seed, ids):
    draw = random.Random(seed)
    pick = lambda: "\n".join(draw.choice(["ad", "menu", "share", f"story {draw.randint(0, 30)}", ""]) for _ in range(draw.randint(0, 6)))
    return [(i, draw.choice([None, "", pick(), pick(), pick()]), draw.choice(["x", "x", "y", None])) for i in ids]


def test_store_equals_one_run_over_the_last_versions(spark, tmp_path):
    store = NormalizedStore(spark, str(tmp_path / "store"), k=3)
    known = {}
    for batch, ids in enumerate([range(0, 40), range(40, 60), range(10, 50), [], [5, 70]]):
        rows = store_texts(spark, batch, ids)
        store.update(spark.createDataFrame(rows, TEXTS), batch)
        known |= {row[0]: row for row in rows}
        whole = normalize_corpus(spark.createDataFrame(list(known.values()), TEXTS), k=3)
        assert forms(store.read()) == forms(whole)
    assert store.batches() == [0, 1, 2, 3, 4]


def test_store_writes_only_texts_whose_lines_turn(spark, tmp_path):
    store = NormalizedStore(spark, str(tmp_path / "store"), k=3)
    frame = lambda *rows: spark.createDataFrame([(i, t, "x") for i, t in rows], TEXTS)
    store.update(frame((1, "ad\none"), (2, "ad\ntwo"), (3, "three"), (4, "four")), 0)
    assert forms(store.read())[0][1] == "ad\none"
    store.update(frame((5, "ad\nfive")), 1)
    assert sorted(r.doc_id for r in store.rewritten(1).collect()) == [1, 2]
    assert [r[1] for r in forms(store.read())] == ["one", "two", "three", "four", "five"]
    store.update(frame((6, "ad\nsix")), 2)
    assert store.rewritten(2).count() == 0
    store.update(frame((1, "one"), (2, "new")), 3)  # two texts lose the line: it is common no longer
    assert sorted(r.doc_id for r in store.rewritten(3).collect()) == [5, 6]
    assert [r[1] for r in forms(store.read())] == ["one", "new", "three", "four", "ad\nfive", "ad\nsix"]


def test_store_shows_whole_batches_only(spark, tmp_path):
    store = NormalizedStore(spark, str(tmp_path / "store"), k=2)
    with pytest.raises(ValueError):
        store.read()
    frame = lambda *rows: spark.createDataFrame([(i, t, "x") for i, t in rows], TEXTS)
    store.update(frame((1, "ad\none")), 0)
    boom = F.udf(lambda t: 1 / 0, "string")
    with pytest.raises(Exception):  # noqa: B017
        store.update(frame((2, "ad\ntwo")).withColumn("text", boom("text")), 1)
    # what a stopped run may leave behind
    spark.createDataFrame([(9, "left over", 1, 1, 1.0)], "doc_id LONG, normalized_text STRING, original_length INT, normalized_length INT, compression_ratio DOUBLE").write.mode("overwrite").parquet(str(tmp_path / "store/forms/batch=1"))
    assert [r[1] for r in forms(store.read())] == ["ad\none"]
    for _ in range(2):  # the same batch again
        store.update(frame((2, "ad\ntwo")), 1)
        assert [r[1] for r in forms(store.read())] == ["one", "two"]
    with pytest.raises(ValueError):
        store.update(frame((3, "x")), 0)


def test_store_from_a_stream(spark, tmp_path):
    rows = store_texts(spark, 9, range(60))
    folder = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], TEXTS).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(TEXTS).option("maxFilesPerTrigger", 1).parquet(folder)
    store = NormalizedStore(spark, str(tmp_path / "store"), k=3)
    stream_normalized(stream, store, str(tmp_path / "state")).awaitTermination()
    assert len(store.batches()) == 3
    assert forms(store.read()) == forms(normalize_corpus(spark.createDataFrame(rows, TEXTS), k=3))


def test_parts_of_texts_follow_their_size(spark, monkeypatch):
    """A task must not grow with the input, and grams and sentences stay in the task of their text."""
    from galley.operators import skew
    from galley.operators.summary import sentence_scores

    docs = texts(spark, *[f"The river bridge number {i} opens today. Another long line of words follows." for i in range(20)])
    size = docs.agg(F.sum(F.length("text"))).first()[0]
    monkeypatch.setattr(skew, "PART_CHARS", -(-size // 37))
    for frame in (key_phrases(docs), sentence_scores(docs)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert set(re.findall(r"Exchange hashpartitioning\(_bag#\d+L, (\d+)\)", plan)) == {"37"}
        assert not re.search(r"Exchange hashpartitioning\((doc_id|gram)", plan)
    assert sentence_scores(docs).count() == 40


def test_texts_that_share_a_key_or_have_none(spark):
    from galley.operators.summary import sentence_scores

    line = "The river bridge opens again today."
    docs = spark.createDataFrame([(1, line), (1, line), (None, line), (2, "A quiet town sleeps all day.")], "doc_id LONG, text STRING")
    scored = sorted(((r.doc_id or 0, r.score) for r in sentence_scores(docs).collect()))
    assert [k for k, _ in scored] == [0, 1, 1, 2] and scored[0][1] == 0 and scored[1][1] == scored[2][1] > 0
    assert {r.doc_id for r in key_phrases(docs).collect()} == {None, 1, 2}
