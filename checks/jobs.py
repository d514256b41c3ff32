"""Registered request, status, report and alarm queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs
from checks import oracle_html as h
from checks import oracle_text as o
from galley.functions.flags import ENRICHMENTS, FEATURES
from galley.operators.alarms import (
    rolling_duration_alarm,
    rolling_error_alarm,
    duration_alarm,
    error_alarm,
    step_metrics,
)
from galley.operators.enrichment import batch_report, call_counts, enrich, enrich_input
from galley.operators.errors import (
    classify_errors,
    error_rows,
    failure_note,
    feature_failures,
    processing_errors,
    status_code,
)
from galley.operators.fetches import resolve_fetches
from galley.operators.normalization import normalize_corpus
from galley.operators.responses import response_json
from galley.plans.articles import extract_articles
from galley.plans.requests import process_requests
from galley.session import new_path
from galley.sources.pages import read_pages
from galley.sources.requests import read_requests
from galley.sources.sinks import write_articles, write_responses
from galley.streaming.jobs import read_alarms, stream_alarms, stream_pages

RUN_TS = "2024-02-01T00:00:00Z"


def _requests(spark, sf_dir):
    return read_requests(inputs.request_bodies(spark, sf_dir))


def _results(spark, sf_dir):
    pages = inputs.table(spark, sf_dir, "pages")
    return process_requests(inputs.request_bodies(spark, sf_dir), pages, RUN_TS)


def _flagged_docs(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        F.expr("CASE WHEN doc_id % 25 = 7 THEN ' ' ELSE text END").alias("text"),
        F.expr("doc_id % 2 = 0").alias("sentiment"),
        F.expr("doc_id % 3 = 0").alias("pii"),
        F.expr("doc_id % 4 < 2").alias("topics"),
        F.expr("doc_id % 5 < 3").alias("summary"),
    )


def s2_read_requests(spark, sf_dir):
    return _requests(spark, sf_dir).select("request_id", "url", "error_type", "message")


def p5_parse_flags(spark, sf_dir):
    return _requests(spark, sf_dir).select("request_id", *FEATURES)


def p6_enabled_features(spark, sf_dir):
    return _requests(spark, sf_dir).select(
        "request_id", F.array_join("enabled", ",").alias("enabled"), (F.size("enabled") == 0).alias("basic_only")
    )


def s3_write_articles(spark, sf_dir):
    folder = new_path(spark, "articles")
    write_articles(extract_articles(inputs.table(spark, sf_dir, "pages")), folder)
    written = spark.read.parquet(folder)
    return written.select(
        "page_id", "domain", "title", "word_count", "extraction_method", F.sha2(F.col("clean_content").cast("binary"), 256).alias("content_sha")
    )


def s4_outbox(spark, sf_dir):
    sent = _results(spark, sf_dir).outbox

    def field(path: str):
        return F.get_json_object("payload", path)

    return sent.select(
        "request_id", field("$.article_metadata.url").alias("url"), field("$.article_metadata.title").alias("title"),
        F.length(field("$.extracted_content")).alias("content_chars"), field("$.sentiment_analysis.sentiment").alias("sentiment"),
        field("$.pii_detection.redacted_text").alias("redacted"), field("$.topic_analysis.topics[0]").alias("first_topic"),
        field("$.summary").alias("summary"),
    )


def s3_write_responses(spark, sf_dir):
    folder = new_path(spark, "responses")
    write_responses(response_json(_results(spark, sf_dir).responses).select("request_id", "response"), folder)
    written = spark.read.parquet(folder)
    url = F.get_json_object("response", "$.article_metadata.url").alias("url")
    return written.select("request_id", url, F.length(F.get_json_object("response", "$.extracted_content")).alias("content_chars"))


def s6_resolve_fetches(spark, sf_dir):
    return resolve_fetches(inputs.fetch_log(spark, sf_dir))


def s7_stream_pages(spark, sf_dir):
    folder = new_path(spark, "stream")
    stream_pages(spark, inputs.arriving(sf_dir, "pages"), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(
        "page_id", "domain", "title", "extractor_method", "word_count", F.sha2(F.col("clean_content").cast("binary"), 256).alias("content_sha")
    )


def t1_error_alarm(spark, sf_dir):
    rows = error_alarm(inputs.table(spark, sf_dir, "events"), threshold=1)
    return rows.select(_minute(), "errors", "breach", "alarm")


def _streamed(spark, sf_dir, alarms, **options):
    """What a stream over the whole event file says in the end."""
    folder = new_path(spark, "alarms")
    schema = inputs.table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(inputs.arriving(sf_dir, "events"))
    stream_alarms(alarms(events, lateness_seconds=600, **options), f"{folder}/out", f"{folder}/state").awaitTermination()
    return read_alarms(spark, f"{folder}/out")


def t1_error_alarm_stream(spark, sf_dir):
    rows = _streamed(spark, sf_dir, rolling_error_alarm, threshold=1)
    return rows.select(_minute(), "errors", "breach", "alarm")


def t1_error_alarm_by_user_group(spark, sf_dir):
    """One alarm series per group of users, over three periods in a row."""
    events = inputs.table(spark, sf_dir, "events").withColumn("group", F.col("user_id") % 3)
    rows = rolling_error_alarm(events, threshold=0, by=("group",), periods=3)
    return rows.select("group", _minute(), "errors", "breach", "alarm")


def t2_duration_alarm_stream(spark, sf_dir):
    rows = _streamed(spark, sf_dir, rolling_duration_alarm, threshold=60.0)
    return rows.select(_minute(), "mean_ms", "breach", "alarm")


def t2_duration_alarm(spark, sf_dir):
    rows = duration_alarm(inputs.table(spark, sf_dir, "events"), threshold=60.0)
    return rows.select(_minute(), "mean_ms", "breach", "alarm")


def _minute():
    return F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start")


def a9_step_metrics(spark, sf_dir):
    return step_metrics(inputs.table(spark, sf_dir, "events"))


def j7_enrich_input(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents")
    normalized = normalize_corpus(docs)
    return enrich_input(docs, normalized)


def j8_enrich(spark, sf_dir):
    rows = enrich(_flagged_docs(spark, sf_dir))
    return rows.select(
        "doc_id",
        F.array_join("features_requested", ",").alias("requested"),
        F.array_join("features_processed", ",").alias("processed"),
        F.col("mood.sentiment").alias("mood"),
        F.size("personal.entities").alias("n_entities"),
        F.array_join("personal.pii_types", ",").alias("pii_types"),
        F.array_join("topic_analysis.topics", "|").alias("topics"),
        F.size("topic_analysis.top_phrases").alias("n_phrases"),
        F.col("digest.summary").alias("summary"),
    )


def a6_call_counts(spark, sf_dir):
    docs = _flagged_docs(spark, sf_dir)
    given = enrich_input(docs.select("doc_id", "text"), normalize_corpus(inputs.table(spark, sf_dir, "documents"))).select("doc_id", "is_normalized")
    return call_counts(enrich(docs).join(given, "doc_id"))


def a7_batch_report(spark, sf_dir):
    return batch_report(enrich(_flagged_docs(spark, sf_dir)))


def o1_build_response(spark, sf_dir):
    rows = response_json(_results(spark, sf_dir).responses)

    def field(path: str):
        return F.get_json_object("response", path)

    return rows.select(
        "request_id",
        field("$.article_metadata.url").alias("url"),
        field("$.article_metadata.title").alias("title"),
        field("$.article_metadata.domain").alias("domain"),
        field("$.article_metadata.scrape_timestamp").alias("scraped"),
        F.length(field("$.extracted_content")).alias("content_chars"),
        F.length(field("$.normalized_content")).alias("normalized_chars"),
        field("$.sentiment_analysis.sentiment").alias("sentiment"),
        field("$.pii_detection.redacted_text").alias("redacted"),
        field("$.topic_analysis.topics[0]").alias("first_topic"),
        F.size(F.from_json(field("$.topic_analysis.key_phrases"), "array<struct<text: string>>")).cast("long").alias("n_key_phrases"),
        field("$.summary").alias("summary"),
        field("$.processing_metadata.features_enabled.pii").alias("pii_enabled"),
        field("$.processing_metadata.extraction_method").alias("method"),
        "status_code",
    )


def o2_feature_failures(spark, sf_dir):
    rows = enrich(_flagged_docs(spark, sf_dir))
    failed = feature_failures(F.col("features_requested"), F.col("features_processed"))
    return rows.select("doc_id", F.array_join(failed, ",").alias("failed"), failure_note(failed).alias("note"))


def o3_status_code(spark, sf_dir):
    results = _results(spark, sf_dir)
    return results.responses.select("request_id", "status_code").unionByName(
        results.errors.select("request_id", "status_code")
    )


def o4_error_rows(spark, sf_dir):
    rows = error_rows(inputs.stage_errors(spark, sf_dir), RUN_TS)

    def field(path: str):
        return F.get_json_object("response", path)

    return rows.select(
        "page_id",
        field("$.error.type").alias("type"),
        field("$.error.step").alias("step"),
        field("$.error.message").alias("message"),
        field("$.error.recoverable").alias("recoverable"),
        field("$.error.retry_recommended").alias("retry"),
        field("$.article_metadata.url").alias("url"),
    )


def o4_request_errors(spark, sf_dir):
    partial = F.get_json_object("response", "$.partial_results.scraping.success").alias("scraped")
    return _results(spark, sf_dir).errors.select("request_id", "error_type", "message", "step", partial)


def o5_processing_errors(spark, sf_dir):
    rows = inputs.stage_errors(spark, sf_dir)
    errors = processing_errors(
        F.when(F.col("step") == "scraping", F.col("message")),
        F.when(F.col("error_type").isin("TIMEOUT_ERROR", "CONNECTION_ERROR"), F.col("message")),
        F.when(F.col("step") == "nlp_enrichment", F.concat(F.lit("NLP enrichment failed: "), "message")),
    )
    return rows.select(
        "page_id",
        F.array_join(errors, " / ").alias("errors"),
        status_code(F.lit(None).cast("string"), errors).alias("status_code"),
    )


def j9_classify_errors(spark, sf_dir):
    return classify_errors(inputs.stage_errors(spark, sf_dir)).select(
        "page_id", "error_class", "retryable", "recoverable", "retry_recommended", F.array_join("hints", "|").alias("hints")
    )


QUERIES = {
    name: f
    for name, f in list(globals().items())
    if callable(f) and getattr(f, "__module__", None) == __name__ and name[0] in "spjaot" and name[1].isdigit()
}

# requests in SQL ------------------------------------------------------------------------------
_BODY = f"SELECT page_id AS request_id, {inputs.REQUEST_BODY} AS body FROM pages"
_REQ = f"""rq AS MATERIALIZED (SELECT request_id, j, CASE WHEN j IS NULL THEN 'Invalid JSON in request body'
      WHEN json_extract(j, '$.url') IS NULL THEN 'Missing required field: url'
      WHEN trim(json_extract_string(j, '$.url')) = '' THEN 'URL must be a non-empty string' END AS message
    FROM (SELECT request_id, TRY_CAST(body AS JSON) AS j FROM ({_BODY})))"""


def _flag(name: str) -> str:
    v = f"json_extract(j, '$.features.{name}')"
    s = f"json_extract_string(j, '$.features.{name}')"
    return (
        f"coalesce(message IS NULL AND CASE json_type({v}) WHEN 'BOOLEAN' THEN {s} = 'true' WHEN 'VARCHAR' THEN lower({s}) IN ('true','1','yes','on') "
        f"WHEN 'UBIGINT' THEN CAST({s} AS DOUBLE) <> 0 WHEN 'BIGINT' THEN CAST({s} AS DOUBLE) <> 0 WHEN 'DOUBLE' THEN CAST({s} AS DOUBLE) <> 0 ELSE false END, false)"
    )


_FLAGS = ", ".join(f"{_flag(f)} AS {f}" for f in FEATURES)
_URL = "CASE WHEN message IS NULL THEN trim(json_extract_string(j, '$.url')) END"
_RQ = f"WITH {_REQ}, fl AS MATERIALIZED (SELECT request_id, {_URL} AS url, message, {_FLAGS} FROM rq)"
_ON = ", ".join(f"CASE WHEN {f} THEN '{f}' END" for f in FEATURES)

_DOCS = """(SELECT doc_id, CASE WHEN doc_id % 25 = 7 THEN ' ' ELSE text END AS text, doc_id % 2 = 0 AS sentiment, doc_id % 3 = 0 AS pii,
    doc_id % 4 < 2 AS topics, doc_id % 5 < 3 AS summary FROM documents)"""


def _enriched(source: str, key: str) -> str:
    """Select of every enrichment per key; ``source`` has text and the four flags."""
    def only(flag: str) -> str:
        return f"(SELECT * FROM {source} WHERE {flag} AND regexp_matches(text, {o.q(o.WORD)}))"

    topics = (
        f"SELECT {key}, string_agg(topic, '|' ORDER BY rank) AS topics FROM (SELECT {key}, rank, {o.TITLE} AS topic FROM "
        f"({o.ranked('WHERE confidence > 0.8', 5, key)})) GROUP BY ALL"
    )
    counts = f"SELECT {key}, least(count(*), 10) AS n_phrases, count(*) AS n_key_phrases FROM kp GROUP BY ALL"
    return f"""SELECT s.*, m.sentiment AS mood, r.redacted_text, r.has_pii, r.pii_types AS pii_found, coalesce(n.n, 0) AS n_entities, tp.topics AS topic_list,
        tn.n_phrases, tn.n_key_phrases, sm.summary AS digest
      FROM {source} s LEFT JOIN ({o.sentiment(only('sentiment'), key)}) m USING ({key})
      LEFT JOIN ({o.redact(only('pii'), key)}) r USING ({key})
      LEFT JOIN (SELECT {key}, count(*) AS n FROM ({o.pii_entities(only('pii'), key)}) GROUP BY ALL) n USING ({key})
      LEFT JOIN ({o.grams(only('topics'), key)} {topics}) tp USING ({key})
      LEFT JOIN ({o.grams(only('topics'), key)} {counts}) tn USING ({key})
      LEFT JOIN ({o.sentences(only('summary'), key)} SELECT * FROM sm) sm USING ({key})"""


_NB = f"regexp_matches(text, {o.q(o.WORD)})"
_DONE = (
    "CASE WHEN mood IS NOT NULL THEN 'sentiment' END, CASE WHEN redacted_text IS NOT NULL THEN 'pii' END, "
    f"CASE WHEN topics AND {_NB} THEN 'topics' END, CASE WHEN digest IS NOT NULL THEN 'summary' END"
)
_ASKED = ", ".join(f"CASE WHEN {f} THEN '{f}' END" for f in ENRICHMENTS)


def _list(parts: str) -> str:
    return f"list_filter([{parts}], lambda x: x IS NOT NULL)"


_EN = f"WITH en AS MATERIALIZED ({_enriched(_DOCS, 'doc_id')}), pr AS (SELECT *, {_list(_DONE)} AS done, {_list(_ASKED)} AS asked FROM en)"
_FAILED = "list_sort(list_filter(asked, lambda x: NOT list_contains(done, x)))"

# the request job: articles, merged flags, normalised and enriched texts, answers
_ET_FLAGS = ", ".join(f"max({f}) AS {f}" for f in FEATURES)
_ANSWERS = f"""WITH ar AS MATERIALIZED (SELECT * FROM ({h.articles_ctes(h.PLAIN)} {h.ARTICLES})),
{_REQ}, fl AS MATERIALIZED (SELECT request_id, {_URL} AS url, message, {_FLAGS} FROM rq),
mg AS MATERIALIZED (SELECT url, {_ET_FLAGS} FROM fl WHERE message IS NULL GROUP BY ALL),
am AS MATERIALIZED (SELECT ar.page_id, ar.domain, ar.clean_content, mg.* EXCLUDE url FROM ar JOIN mg USING (url)),
nz AS MATERIALIZED (SELECT page_id, normalized_text FROM ({o.normalized('(SELECT * FROM am WHERE llm_normalization)', 'page_id', 'clean_content', 'domain')} SELECT * FROM nm) WHERE normalized_text <> ''),
et AS MATERIALIZED (SELECT page_id, coalesce(nz.normalized_text, clean_content) AS text, sentiment, pii, topics, summary FROM am LEFT JOIN nz USING (page_id)),
en AS MATERIALIZED ({_enriched('et', 'page_id')}),
an AS MATERIALIZED (
  SELECT fl.request_id, fl.url, fl.pii AS pii_enabled, ar.title, ar.domain, length(ar.clean_content) AS content_chars, ar.extraction_method AS method,
    CASE WHEN fl.llm_normalization THEN length(nz.normalized_text) END AS normalized_chars, fl.llm_normalization, fl.external_api, CASE WHEN fl.topics THEN en.n_key_phrases END AS n_key_phrases,
    CASE WHEN fl.sentiment THEN en.mood END AS sentiment, CASE WHEN fl.pii THEN en.redacted_text END AS redacted,
    CASE WHEN fl.topics THEN string_split(en.topic_list, '|')[1] END AS first_topic, CASE WHEN fl.summary THEN en.digest END AS summary,
    (fl.sentiment AND en.mood IS NULL) OR (fl.pii AND en.redacted_text IS NULL) OR (fl.summary AND en.digest IS NULL)
      OR (fl.topics AND NOT regexp_matches(en.text, {o.q(o.WORD)})) OR (fl.llm_normalization AND nz.normalized_text IS NULL)
      OR ar.clean_content = '' AS partial
  FROM fl JOIN ar ON ar.url = fl.url LEFT JOIN nz USING (page_id) LEFT JOIN en USING (page_id) WHERE fl.message IS NULL)"""

_SERVICE = "CASE error_code WHEN 'ThrottlingException' THEN 'RATE_LIMIT' WHEN 'ServiceUnavailableException' THEN 'SERVICE_ERROR' WHEN 'ValidationException' THEN 'CLIENT_ERROR' WHEN 'ReadTimeoutError' THEN 'TIMEOUT' WHEN 'BotoCoreError' THEN 'SDK_ERROR' ELSE 'UNKNOWN' END"
_STAGE = f"(SELECT {inputs.STAGE_ERRORS} FROM pages)"


def _hints_sql() -> str:
    from galley.operators.errors import STEP_HINTS, TYPE_HINTS

    by_type = " ".join(f"WHEN {o.q(t)} THEN {o.q('|'.join(v))}" for t, v in TYPE_HINTS.items())
    by_step = " ".join(f"WHEN {o.q(s)} THEN {o.q(v)}" for s, v in STEP_HINTS.items())
    return f"concat_ws('|', CASE error_type {by_type} END, CASE step {by_step} END)"


_LOG = f"(SELECT {inputs.FETCH_LOG.replace('{text}', 'VARCHAR').replace('{div}', '//')} FROM events)"
_FINAL = "(status_code = 200 OR (status_code BETWEEN 400 AND 499 AND status_code <> 429) OR exception = 'TooManyRedirects')"
_WINDOW = "time_bucket(INTERVAL '5 minutes', ts)"


def _alarm(source: str, value: str, test: str) -> str:
    return (
        f"SELECT strftime(w, '%Y-%m-%d %H:%M') AS window_start, {value}, {test} AS breach, {test} AND coalesce(lag(w) OVER (ORDER BY w) = w - INTERVAL '5 minutes' "
        f"AND lag({test}) OVER (ORDER BY w), false) AS alarm FROM ({source})"
    )


_ERRORS = f"SELECT {_WINDOW} AS w, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY ALL"

ORACLE = {
    "s2_read_requests": f"{_RQ} SELECT request_id, url, CASE WHEN message IS NOT NULL THEN 'VALIDATION_ERROR' END AS error_type, message FROM fl",
    "p5_parse_flags": f"{_RQ} SELECT request_id, {', '.join(FEATURES)} FROM fl",
    "p6_enabled_features": f"{_RQ} SELECT request_id, array_to_string(l, ',') AS enabled, len(l) = 0 AS basic_only FROM (SELECT request_id, {_list(_ON)} AS l FROM fl)",
    "s3_write_articles": f"{h.articles_ctes(h.PLAIN)} SELECT page_id, domain, title, word_count, extraction_method, sha256(clean_content) AS content_sha FROM ({h.ARTICLES})",
    "s4_outbox": f"{_ANSWERS} SELECT request_id, url, title, content_chars, sentiment, redacted, first_topic, summary FROM an WHERE external_api",
    "s3_write_responses": f"{_ANSWERS} SELECT request_id, url, content_chars FROM an",
    "s6_resolve_fetches": f"""WITH lg AS (SELECT * FROM {_LOG}),
      fin AS (SELECT url, coalesce(min(attempt) FILTER ({_FINAL}), max(attempt)) AS attempts FROM lg GROUP BY ALL)
      SELECT url, coalesce(l.status_code = 200, false) AS success, CASE WHEN l.status_code = 200 THEN 200 ELSE 0 END AS status_code, f.attempts,
        round((SELECT sum(duration_ms) FROM lg x WHERE x.url = f.url AND x.attempt <= f.attempts), 6) AS fetch_time_ms,
        CASE WHEN l.status_code = 200 THEN NULL WHEN exception = 'Timeout' THEN 'Request timeout' WHEN exception = 'ConnectionError' THEN 'Connection error - unable to reach server'
          WHEN exception = 'TooManyRedirects' THEN 'Too many redirects' WHEN status_code = 403 THEN 'Access forbidden (403) - possible bot detection'
          WHEN status_code = 404 THEN 'Page not found (404)' WHEN status_code = 429 THEN 'Rate limited (429) - too many requests' ELSE concat('HTTP ', status_code) END AS error_message
      FROM fin f JOIN lg l USING (url) WHERE l.attempt = f.attempts""",
    "s7_stream_pages": f"{h.articles_ctes(h.PLAIN)} SELECT page_id, domain, p.title, extractor_method, word_count, sha256(clean_content) AS content_sha FROM ex JOIN (SELECT page_id, title FROM pr) p USING (page_id)",
    "t1_error_alarm": _alarm(_ERRORS, "errors", "errors > 1"),
    "t1_error_alarm_stream": _alarm(_ERRORS, "errors", "errors > 1"),
    "t1_error_alarm_by_user_group": f"""WITH w AS (SELECT user_id % 3 AS "group", {_WINDOW} AS w, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY ALL)
      SELECT a."group", strftime(a.w, '%Y-%m-%d %H:%M') AS window_start, a.errors, true AS breach, (b.w IS NOT NULL AND c.w IS NOT NULL) AS alarm FROM w a
      LEFT JOIN w b ON b."group" = a."group" AND b.w = a.w - INTERVAL '5 minutes' LEFT JOIN w c ON c."group" = a."group" AND c.w = a.w - INTERVAL '10 minutes'""",
    "t2_duration_alarm_stream": _alarm(f"SELECT {_WINDOW} AS w, round(avg(value), 6) AS mean_ms FROM events GROUP BY ALL", "mean_ms", "mean_ms > 60"),
    "t2_duration_alarm": _alarm(f"SELECT {_WINDOW} AS w, round(avg(value), 6) AS mean_ms FROM events GROUP BY ALL", "mean_ms", "mean_ms > 60"),
    "a9_step_metrics": "SELECT event_type AS step, count(*) AS calls, round(avg(value), 6) AS mean_ms, min(value) AS min_ms, max(value) AS max_ms, quantile_disc(value, 0.95) AS p95_ms FROM events GROUP BY ALL",
    "j7_enrich_input": f"""SELECT d.doc_id, coalesce(n.normalized_text, d.text) AS text, n.normalized_text IS NOT NULL AS is_normalized FROM documents d LEFT JOIN (
      SELECT * FROM ({o.normalized()} SELECT * FROM nm) WHERE normalized_text <> '') n USING (doc_id)""",
    "j8_enrich": f"""{_EN} SELECT doc_id, array_to_string(asked, ',') AS requested, array_to_string(done, ',') AS processed, mood, CASE WHEN redacted_text IS NULL THEN NULL ELSE n_entities END AS n_entities,
      pii_found AS pii_types, CASE WHEN topics AND {_NB} THEN coalesce(topic_list, '') END AS topics, n_phrases, digest AS summary FROM pr""",
    "a6_call_counts": f"{_EN} SELECT doc_id, len(list_filter(done, lambda x: x <> 'summary')) AS language_calls, CASE WHEN list_contains(done, 'summary') THEN 1 ELSE 0 END AS summary_calls, CASE WHEN n.doc_id IS NULL THEN 0 ELSE 1 END AS normalization_calls FROM pr LEFT JOIN (SELECT doc_id FROM ({o.normalized()} SELECT * FROM nm) WHERE normalized_text <> '') n USING (doc_id)",
    "a7_batch_report": f"{_EN} SELECT count(*) AS texts, count(*) FILTER (len(done) > 0) AS succeeded, count(*) FILTER (len(done) = 0) AS failed, "
    + ", ".join(f"count(*) FILTER (list_contains(done, '{f}')) AS {f}_results" for f in ENRICHMENTS)
    + " FROM pr",
    "o1_build_response": f"""{_ANSWERS} SELECT request_id, url, title, domain, '{RUN_TS}' AS scraped, content_chars, normalized_chars, sentiment, redacted, first_topic, n_key_phrases, summary,
      CAST(pii_enabled AS VARCHAR) AS pii_enabled, method, CASE WHEN partial THEN 206 ELSE 200 END AS status_code FROM an""",
    "o2_feature_failures": f"{_EN} SELECT doc_id, array_to_string({_FAILED}, ',') AS failed, CASE WHEN len({_FAILED}) > 0 THEN concat('Some NLP features failed: ', array_to_string({_FAILED}, ', ')) END AS note FROM pr",
    "o3_status_code": f"{_ANSWERS} SELECT request_id, CASE WHEN partial THEN 206 ELSE 200 END AS status_code FROM an UNION ALL SELECT request_id, 400 FROM fl WHERE message IS NOT NULL",
    "o4_error_rows": f"""SELECT page_id, error_type AS type, step, message, CAST(error_type IN ('TIMEOUT_ERROR','CONNECTION_ERROR','HTTP_ERROR','AWS_SERVICE_ERROR','EXTERNAL_API_ERROR') AS VARCHAR) AS recoverable,
      CAST(error_type IN ('TIMEOUT_ERROR','CONNECTION_ERROR','AWS_SERVICE_ERROR') AS VARCHAR) AS retry, url FROM {_STAGE}""",
    "o4_request_errors": f"{_RQ} SELECT request_id, 'VALIDATION_ERROR' AS error_type, message, 'request_handling' AS step, NULL AS scraped FROM fl WHERE message IS NOT NULL",
    "o5_processing_errors": f"""SELECT page_id, errors, CASE WHEN errors = '' THEN 200 ELSE 206 END AS status_code FROM (SELECT page_id, concat_ws(' / ', CASE WHEN step = 'scraping' THEN concat('Extraction: ', message) END,
      CASE WHEN error_type IN ('TIMEOUT_ERROR','CONNECTION_ERROR') THEN concat('LLM normalization failed: ', message) END,
      CASE WHEN step = 'nlp_enrichment' THEN concat('NLP enrichment failed: ', message) END) AS errors FROM {_STAGE})""",
    "j9_classify_errors": f"""SELECT page_id, {_SERVICE} AS error_class, {_SERVICE} NOT IN ('CLIENT_ERROR', 'UNKNOWN') AS retryable,
      error_type IN ('TIMEOUT_ERROR','CONNECTION_ERROR','AWS_SERVICE_ERROR','EXTERNAL_API_ERROR') AS recoverable,
      error_type IN ('TIMEOUT_ERROR','CONNECTION_ERROR','AWS_SERVICE_ERROR') AS retry_recommended, {_hints_sql()} AS hints FROM {_STAGE}""",
}
