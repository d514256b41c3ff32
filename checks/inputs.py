"""Inputs that are derived from the given tables, the same way in Spark and in SQL.

The given pages carry no author, date, class (but ``ad``) or known site, and there is no request or
fetch table. Each derivation below adds what an operator needs to rows of a given table, so its size
grows with that table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arriving(sf_dir: str, name: str) -> str:
    """The path of a table for a stream, be it one file or a folder of them.

    It is a pattern that fits this path only: a stream takes a plain path for a folder.
    """
    return f"{sf_dir}/[{name[0]}]{name[1:]}.parquet"


DATED_HTML = """
  CASE WHEN page_id % 9 = 0 THEN html
  ELSE replace(html, '</h1>', concat('</h1><div class="byline">By Host ', page_id % 50, '</div>',
    CASE WHEN page_id % 5 = 0 THEN concat('<time>', shown, '</time>')
    ELSE concat('<time datetime="', shown, '">some day</time>') END)) END"""
DATED_URL = """
  CASE page_id % 4
    WHEN 0 THEN concat('https://www.theguardian.com/world/', page_id)
    WHEN 1 THEN concat('https://timesofindia.indiatimes.com/city/', page_id)
    ELSE url END"""
STYLED_HTML = """
  replace(replace(html, '<article>', concat(
      CASE page_id % 6
        WHEN 0 THEN '<div class="main-sidebar">side one two</div>'
        WHEN 1 THEN '<div style="display: none">hidden one two</div>'
        WHEN 2 THEN '<div data-ad="slot">slot one two</div>'
        WHEN 3 THEN '<div id="NewsLetter" data-widget="">letter one two</div>'
        WHEN 4 THEN '<section class="story"><p>lead one two three</p><a href="x">go</a></section>'
        ELSE '<div class=story-body data-widget=w>w one</div>' END,
      CASE WHEN page_id % 3 = 0 THEN '<article class="content story">' ELSE '<article>' END)),
    '<footer>', CASE WHEN page_id % 2 = 0 THEN '<h2 class="headline">A loaded line of text</h2><footer>'
                     ELSE '<footer>' END)"""


def shown_date(day: str, key: str, spoil: str) -> str:
    """SQL for a day printed in one of the accepted formats by ``key % 8``; the same text in both engines.

    ``day`` is a DATE expression, ``spoil`` a condition under which the text is no date.
    """
    y, m, d = f"year({day})", f"month({day})", f"day({day})"
    month = (
        f"CASE {m} WHEN 1 THEN 'January' WHEN 2 THEN 'February' WHEN 3 THEN 'March' WHEN 4 THEN 'April' "
        f"WHEN 5 THEN 'May' WHEN 6 THEN 'June' WHEN 7 THEN 'July' WHEN 8 THEN 'August' "
        f"WHEN 9 THEN 'September' WHEN 10 THEN 'October' WHEN 11 THEN 'November' ELSE 'December' END"
    )
    mm, dd = f"lpad(cast({m} AS {{text}}), 2, '0')", f"lpad(cast({d} AS {{text}}), 2, '0')"
    return (
        f"CASE WHEN {spoil} THEN concat('on ', {y}, ' or so') ELSE CASE {key} % 8 "
        f"WHEN 0 THEN concat({y}, '-', {mm}, '-', {dd}, 'T10:20:30+0200') "
        f"WHEN 1 THEN concat({y}, '-', {mm}, '-', {dd}, 'T10:20:30Z') "
        f"WHEN 2 THEN concat({y}, '-', {mm}, '-', {dd}, ' 10:20:30') "
        f"WHEN 3 THEN concat({y}, '-', {mm}, '-', {dd}) "
        f"WHEN 4 THEN concat({dd}, '/', {mm}, '/', {y}) "
        f"WHEN 5 THEN concat({m}, '/', {d}, '/', {y}) "
        f"WHEN 6 THEN concat({month}, ' ', {d}, ', ', {y}) "
        f"ELSE concat({d}, ' ', {month}, ' ', {y}) END END"
    )


def dialect(sql: str, engine: str) -> str:
    return sql.replace("{text}", "STRING" if engine == "spark" else "VARCHAR")


# a day of 2023 by page, kept as a DATE in both engines
PAGE_DAY = "date_add(DATE '2023-01-01', CAST(page_id % 365 AS INT))"
PAGE_DAY_SQL = "CAST(DATE '2023-01-01' + CAST(page_id % 365 AS INT) AS DATE)"
PAGE_SPOIL = "page_id % 11 = 0"


def dated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a byline and a date after the headline, half of them on sites with rules."""
    shown = dialect(shown_date("day", "page_id", PAGE_SPOIL), "spark")
    return (
        table(spark, sf_dir, "pages")
        .withColumn("day", F.expr(PAGE_DAY))
        .withColumn("shown", F.expr(shown))
        .select("page_id", F.expr(DATED_URL).alias("url"), F.expr(DATED_HTML).alias("html"))
    )


def styled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with classes, ids, hidden blocks and widgets around the article."""
    return table(spark, sf_dir, "pages").select("page_id", "url", F.expr(STYLED_HTML).alias("html"))


DATE_STRINGS_SPOIL = "o_orderkey % 10 = 9"


def date_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates printed in the accepted formats, every tenth one spoiled."""
    shown = dialect(shown_date("day", "o_orderkey", DATE_STRINGS_SPOIL), "spark")
    return (
        table(spark, sf_dir, "orders")
        .selectExpr("o_orderkey", "CAST(o_orderdate AS DATE) AS day")
        .selectExpr("o_orderkey", f"{shown} AS text")
    )


REQUEST_BODY = """
  CASE WHEN page_id % 13 = 0 THEN concat('{"url": "', url)
  WHEN page_id % 11 = 0 THEN '{"features": {"sentiment": true}}'
  WHEN page_id % 17 = 0 THEN '{"url": "  ", "features": {}}'
  ELSE concat('{"url": "', url, '", "features": {',
    CASE page_id % 7
      WHEN 0 THEN '"sentiment": true, "pii": "yes", "topics": "0", "summary": 1, "external_api": true'
      WHEN 1 THEN '"sentiment": "ON", "topics": 0, "external_api": "no"'
      WHEN 2 THEN ''
      WHEN 3 THEN '"llm_normalization": "True", "summary": 2.5, "pii": null'
      WHEN 4 THEN '"sentiment": false, "pii": true, "topics": true, "summary": true, "external_api": "1"'
      WHEN 5 THEN '"topics": "2", "sentiment": [1], "summary": "yes"'
      ELSE '"llm_normalization": true, "sentiment": true, "pii": true, "topics": true, "summary": true' END,
    '}}') END"""


def request_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per page: a JSON body with flags in many spellings, some bodies broken."""
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("request_id"), F.expr(REQUEST_BODY).alias("body")
    )


FETCH_LOG = """
  concat('https://host', CAST(event_id {div} 6 AS {text}), '.example.com/a') AS url,
  CAST(event_id % 6 + 1 AS INT) AS attempt,
  CASE WHEN event_type IN ('view', 'click') AND event_id % 4 = 0 THEN 200
       WHEN event_type = 'signup' AND event_id % 3 = 0 THEN 404
       WHEN event_type = 'purchase' THEN 429
       WHEN event_type = 'error' AND event_id % 5 = 1 THEN NULL
       WHEN event_type = 'error' AND event_id % 5 = 2 THEN NULL
       WHEN event_type = 'click' AND event_id % 9 = 1 THEN 403
       ELSE 503 END AS status_code,
  CASE WHEN event_type = 'error' AND event_id % 5 = 1 THEN 'Timeout'
       WHEN event_type = 'error' AND event_id % 5 = 2 THEN
         CASE WHEN event_id % 2 = 0 THEN 'TooManyRedirects' ELSE 'ConnectionError' END
       END AS exception,
  value AS duration_ms"""


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to six attempts per URL, made from consecutive events."""
    exprs = FETCH_LOG.replace("{text}", "STRING").replace("{div}", "DIV")
    events = table(spark, sf_dir, "events")
    events.createOrReplaceTempView("_galley_events")
    return spark.sql(f"SELECT {exprs} FROM _galley_events")


RULE_ROWS = """
  host AS domain,
  CASE WHEN page_id % 5 = 0 THEN '' WHEN page_id % 5 = 1 THEN 'h1, h2.headline' ELSE 'h1' END AS title_selector,
  CASE WHEN page_id % 7 = 0 THEN 'div > p' WHEN page_id % 7 = 1 THEN NULL ELSE 'article p' END AS content_selector,
  CASE WHEN page_id % 3 = 0 THEN '.byline' WHEN page_id % 3 = 1 THEN 'a(b)' END AS author_selector,
  CASE WHEN page_id % 4 = 0 THEN 'time' END AS date_selector"""
RULE_HOST = """
  CASE WHEN page_id % 10 = 3 THEN '' WHEN page_id % 10 = 4 THEN concat('bad_', page_id, '!')
  ELSE lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) END"""


def rule_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A proposed site rule per page, good and bad ones."""
    table(spark, sf_dir, "pages").createOrReplaceTempView("_galley_pages")
    return spark.sql(
        f"SELECT page_id, {RULE_ROWS}, CASE WHEN page_id % 6 = 0 THEN array('main p', '', 'p{{') "
        f"ELSE array('section p') END AS fallback_selectors "
        f"FROM (SELECT *, {RULE_HOST} AS host FROM _galley_pages)"
    )


STAGE_ERRORS = """
  page_id, url,
  CASE page_id % 7 WHEN 0 THEN 'TIMEOUT_ERROR' WHEN 1 THEN 'CONNECTION_ERROR' WHEN 2 THEN 'AWS_SERVICE_ERROR'
    WHEN 3 THEN 'SCRAPING_ERROR' WHEN 4 THEN 'VALIDATION_ERROR' WHEN 5 THEN 'EXTERNAL_API_ERROR'
    ELSE 'PROCESSING_ERROR' END AS error_type,
  CASE page_id % 4 WHEN 0 THEN 'scraping' WHEN 1 THEN 'llm_normalization' WHEN 2 THEN 'nlp_enrichment'
    ELSE 'pipeline' END AS step,
  CASE page_id % 6 WHEN 0 THEN 'ThrottlingException' WHEN 1 THEN 'ServiceUnavailableException'
    WHEN 2 THEN 'ValidationException' WHEN 3 THEN 'ReadTimeoutError' WHEN 4 THEN 'BotoCoreError'
    ELSE 'Odd' END AS error_code,
  concat('failed on ', page_id) AS message"""


def stage_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One failed stage per page, over all error types, steps and service codes."""
    table(spark, sf_dir, "pages").createOrReplaceTempView("_galley_pages")
    return spark.sql(f"SELECT {STAGE_ERRORS} FROM _galley_pages")
