"""The request job: requests and pages in; responses, errors and an outbox out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.functions.flags import ENRICHMENTS, FEATURES
from galley.operators.enrichment import enrich, enrich_input
from galley.operators.errors import error_rows, status_code
from galley.operators.normalization import normalize_corpus
from galley.operators.responses import build_response, response_json
from galley.operators.skew import salted_join
from galley.plans.articles import article_errors, extract_articles
from galley.session import stage
from galley.sources.requests import read_requests
from galley.sources.sinks import outbox


#: What a failed request got done, by step.
PARTIAL = "map<string, struct<success: boolean, error: string>>"


@dataclass
class RequestResults:
    """Frames of one run."""

    responses: DataFrame
    errors: DataFrame
    outbox: DataFrame


def process_requests(
    requests: DataFrame,
    pages: DataFrame,
    run_ts: str,
    rules: DataFrame | None = None,
    work_folder: str | None = None,
) -> RequestResults:
    """Answer every request from the page table.

    A request is answered from one page, the latest with its URL, so neither many requests for a URL
    nor many copies of a page multiply. Only asked-for pages are extracted, once each: the flags of
    all requests of a URL are merged, and a request then sees only what it asked for. Parsed requests,
    articles and results by page feed several branches and are written as Parquet in ``work_folder``
    (else ``spark.checkpoint.dir``) first.
    """
    parsed = stage(read_requests(requests), "requests", work_folder)
    valid = parsed.filter("error_type IS NULL")
    merged = valid.groupBy("url").agg(*[F.max(f).alias(f) for f in FEATURES])
    # one row per URL on both sides, then one per page: no key repeats in these joins
    latest = pages.groupBy("url").agg(F.max("page_id").alias("page_id"))
    asked_flags = latest.join(merged, "url").drop("url")
    asked_pages = pages.join(asked_flags.select("page_id"), "page_id", "left_semi")
    articles = stage(
        extract_articles(asked_pages, rules).join(asked_flags, "page_id"), "articles", work_folder
    )
    asks_normal = articles.filter("llm_normalization").select("page_id", "domain", F.col("clean_content").alias("text"))
    normalized = stage(normalize_corpus(asks_normal, "page_id", "text", "domain"), "normalized", work_folder)
    texts = enrich_input(
        articles.select("page_id", F.col("clean_content").alias("text")), normalized, "page_id"
    ).select("page_id", "text")
    flags = articles.select("page_id", *ENRICHMENTS)
    enriched = enrich(texts.join(flags, "page_id"), "page_id")
    results = (
        articles.drop(*FEATURES)
        .join(enriched.select("page_id", "mood", "personal", "topic_analysis", "digest"), "page_id", "left")
        .join(normalized.select("page_id", "normalized_text"), "page_id", "left")
    )
    # one row per page; responses and errors both read it
    results = stage(results, "results", work_folder)
    answered = salted_join(valid, results, ["url"], "request_id")
    found = answered.filter("page_id IS NOT NULL")
    for feature, column in (("sentiment", "mood"), ("pii", "personal"), ("topics", "topic_analysis"), ("summary", "digest")):
        found = found.withColumn(column, F.when(F.col(feature), F.col(column)))
    found = found.withColumn("normalized_text", F.when(F.col("llm_normalization"), F.col("normalized_text")))
    asked = F.filter(F.array(*[F.when(F.col(f), F.lit(f)) for f in ENRICHMENTS]), lambda f: f.isNotNull())
    done = F.filter(
        F.array(
            F.when(F.col("mood").isNotNull(), "sentiment"), F.when(F.col("personal").isNotNull(), "pii"),
            F.when(F.col("topic_analysis").isNotNull(), "topics"), F.when(F.col("digest").isNotNull(), "summary"),
        ),
        lambda f: f.isNotNull(),
    )
    found = found.withColumn("features_requested", asked).withColumn("features_processed", done)
    responses = build_response(found, run_ts)
    rejected = parsed.filter("error_type IS NOT NULL").select(
        "request_id", "url", "error_type", "message", F.lit("request_handling").alias("step"),
        F.lit(None).cast(PARTIAL).alias("partial_results"),
    )
    unusable = article_errors(asked_pages).select("url", F.col("message").alias("_why"))
    missing = salted_join(answered.filter("page_id IS NULL").select("request_id", "url"), unusable, ["url"], "request_id")
    failed = missing.select(
        "request_id",
        "url",
        F.lit("SCRAPING_ERROR").alias("error_type"),
        F.coalesce("_why", F.lit("Scraping failed")).alias("message"),
        F.lit("scraping").alias("step"),
        F.map_from_arrays(
            F.array(F.lit("scraping")),
            F.array(F.struct(F.lit(False).alias("success"), F.coalesce("_why", F.lit("Scraping failed")).alias("error"))),
        ).cast(PARTIAL).alias("partial_results"),
    )
    errors = error_rows(rejected.unionByName(failed), run_ts).withColumn(
        "status_code", status_code(F.col("error_type"), F.array())
    )
    return RequestResults(responses, errors, outbox(response_json(responses)))
