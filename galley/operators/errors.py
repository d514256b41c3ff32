"""Error rows: classes, retry advice and hints from fixed rule tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Service error codes, their class and whether a retry helps.
SERVICE_CODES = {
    "ReadTimeoutError": ("TIMEOUT", True),
    "ConnectTimeoutError": ("TIMEOUT", True),
    "ThrottlingException": ("RATE_LIMIT", True),
    "TooManyRequestsException": ("RATE_LIMIT", True),
    "InternalServerError": ("SERVICE_ERROR", True),
    "ServiceUnavailableException": ("SERVICE_ERROR", True),
    "ValidationException": ("CLIENT_ERROR", False),
    "AccessDeniedException": ("CLIENT_ERROR", False),
    "BotoCoreError": ("SDK_ERROR", True),
}
# Error types that may be recovered from, and those worth a retry.
RECOVERABLE = ("TIMEOUT_ERROR", "CONNECTION_ERROR", "HTTP_ERROR", "AWS_SERVICE_ERROR", "EXTERNAL_API_ERROR")
RETRYABLE = ("TIMEOUT_ERROR", "CONNECTION_ERROR", "AWS_SERVICE_ERROR")
# Troubleshooting hints by error type and by step.
TYPE_HINTS = {
    "VALIDATION_ERROR": [
        "Check that the URL is valid and accessible",
        "Ensure feature flags are boolean values",
        "Verify request body contains required fields",
    ],
    "SCRAPING_ERROR": [
        "Verify the URL is accessible and returns HTML content",
        "Check if the website blocks automated requests",
        "Try again later if the site is temporarily unavailable",
    ],
    "AWS_SERVICE_ERROR": [
        "Check AWS credentials and permissions",
        "Verify AWS service availability in your region",
        "Check if you've exceeded service quotas or rate limits",
    ],
    "TIMEOUT_ERROR": [
        "The request took longer than expected to complete",
        "Try again with a shorter article or fewer features enabled",
        "Check network connectivity to external services",
    ],
    "CONFIGURATION_ERROR": [
        "Check environment variables are properly set",
        "Verify configuration files are valid and accessible",
        "Ensure AWS region and service endpoints are correct",
    ],
    "EXTERNAL_API_ERROR": [
        "Check external API endpoint configuration",
        "Verify authentication credentials",
        "Check if external API is available and accepting requests",
    ],
}
STEP_HINTS = {
    "scraping": "Consider checking if the website has changed its structure",
    "llm_normalization": "Try processing without LLM normalization enabled",
    "nlp_enrichment": "Try processing with fewer NLP features enabled",
}


def error_rules(spark: SparkSession) -> DataFrame:
    """Rule rows per service error code (a fixed, tiny table)."""
    rows = json.dumps([{"error_code": c, "error_class": k, "retryable": r} for c, (k, r) in SERVICE_CODES.items()])
    schema = "ARRAY<STRUCT<error_code: STRING, error_class: STRING, retryable: BOOLEAN>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(rows), schema)))


def hints(error_type: Column, step: Column) -> Column:
    """Hints for an error type, then the one for its step."""
    by_type = F.from_json(F.lit(json.dumps(TYPE_HINTS)), "MAP<STRING, ARRAY<STRING>>")
    by_step = F.from_json(F.lit(json.dumps(STEP_HINTS)), "MAP<STRING, STRING>")
    none = F.array().cast("array<string>")
    step_hint = F.try_element_at(by_step, step)
    return F.concat(
        F.coalesce(F.try_element_at(by_type, error_type), none),
        F.when(step_hint.isNotNull(), F.array(step_hint)).otherwise(none),
    )


def classify_errors(errors: DataFrame) -> DataFrame:
    """Add class and retry advice by service code, and recoverability and hints by type and step."""
    rules = F.broadcast(error_rules(errors.sparkSession))  # nine rows
    rows = errors.join(rules, "error_code", "left")
    return rows.select(
        *errors.columns,
        F.coalesce("error_class", F.lit("UNKNOWN")).alias("error_class"),
        F.coalesce("retryable", F.lit(False)).alias("retryable"),
        F.col("error_type").isin(*RECOVERABLE).alias("recoverable"),
        F.col("error_type").isin(*RETRYABLE).alias("retry_recommended"),
        hints(F.col("error_type"), F.col("step")).alias("hints"),
    )


def error_rows(errors: DataFrame, run_ts: str) -> DataFrame:
    """Error responses as JSON, from rows with ``url, error_type, message, step``.

    A column ``partial_results``, where there is one, says what was done before the failure.
    """
    at = F.lit(run_ts)
    partial = ["partial_results"] if "partial_results" in errors.columns else []
    body = F.struct(
        F.lit(False).alias("success"),
        F.struct(
            F.col("error_type").alias("type"),
            "message",
            "step",
            at.alias("timestamp"),
            F.col("error_type").isin(*RECOVERABLE).alias("recoverable"),
            F.col("error_type").isin(*RETRYABLE).alias("retry_recommended"),
            hints(F.col("error_type"), F.col("step")).alias("troubleshooting_hints"),
        ).alias("error"),
        F.struct("url", at.alias("scrape_timestamp")).alias("article_metadata"),
        *partial,
        at.alias("timestamp"),
    )
    return errors.withColumn("response", F.to_json(body))


def feature_failures(requested: Column, processed: Column) -> Column:
    """Requested features that were not processed, sorted."""
    return F.array_sort(F.array_except(requested, processed))


def failure_note(failed: Column) -> Column:
    """The error line for failed features, NULL when none failed. The wording is a fixed value."""
    return F.when(
        F.size(failed) > 0, F.concat(F.lit("Some NLP features failed: "), F.array_join(failed, ", "))
    )


def processing_errors(extraction: Column, normalization: Column, enrichment: Column) -> Column:
    """The list of error lines of one article, with fixed prefixes; NULL parts are left out."""
    parts = F.array(
        F.concat(F.lit("Extraction: "), extraction),
        F.concat(F.lit("LLM normalization failed: "), normalization),
        enrichment,
    )
    return F.filter(parts, lambda e: e.isNotNull())


def status_code(error_type: Column, errors: Column) -> Column:
    """400 for validation and scraping errors, 500 for other errors, 206 for partial results, else 200."""
    return (
        F.when(error_type.isin("VALIDATION_ERROR", "SCRAPING_ERROR"), 400)
        .when(error_type.isNotNull(), 500)
        .when(F.size(errors) > 0, 206)
        .otherwise(200)
    )
