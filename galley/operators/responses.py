"""The response of a request, assembled from article and enrichment columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions.flags import FEATURES
from galley.operators.errors import failure_note, feature_failures, processing_errors, status_code


def iso(stamp: str) -> Column:
    return F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss")


def build_response(rows: DataFrame, run_ts: str) -> DataFrame:
    """Add ``response`` (a struct), ``failed_features``, ``processing_errors`` and ``status_code``.

    ``rows`` hold the article columns, the enrichment structs, the six flags and ``normalized_text``.
    The run time stamp is an argument, so a job can be repeated with the same result.
    """
    done = F.col("features_processed")
    rows = rows.withColumn("failed_features", feature_failures(F.col("features_requested"), done))
    no_text = F.when(F.length("clean_content") == 0, F.lit("no text found"))
    not_normalized = F.when(F.col("llm_normalization") & F.col("normalized_text").isNull(), F.lit("no text left"))
    errors = processing_errors(no_text, not_normalized, failure_note(F.col("failed_features")))
    rows = rows.withColumn("processing_errors", errors)
    rows = rows.withColumn("status_code", status_code(F.lit(None).cast("string"), F.col("processing_errors")))
    calls = F.struct(
        *[
            sum((F.array_contains(done, f).cast("int") for f in group), F.lit(0)).alias(name)
            for name, group in (("language", ("sentiment", "pii", "topics")), ("summary", ("summary",)))
        ]
    )
    mood = F.col("mood")
    response = F.struct(
        F.lit(True).alias("success"),
        F.struct(
            "url", "title", "author", iso("publish_date").alias("publish_date"),
            F.lit(run_ts).alias("scrape_timestamp"), "domain",
        ).alias("article_metadata"),
        F.col("clean_content").alias("extracted_content"),
        F.col("normalized_text").alias("normalized_content"),
        F.when(
            mood.isNotNull(),
            F.struct(
                mood.sentiment.alias("sentiment"),
                F.struct(
                    mood.positive.alias("POSITIVE"), mood.negative.alias("NEGATIVE"),
                    mood.neutral.alias("NEUTRAL"), mood.mixed.alias("MIXED"),
                ).alias("confidence_scores"),
                mood.dominant_confidence.alias("dominant_confidence"),
            ),
        ).alias("sentiment_analysis"),
        F.col("personal").alias("pii_detection"),
        F.col("topic_analysis").alias("topic_analysis"),
        F.col("digest.summary").alias("summary"),
        F.struct(
            F.struct(*FEATURES).alias("features_enabled"),
            calls.alias("service_calls"),
            F.col("processing_errors").alias("errors_encountered"),
            "extraction_method",
            F.col("confidence_score").alias("extraction_confidence"),
        ).alias("processing_metadata"),
        F.lit(run_ts).alias("timestamp"),
    )
    return rows.withColumn("response", response)


def response_json(rows: DataFrame) -> DataFrame:
    """The response struct as JSON text."""
    return rows.withColumn("response", F.to_json("response"))
