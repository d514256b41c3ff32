"""Enrichment of texts by request: four independent frames joined by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions.flags import ENRICHMENTS
from galley.functions.text import is_blank
from galley.operators.phrases import TOP_PHRASES, TOPIC_CONFIDENCE, TOPIC_WORDS, TOPICS, phrase_lists
from galley.operators.pii import pii_entities, redact
from galley.operators.sentiment import sentiment
from galley.operators.summary import summarize


def enrich_input(articles: DataFrame, normalized: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The text to enrich: the normalised one where there is one, else the clean text."""
    rows = articles.select(key, text).join(normalized.select(key, "normalized_text"), key, "left")
    given = F.when(F.length("normalized_text") > 0, F.col("normalized_text"))
    return rows.select(key, F.coalesce(given, F.col(text)).alias("text"), given.isNotNull().alias("is_normalized"))


def topic_lists(phrases: DataFrame, key: str) -> DataFrame:
    """``key, key_phrases, topics, top_phrases``: arrays in rank order, from the lists of ``phrase_lists``."""
    shown = F.transform("phrases", lambda p: p.dropFields("n_words"))
    short = F.filter("phrases", lambda p: (p.confidence > TOPIC_CONFIDENCE) & (p.n_words <= TOPIC_WORDS))
    return phrases.select(
        key,
        shown.alias("key_phrases"),
        F.transform(F.slice(short, 1, TOPICS), lambda p: F.initcap(p.text)).alias("topics"),
        F.slice(shown, 1, TOP_PHRASES).alias("top_phrases"),
    )


def enrich(
    texts: DataFrame, key: str = "doc_id", text: str = "text", limit: int | None = None
) -> DataFrame:
    """Add the requested enrichments to ``texts``, which carries the four boolean flags.

    Each operator sees only the texts that ask for it; a text it refuses has NULL there and the
    feature is missing from ``features_processed``. Nothing stops the job.
    """
    keyed = texts.select(key, F.col(text).alias("text"), *ENRICHMENTS).filter(~is_blank(F.col("text")))

    def asked(feature: str) -> DataFrame:
        return keyed.filter(F.col(feature)).select(key, "text")

    mood = sentiment(asked("sentiment"), key).select(
        key, F.struct("sentiment", "positive", "negative", "neutral", "mixed", "dominant_confidence").alias("mood")
    )
    found = pii_entities(asked("pii"), key).groupBy(key).agg(
        F.array_sort(
            F.collect_list(F.struct("begin_offset", "end_offset", "type", "text", "confidence"))
        ).alias("entities")
    )
    personal = (
        redact(asked("pii"), key)
        .join(found, key, "left")
        .select(
            key,
            F.struct(
                F.coalesce("entities", F.array().cast(found.schema["entities"].dataType)).alias("entities"),
                "has_pii",
                "pii_types",
                "redacted_text",
            ).alias("personal"),
        )
    )
    phrases = phrase_lists(asked("topics"), key)
    labels = asked("topics").select(key).join(topic_lists(phrases, key), key, "left")
    empty = F.array().cast("array<string>")
    labels = labels.select(
        key,
        F.struct("key_phrases", F.coalesce("topics", empty).alias("topics"), "top_phrases").alias("topic_analysis"),
        # says that there is a result without the lists, which so travel only to who reads them
        F.lit(True).alias(_HAS_TOPICS),
    )
    short = summarize(asked("summary"), key, limit=limit).select(
        key, F.struct("summary", "original_length", "summary_length", "compression_ratio").alias("digest")
    )
    rows = texts
    for frame in (mood, personal, labels, short):
        rows = rows.join(frame, key, "left")
    return rows.withColumn("features_processed", processed_features()).withColumn(
        "features_requested", requested_features()
    ).drop(_HAS_TOPICS)


_HAS_TOPICS = "_has_topics"
_RESULT_OF = {"sentiment": "mood", "pii": "personal", "topics": _HAS_TOPICS, "summary": "digest"}


def processed_features() -> Column:
    marks = [F.when(F.col(_RESULT_OF[f]).isNotNull(), F.lit(f)) for f in ENRICHMENTS]
    return F.filter(F.array(*marks), lambda f: f.isNotNull())


def requested_features() -> Column:
    marks = [F.when(F.col(f), F.lit(f)) for f in ENRICHMENTS]
    return F.filter(F.array(*marks), lambda f: f.isNotNull())


def call_counts(enriched: DataFrame, key: str = "doc_id") -> DataFrame:
    """Feature calls per text, by kind: word statistics, summaries, normalisation."""
    done = F.col("features_processed")
    language = sum(
        (F.array_contains(done, f).cast("int") for f in ("sentiment", "pii", "topics")), F.lit(0)
    )
    normalized = F.col("is_normalized").cast("int") if "is_normalized" in enriched.columns else F.lit(0)
    return enriched.select(
        key,
        language.alias("language_calls"),
        F.array_contains(done, "summary").cast("int").alias("summary_calls"),
        normalized.alias("normalization_calls"),
    )


def batch_report(enriched: DataFrame) -> DataFrame:
    """Texts in, succeeded (at least one feature), failed, and results per feature."""
    done = F.col("features_processed")
    return enriched.agg(
        F.count("*").alias("texts"),
        F.count_if(F.size(done) > 0).alias("succeeded"),
        F.count_if(F.size(done) == 0).alias("failed"),
        *[F.count_if(F.array_contains(done, f)).alias(f"{f}_results") for f in ENRICHMENTS],
    )
