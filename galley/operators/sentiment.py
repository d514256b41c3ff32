"""Sentiment by word polarity: one narrow projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions.lexicon import NEGATIVE, POSITIVE, WORDS

SCORES = ("positive", "negative", "neutral", "mixed")


def sentiment(
    texts: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    positive: tuple[str, ...] = POSITIVE,
    negative: tuple[str, ...] = NEGATIVE,
) -> DataFrame:
    """``key, sentiment`` and four scores that sum to 1; texts without words give no row.

    With p and n hits among w words: mixed = 2 min(p, n) / w, positive = max(p - n, 0) / w, negative
    the other way round, neutral the rest. The label is NEUTRAL without hits, MIXED when the weaker
    side has at least half the hits of the stronger, else the stronger side.
    """
    rows = texts.select(key, F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0)).alias("words"))
    rows = rows.filter(F.size("words") > 0).select(
        key,
        F.size("words").alias("w"),
        F.size(F.filter("words", lambda x: x.isin(*positive))).alias("p"),
        F.size(F.filter("words", lambda x: x.isin(*negative))).alias("n"),
    )
    p, n, w = F.col("p"), F.col("n"), F.col("w")
    low, high = F.least(p, n), F.greatest(p, n)
    label = (
        F.when(high == 0, "NEUTRAL")
        .when((low > 0) & (low * 2 >= high), "MIXED")
        .when(p > n, "POSITIVE")
        .otherwise("NEGATIVE")
    )
    return rows.select(
        key,
        label.alias("sentiment"),
        F.round(F.greatest(p - n, F.lit(0)) / w, 6).alias("positive"),
        F.round(F.greatest(n - p, F.lit(0)) / w, 6).alias("negative"),
        F.round((w - low - high) / w, 6).alias("neutral"),
        F.round(low * 2 / w, 6).alias("mixed"),
    ).withColumn("dominant_confidence", dominant_confidence())


def dominant_confidence() -> Column:
    """The score that belongs to the label."""
    return (
        F.when(F.col("sentiment") == "POSITIVE", F.col("positive"))
        .when(F.col("sentiment") == "NEGATIVE", F.col("negative"))
        .when(F.col("sentiment") == "MIXED", F.col("mixed"))
        .otherwise(F.col("neutral"))
    )


def sentiment_eval(scored: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Label counts by toxicity mark, from the marked documents."""
    return (
        scored.join(labels.select(key, "toxic"), key)
        .groupBy("toxic", "sentiment")
        .agg(F.count("*").alias("n"))
    )
