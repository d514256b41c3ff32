"""Reports over whole tables; every aggregate combines before it shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions.markup import tag_name


def removed_report(rows: DataFrame) -> DataFrame:
    """Removed elements per page and reason, from DOM rows.

    Every removed node counts once; a pattern match inside an element that is removed by its tag
    is gone before patterns are tried and does not count.
    """
    return (
        rows.select("page_id", counted_reason().alias("reason"))
        .filter("reason IS NOT NULL")
        .groupBy("page_id", "reason")
        .agg(F.count("*").alias("n"))
    )


def counted_reason() -> Column:
    """The reason a DOM row counts as removed, NULL where it does not."""
    kind, reason = F.col("kind"), F.col("reason")
    return F.when(
        reason.isNotNull() & (~reason.startswith("pattern") | ~F.col("in_removed_tag")), reason
    ).when(kind == "skip", F.col("skipped"))


def skipped_reason(token):
    """The reason of a token without nodes: a comment, a script or a style."""
    return F.when(token.startswith("<!--"), "comment").when(
        token.rlike(r"(?i)^<(script|style)"), F.concat(F.lit("script_style:"), tag_name(token))
    )


def corpus_report(articles: DataFrame) -> DataFrame:
    """Articles, words and mean confidence per domain and method, with subtotals."""
    return articles.rollup("domain", F.col("extractor_method").alias("method")).agg(
        F.count("*").alias("articles"),
        F.sum("word_count").alias("words"),
        F.round(F.avg("confidence_score"), 6).alias("mean_confidence"),
    )
