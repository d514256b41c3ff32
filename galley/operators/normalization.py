"""Corpus normalisation: repeated lines and site-wide boilerplate lines are removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions.text import compression_ratio, eligibility_error, eligible_for_llm
from galley.operators.skew import balanced_lookup

SEEN_IN = 5
LINE_KEY = ["h1", "h2"]


def distinct_lines(text: Column) -> Column:
    """Distinct non-empty lines of a text in the order of their first places."""
    lines = F.transform(F.split(text, "\n"), lambda s: F.trim(s))
    return F.array_distinct(F.filter(lines, lambda line: line != ""))


def line_rows(texts: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """Distinct lines of each text as ``key, i`` and 128 bits of source and line.

    The hashes are what is counted and looked up; the lines stay with their text. A null source is a
    source like any other.
    """
    rows = texts.select(key, source, F.posexplode(distinct_lines(F.col(text))).alias("i", "line"))
    return rows.select(
        key, "i", F.xxhash64(source, "line").alias("h1"), F.xxhash64("line", F.lit(1), source).alias("h2")
    )


def common_lines(lines: DataFrame, k: int = SEEN_IN) -> DataFrame:
    """Lines that at least k texts of one source hold; counted with map-side combine."""
    return lines.groupBy(*LINE_KEY).agg(F.count("*").alias("seen")).filter(F.col("seen") >= k)


def normalize_corpus(
    texts: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    k: int = SEEN_IN,
    limit: int | None = None,
) -> DataFrame:
    """``key, normalized_text, original_length, normalized_length, compression_ratio``.

    A line is kept once per text, and not at all when k texts of the same source hold it. Texts that
    end up blank, and texts that are refused, are listed by ``normalization_errors``. There is no
    limit of length unless one is given.
    """
    return _normalized(texts, key, text, source, k, limit).filter("normalized_length > 0")


def _normalized(texts, key, text, source, k, limit) -> DataFrame:
    usable = texts.filter(eligible_for_llm(F.col(text), limit))
    lines = line_rows(usable, key, text, source)
    return without_common(usable, lines, common_lines(lines, k), key, text)


def without_common(texts: DataFrame, lines: DataFrame, common: DataFrame, key: str, text: str) -> DataFrame:
    """The texts without their lines among ``common(h1, h2, seen)``; ``lines`` are the ``line_rows`` of the texts."""
    # a line of very many texts is looked up by broadcast, its rows are spread
    marked = balanced_lookup(lines, common, LINE_KEY, "seen", key, ["seen"])
    gone = marked.filter("seen IS NOT NULL").groupBy(key).agg(F.collect_list("i").alias("gone"))
    rows = texts.select(key, text).join(gone, key, "left").withColumn("_lines", distinct_lines(F.col(text)))
    places = F.sequence(F.lit(0), F.size("_lines") - 1)
    left = F.when(F.col("gone").isNull(), F.col("_lines")).otherwise(
        F.transform(F.array_except(places, "gone"), lambda i: F.get("_lines", i))
    )
    kept = F.when(F.size("_lines") > 0, left).otherwise(F.col("_lines"))
    rows = rows.select(
        key, F.length(text).alias("original_length"), F.array_join(kept, "\n").alias("normalized_text")
    ).withColumn("normalized_length", F.length("normalized_text"))
    ratio = compression_ratio(F.col("normalized_length"), F.col("original_length"))
    return rows.select(
        key, "normalized_text", "original_length", "normalized_length", F.round(ratio, 6).alias("compression_ratio")
    )


def normalization_errors(
    texts: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    k: int = SEEN_IN,
    limit: int | None = None,
) -> DataFrame:
    """Texts without a normalised form, with the reason."""
    refused = texts.select(key, eligibility_error(F.col(text), limit).alias("message")).filter(
        "message IS NOT NULL"
    )
    emptied = _normalized(texts, key, text, source, k, limit).filter("normalized_length = 0")
    return refused.unionByName(emptied.select(key, F.lit("Empty normalized text").alias("message")))
