"""The parser branch: title, author, date and body from selectors, with fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions.dates import parse_date
from galley.functions.scores import FALLBACK_FACTOR, parse_confidence
from galley.functions.text import block_words, word_count
from galley.operators.records import hits_of, whole_text

FALLBACK_BELOW = 0.5


def _by_priority(field: str) -> Column:
    """Hits ordered by selector priority, then document order (hits are sorted by field, priority, pos)."""
    return hits_of(field)


def first_text(field: str, accept) -> Column:
    """The first text among the hits of a field that ``accept`` takes; NULL when there is none."""
    texts = F.transform(_by_priority(field), lambda h: whole_text(h.pos, h.end))
    return F.get(F.filter(texts, accept), F.lit(0))


def first_title(field: str) -> Column:
    return first_text(field, lambda t: F.length(t) > 10)


def first_author(field: str) -> Column:
    return first_text(field, lambda t: (F.length(t) > 0) & (F.length(t) < 100))


def _date_text(h: Column) -> Column:
    return F.when(F.length(h.datetime) > 0, h.datetime).otherwise(whole_text(h.pos, h.end))


def first_date(field: str) -> Column:
    """The date of the first hit that has a datetime attribute or text, even if it does not parse."""
    texts = F.filter(F.transform(_by_priority(field), _date_text), lambda t: F.length(t) > 0)
    return parse_date(F.get(texts, F.lit(0)))


def generic_date_texts(priorities: int = 5) -> Column:
    """Per generic date selector, the text its first dated hit shows; selectors without one are left out."""

    def first_shown(i: Column) -> Column:
        texts = F.filter(F.transform(hits_of("g_date", i), _date_text), lambda t: F.length(t) > 0)
        return F.get(texts, F.lit(0))

    shown = F.transform(F.sequence(F.lit(0), F.lit(priorities - 1)), first_shown)
    return F.filter(shown, lambda t: t.isNotNull())


def first_parsed(texts: Column) -> Column:
    """The date of the first text that parses."""
    dates = F.transform(texts, lambda t: parse_date(t))
    return F.get(F.filter(dates, lambda d: d.isNotNull()), F.lit(0))


def paragraphs_of(field: str, priority: Column | int | None = None) -> Column:
    """Texts of more than 5 words among the hits of a field."""
    texts = F.transform(hits_of(field, priority), lambda h: whole_text(h.pos, h.end))
    return F.filter(texts, lambda t: word_count(t) > 5)


def fallback_lists() -> Column:
    """Per fallback selector, in order: its name and its paragraphs."""
    return F.transform(
        "fallback_selectors",
        lambda s, i: F.struct(
            F.concat(F.lit("fallback_"), F.replace(s, F.lit(" "), F.lit("_"))).alias("method"),
            paragraphs_of("fallback", i).alias("paragraphs"),
        ),
    )


def generic_lists(priorities: int = 6) -> Column:
    """Per generic selector, its paragraphs; only lists of more than two are kept."""
    lists = F.transform(F.sequence(F.lit(0), F.lit(priorities - 1)), lambda i: paragraphs_of("g_content", i))
    return F.filter(lists, lambda found: F.size(found) > 2)


def choose_fallback(lists: Column, generic: Column) -> Column:
    """The first list of more than two paragraphs; else the last list; else the generic paragraphs.

    ``lists`` and ``generic`` are columns that hold ``fallback_lists`` and ``generic_lists``.
    """
    rich = F.get(F.filter(lists, lambda c: F.size(c.paragraphs) > 2), F.lit(0))
    last = F.try_element_at(lists, F.lit(-1)).paragraphs
    empty = F.array().cast("array<string>")
    return (
        F.when(F.exists(lists, lambda c: F.size(c.paragraphs) > 2), rich)
        .when(F.size(last) > 0, F.struct(F.lit("generic_fallback").alias("method"), last.alias("paragraphs")))
        .otherwise(
            F.struct(
                F.lit("generic_extraction").alias("method"),
                F.coalesce(F.get(generic, F.lit(0)), empty).alias("paragraphs"),
            )
        )
    )


def parse(records: DataFrame) -> DataFrame:
    """Add ``title, author, publish_date, content, extraction_method, confidence_score``.

    The site's selectors go first. Only where they score below 0.5 are the fallback selectors
    evaluated, and they are taken only when they score strictly higher.
    """
    rows = records.select(
        "*",
        first_title("title").alias("site_title"),
        first_author("author").alias("site_author"),
        first_date("date").alias("site_date"),
        paragraphs_of("content").alias("site_paragraphs"),
        F.concat(F.lit("site_specific_"), F.col("rule_domain")).alias("site_method"),
    )
    rows = _scored(rows, "site")
    weak = F.col("site_confidence") < FALLBACK_BELOW
    rows = rows.select(
        "*",
        F.when(weak, fallback_lists()).alias("_lists"),
        F.when(weak, generic_lists()).alias("_generic"),
        F.when(weak, generic_date_texts()).alias("_dates"),
    )
    choice = F.when(weak, choose_fallback(F.col("_lists"), F.col("_generic")))
    rows = rows.select(
        "*",
        choice.alias("_fallback"),
        F.when(weak, first_title("g_title")).alias("fallback_title"),
        F.when(weak, first_author("g_author")).alias("fallback_author"),
        first_parsed(F.col("_dates")).alias("fallback_date"),
    )
    rows = rows.select(
        "*",
        F.col("_fallback.paragraphs").alias("fallback_paragraphs"),
        F.col("_fallback.method").alias("fallback_method"),
    )
    rows = _scored(rows, "fallback", FALLBACK_FACTOR)
    better = F.coalesce(F.col("fallback_confidence") > F.col("site_confidence"), F.lit(False))
    rows = rows.withColumn("_better", weak & better)

    def pick(name: str) -> Column:
        return F.when(F.col("_better"), F.col(f"fallback_{name}")).otherwise(F.col(f"site_{name}"))

    return rows.select(
        "*",
        pick("title").alias("title"),
        pick("author").alias("author"),
        pick("date").alias("publish_date"),
        pick("content").alias("content"),
        pick("words").alias("parsed_words"),
        F.size(pick("paragraphs")).alias("parsed_paragraphs"),
        pick("method").alias("extraction_method"),
        pick("confidence").alias("confidence_score"),
    ).drop("_fallback", "_better", "_lists", "_generic", "_dates")


def _scored(rows: DataFrame, prefix: str, factor: float = 1.0) -> DataFrame:
    """Add the joined content, its word count and the confidence of one parse."""
    content = F.col(f"{prefix}_content")
    rows = rows.withColumn(f"{prefix}_content", F.array_join(f"{prefix}_paragraphs", "\n\n"))
    rows = rows.withColumn(f"{prefix}_words", word_count(content))
    confidence = parse_confidence(
        F.col(f"{prefix}_title"), content, F.col(f"{prefix}_author"), F.col(f"{prefix}_date"),
        F.col(f"{prefix}_words"),
    )
    return rows.withColumn(f"{prefix}_confidence", F.round(confidence * factor, 6))
