"""Personal data by pattern: entities with character offsets, and redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galley.functions.lexicon import singles

_DIGIT = f"[{singles('0-9')}]"
_ALNUM = singles("A-Z", "a-z", "0-9")
# Entity types in priority order and their patterns.
PATTERNS = (
    ("EMAIL", rf"[{_ALNUM}._%+-]+@[{_ALNUM}.-]+\.[{singles('A-Z', 'a-z')}]{{2,}}"),
    ("IP_ADDRESS", rf"{_DIGIT}{{1,3}}\.{_DIGIT}{{1,3}}\.{_DIGIT}{{1,3}}\.{_DIGIT}{{1,3}}"),
    ("CREDIT_DEBIT_NUMBER", rf"{_DIGIT}{{16}}"),
    ("PHONE", rf"\+?{_DIGIT}{{1,2}} \({_DIGIT}{{3}}\) {_DIGIT}{{3}}-{_DIGIT}{{4}}"),
)
# Text every match of a type holds; a plain search for it spares most texts the pattern.
HINTS = {"EMAIL": "@", "IP_ADDRESS": ".", "CREDIT_DEBIT_NUMBER": "", "PHONE": ") "}
CONFIDENCE = 1.0  # a pattern either matches or does not
FILLER = "\u0001"


def _has(text: Column, name: str, pattern: str) -> Column:
    return (text.contains(HINTS[name]) & text.rlike(pattern)) if HINTS[name] else text.rlike(pattern)


def _mask(text: Column, name: str, pattern: str) -> Column:
    """The text with every match overwritten by filler of the same length, so offsets stay true."""
    pieces = F.split(text, pattern)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    joined = F.zip_with(
        pieces,
        F.transform(found, lambda m: F.repeat(F.lit(FILLER), F.length(m))),
        lambda piece, fill: F.concat(piece, F.coalesce(fill, F.lit(""))),
    )
    return F.when(_has(text, name, pattern), F.array_join(joined, "")).otherwise(text)


def masked_texts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Per type, the text in which the types of higher priority are masked."""
    rows = texts.select(key, F.col(text).alias("_0"))
    for i, (name, pattern) in enumerate(PATTERNS):
        rows = rows.withColumn(f"_{i + 1}", _mask(F.col(f"_{i}"), name, pattern))
    return rows


def pii_entities(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, type, text, confidence, begin_offset, end_offset`` (end exclusive, in characters).

    Offsets are running sums of the lengths between matches. Only texts with a match are exploded,
    and only lengths and matches travel, so the shuffle is small next to the texts.
    """
    rows = masked_texts(texts, key, text)
    kinds = []
    for i, (name, pattern) in enumerate(PATTERNS):
        gaps = F.transform(F.split(F.col(f"_{i}"), pattern), F.length)
        found = F.regexp_extract_all(F.col(f"_{i}"), F.lit(pattern), F.lit(0))
        pairs = F.when(_has(F.col(f"_{i}"), name, pattern), F.arrays_zip(gaps.alias("gap"), found.alias("hit")))
        kinds.append(F.struct(F.lit(name).alias("type"), pairs.alias("pairs")))
    rows = rows.select(key, F.explode(F.array(*kinds)).alias("kind")).filter(F.col("kind.pairs").isNotNull())
    rows = rows.select(key, F.col("kind.type").alias("type"), F.posexplode("kind.pairs").alias("i", "pair"))
    order = Window.partitionBy(key, "type").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("pair.gap") + F.coalesce(F.length("pair.hit"), F.lit(0))).over(order)
    rows = rows.withColumn("end_offset", end.cast("int")).filter(F.col("pair.hit").isNotNull())
    return rows.select(
        key,
        "type",
        F.col("pair.hit").alias("text"),
        F.lit(CONFIDENCE).alias("confidence"),
        (F.col("end_offset") - F.length("pair.hit")).alias("begin_offset"),
        "end_offset",
    )


def redact(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, redacted_text, has_pii, pii_types``: every entity replaced by its type in brackets."""
    rows = masked_texts(texts, key, text)
    redacted = F.col("_0")
    for name, pattern in PATTERNS:
        redacted = F.regexp_replace(redacted, pattern, f"[{name}]")
    marks = [F.when(_has(F.col(f"_{i}"), name, pattern), F.lit(name)) for i, (name, pattern) in enumerate(PATTERNS)]
    types = F.array_sort(F.filter(F.array(*marks), lambda t: t.isNotNull()))
    rows = rows.select(key, redacted.alias("redacted_text"), types.alias("pii_types"))
    return rows.select(key, "redacted_text", (F.size("pii_types") > 0).alias("has_pii"), "pii_types")
