"""Confidence scores. The weights are fixed values of the scoring rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from galley.functions.text import sentence_parts, word_count

FALLBACK_FACTOR = 0.7
LOW_CONFIDENCE = 0.3
# Fixed value: the warning.
WARNING = "Low confidence extraction - content quality may be poor"
METHOD_BASE = {"site_specific": 0.8, "readability": 0.6, "generic_fallback": 0.4, "error": 0.0}
OTHER_METHOD = 0.3


def parse_confidence(
    title: Column, content: Column, author: Column, publish_date: Column, words: Column
) -> Column:
    """Share of the parser's fields that were found, content weighted by its length."""
    title_part = F.when(F.length(title) > 10, 0.25).otherwise(0.0)
    content_part = (
        F.when(words > 100, 0.5).when(words > 50, 0.3).when(words > 20, 0.1).otherwise(0.0)
    )
    content_part = F.when(F.length(content) > 0, content_part).otherwise(0.0)
    author_part = F.when(F.length(author) > 0, 0.15).otherwise(0.0)
    date_part = F.when(publish_date.isNotNull(), 0.1).otherwise(0.0)
    return F.round(F.least(title_part + content_part + author_part + date_part, F.lit(1.0)), 6)


def extraction_confidence(text: Column, method: Column, words: Column | None = None) -> Column:
    """Base by method, then length, sentence and block bonuses, kept within 0 and 1."""
    words = word_count(text) if words is None else words
    base = F.lit(OTHER_METHOD)
    for name, value in METHOD_BASE.items():
        base = F.when(method == name, F.lit(value)).otherwise(base)
    length_part = F.when(words > 200, 0.2).when(words > 100, 0.1).when(words < 50, -0.2).otherwise(0.0)
    sentence_part = F.when(sentence_parts(text) > 5, 0.1).otherwise(0.0)
    blocks = F.size(F.split(text, "\n\n"))
    block_part = F.when(blocks > 2, 0.1).otherwise(0.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + length_part + sentence_part + block_part))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0.0)).otherwise(F.round(score, 6))


def quality_warning(method: Column, confidence: Column) -> Column:
    """The warning for a generic extraction of low confidence, NULL otherwise."""
    return F.when((method == "generic_fallback") & (confidence < LOW_CONFIDENCE), F.lit(WARNING))
