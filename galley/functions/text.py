"""Scalar text functions; all of them are JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters str.split() and \s treat as white space in Python 3. The separators are
# named by their category: a long union of ranges is several times slower in Java's matcher.
WS_CLASS = r"\s\x0B\x1C\x1D\x1E\x1F\x{85}\pZ"
WS = f"[{WS_CLASS}]"
WORD = f"[^{WS_CLASS}]+"
NOT_BLANK = f"[^{WS_CLASS}]"

# Fixed value: control characters that are dropped before parsing.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"

# Phrases removed from extracted text, applied in this order to one line of text.
LEADING_LABEL = r"(?i)^(Advertisement|Sponsored|Related:|Share:|Follow:|Subscribe:)"
READ_ON_TAIL = r"(?is)(Click here|Read more|Continue reading).*"
LEADING_BYLINE = r"(?i)^ *(By|Author:|Written by) +"
SHARE_TAIL = r"(?is) *(Share on|Follow us|Subscribe to).*"
# Fixed value: labels removed from the start of a parsed block.
BLOCK_LABEL = r"(?i)^(Advertisement|Sponsored|Related:|Share:|Follow:)"

SENTENCE_END = r"[.!?]+"
LLM_LIMIT = 100_000


def sanitize_text(text: Column) -> Column:
    """Drop NUL and the other control characters that are not tab, newline or carriage return."""
    return F.regexp_replace(text, CONTROL, "")


def collapse(text: Column) -> Column:
    """One space for every run of white space, none at the ends."""
    return F.trim(F.regexp_replace(text, WS + "+", " "))


def clean_text(text: Column) -> Column:
    """Clean one extracted text; the whole text is one line once white space is collapsed."""
    out = F.regexp_replace(text, WS + "+", " ")
    for pattern in (LEADING_LABEL, READ_ON_TAIL, LEADING_BYLINE, SHARE_TAIL):
        out = F.regexp_replace(out, pattern, "")
    return F.trim(out)


def clean_block(text: Column) -> Column:
    """Clean one parsed block: collapse, then drop a leading label."""
    return F.regexp_replace(collapse(text), BLOCK_LABEL, "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def sentence_parts(text: Column) -> Column:
    """Parts of a split at sentence ends, the trailing empty part included."""
    return F.regexp_count(text, F.lit(SENTENCE_END)) + 1


def paragraph_count(text: Column) -> Column:
    """Non-blank blocks between empty lines."""
    return F.size(F.filter(F.split(text, "\n\n"), lambda p: p.rlike(NOT_BLANK)))


def letters(text: Column) -> Column:
    """Total length of the words."""
    return F.length(F.regexp_replace(text, WS, ""))


def block_letters(blocks: Column) -> Column:
    """``letters`` of clean blocks joined by empty lines, without a regular expression."""
    return F.length(_unspaced(blocks))


def block_words(blocks: Column) -> Column:
    """``word_count`` of clean blocks joined by empty lines, without a regular expression.

    Clean blocks hold single spaces only, so every space and every block break is one gap.
    """
    flat = F.replace(blocks, F.lit("\n\n"), F.lit(" "))
    return F.length(flat) - F.length(_unspaced(blocks)) + F.when(F.length(blocks) > 0, 1).otherwise(0)


def _unspaced(blocks: Column) -> Column:
    return F.replace(F.replace(blocks, F.lit("\n\n"), F.lit("")), F.lit(" "), F.lit(""))


def good_measures(words: Column, parts: Column, total_letters: Column) -> Column:
    """At least 50 words, 3 sentence parts and a mean word length of 3 to 15."""
    return F.coalesce(
        (words >= 50)
        & (parts >= 3)
        & (total_letters >= words * 3)
        & (total_letters <= words * 15),
        F.lit(False),
    )


def is_good_content(text: Column) -> Column:
    """The quality gate on any text."""
    return good_measures(word_count(text), sentence_parts(text), letters(text))


def is_good_blocks(blocks: Column) -> Column:
    """The quality gate on clean blocks joined by empty lines."""
    return good_measures(block_words(blocks), sentence_parts(blocks), block_letters(blocks))


def truncate_bytes(text: Column, limit: int = 5000) -> Column:
    """The longest prefix of at most ``limit`` UTF-8 bytes that ends on a character boundary."""
    raw = F.encode(text, "UTF-8")
    cuts = [
        F.try_validate_utf8(F.substring(raw, 1, limit - drop).cast("string"))
        for drop in range(min(4, limit + 1))
    ]
    return F.when(F.octet_length(raw) <= limit, text).otherwise(F.coalesce(*cuts))


def is_blank(text: Column) -> Column:
    return F.coalesce(~text.rlike(NOT_BLANK), F.lit(True))


def eligible_for_llm(text: Column, limit: int | None = LLM_LIMIT) -> Column:
    """True where a text is neither blank nor longer than ``limit`` characters (None: any length)."""
    usable = ~is_blank(text)
    return usable if limit is None else usable & (F.length(text) <= limit)


def eligibility_error(text: Column, limit: int | None = LLM_LIMIT) -> Column:
    """The reason a text is not eligible, NULL where it is."""
    blank = F.when(is_blank(text), F.lit("Text cannot be empty"))
    return blank if limit is None else blank.when(F.length(text) > limit, F.lit("Text too long"))


def compression_ratio(out_chars: Column, in_chars: Column) -> Column:
    return F.when(in_chars == 0, F.lit(0.0)).otherwise(out_chars / in_chars)


def text_metrics(text: Column) -> dict[str, Column]:
    """Word, character, byte and paragraph counts by name."""
    return {
        "word_count": word_count(text),
        "char_count": F.length(text),
        "byte_count": F.octet_length(text),
        "paragraph_count": paragraph_count(text),
    }


def formatting_info(text: Column, words: Column | None = None, paragraphs: Column | None = None) -> dict[str, Column]:
    """Formatting facts of an extracted text by name; counts that are known need not be taken again."""
    words = word_count(text) if words is None else words
    paragraphs = paragraph_count(text) if paragraphs is None else paragraphs
    return {
        "has_paragraphs": paragraphs > 1,
        "avg_paragraph_length": words / F.greatest(paragraphs, F.lit(1)),
        "has_proper_sentences": text.rlike("[.!?]"),
    }
