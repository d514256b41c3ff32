"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.llm.words import WORD_SPACE, words_column

SYMBOLS = "#*$%&|<>"
# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with a in is it for on was as are this from by at or an not "
    "der die das und ist den von zu mit ein eine im dem nicht auf für des sich als auch "
    "le la les de du un une et est en que qui dans pour pas sur par au avec "
    "el los las y es por con para del se no al lo su"
).split()
BASE_WORDS = 50
BASE_REPEATED_PERCENT = 50


@dataclass(frozen=True)
class Threshold:
    """Bounds on 100 * ``part`` / ``whole``; a bound that is None does not count. Both are metric names."""

    part: str
    whole: str
    low: int | None = None
    high: int | None = None

    def broken(self) -> Column:
        share, whole = 100 * F.col(self.part), F.col(self.whole)
        tests = [share < self.low * whole] if self.low is not None else []
        tests += [share > self.high * whole] if self.high is not None else []
        either = F.lit(False)
        for test in tests:
            either = either | test
        return either


#: A document is kept when it breaks none of these.
THRESHOLDS = (
    Threshold("word_chars", "n_words", low=300, high=1_000),
    Threshold("n_symbols", "n_words", high=10),
    Threshold("n_stop_words", "n_words", low=8),
    Threshold("n_dup_lines", "n_lines", high=40),
)


def window_hashes(words: Column) -> Column:
    """A hash of every three-word window; equal windows have equal hashes."""
    return F.when(
        F.size(words) > 2,
        F.transform(
            F.sequence(F.lit(2), F.size(words) - 1),
            lambda end: F.xxhash64(F.get(words, end - 2), F.get(words, end - 1), F.get(words, end)),
        ),
    )


def ordered_windows(words: Column, hashes: Column) -> Column:
    """The windows with their last place, sorted, where any two may be equal; else null.

    Most texts repeat no window, and their hashes show it without sorting strings.
    """
    windows = F.transform(
        F.sequence(F.lit(2), F.size(words) - 1),
        lambda end: F.struct(
            F.concat_ws(" ", F.get(words, end - 2), F.get(words, end - 1), F.get(words, end)).alias("window"),
            end.alias("end"),
        ),
    )
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(windows))


def _repeated_ends(ordered: Column) -> Column:
    """Places of windows that equal a neighbour in the sorted windows."""
    same = lambda a, b: F.get(ordered, a).getField("window") == F.get(ordered, b).getField("window")
    return F.filter(
        F.sequence(F.lit(0), F.size(ordered) - 1),
        lambda i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)),
    )


def _covered(ends: Column) -> Column:
    """Words covered by windows of three that end at the given sorted places."""
    first = F.when(F.size(ends) > 0, 3).otherwise(0)
    more = F.aggregate(
        F.sequence(F.lit(1), F.size(ends) - 1),
        F.lit(0),
        lambda total, i: total + F.least(F.get(ends, i) - F.get(ends, i - 1), F.lit(3)),
    )
    return first + F.when(F.size(ends) > 1, more).otherwise(0)


def quality(documents: DataFrame, thresholds: tuple[Threshold, ...] = THRESHOLDS) -> DataFrame:
    """Counts of every whole text, whether it fails the base rules, and whether it is kept.

    One narrow projection: no shuffle, no user function. Null or blank text: all counts zero, fails
    the base rules, not kept. Ids may be null or repeated, one row each. A text of n words costs
    n log n. Other columns are not read. An empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    word_space = F.lit(WORD_SPACE)
    counted = (
        documents.select("doc_id", text.alias("text"))
        .select(
            "doc_id",
            (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.length(F.translate("text", WORD_SPACE, "")).cast("long").alias("word_chars"),
            F.filter(F.split("text", "\n"), lambda line: F.btrim(line, word_space) != "").alias("lines"),
            words_column(F.col("text")).alias("words"),
        )
        .select(
            "doc_id",
            "word_chars",
            "n_symbols",
            F.size("words").cast("long").alias("n_words"),
            F.size("lines").cast("long").alias("n_lines"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            "words",
            window_hashes(F.col("words")).alias("hashes"),
        )
        .withColumn("ordered", ordered_windows(F.col("words"), F.col("hashes")))
        .withColumn("places", _repeated_ends(F.col("ordered")))
        .withColumn("ends", F.sort_array(F.transform("places", lambda i: F.get("ordered", i).getField("end"))))
        .withColumn("n_repeat_words", F.coalesce(_covered(F.col("ends")), F.lit(0)).cast("long"))
    )
    failed = (F.col("n_words") < BASE_WORDS) | (
        100 * F.col("n_repeat_words") > BASE_REPEATED_PERCENT * F.col("n_words")
    )
    broken = F.lit(False)
    for threshold in thresholds:
        broken = broken | threshold.broken()
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words",
        failed.alias("base_failed"), (~failed & ~broken).alias("kept"),
    )


QUALITY_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
grams AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
          FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(0, 3) AS r(k) GROUP BY doc_id),
c AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
        len(lines)::BIGINT AS n_lines,
        len(list_filter(words, lambda x: lower(x) IN ({", ".join(f"'{w}'" for w in STOP_WORDS)})))::BIGINT AS n_stop_words
      FROM w LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, n_words < {BASE_WORDS} OR 100 * n_repeat_words > {BASE_REPEATED_PERCENT} * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words, base_failed,
  NOT base_failed AND word_chars >= 3 * n_words AND word_chars <= 10 * n_words AND 10 * n_symbols <= n_words
  AND 100 * n_stop_words >= 8 * n_words AND 100 * n_dup_lines <= 40 * n_lines AS kept FROM b"""
