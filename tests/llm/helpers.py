"""Rows every operator must take: nulls, blanks, repeats, clashing columns, one long text."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCUMENTS = "doc_id long, text string, score double, _d string, n_words string, contaminations int, `_key` string"


def lower_ascii(text):
    return (text or "").translate({code: code + 32 for code in range(65, 91)})


def odd_documents(spark, extra=()):
    """Documents with null and repeated ids, null, empty, blank and very long texts, and odd columns."""
    long_text = " ".join(f"word{k % 977} and{k % 31}" for k in range(30_000))
    texts = [
        (1, "The quick brown fox jumps over the lazy dog. The end."), (2, None), (3, ""), (4, " \t\n\x0b\x0c\r "),
        (None, "no id here"), (None, None), (5, "same row"), (5, "same row"), (5, "same id, other text"),
        (6, long_text), (7, "x"), (8, "two words"), (9, "Ünïcødé ß ﬁ 漢字 \u00a0\u2028 🙂 a\x00b"), (10, "a  b   c \n\n d"), *extra,
    ]
    rows = [(i, t, 1.0, "x", None, 3, "k") for i, t in texts]
    return spark.createDataFrame(rows, DOCUMENTS), texts


def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)


def hard_documents(spark, words=100_000):
    """Texts that are one run of something: blanks, letters, one word."""
    texts = [
        (1, " " * 5_000_000), (2, "\n " * 1_000_000), (3, "x" * 1_000_000), (4, "the " * words),
        (5, "\t" * 1_000_000 + "a"), (6, "ab" * 300_000), (7, "a small text at the end"),
    ]
    rows = [(i, t, 1.0, "x", None, 3, "k") for i, t in texts]
    return spark.createDataFrame(rows, DOCUMENTS), texts
