"""Key phrases by corpus TF-IDF, and what is derived from them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from galley.functions.lexicon import STOP_WORDS
from galley.operators.bags import Terms, groups, half_up, in_order, read_words, with_frequencies, word_hashes

TOP_PHRASES = 10
TOPIC_CONFIDENCE = 0.8
TOPIC_WORDS = 3
TOPICS = 5
LONGEST = 3

# columns of a phrase; offsets are in characters, the end is exclusive
PHRASE = {"text": StringType(), "n_words": IntegerType(), "confidence": DoubleType(), "begin_offset": IntegerType(), "end_offset": IntegerType()}
# phrases that go to the JVM at once
BATCH_ROWS = 1 << 15
BATCH_TEXTS = 64


@dataclass
class Grams:
    """The grams of a bag, one row per text and gram."""

    texts: pa.Array  # the keys of the texts
    words: pa.Array  # the vocabulary
    ids: np.ndarray  # words in order, by place in the vocabulary
    of: np.ndarray  # number of the text
    term: np.ndarray  # number of the gram
    tf: np.ndarray
    length: np.ndarray  # words
    first: np.ndarray  # number of the first word at the first place
    begin: np.ndarray
    end: np.ndarray


def read_grams(bag: pa.Table, key: str, longest: int = LONGEST) -> tuple[Terms, Grams]:
    """Grams of one to ``longest`` adjacent words of one sentence, none starting or ending with a stop word.

    The words of texts with the same key, or without one, are one sequence, by their numbers.
    """
    words = read_words(bag["_text"].to_pylist())
    of_text, keys = groups(bag[key])
    of = of_text[words.text]
    fresh = np.diff(words.text, prepend=-1) != 0
    ends_one = words.sentence > np.where(fresh, 0, np.concatenate([[0], words.sentence[:-1]]))
    order = np.arange(len(of)) if len(keys) == len(of_text) else np.lexsort((words.text, words.place, of))
    of, ids, size = of[order], words.id[order], words.size[order]
    sentence = np.cumsum(ends_one[order])
    end = np.cumsum(words.gap[order] + size)
    fresh = np.diff(of, prepend=-1) != 0
    end -= np.repeat((end - size - words.gap[order])[fresh], np.diff(np.flatnonzero(fresh), append=len(of)))
    begin = end - size
    stop = np.isin(np.arange(len(words.vocabulary)), pc.index_in(pa.array(STOP_WORDS, pa.large_string()), words.vocabulary).drop_null().to_numpy())[ids]
    joined = np.concatenate([(of[1:] == of[:-1]) & (sentence[1:] == sentence[:-1]), np.zeros(min(1, len(of)), bool)])

    rows = np.flatnonzero(~stop)  # first words of what may become a gram
    coded, bound = ids.copy(), max(1, len(words.vocabulary))
    hashes = word_hashes(words.vocabulary)
    terms, held = [], []
    count = 0
    for n in range(longest):
        if n:
            rows = rows[rows + n < len(ids)]
            rows = rows[joined[rows + n - 1]]
            # the code of the gram before, and the next word
            values, bound = coded[rows] * len(words.vocabulary) + ids[rows + n], bound * len(words.vocabulary)
        else:
            values = coded[rows]
        order = in_order(values, bound)
        at, values = rows[order], values[order]
        change = np.diff(values, prepend=-1) != 0
        # dense codes keep the next ones small
        coded[at], bound = np.cumsum(change) - 1, max(1, len(at))
        whole = ~stop[at + n]
        at, change = at[whole], np.diff(values[whole], prepend=-1) != 0
        pair = np.flatnonzero(change | (np.diff(of[at], prepend=-1) != 0))
        term = np.cumsum(change)[pair] - 1
        firsts = at[pair]
        kinds = at[change]
        mixed = hashes[:, ids[kinds]]
        for k in range(1, n + 1):
            mixed = mixed * _MIX + hashes[:, ids[kinds + k]]
        terms.append((*mixed, np.bincount(term, minlength=len(kinds))))
        held.append((of[firsts], term + count, np.diff(pair, append=len(at)), np.full(len(pair), n + 1), firsts, begin[firsts], end[firsts + n]))
        count += len(kinds)
    hash_, tail, texts = (np.concatenate(x) for x in zip(*terms))
    found = Terms(hash_, (tail >> np.uint64(32)).astype(np.uint32), texts)
    return found, Grams(keys, words.vocabulary, ids, *(np.concatenate(x) for x in zip(*held)))


# an odd number; words have random hashes, so sums of their products are as random
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _phrase_columns(grams: Grams, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, pa.Array]]:
    """Number of the text, confidence, and the other columns of ``PHRASE``, in the order of the texts."""
    longest = int(grams.length.max(initial=1))
    # a gram has one place for its first word and its length
    slots = np.full(len(grams.ids) * longest, -1)
    slots[grams.first * longest + grams.length - 1] = np.arange(len(grams.first))
    order = slots[slots >= 0]
    raw = (grams.tf * weights[grams.term])[order]
    of = grams.of[order]
    begins = np.flatnonzero(np.diff(of, prepend=-1))
    best = np.repeat(np.maximum.reduceat(raw, begins), np.diff(begins, append=len(of))) if len(of) else raw
    confidence = half_up(np.divide(raw, best, out=np.zeros(len(raw)), where=best > 0))
    first, length = grams.first[order], grams.length[order]
    words = grams.words.take(pa.array(grams.ids))
    begins = np.frombuffer(words.buffers()[1], np.int64)[words.offset :][: len(words) + 1]
    spaced = pc.binary_join_element_wise(words, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    # with a space behind every word, a gram is one stretch
    data = np.frombuffer(spaced.buffers()[2] or b"", np.uint8)
    starts = begins[first] - begins[0] + first
    sizes = begins[first + length] - begins[first] + length - 1
    ends = np.cumsum(sizes)
    stretch = np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
    text = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(np.concatenate([[0], ends])), pa.py_buffer(data[stretch]))
    return of, confidence, {
        "text": text.cast(pa.string()), "n_words": pa.array(length, pa.int32()), "confidence": pa.array(confidence),
        "begin_offset": pa.array(grams.begin[order], pa.int32()), "end_offset": pa.array(grams.end[order], pa.int32()),
    }


def key_phrases(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, text, n_words, confidence, begin_offset, end_offset`` for every gram of every text.

    ``confidence`` is the TF-IDF weight scaled by the largest one of the text. Phrases stand in the
    order of their first places.
    """
    schema = StructType([texts.schema[key], *(StructField(name, kind) for name, kind in PHRASE.items())])

    def rows(bag: pa.Table, grams: Grams, weights: np.ndarray) -> pa.Table:
        of, _, columns = _phrase_columns(grams, weights)
        table = pa.Table.from_arrays([grams.texts.take(pa.array(of)), *columns.values()], [key, *columns])
        return pa.Table.from_batches(table.to_batches(BATCH_ROWS), table.schema)

    return with_frequencies(texts, key, text, lambda bag: read_grams(bag, key), rows, schema)


def phrase_lists(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, phrases``: what ``key_phrases`` gives, as one list per key, the most confident first.

    Ties go to the phrase that comes first. Keys without a phrase have no row.
    """
    phrase = StructType([StructField(name, kind) for name, kind in PHRASE.items()])
    schema = StructType([texts.schema[key], StructField("phrases", ArrayType(phrase))])

    def rows(bag: pa.Table, grams: Grams, weights: np.ndarray) -> pa.Table:
        of, confidence, columns = _phrase_columns(grams, weights)
        # places rise within a text already
        order = np.lexsort((-confidence, of))
        begins = np.flatnonzero(np.diff(of, prepend=-1))
        items = pa.StructArray.from_arrays([c.take(pa.array(order)) for c in columns.values()], list(columns))
        lists = pa.ListArray.from_arrays(pa.array([*begins, len(of)], pa.int32()), items)
        table = pa.Table.from_arrays([grams.texts.take(pa.array(of[begins])), lists], [key, "phrases"])
        return pa.Table.from_batches(table.to_batches(BATCH_TEXTS), table.schema)

    return with_frequencies(texts, key, text, lambda bag: read_grams(bag, key), rows, schema)


def _ranked(phrases: DataFrame, key: str, limit: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("confidence"), "begin_offset", "end_offset")
    return phrases.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def top_phrases(phrases: DataFrame, key: str = "doc_id", limit: int = TOP_PHRASES) -> DataFrame:
    """The most confident phrases of a text; ties go to the one that comes first."""
    return _ranked(phrases, key, limit)


def topics(phrases: DataFrame, key: str = "doc_id") -> DataFrame:
    """Topic labels of a text: its most confident short phrases above 0.8, in title case."""
    short = phrases.filter((F.col("confidence") > TOPIC_CONFIDENCE) & (F.col("n_words") <= TOPIC_WORDS))
    return _ranked(short, key, TOPICS).select(key, "rank", F.initcap("text").alias("topic"))
