"""Extractive summaries: the sentences with the rarest words, in text order."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from galley.functions.lexicon import STOP_WORDS
from galley.functions.text import compression_ratio, eligibility_error, eligible_for_llm
from galley.operators.bags import Terms, groups, half_up, in_order, read_words, with_frequencies, word_hashes

SENTENCES = 3
SHORTEST = 5
SPLIT = re.compile(r"[.!?\n]+")
# sentences that go to the JVM at once
BATCH_ROWS = 1 << 13


@dataclass
class Sentences:
    """The long sentences of a bag, and the words in them that are no stop words."""

    keys: pa.Array  # the keys of the texts
    text: np.ndarray  # per sentence: number of the text, of its key and in the text
    of: np.ndarray
    i: np.ndarray
    place: np.ndarray  # number of its key and place; sentences that agree in both share their words
    word_place: np.ndarray  # per word: the same, and the number of the pair of key and word
    word_pair: np.ndarray
    tf: np.ndarray  # per pair, with the number of the word among the terms
    term: np.ndarray


def read_sentences(bag: pa.Table, key: str) -> tuple[Terms, Sentences]:
    words = read_words(bag["_text"].to_pylist())
    of_text, keys = groups(bag[key])
    fresh = (np.diff(words.text, prepend=-1) != 0) | (np.diff(words.sentence, prepend=-1) != 0)
    begins = np.flatnonzero(fresh)
    sizes = np.diff(begins, append=len(fresh))
    is_long = sizes >= SHORTEST
    text, i = words.text[begins[is_long]], words.sentence[begins[is_long]]
    stop = np.isin(np.arange(len(words.vocabulary)), pc.index_in(pa.array(STOP_WORDS, pa.large_string()), words.vocabulary).drop_null().to_numpy())

    used = ~stop[words.id]
    ids, of = words.id[used], of_text[words.text[used]]
    values = ids * max(1, len(keys)) + of
    order = in_order(values, max(1, len(words.vocabulary) * len(keys)))
    fresh = np.diff(values[order], prepend=-1) != 0
    pair = np.empty(len(ids), np.int64)
    pair[order] = np.cumsum(fresh) - 1
    heads = ids[order][fresh]
    kinds = np.diff(heads, prepend=-1) != 0
    term = np.cumsum(kinds) - 1
    hashes = word_hashes(words.vocabulary)[:, heads[kinds]]

    in_long = np.repeat(is_long, sizes)[used]
    number = np.repeat(np.cumsum(is_long) - 1, sizes)[used][in_long]
    longest = int(i.max(initial=0)) + 1
    _, place = np.unique(of_text[text] * longest + i, return_inverse=True)
    found = Terms(hashes[0], (hashes[1] >> np.uint64(32)).astype(np.uint32), np.bincount(term, minlength=int(kinds.sum())))
    tf = np.bincount(pair, minlength=len(heads))
    return found, Sentences(keys, text, of_text[text], i, place, place[number], pair[in_long], tf, term)


def sentence_scores(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sentences of at least five words, ``key, i, sentence``, with the mean TF-IDF of their words that are no
    stop words (0 if there are none) as ``score``.

    Words, weights and sentences meet in the task of their text (see ``with_frequencies``). Sentences with
    the same key and place share their words.
    """
    kinds = {"i": IntegerType(), "sentence": StringType(), "score": DoubleType()}
    schema = StructType([texts.schema[key], *(StructField(name, kind) for name, kind in kinds.items())])

    def rows(bag: pa.Table, held: Sentences, weights: np.ndarray) -> pa.Table:
        raw = (held.tf * weights[held.term])[held.word_pair]
        places = int(held.place.max(initial=-1)) + 1
        sums, counts = (np.bincount(held.word_place, w, places) for w in (raw, None))
        score = half_up(np.divide(sums, counts, out=np.zeros(places), where=counts > 0))[held.place]
        # a text without a key has no words that could be told from another's
        score[~held.keys.is_valid().to_numpy(zero_copy_only=False)[held.of]] = 0.0
        sentences: list[str] = []
        shown = np.split(held.i, np.flatnonzero(np.diff(held.text)) + 1)
        texts = bag["_text"]
        for number, places_of in zip(held.text[np.flatnonzero(np.diff(held.text, prepend=-1))].tolist(), shown):
            parts = SPLIT.split(texts[number].as_py().decode("utf-8", "replace"))
            sentences += [parts[k].strip(" ") for k in places_of.tolist()]
        table = pa.table({key: held.keys.take(pa.array(held.of)), "i": pa.array(held.i, pa.int32()), "sentence": pa.array(sentences, pa.string()), "score": pa.array(score)})
        return pa.Table.from_batches(table.to_batches(BATCH_ROWS), table.schema)

    return with_frequencies(texts, key, text, lambda bag: read_sentences(bag, key), rows, schema)


def top_sentences(scored: DataFrame, key: str = "doc_id", k: int = SENTENCES) -> DataFrame:
    """The k best sentences of a text; ties go to the earlier one."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), "i")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def summarize(
    texts: DataFrame, key: str = "doc_id", text: str = "text", k: int = SENTENCES, limit: int | None = None
) -> DataFrame:
    """``key, summary, original_length, summary_length, compression_ratio``.

    Texts of any length are read whole. Blank texts, and those over ``limit`` characters where one is
    given, are refused; ``summary_errors`` lists them. A text without a long
    enough sentence gets an empty summary.
    """
    usable = texts.filter(eligible_for_llm(F.col(text), limit)).select(key, text)
    best = top_sentences(sentence_scores(usable, key, text), key, k)
    joined = best.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "sentence"))).alias("s"))
    body = F.concat(F.array_join(F.transform("s", lambda s: s.sentence), ". "), F.lit("."))
    rows = usable.select(key, F.length(text).alias("original_length")).join(
        joined.select(key, body.alias("summary")), key, "left"
    )
    rows = rows.withColumn("summary", F.coalesce("summary", F.lit(""))).withColumn(
        "summary_length", F.length("summary")
    )
    ratio = compression_ratio(F.col("summary_length"), F.col("original_length"))
    return rows.withColumn("compression_ratio", F.round(ratio, 6))


def summary_errors(texts: DataFrame, key: str = "doc_id", text: str = "text", limit: int | None = None) -> DataFrame:
    """Texts that are not summarised, with the reason."""
    return texts.select(key, eligibility_error(F.col(text), limit).alias("message")).filter("message IS NOT NULL")
