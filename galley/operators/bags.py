"""Bags of texts: words as Arrow and numpy columns, and in how many texts of the whole table a term stands.

A bag is what one task breaks up. Terms never leave it: what is shuffled is a hash of every distinct term of a
bag and the number of its texts that hold it, packed by range of the hash, and back the number of all texts.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pandas.util import hash_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from galley.functions.lexicon import LETTERS
from galley.operators.skew import parts_for

# the number of a text's bag: never null, from the hash of the key, so texts with the same key or none meet
BAG = "_bag"
# the ranges of the hash: so many bags' worth of terms are added up at once
SHARD = "_shard"
BAGS_A_SHARD = 4
# a term is known by 64 bits and a tail of 16; from so many bags on (2^34 characters) the tail has 32. Two of N terms
# agree by chance with a probability of N^2 / 2^81, which is 1 in 100,000 there
LONG_TAIL_FROM = 8_192

_ASKED = f"{BAG} LONG, {SHARD} INT, _steps BINARY, _tails BINARY, _texts BINARY"
_ANSWERS = f"{BAG} LONG, {SHARD} INT, _found BINARY"


def in_bags(texts: DataFrame, key: str, text: str) -> tuple[DataFrame, int, int]:
    """``_bag, key, _text``, hashed once into bags of bounded size (see ``sized_parts``), their number and that of texts."""
    rows = texts.select(key, F.col(text).alias("_text"))
    chars, total = rows.agg(F.sum(F.length("_text").cast("long")), F.count("*")).first()
    parts = parts_for(rows, chars or 0)
    bag = F.pmod(F.xxhash64(key), F.lit(parts)).cast("long")
    # bytes, so that a text that is no valid UTF-8 ends no task
    rows = rows.select(bag.alias(BAG), key, F.col("_text").cast("binary").alias("_text"))
    return rows.repartition(parts, BAG), parts, total


def _bytes_of(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[c.encode()[-1] for c in chars]] = True
    return table


# letters are a byte of ASCII, or 0xC3 and another byte
_LEAD = 0xC3
_ONE, _TWO = _bytes_of("".join(c for c in LETTERS if c < "\x80")), _bytes_of("".join(c for c in LETTERS if c >= "\x80"))
_SENTENCE_ENDS = _bytes_of(".!?\n")


@dataclass
class Words:
    """The words of lower-cased texts, in order; lengths are in characters."""

    text: np.ndarray  # number of the text
    place: np.ndarray  # number in the text
    sentence: np.ndarray  # runs of sentence ends before it in the text
    gap: np.ndarray  # length of what stands between it and the word before
    size: np.ndarray
    id: np.ndarray  # place in the vocabulary
    vocabulary: pa.Array


def read_words(texts: list[bytes | None]) -> Words:
    """A null text has no words."""
    lowered = [(text or b"").decode("utf-8", "replace").lower().encode() for text in texts]
    data = np.frombuffer(b"\0".join([*lowered, b""]) or b"\0", np.uint8)  # a zero byte behind every text
    begins = np.cumsum([0, *(len(text) + 1 for text in lowered)])[:-1]
    letter = _ONE[data]
    pairs = (data[:-1] == _LEAD) & _TWO[data[1:]]
    letter[:-1] |= pairs
    letter[1:] |= pairs
    edges = np.flatnonzero(np.diff(letter, prepend=False))
    starts, ends = edges[::2], edges[1::2]
    chars = np.cumsum((data & 0xC0) != 0x80)
    stops = _SENTENCE_ENDS[data]
    runs = np.cumsum(stops & ~np.concatenate([[False], stops[:-1]]))
    firsts = np.searchsorted(starts, begins)
    text = np.repeat(np.arange(len(begins)), np.diff(firsts, append=len(starts)))
    first = np.zeros(len(starts), bool)
    first[firsts[firsts < len(starts)]] = True
    before = np.concatenate([[0], ends[:-1]])
    before[first] = begins[text[first]]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[letter]))
    coded = words.dictionary_encode()
    return Words(
        text,
        np.arange(len(starts)) - firsts[text],
        runs[starts] - np.concatenate([[0], runs[begins[1:] - 1]])[text] if len(starts) else runs[:0],
        chars[starts] - chars[before],
        chars[ends] - chars[starts],
        coded.indices.to_numpy().astype(np.int64),
        coded.dictionary,
    )


def groups(keys: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """The number of each key among the distinct ones, of which null is one, and these."""
    coded = pa.chunked_array(keys).combine_chunks().dictionary_encode(null_encoding="encode")
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def in_order(values: np.ndarray, bound: int) -> np.ndarray:
    """The stable order of whole numbers from 0 to below ``bound``."""
    bits = len(values).bit_length()
    if bound.bit_length() + bits > 63:
        return np.argsort(values, kind="stable")
    packed = values << bits | np.arange(len(values))  # sorting numbers is several times faster than an argsort
    packed.sort()
    return packed & (1 << bits) - 1


def word_hashes(vocabulary: pa.Array) -> np.ndarray:
    """128 bits of each word as two rows of unsigned numbers (SipHash with two keys)."""
    words = vocabulary.to_numpy(zero_copy_only=False)
    return np.stack([hash_array(words, hash_key=seed, categorize=False) for seed in ("galley-first-key", "galley-other-key")])


@dataclass
class Terms:
    """The distinct terms of a bag: a hash of 64 bits, 32 further bits, and how many texts of the bag hold each."""

    hash: np.ndarray
    tail: np.ndarray
    texts: np.ndarray

    def order(self) -> np.ndarray:
        order = np.argsort(self.hash)
        held = self.hash[order]
        return np.lexsort((self.tail, self.hash)) if (held[1:] == held[:-1]).any() else order


def _packed(values: np.ndarray) -> bytes:
    """All first bytes, then all second ones and so on: high bytes are mostly zero, and zeros take no room in a shuffle."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _asked(bag: int, terms: Terms, shards: int, tail: type) -> pa.Table:
    """A row per range of the hash: its terms in order, as steps from one hash to the next."""
    order = terms.order()
    hashes, tails, texts = terms.hash[order], terms.tail[order].astype(tail), terms.texts[order].astype(np.uint32)
    width = (1 << 64) // shards + 1
    cuts = np.searchsorted(hashes, np.array([width * k for k in range(1, shards)], np.uint64))
    rows: list[tuple] = []
    for shard, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(hashes)])):
        if a < b:
            steps = np.diff(hashes[a:b], prepend=np.uint64(0))
            rows.append((bag, shard, _packed(steps), tails[a:b].tobytes(), _packed(texts[a:b])))
    columns = list(zip(*rows)) or [()] * 5
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    names = (BAG, SHARD, "_steps", "_tails", "_texts")
    return pa.table({name: pa.array(c, kind) for name, c, kind in zip(names, columns, kinds)})


def _answered(asked: pa.Table, tail: type) -> pa.Table:
    """Adds up one range of the hash over all bags, and answers each bag in the order of its terms."""
    steps = [np.cumsum(_unpacked(x, np.uint64)) for x in asked["_steps"].to_pylist()]
    hashes = np.concatenate(steps)
    tails = np.concatenate([np.frombuffer(x, tail) for x in asked["_tails"].to_pylist()])
    texts = np.concatenate([_unpacked(x, np.uint32) for x in asked["_texts"].to_pylist()])
    order = np.argsort(hashes)
    same = hashes[order][1:] == hashes[order][:-1]
    if (same & (tails[order][1:] != tails[order][:-1])).any():  # terms that agree in 64 bits only
        order = np.lexsort((tails, hashes))
        same = (hashes[order][1:] == hashes[order][:-1]) & (tails[order][1:] == tails[order][:-1])
    begins = np.flatnonzero(np.concatenate([[True], ~same]))
    sums = np.add.reduceat(texts[order], begins, dtype=np.int64)
    found = np.empty(len(hashes), np.uint32)
    found[order] = np.repeat(sums, np.diff(begins, append=len(hashes)))
    ends = np.cumsum([len(x) for x in steps])
    answers = [_packed(found[b - len(x) : b]) for b, x in zip(ends, steps)]
    return pa.table({BAG: asked[BAG], SHARD: asked[SHARD], "_found": pa.array(answers, pa.binary())})


def _found(terms: Terms, answers: pa.Table) -> np.ndarray:
    """How many texts of the whole table hold each term."""
    rows = sorted(zip(answers[SHARD].to_pylist(), answers["_found"].to_pylist()))
    found = np.concatenate([np.zeros(0, np.uint32), *(_unpacked(x, np.uint32) for _, x in rows)])
    if len(found) != len(terms.hash):
        raise ValueError(f"{len(terms.hash)} terms were looked up and {len(found)} found: the texts changed meanwhile")
    out = np.empty(len(found), np.int64)
    out[terms.order()] = found
    return out


def with_frequencies(
    texts: DataFrame,
    key: str,
    text: str,
    read: Callable[[pa.Table], tuple[Terms, object]],
    finish: Callable[[pa.Table, object, np.ndarray], pa.Table],
    schema: StructType,
) -> DataFrame:
    """What ``finish`` makes of every bag, told how much each of its terms weighs.

    ``read`` takes a bag (``key, _text``) and gives its distinct terms and what else is to be kept; it
    is called for the question and again for the answer, so that terms are not shuffled. A weight is
    ln((1 + N) / (1 + df)) with N texts in all and df texts (by key) that hold the term.
    """
    bags, parts, total = in_bags(texts, key, text)
    shards = max(2, -(-parts // BAGS_A_SHARD))
    tail = np.uint16 if parts < LONG_TAIL_FROM else np.uint32

    def ask(bag: tuple, table: pa.Table) -> pa.Table:
        return _asked(bag[0].as_py(), read(table)[0], shards, tail)

    def add_up(asked: pa.Table) -> pa.Table:
        return _answered(asked, tail)

    def answer(table: pa.Table, answers: pa.Table) -> pa.Table:
        terms, kept = read(table)
        values, which = np.unique(_found(terms, answers), return_inverse=True)
        weights = np.array([math.log((total + 1) / (df + 1)) for df in values.tolist()])
        return finish(table, kept, weights[which] if len(which) else np.zeros(0))

    asked = bags.groupBy(BAG).applyInArrow(ask, _ASKED)
    answers = asked.repartitionById(shards, SHARD).groupBy(SHARD).applyInArrow(add_up, _ANSWERS)
    answers = answers.repartition(parts, BAG)
    return bags.groupBy(BAG).cogroup(answers.groupBy(BAG)).applyInArrow(answer, schema)


def half_up(values: np.ndarray, digits: int = 6) -> np.ndarray:
    """Rounds as Spark does: halves of the shortest decimal form go up."""
    scale = 10.0**digits
    scaled = values * scale
    whole = np.floor(scaled)
    rest = scaled - whole
    out = (whole + (rest >= 0.5)) / scale
    unit = Decimal(1).scaleb(-digits)
    for k in np.flatnonzero(np.abs(rest - 0.5) < 1e-6 + scaled * 1e-15):  # too near to a half to tell by the product
        out[k] = float(Decimal(repr(float(values[k]))).quantize(unit, ROUND_HALF_UP))
    return out
