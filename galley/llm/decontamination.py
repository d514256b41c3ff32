"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.llm.words import chunks, field_types, texts_of, with_columns

TOKEN = re.compile(r"\w+")
#: Base of the running Karp-Rabin hash over token numbers, modulo 2 ** 64.
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of benchmark text that tasks hold at once; a larger benchmark is tested part by part.
PART_BYTES = 32 << 20
#: Pairs of places that are formed at once.
PAIRS = 1 << 20


def tokens_of(text: str) -> list[str]:
    """Letters and digits in lower case; spacing and punctuation do not count."""
    return TOKEN.findall(text.lower())


def running_hashes(numbers: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hash of every ``length`` neighbouring numbers."""
    total = len(numbers) - length + 1
    if total <= 0:
        return np.empty(0, dtype=np.uint64)
    found = np.zeros(total, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(length):
            found = found * BASE + numbers[k : k + total]
    return found


@dataclass(frozen=True)
class Tiles:
    """How much of a benchmark item a document covers."""

    item: int
    item_tokens: int
    matched: int
    count: int
    longest: int

    @property
    def coverage(self) -> float:
        return self.matched / self.item_tokens


def runs_of(of: np.ndarray, doc_at: np.ndarray, item_at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs (item, document place, item place, length) put together where one goes on as another ends on its diagonal.

    Runs on a diagonal of an item neither overlap nor repeat.
    """
    diagonal = doc_at - item_at
    by = np.lexsort([doc_at, diagonal, of])
    of, doc_at, item_at, length, diagonal = (x[by] for x in (of, doc_at, item_at, length, diagonal))
    new = np.ones(len(by), dtype=bool)
    new[1:] = (of[1:] != of[:-1]) | (diagonal[1:] != diagonal[:-1]) | (doc_at[1:] != doc_at[:-1] + length[:-1])
    begin = np.flatnonzero(new)
    return of[begin], doc_at[begin], item_at[begin], np.add.reduceat(length, begin) if len(begin) else length


def greedy_tiles(
    doc_at: np.ndarray, item_at: np.ndarray, lengths: np.ndarray, seed: int, doc_tokens: int, item_tokens: int
) -> list[int]:
    """Lengths of the tiles, longest first, of maximal matches given by their places and lengths.

    The longest match whose tokens are all free becomes a tile; a match that has lost tokens to a
    tile goes back in line with what is left of it, if that is at least ``seed`` long.
    """
    waiting = [(-n, i, j) for n, i, j in zip(lengths.tolist(), doc_at.tolist(), item_at.tolist(), strict=True)]
    heapq.heapify(waiting)
    doc_free, item_free = np.ones(doc_tokens, dtype=bool), np.ones(item_tokens, dtype=bool)
    tiles = []
    while waiting:
        negative, i, j = heapq.heappop(waiting)
        length = -negative
        free = doc_free[i : i + length] & item_free[j : j + length]
        if free.all():
            doc_free[i : i + length] = item_free[j : j + length] = False
            tiles.append(length)
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= seed:
                heapq.heappush(waiting, (a - b, i + a, j + a))
    return tiles


class Benchmark:
    """Items as token numbers, and their seeds by hash."""

    def __init__(self, items: list[tuple[int, str]], seed: int):
        self.number: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        for item, text in items:
            numbers = [self.number.setdefault(token, len(self.number) + 1) for token in tokens_of(text or "")]
            if numbers:
                self.items.append((item, np.array(numbers, dtype=np.uint64)))
        self._flat = np.concatenate([n for _, n in self.items]) if self.items else np.empty(0, dtype=np.uint64)
        self._starts = np.cumsum([0, *[len(n) for _, n in self.items]])
        # an item shorter than a seed can only be found whole
        self.seeds = []
        for length in sorted({min(seed, len(numbers)) for _, numbers in self.items}):
            of, at, hashes = [], [], []
            for k, (_, numbers) in enumerate(self.items):
                if min(seed, len(numbers)) == length:
                    found = running_hashes(numbers, length)
                    hashes.append(found)
                    of.append(np.full(len(found), k))
                    at.append(np.arange(len(found)))
            hashes, of, at = np.concatenate(hashes), np.concatenate(of), np.concatenate(at)
            by = np.argsort(hashes, kind="stable")
            self.seeds.append((length, hashes[by], of[by], at[by]))

    def _matches(self, numbers: np.ndarray, length: int, hashes: np.ndarray, of: np.ndarray, at: np.ndarray):
        """Item, document place, item place and length in tokens of the maximal matches, tokens compared.

        Places that agree are formed for a stretch of the document at a time and kept as runs, so a text
        that repeats itself costs time, but memory for its matches only.
        """
        running = running_hashes(numbers, length)
        low = np.searchsorted(hashes, running)
        place = np.flatnonzero((low < len(hashes)) & (hashes[np.minimum(low, len(hashes) - 1)] == running))
        count = np.searchsorted(hashes, running[place], side="right") - low[place]
        upto = np.cumsum(count)
        runs: list[tuple[np.ndarray, ...]] = []
        start = 0
        while start < len(place):
            done = int(upto[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(upto, done + PAIRS, side="right")))
            own, times = place[start:stop], count[start:stop]
            doc_at = np.repeat(own, times)
            entry = np.repeat(low[own], times) + np.arange(len(doc_at)) - np.repeat(np.cumsum(times) - times, times)
            items, item_at = of[entry], at[entry]
            first = self._starts[items] + item_at
            same = np.all([numbers[doc_at + k] == self._flat[first + k] for k in range(length)], axis=0)
            runs.append(runs_of(items[same], doc_at[same], item_at[same], np.ones(int(same.sum()), dtype=np.int64)))
            start = stop
        if not runs:
            return None
        items, doc_at, item_at, lengths = runs_of(*(np.concatenate(column) for column in zip(*runs, strict=True)))
        return items, doc_at, item_at, lengths + length - 1

    def contaminations(self, text: str, threshold: float) -> list[Tiles]:
        """Items of which tiles cover at least ``threshold``."""
        get = self.number.get
        numbers = np.array([get(token, 0) for token in tokens_of(text)], dtype=np.uint64)
        found = []
        for length, hashes, of, at in self.seeds:
            matches = self._matches(numbers, length, hashes, of, at)
            if matches is None or not len(matches[0]):
                continue
            items, doc_at, item_at, lengths = matches
            borders = [0, *(np.flatnonzero(items[1:] != items[:-1]) + 1).tolist(), len(items)]
            for a, b in zip(borders, borders[1:], strict=False):
                item, own = self.items[items[a]]
                # tiles cannot cover more of the item than its matches do
                reach = np.zeros(len(own) + 1, dtype=np.int64)
                np.add.at(reach, item_at[a:b], 1)
                np.add.at(reach, item_at[a:b] + lengths[a:b], -1)
                if np.count_nonzero(np.cumsum(reach)) < threshold * len(own):
                    continue
                tiles = greedy_tiles(doc_at[a:b], item_at[a:b], lengths[a:b], length, len(numbers), len(own))
                if sum(tiles) >= threshold * len(own):
                    found.append(Tiles(item, len(own), sum(tiles), len(tiles), tiles[0]))
        return found


_FOUND = pa.list_(
    pa.struct([
        ("item_id", pa.int64()), ("item_tokens", pa.int64()), ("matched_tokens", pa.int64()),
        ("tiles", pa.int64()), ("longest_tile", pa.int64()), ("coverage", pa.float64()),
    ])
)
_FOUND_DDL = (
    "array<struct<item_id:bigint,item_tokens:bigint,matched_tokens:bigint,tiles:bigint,longest_tile:bigint,coverage:double>>"
)


def _parts(benchmark: DataFrame, part_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in parts of about ``part_bytes``, by item."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(total // part_bytes) + 1
    for part in range(parts):
        chosen = rows if parts == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        yield [(row.item_id, row.text) for row in chosen.orderBy("item_id", "text").collect()]


def with_contaminations(
    documents: DataFrame, benchmark: DataFrame, seed: int = 5, threshold: float = 0.6, part_bytes: int = PART_BYTES
) -> DataFrame:
    """The documents with a column ``contaminations``: the benchmark items they give away.

    A task holds the benchmark (or a part of it of bounded size; parts are tested one after the
    other over the same rows) and meets its documents where they are: nothing is shuffled. A
    document shares seeds of ``seed`` tokens with an item, which a running hash finds and a
    comparison of the tokens confirms. Tiles of at least a seed are laid over both, the longest
    first, without overlap; so a passage with its parts in another order is found as well. An item
    counts when tiles cover ``threshold`` of its tokens.

    Tokens are letters and digits in lower case. Null or empty documents have no contaminations,
    nor are null or tokenless items ever found; an item shorter than a seed is found only as a
    whole. Repeated items are reported each, repeated documents as well; ties between matches go to
    the one that starts first. Whole texts are searched. An empty table on either side gives none.
    """
    found = documents.drop("contaminations").withColumn("contaminations", F.array().cast(_FOUND_DDL))
    schema = field_types(documents, ["contaminations"]) + f", contaminations {_FOUND_DDL}"
    for items in _parts(benchmark, part_bytes):
        sent = documents.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known = Benchmark(sent.value, seed)
            for batch in chunks(batches):
                before = batch.column(batch.schema.get_field_index("contaminations")).to_pylist()
                lists = []
                for text, old in zip(texts_of(batch.column(batch.schema.get_field_index("text"))), before, strict=True):
                    new = [
                        {
                            "item_id": t.item, "item_tokens": t.item_tokens, "matched_tokens": t.matched,
                            "tiles": t.count, "longest_tile": t.longest, "coverage": t.coverage,
                        }
                        for t in known.contaminations(text, threshold)
                    ]
                    lists.append(old + new)
                yield with_columns(batch, {"contaminations": pa.array(lists, _FOUND)})

        found = found.mapInArrow(run, schema)
    return found


def contaminations(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document and item it gives away; clean documents have none."""
    rows = with_contaminations(documents.select("doc_id", "text"), benchmark, **options)
    return rows.select("doc_id", F.explode("contaminations").alias("c")).select("doc_id", "c.*")


def clean_documents(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that give no item away, all columns."""
    marked = with_contaminations(documents, benchmark, **options)
    return marked.filter(F.size("contaminations") == 0).select(documents.columns)
