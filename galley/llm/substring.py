"""Removal of repeated passages: winnowed anchors as seeds, extended to both sides."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galley.llm.words import WORD, WORD_BYTES, chunks, field_types, texts_of, with_columns

ANCHOR_WORDS = 8
#: One document in SAMPLE is looked at for anchors that need salting; results do not depend on it.
SAMPLE = 64
#: An anchor is salted when it occurs this often per sampled document, and at least HOT_LEAST times.
HOT_SHARE = 1 / 500
HOT_LEAST = 8
#: Documents hashed together.
CHUNK = 256
#: Documents whose equal runs are combined before the shuffle.
BATCH = 4_096
#: A run of windows is one number: its first word and, in the low bits, its length and a flag.
RUN_BITS = 8
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.array([xxh3_64_intdigest(word) for word in words], dtype=np.uint64)


def rolling(hashes: np.ndarray, length: int, factor: int) -> np.ndarray:
    """Polynomial hash of every run of ``length`` words, put together from runs of powers of two."""
    result, covered = None, 0
    power, size = hashes, 1
    raised = np.uint64(factor)
    with np.errstate(over="ignore"):
        while size <= length:
            if length & size:
                if result is None:
                    result = power
                else:
                    n = len(hashes) - covered - size + 1
                    result = result[:n] * raised + power[covered : covered + n]
                covered += size
            power = power[: len(power) - size] * raised + power[size:] if len(power) > size else power[:0]
            raised = raised * raised
            size *= 2
    return _mix(result)


def _window_starts(sizes: np.ndarray, length: int) -> np.ndarray:
    """Which words of joined documents begin a window inside their document."""
    ends = np.cumsum(sizes)
    at = np.arange(int(ends[-1]) if len(ends) else 0)
    return at + length <= np.repeat(ends, sizes)


def anchored_runs(hashes: np.ndarray, sizes: np.ndarray, length: int):
    """Runs of neighbouring windows that share their anchor.

    A window's anchor is the eight-word gram in it with the smallest hash, the first of equal ones,
    so equal windows have equal anchors at equal places: they meet in one run of either document,
    reached from the anchor to both sides. Returns anchor, content hash, first word and number of
    windows of every run; equal content hashes mean equal windows around the anchor.
    """
    starts = _window_starts(sizes, length)
    width = length - ANCHOR_WORDS + 1
    empty = np.empty(0, np.int64)
    if not starts.any():
        return empty.view(np.uint64), empty.view(np.uint64), empty, empty
    grams = rolling(hashes, ANCHOR_WORDS, 0x9FB21C651E98DF25)
    windows = rolling(hashes, length, 0xD6E8FEB86659FD93)
    valid = np.flatnonzero(starts[: len(windows)])
    anchor = valid + np.lib.stride_tricks.sliding_window_view(grams, width)[valid].argmin(axis=1)
    document = np.repeat(np.arange(len(sizes)), sizes)[valid]
    new = np.ones(len(valid), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (document[1:] != document[:-1])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(valid)))
    first, last, place = valid[begin], valid[begin + count - 1], anchor[begin]
    with np.errstate(over="ignore"):
        content = _mix(windows[first] * _ODD + windows[last])
        content = _mix(content + (place - first).astype(np.uint64) * _ODD + count.astype(np.uint64))
    return grams[place], content, first, count


def _joined(batch: pa.RecordBatch, text: int) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts of a batch, and the number of words of each."""
    words = [WORD_BYTES.findall(t.encode("utf-8", "surrogatepass")) for t in texts_of(batch.column(text))]
    return word_hashes([word for found in words for word in found]), np.array([len(w) for w in words], dtype=np.int64)


def _first_of_equal(keys: list[np.ndarray], order: list[np.ndarray]) -> np.ndarray:
    """Places of the first row, by ``order``, of each distinct key."""
    by = np.lexsort([*reversed(order), *reversed(keys)])
    changed = np.zeros(len(by), dtype=bool)
    changed[:1] = True
    for key in keys:
        changed[1:] |= key[by][1:] != key[by][:-1]
    return by[changed]


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _run_rows(batches: Iterable[pa.RecordBatch], length: int, hot: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Runs of every document, equal ones of a batch combined to the first (not when sampling)."""
    for batch in chunks(batches, BATCH):
        parts = []
        ids, ties = _column(batch, "_d"), _column(batch, "_t")
        for start in range(0, batch.num_rows, CHUNK):
            part = batch.slice(start, CHUNK)
            hashes, sizes = _joined(part, part.schema.get_field_index("text"))
            anchor, content, first, count = anchored_runs(hashes, sizes, length)
            ends = np.cumsum(sizes)
            row = np.searchsorted(ends, first, side="right")
            local = first - (ends - sizes)[row]
            run = (local << RUN_BITS) | (count << 1)
            parts.append((anchor.view(np.int64), content.view(np.int64), ids[start + row], ties[start + row], run))
        anchor, content, d, t, run = (np.concatenate(x) for x in zip(*parts, strict=True))
        salt = np.zeros(len(anchor), dtype=np.int64)
        if hot is not None:
            keep = _first_of_equal([anchor, content], [d, t, run])
            anchor, content, d, t, run = (x[keep] for x in (anchor, content, d, t, run))
            salt = np.where(np.isin(anchor, hot), content, 0)
        yield pa.RecordBatch.from_pydict({"anchor": anchor, "salt": salt, "content": content, "_d": d, "_t": t, "run": run})


def _window_rows(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Hashes of the windows in runs that are flagged, equal ones of a batch combined to the first."""
    for batch in chunks(batches, BATCH):
        runs = batch.column(batch.schema.get_field_index("_runs")).to_pylist()
        ids, ties = _column(batch, "_d"), _column(batch, "_t")
        texts = batch.column(batch.schema.get_field_index("text"))
        found: list[tuple[np.ndarray, ...]] = []
        for row, marks in enumerate(runs):
            flagged = np.array([run for run in marks or () if run & 1], dtype=np.int64)
            if not len(flagged):
                continue
            hashes = word_hashes(WORD_BYTES.findall((texts[row].as_py() or "").encode("utf-8", "surrogatepass")))
            begin, count = flagged >> RUN_BITS, (flagged & ((1 << RUN_BITS) - 1)) >> 1
            at = np.repeat(begin, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            one, two = (rolling(hashes, length, factor)[at] for factor in (0xD6E8FEB86659FD93, 0xCF1BBCDCB7A56463))
            n = len(at)
            found.append((one.view(np.int64), two.view(np.int64), np.full(n, ids[row]), np.full(n, ties[row]), at))
        if found:
            one, two, d, t, at = (np.concatenate(x) for x in zip(*found, strict=True))
            keep = _first_of_equal([one, two], [d, t, at])
            columns = {"one": one, "two": two, "_d": d, "_t": t, "at": at}
            yield pa.RecordBatch.from_pydict({name: values[keep] for name, values in columns.items()})


def kept_words(words: list[str], runs: list[int] | None, firsts: list[int] | None, length: int) -> list[str]:
    """The words no repeated window covers.

    ``runs`` are the runs whose windows are first occurrences; of the flagged ones, only the windows
    that begin at one of ``firsts``. All other windows of the document repeat an earlier one.
    """
    total = len(words) - length + 1
    if total <= 0:
        return words
    repeated = np.ones(total, dtype=bool)
    for run in runs or ():
        if not run & 1:
            begin = run >> RUN_BITS
            repeated[begin : begin + ((run & ((1 << RUN_BITS) - 1)) >> 1)] = False
    if firsts:
        repeated[np.array(firsts)] = False
    if not repeated.any():
        return words
    edge = np.zeros(len(words) + 1, dtype=np.int32)
    edge[:total] += repeated
    edge[length : length + total] -= repeated
    covered = np.cumsum(edge[:-1]) > 0
    return [word for word, gone in zip(words, covered.tolist(), strict=True) if not gone]


def _cleaned_rows(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        runs = batch.column(batch.schema.get_field_index("_runs")).to_pylist()
        firsts = batch.column(batch.schema.get_field_index("_firsts")).to_pylist()
        before, after, texts = [], [], []
        for text, run, first in zip(
            texts_of(batch.column(batch.schema.get_field_index("text"))), runs, firsts, strict=True
        ):
            words = WORD.findall(text)
            kept = kept_words(words, run, first, length)
            before.append(len(words))
            after.append(len(words) - len(kept))
            texts.append(" ".join(kept))
        added = {
            "n_words": pa.array(before, pa.int64()),
            "n_removed": pa.array(after, pa.int64()),
            "kept_text": pa.array(texts, pa.string()),
        }
        yield with_columns(batch, added)


def _hot_anchors(rows: DataFrame, length: int) -> np.ndarray:
    """Anchors that may hold a large share of all runs, from one document in SAMPLE.

    A document has at most one run per word, so their number is bounded by 1 / HOT_SHARE times the
    words of a document, whatever the number of documents.
    """
    sample = rows.filter(F.pmod(F.xxhash64("_d", "_t"), F.lit(SAMPLE)) == 0)
    runs = sample.mapInArrow(lambda batches: _run_rows(batches, length, None), _RUNS)
    counted = runs.groupBy("anchor").agg(F.count("*").alias("n"))
    floor = F.greatest(sample.agg(F.count("*") * HOT_SHARE).scalar(), F.lit(HOT_LEAST))
    return counted.filter(F.col("n") >= floor).select("anchor").toPandas()["anchor"].to_numpy(np.int64)


_RUNS = "anchor long, salt long, content long, _d long, _t int, run long"


def remove_repeats(documents: DataFrame, length: int = 20) -> DataFrame:
    """Drop every word covered by a window of ``length`` words that also starts earlier.

    Returns the columns of ``documents`` with ``n_words``, ``n_removed`` and ``kept_text`` (kept
    words joined by one space). Earlier means a smaller doc_id, or an earlier start in the same
    document; windows are judged on the input.

    Seeds: every window is filed under its winnowed anchor (see ``anchored_runs``), about one run of
    windows for six words. Runs of equal content are combined before and after the shuffle to the
    first; its windows are first occurrences unless another content shares the anchor. Only then
    are single windows compared, by 128-bit hashes. Results travel back by document, so a passage
    that a third of all documents share never meets in one task: equal contents are combined
    in the task that reads them, and an anchor found often in different surroundings is salted by
    its content (its windows are then always compared one by one). Per-document lists are bounded by
    the words of that document.

    Null text has no words. Documents without id come after all others. Rows that share an id are
    ordered by a checksum of their text; rows equal in both count as one document, so neither
    removes the other. Documents shorter than a window keep all words. No rows give no rows.
    """
    if not ANCHOR_WORDS < length < 1 << RUN_BITS - 1:
        raise ValueError(f"windows have {ANCHOR_WORDS + 1} to {(1 << RUN_BITS - 1) - 1} words")
    clash = [c for c in documents.columns if c in ("_d", "_t", "_runs", "_firsts", "n_words", "n_removed", "kept_text")]
    rows = documents.drop(*clash).select(
        "*",
        F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("_d"),
        F.hash("text").alias("_t"),
    )
    narrow = rows.select("_d", "_t", "text")
    hot = _hot_anchors(narrow, length)
    runs = narrow.mapInArrow(lambda batches: _run_rows(batches, length, hot), _RUNS)
    first = F.min(F.struct("_d", "_t", "run")).alias("first")
    contents = runs.repartition("anchor", "salt").groupBy("anchor", "salt", "content").agg(first)
    same_anchor = Window.partitionBy("anchor", "salt")
    several = (F.min("content").over(same_anchor) != F.max("content").over(same_anchor)) | (F.col("salt") != 0)
    marked = contents.select("first.*", several.cast("long").alias("flag"))
    marks = marked.groupBy("_d", "_t").agg(F.collect_list(F.col("run") + F.col("flag")).alias("_runs"))
    known = rows.join(marks, ["_d", "_t"], "left")
    windows = known.mapInArrow(lambda batches: _window_rows(batches, length), "one long, two long, _d long, _t int, at long")
    earliest = windows.groupBy("one", "two").agg(F.min(F.struct("_d", "_t", "at")).alias("first")).select("first.*")
    firsts = earliest.groupBy("_d", "_t").agg(F.collect_list("at").alias("_firsts"))
    joined = known.join(firsts, ["_d", "_t"], "left")
    added = ("n_words", "n_removed", "kept_text")
    schema = field_types(joined, added) + ", n_words long, n_removed long, kept_text string"
    cleaned = joined.mapInArrow(lambda batches: _cleaned_rows(batches, length), schema)
    return cleaned.drop("_d", "_t", "_runs", "_firsts")


def kept_digest(kept_text: Column) -> Column:
    return F.sha2(kept_text.cast("binary"), 256)
