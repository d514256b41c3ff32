"""Near-duplicates by SimHash, compared on vertical bit planes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.llm.components import connected_components
from galley.llm.words import WORD_BYTES, chunks, texts_of
from galley.operators.skew import balanced_lookup
from galley.session import stage

BITS = 64
SEED = 42
#: Shingle hashes whose bits are counted at once.
SLICE = 1 << 15


def fingerprint(text: str, shingle: int) -> int:
    """A bit is set where more than half the shingle hashes have it set; 0 without words."""
    from xxhash import xxh64_intdigest

    words = WORD_BYTES.findall(text.encode("utf-8", "surrogatepass").lower())  # bytes: A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    starts = list(accumulate((len(word) + 1 for word in words), initial=0))
    size = min(shingle, len(words))
    hashes = np.array(
        [xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[size:])], dtype=np.uint64
    )
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), SLICE):
        part = hashes[at : at + SLICE].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) with the 64 bits of the fingerprint as a long, for every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found = np.array([fingerprint(text, shingle) for text in texts_of(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"]
            )

    rows = documents.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def block_masks(radius: int) -> list[int]:
    """Masks such that two fingerprints within the radius agree under at least one of them.

    The bits are cut into radius + 6 blocks. Differing bits touch at most ``radius`` blocks, so some
    choice of the other six agrees. What a mask leaves open bounds the distinct fingerprints that
    can share a key: 2 ** 16 for radius 2.
    """
    blocks = np.array_split(np.arange(BITS), radius + 6)
    masks = []
    for left_out in combinations(range(len(blocks)), radius):
        kept = [bit for k, block in enumerate(blocks) if k not in left_out for bit in block.tolist()]
        masks.append(sum(1 << bit for bit in kept))
    return masks


def vertical_planes(values: np.ndarray) -> np.ndarray:
    """Bit planes of 64-bit values: word [k, b] holds bit b of the values 64 k to 64 k + 63."""
    blocks = -(-len(values) // 64)
    padded = np.zeros(blocks * 64, dtype=np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(blocks, 64, 8), axis=2, bitorder="little")
    turned = np.ascontiguousarray(bits.transpose(0, 2, 1))  # block, bit, value
    return np.packbits(turned, axis=2, bitorder="little").view(np.uint64).reshape(blocks, BITS)


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Bit-wise test of vertical counters: larger than the radius."""
    larger = np.zeros_like(counters[0])
    equal = ~larger
    for place in reversed(range(len(counters))):
        if radius >> place & 1:
            equal &= counters[place]
        else:
            larger |= equal & counters[place]
            equal &= ~counters[place]
    return larger


def close_pairs(groups: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places in one group whose values differ in at most ``radius`` bits.

    ``groups`` is sorted. Each value is held against blocks of 64 later values of its group. The
    differences of all 64 are counted at once, bit plane by bit plane, by adding with carry into
    vertical counters; every eight planes, the blocks in which all have passed the radius are left.
    """
    total = len(values)
    if total < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    planes = vertical_planes(values)
    last = np.append(np.flatnonzero(groups[1:] != groups[:-1]), total - 1)
    end = last[np.searchsorted(last, np.arange(total))] + 1
    ones = ~np.uint64(0)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    query = np.arange(total)[end > np.arange(total) + 1]
    block = query // 64
    while len(query):
        low = np.maximum(query + 1 - 64 * block, 0).astype(np.uint64)
        high = np.minimum(end[query] - 64 * block, 64).astype(np.uint64)
        wanted = np.where(low < 64, ones << np.minimum(low, np.uint64(63)), np.uint64(0))
        wanted &= ones >> (np.uint64(64) - high)
        live = np.flatnonzero(wanted)
        place, blocks, wanted, own = query[live], block[live], wanted[live], values[query[live]]
        counters = [np.zeros(len(place), dtype=np.uint64) for _ in range(max(1, radius.bit_length()))]
        passed = np.zeros(len(place), dtype=np.uint64)
        for bit in range(BITS):
            carry = planes[blocks, bit] ^ (np.uint64(0) - (own >> np.uint64(bit) & np.uint64(1)))
            for counter in counters:
                carried = counter & carry
                counter ^= carry
                carry = carried
            passed |= carry
            if bit % 8 == 7:
                passed |= _above(counters, radius)
                keep = np.flatnonzero(wanted & ~passed)
                if len(keep) < len(place):
                    place, blocks, wanted, own, passed = (x[keep] for x in (place, blocks, wanted, own, passed))
                    counters = [counter[keep] for counter in counters]
        if len(place):
            near = np.unpackbits((wanted & ~passed).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, offset = np.nonzero(near)
            found.append((place[row], 64 * blocks[row] + offset))
        block = block + 1
        more = 64 * block < end[query]
        query, block = query[more], block[more]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _forest(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Enough of the pairs to connect what they connect."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept = []
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        root, other = top(a), top(b)
        if root != other:
            parent[other] = root
            kept.append((a, b))
    return kept


def _links(batches: Iterable[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links within runs of equal (table, key); the last run of a batch waits for the next batch."""
    held = np.empty((0, 3), dtype=np.int64)

    def links(rows: np.ndarray) -> pa.RecordBatch:
        new = np.any(rows[1:, :2] != rows[:-1, :2], axis=1)
        groups = np.concatenate([[0], np.cumsum(new)])
        shared = np.bincount(groups)[groups] > 1
        groups, values = groups[shared], rows[shared, 2].astype(np.int64)
        pairs = _forest(*close_pairs(groups, values.view(np.uint64), radius))
        a = pa.array([int(values[i]) for i, _ in pairs], pa.int64())
        b = pa.array([int(values[j]) for _, j in pairs], pa.int64())
        return pa.RecordBatch.from_arrays([a, b], names=["a", "b"])

    for batch in batches:
        rows = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)])
        held = np.concatenate([held, rows])
        changes = np.flatnonzero(np.any(held[1:, :2] != held[:-1, :2], axis=1))
        if len(changes):
            cut = changes[-1] + 1
            yield links(held[:cut])
            held = held[cut:]
    if len(held):
        yield links(held)


def fingerprint_links(distinct: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that connect all fingerprints of ``distinct(fp)`` within the radius of each other."""
    masks = [mask - (1 << 64) if mask >> 63 else mask for mask in block_masks(radius)]
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(mask).cast("long")) for mask in masks])
    keyed = distinct.select("fp", F.posexplode(keys).alias("block", "key")).select("block", "key", "fp")
    dealt = keyed.repartition("block", "key").sortWithinPartitions("block", "key")
    return dealt.mapInArrow(lambda batches: _links(batches, radius), "a long, b long")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def simhash_groups(
    documents: DataFrame, shingle: int = 3, radius: int = 2, work_folder: str | None = None
) -> DataFrame:
    """(doc_id, fingerprint, component_id, linked) per row: groups of fingerprints that links connect.

    ``component_id`` is the smallest doc_id that can be reached; ``linked`` counts the rows that
    share the fingerprint. Rows with equal fingerprints are one node from the start, so copies are
    counted before any comparison. Keys that fingerprints are compared under hold a bounded number
    of distinct ones, so no key can be hot, and pairs never leave a task.

    Null, empty or blank text has fingerprint 0 and links like any other. Null ids are never the
    smallest; a group of nulls only has a null component. Repeated rows stay. Long texts are counted
    in slices. No rows give no rows. Other columns are not read.
    """
    prints = stage(fingerprints(documents, shingle), "fingerprints", work_folder)
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("linked"))
    roots = connected_components(fingerprint_links(nodes.select("fp"), radius), work_folder)
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    lookup = stage(rooted.join(least, "root").select("fp", "linked", "component_id"), "components", work_folder)
    found = balanced_lookup(prints, lookup, ["fp"], "linked", "doc_id", ["component_id", "linked"])
    return found.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id", "linked")


def keep_one_of_each(documents: DataFrame, groups: DataFrame) -> DataFrame:
    """The documents that are the first of their group, all columns.

    Rows that repeat both id and text count once; other rows that share an id stand or fall together.
    Where a whole group has no ids, its distinct texts stay.
    """
    first = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_first"))
    kept = documents.join(first.distinct(), F.col("doc_id").eqNullSafe(F.col("_first")), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"])
