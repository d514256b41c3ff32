"""Spelling variants: words one edit apart, found by products of letter-count blocks."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.llm.words import chunks, texts_of
from galley.operators.skew import balanced_lookup
from galley.session import stage

#: a to z, then U+00C0 to U+00FF: the letters a word can have.
LETTERS = 26 + 64
#: Letters are dealt to so many sets in turn; words in one block agree in the counts of most sets.
SETS = 5
#: Words and bytes a task counts before it passes the counts on.
HELD_WORDS, HELD_BYTES = 200_000, 32_000_000
#: Rows of one product, and the bytes of letters in them.
TILE, TILE_BYTES = 128, 16_000_000
#: Words of a block that stay in one task; larger blocks are cut into pairs of parts.
BLOCK_WORDS = 8_192
#: Large blocks whose list is broadcast, at some twenty bytes each.
MAX_LARGE = 500_000
#: A step of the chain of forms at least doubles n, and n is a long.
CHAIN_ROUNDS = 7


def damaged(run: str, checksum: int, one_in: int) -> str:
    """The run without one letter if ``one_in`` divides the checksum, else as it is."""
    if checksum % one_in:
        return run
    at = checksum % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(documents: DataFrame, one_in: int = 97, least_letters: int = 5) -> DataFrame:
    """(word, n): the runs of letters of whole texts, in lower case, some of them damaged, and how often each occurs.

    A run loses a letter if ``one_in`` divides the CRC-32 of ``<doc_id>:<run>`` (a null id is empty).
    Words shorter than ``least_letters`` are left out. Counts are added up in each task, in a table of
    bounded size, before they are shuffled.
    """

    def batch_of(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"]
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(f"[a-zÀ-ÿ]{{{least_letters},}}").findall  # runs that are shorter stay so
        counts: Counter = Counter()
        held = 0
        for batch in chunks(batches, 256):
            ids = batch.column(0).cast(pa.string()).to_pylist()
            for doc_id, text in zip(ids, texts_of(batch.column(1)), strict=True):
                prefix = zlib.crc32(f"{doc_id or ''}:".encode())
                before = len(counts)
                lower = text.encode().lower().decode()  # as bytes: A to Z only
                for found, n in Counter(find(lower)).items():
                    checksum = zlib.crc32(found.encode(), prefix)
                    word = found if checksum % one_in else damaged(found, checksum, one_in)
                    if len(word) >= least_letters:
                        counts[word] += n
                        held += len(word)
                if len(counts) > HELD_WORDS or (held > HELD_BYTES and len(counts) > before):
                    yield batch_of(counts)
                    counts, held = Counter(), 0
        if counts:
            yield batch_of(counts)

    parts = documents.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


class Letters:
    """Words as code points in one array, and their letter counts."""

    def __init__(self, words: list[str]):
        self.lengths = np.array([len(word) for word in words], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        self.codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)

    def counts(self, rows: np.ndarray) -> np.ndarray:
        """Letter counts of some words as a matrix, in numbers whose products are exact."""
        lengths = self.lengths[rows]
        row = np.repeat(np.arange(len(rows)), lengths)
        at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(self.starts[rows], lengths)
        code = self.codes[at]
        letter = np.where(code < 0xC0, code - 97, code - 0xC0 + 26).astype(np.int64)
        found = np.bincount(row * LETTERS + letter, minlength=len(rows) * LETTERS)
        exact = np.float32 if lengths.max(initial=0) < 1_000 else np.float64
        return found.reshape(len(rows), LETTERS).astype(exact)

    def _rows(self, words: np.ndarray, length: int, skip: int = 0) -> np.ndarray:
        return self.codes[self.starts[words][:, None] + np.arange(skip, skip + length)]

    def one_edit(self, short: np.ndarray, long: np.ndarray) -> np.ndarray:
        """For pairs of words, the second as long as the first or longer by one: do they differ by one
        replaced or one inserted letter?"""
        keep = np.zeros(len(short), dtype=bool)
        lengths = self.lengths[short]
        longer = self.lengths[long] - lengths
        for length in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == length)
            step = max(1, TILE_BYTES // (4 * length))
            for part in (own[k : k + step] for k in range(0, len(own), step)):
                left = self._rows(short[part], length)
                same = left == self._rows(long[part], length)
                prefix = np.where(same.all(axis=1), length, same.argmin(axis=1))
                shift = longer[part]
                after = self.codes[(self.starts[long[part]] + shift)[:, None] + np.arange(length)]
                tail = (left == after)[:, ::-1]
                suffix = np.where(tail.all(axis=1), length, tail.argmin(axis=1))
                keep[part] = prefix + suffix >= length - (1 - shift)
                keep[part] &= (shift == 1) | (prefix < length)
        return keep


def _sets() -> np.ndarray:
    """The set of every letter."""
    return np.arange(LETTERS) % SETS


def set_choices(radius: int) -> list[tuple[int, ...]]:
    """The choices of ``radius`` sets that may differ."""
    return list(combinations(range(SETS), radius))


#: Words of equal length one replaced letter apart differ in the counts of two letters, so in two sets
#: at most; words one inserted letter apart in one letter's, so in one set.
EQUAL, NEXT = set_choices(2), set_choices(1)
#: Kinds of blocks: each choice for words of equal length, then each for words of a length and the next.
KINDS = [(False, choice) for choice in EQUAL] + [(True, choice) for choice in NEXT]


def _factors() -> np.ndarray:
    """A fixed odd 64-bit factor for every letter, spread by the golden ratio's bits."""
    golden = np.uint64(0x9E3779B97F4A7C15)
    mixed = (np.arange(1, LETTERS + 1, dtype=np.uint64) * golden) ^ (np.arange(1, LETTERS + 1, dtype=np.uint64) << np.uint64(17))
    mixed *= golden
    mixed ^= mixed >> np.uint64(29)
    return mixed * golden | np.uint64(1)


def block_keys(letters: Letters, rows: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, key, rows) of all blocks that words go to: hashes of the kind, the length, and the letter counts of
    the sets that agree. Words with equal counts there have equal keys; a chance collision only adds
    candidates, which the products refuse."""
    counts, sets, factors = letters.counts(rows).astype(np.uint64), _sets(), _factors()
    sums = [counts[:, sets == s] @ factors[sets == s] for s in range(SETS)]
    lengths = letters.lengths[rows].astype(np.uint64)
    golden = np.uint64(0x9E3779B97F4A7C15)
    out = []
    for kind, (adjacent, choice) in enumerate(KINDS):
        agreed = sum((sums[s] * np.uint64(2 * s + 3) for s in range(SETS) if s not in choice), np.zeros(len(rows), np.uint64))
        for block in (lengths, lengths - np.uint64(1)) if adjacent else (lengths,):
            key = agreed ^ (block * np.uint64(len(KINDS)) + np.uint64(kind + 1)) * golden
            key ^= key >> np.uint64(31)
            out.append((kind, (key * golden).view(np.int64), rows))
    return out


def block_rows(words: DataFrame) -> DataFrame:
    """(key, kind, word, n): a row for every block a word goes to."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 2_000):
            letters = Letters(batch.column(0).to_pylist())
            for kind, keys, rows in block_keys(letters, np.arange(batch.num_rows)):
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys), pa.array(np.full(len(rows), kind, np.int32)),
                        batch.column(0).take(at), batch.column(1).take(at),
                    ],
                    names=["key", "kind", "word", "n"],
                )

    return words.select("word", "n").mapInArrow(run, "key long, kind int, word string, n long")


def large_blocks(words: DataFrame, work_folder: str | None = None) -> DataFrame:
    """(key, parts) of the blocks over BLOCK_WORDS words: at most one in as many block rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 2_000):
            letters = Letters(batch.column(0).to_pylist())
            found = block_keys(letters, np.arange(batch.num_rows))
            keys, n = np.unique(np.concatenate([keys for _, keys, _ in found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

    counted = words.select("word").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    parts = F.ceil(F.col("n") / BLOCK_WORDS).cast("int").alias("parts")
    return stage(counted.filter(F.col("n") > BLOCK_WORDS).select("key", parts), "blocks", work_folder)


def cut_blocks(blocks: DataFrame, large: DataFrame) -> DataFrame:
    """Large blocks become pairs of parts: (key, first, second, part, kind, word, n).

    A word of part p goes to all pairs with p. Two words meet in the pair of their parts, or, if they
    share a part, in that part by itself. The list of large blocks is broadcast up to MAX_LARGE rows;
    beyond that it is joined by shuffle.
    """
    listed = F.broadcast(large) if large.count() <= MAX_LARGE else large
    parts = F.coalesce("parts", F.lit(1))
    return (
        blocks.join(listed, "key", "left")
        .withColumn("part", F.pmod(F.xxhash64("word"), parts).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .select("key", F.least("part", "_other").alias("first"), F.greatest("part", "_other").alias("second"),
                "part", "kind", "word", "n")
    )


def _products(letters: Letters, group: np.ndarray, part: np.ndarray, kind: np.ndarray, mixed: np.ndarray):
    """Pairs (short, long) of rows of one group that are one edit apart.

    ``group`` is sorted, so a tile of rows meets itself and the later tiles its groups reach into.
    The product of two tiles of letter counts gives all squared distances; pairs at more than two are
    left at once, as are those another kind of block reports.
    """
    total, sets = len(group), _sets()
    longer = np.array([int(adjacent) for adjacent, _ in KINDS])
    reporter = _reporter(longer)
    ends = np.searchsorted(group, group, side="right")
    rows = max(1, min(TILE, TILE_BYTES // (8 * max(LETTERS, int(letters.lengths.max(initial=1))))))
    tiles = [np.arange(k, min(k + rows, total)) for k in range(0, total, rows)]
    made: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def counts(k: int):
        if k not in made:
            found = letters.counts(tiles[k])
            made[k] = found, (found * found).sum(axis=1)
        return made[k]

    for i, left in enumerate(tiles):
        for j in range(i, len(tiles)):
            right = tiles[j]
            if j > i and ends[left[-1]] <= right[0]:
                break
            (a, a_square), (b, b_square) = counts(i), counts(j)
            distance = a_square[:, None] + b_square[None, :] - 2 * (a @ b.T)
            near = (distance <= 2) & (distance > 0) & (group[left][:, None] == group[right][None, :])
            if i == j:
                near = np.triu(near, 1)
            if mixed[left].any():
                near &= ~mixed[left][:, None] | (part[left][:, None] != part[right][None, :])
            x, y = np.nonzero(near)
            if not len(x):
                continue
            differ = a[x] != b[y]
            touched = np.stack([differ[:, sets == s].any(axis=1) for s in range(SETS)], axis=1)
            x, y = left[x], right[y]
            swap = letters.lengths[x] > letters.lengths[y]
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            step = longer[kind[x]]
            keep = (reporter[step, touched @ (1 << np.arange(SETS))] == kind[x]) & (letters.lengths[y] - letters.lengths[x] == step)
            x, y = x[keep], y[keep]
            if len(x):
                edit = letters.one_edit(x, y)
                yield x[edit], y[edit]
        made.pop(i, None)


def _reporter(longer: np.ndarray) -> np.ndarray:
    """The kind of block that reports a pair, by difference of lengths and the sets that differ: the first whose choice
    holds all of these; -1 for none."""
    first = np.full((2, 1 << SETS), -1)
    for number in reversed(range(len(KINDS))):
        allowed = sum(1 << s for s in KINDS[number][1])
        for differing in range(1 << SETS):
            if not differing & ~allowed:
                first[longer[number], differing] = number
    return first


def _near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs, both ways, in runs of rows with equal (key, first, second)."""
    held: list[pa.RecordBatch] = []

    def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
        marks = np.column_stack([table.column(k).to_numpy() for k in ("key", "first", "second")])
        new = np.concatenate([[False], np.any(marks[1:] != marks[:-1], axis=1)])
        group = np.cumsum(new)
        shared = np.bincount(group)[group] > 1
        if not shared.any():
            return
        table = table.filter(pa.array(shared))
        words, n = table.column("word").combine_chunks(), table.column("n").to_numpy()
        letters = Letters(words.to_pylist())
        mixed = marks[shared, 1] != marks[shared, 2]
        part, kind = table.column("part").to_numpy(), table.column("kind").to_numpy()
        for x, y in _products(letters, group[shared], part, kind, mixed):
            ends = np.concatenate([x, y]), np.concatenate([y, x])
            yield pa.RecordBatch.from_arrays(
                [words.take(pa.array(ends[0])), words.take(pa.array(ends[1])), pa.array(n[ends[1]])],
                names=["word", "near", "near_n"],
            )

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        marks = np.column_stack([batch.column(batch.schema.get_field_index(k)).to_numpy() for k in ("key", "first", "second")])
        changes = np.flatnonzero(np.any(marks[1:] != marks[:-1], axis=1))
        if len(changes):
            cut = table.num_rows - batch.num_rows + int(changes[-1]) + 1
            yield from flush(table.slice(0, cut))
            held = table.slice(cut).to_batches()
    if held:
        yield from flush(pa.Table.from_batches(held))


def near_words(words: DataFrame, work_folder: str | None = None) -> DataFrame:
    """(word, near, near_n) for every two words of ``words(word, n)`` one edit apart, both ways, once each.

    Words meet in blocks of a length, or of a length and the next, that agree in the letter counts of
    three sets of letters out of five (four, where a letter more is looked for); every pair one edit
    apart does so in some block, and one of these reports it. Blocks are dealt over all tasks by a
    hash. Inside a block the product of its letter-count matrix with itself gives all squared
    distances, tile by tile; pairs at most two apart are checked letter by letter.
    """
    blocks = cut_blocks(block_rows(words), large_blocks(words, work_folder))
    dealt = blocks.repartition("key", "first", "second")
    ordered = dealt.sortWithinPartitions("key", "first", "second")
    return ordered.mapInArrow(_near, "word string, near string, near_n long")


def _roots(forms: DataFrame, work_folder: str | None) -> DataFrame:
    """(word, root): the end of the chain of forms, by doubling the step each round.

    n at least doubles with every form, so a chain has at most 63 steps and six rounds reach its end.
    """
    links = stage(forms.select("word", F.col("form").alias("root")), "forms", work_folder)
    for _ in range(CHAIN_ROUNDS):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        wanted = links.groupBy("root").agg(F.count("*").alias("_weight"))
        lookup = wanted.join(onward, "root")
        if lookup.isEmpty():
            break
        moved = balanced_lookup(links, lookup, ["root"], "_weight", "word", ["_next"])
        links = stage(moved.select("word", F.coalesce("_next", "root").alias("root")), "forms", work_folder)
    return links


def spelling_variants(
    documents: DataFrame,
    one_in: int = 97,
    least_letters: int = 5,
    least_n: int = 3,
    ratio: int = 2,
    work_folder: str | None = None,
) -> DataFrame:
    """Words of a corpus with the more frequent word each is a variant of.

    A row per word with ``least_letters`` letters and ``least_n`` occurrences: word, n, n_near (words one
    inserted, deleted or replaced letter away), form (the near word with the largest n, if that is
    ``ratio`` times the word's own or more; ties go to the smallest word), form_n, and root (the last
    word that forms lead to, the word itself without one).

    Words count over all rows, repeated rows included; null and empty texts have none, and a null
    doc_id counts as empty. A very long run of letters is one word. An empty table gives no rows.
    Other columns are not read. Blocks with more than BLOCK_WORDS words are cut into pairs of parts, so
    none is one task's; a word with very many neighbours is aggregated before it is shuffled.
    """
    counted = word_counts(documents, one_in, least_letters).filter(F.col("n") >= least_n)
    words = stage(counted, "words", work_folder)
    best = near_words(words, work_folder).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("_best")
    )
    chosen = F.when(-F.col("_best.less") >= ratio * F.col("n"), F.col("_best"))
    found = stage(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            chosen["near"].alias("form"), (-chosen["less"]).alias("form_n"),
        ),
        "variants", work_folder,
    )
    roots = _roots(found.filter(F.col("form").isNotNull()), work_folder)
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
