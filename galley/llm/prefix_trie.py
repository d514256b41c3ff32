"""Prefix trie of conversations from sorted, padded matrices of turn ids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from galley.llm.words import words_column
from galley.operators.skew import balanced_lookup
from galley.session import stage

#: Bytes of a turn id.
ID_BYTES = 16
#: Columns of a padded matrix; deeper turns go to further matrices of the rows that still tie.
COLUMNS = 16
#: Conversations of a range shard, about.
SHARD_ROWS = 50_000
#: Fewer conversations make no shard of their own, so that a small table gives few files.
LEAST_ROWS = 500
#: Bytes of the pieces in which open lists of ends travel.
CHUNK_BYTES = 4_096
NODES = {
    "kind": pa.int32(), "node": pa.binary(), "parent": pa.binary(), "conv_id": pa.int64(), "depth": pa.int64(),
    "parent_conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(),
    "saved_tokens": pa.int64(), "ends_sha256": pa.string(), "shard": pa.int32(), "place": pa.int32(), "chunk": pa.string(),
}
INNER, OPEN, ENDS = 0, 1, 2
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_id(role: Column, text: Column) -> Column:
    """128 bits that stand for a turn: a digest of the length of the role, the role and the text."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def turn_lists(conversations: DataFrame, group: int = 20) -> DataFrame:
    """(first, conv_id, turns): the turns of every conversation in order, as (turn, id, words).

    ``first`` is the id rounded down to a multiple of ``group``. Only ids and word counts are shuffled,
    once, by it. Turns are ordered by number, nulls first, then by id.
    """
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            turn_id(F.col("role"), F.col("text")).alias("id"),
            F.size(words_column(F.col("text"))).alias("words"),
        ).alias("one"),
    )
    keyed = rows.withColumn("first", F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(group))).repartition("first")
    return keyed.groupBy("first", "conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))


def rebuilt(lists: DataFrame, heads: int = 4) -> DataFrame:
    """(conv_id, turns) with the first turns of a conversation replaced by those of conversation ``first``.

    How many is CRC-32 of the id as text, modulo ``heads``; fewer where that conversation has fewer, none
    where it is absent. Ids below zero round down as well.
    """
    head = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("int")
    owners = lists.filter(F.col("first") == F.col("conv_id")).select("first", F.slice("turns", 1, heads - 1).alias("_head"))
    joined = lists.join(owners, "first", "left").withColumn("_h", head)
    own = F.slice("turns", F.col("_h") + 1, F.size("turns"))
    taken = F.slice(F.coalesce("_head", F.slice("turns", 1, 0)), F.lit(1), F.col("_h"))
    return joined.select("conv_id", F.concat(taken, own).alias("turns"))


def sequences(lists: DataFrame) -> DataFrame:
    """(conv_id, ids, words): the turn ids one after another as binary, and the words of every turn."""
    ids = F.unhex(F.array_join(F.transform("turns", lambda turn: turn["id"]), ""))
    return lists.select("conv_id", ids.alias("ids"), F.transform("turns", lambda turn: turn["words"]).alias("words"))


def _shared_turns(left: Column, right: Column) -> Column:
    """Turns that two id strings have in common at their start; -1 if one is missing."""
    turns = (F.least(F.octet_length(left), F.octet_length(right)) / ID_BYTES).cast("int")
    other = F.filter(
        F.sequence(F.lit(0), turns - 1),
        lambda k: F.substring(left, k * ID_BYTES + 1, F.lit(ID_BYTES)) != F.substring(right, k * ID_BYTES + 1, F.lit(ID_BYTES)),
    )
    shared = F.when(turns == 0, 0).otherwise(F.coalesce(F.array_min(other), turns))
    return F.when(left.isNull() | right.isNull(), -1).otherwise(shared)


def shard_borders(sharded: DataFrame) -> DataFrame:
    """(shard, from_last, to_next, goes_on): what a shard has to know of its neighbours; a row per shard.

    ``from_last``: turns its first row shares with the row before; ``to_next``: turns its last row shares
    with the row after; -1 where there is none. ``goes_on``: the next row that differs from the last one
    continues it, be it some shards further on.
    """
    ends = sharded.groupBy("shard").agg(F.min("ids").alias("low"), F.max("ids").alias("high"))
    second = (
        sharded.join(ends.select("shard", "low"), "shard")
        .filter(F.col("ids") > F.col("low"))
        .groupBy("shard")
        .agg(F.min("ids").alias("second"))
    )
    order = Window.orderBy("shard")  # a row per shard
    before, after = F.lag("high").over(order), F.lead("low").over(order)
    new = F.when(before.isNull() | (F.col("low") != before), F.col("low")).otherwise(F.col("second"))
    following = F.first("_new", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    known = ends.join(second, "shard", "left").select("*", before.alias("_before"), after.alias("_after"), new.alias("_new"))
    known = known.select("*", following.alias("_following"))
    goes_on = F.substring("_following", F.lit(1), F.octet_length("high")) == F.col("high")
    return known.select(
        "shard",
        _shared_turns(F.col("_before"), F.col("low")).alias("from_last"),
        _shared_turns(F.col("high"), F.col("_after")).alias("to_next"),
        F.coalesce(goes_on, F.lit(False)).alias("goes_on"),
    )


class Shard:
    """The conversations of one shard in the order of their turns.

    ``differs[i]`` is the depth from which on the nodes of row i are not those of the row above, where
    the change masks of the columns, accumulated with OR, are set; for the first row, of the row
    before the shard. ``runs`` numbers the rows with equal turns.
    """

    def __init__(self, conv: np.ndarray, ids: list[bytes], words: np.ndarray, lengths: np.ndarray, from_last: int):
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        self._flat = np.frombuffer(b"".join(ids), dtype=">u8").astype(np.uint64).reshape(-1, 2)
        order = self._sorted(np.lexsort((conv, lengths)), starts, lengths)
        self.conv, self.lengths, self._starts = conv[order], lengths[order], starts[order]
        self._words, self._ids, self._order = words, ids, order
        self.differs = self._change_masks(from_last)
        repeats = np.concatenate([[False], (self.lengths[1:] == self.lengths[:-1]) & (self.differs[1:] > self.lengths[1:])])
        self.runs = np.cumsum(~repeats) - 1

    def _sorted(self, order: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Rows by their turn ids: a padded matrix of COLUMNS turns at a time, of the rows that still tie."""
        rank = np.zeros(len(order), dtype=np.int64)
        places, column = np.arange(len(order)), 0
        while len(places) > 1:
            rows = order[places]
            wanted = np.arange(column, column + COLUMNS)
            there = wanted < lengths[rows][:, None]
            matrix = np.zeros((len(rows), COLUMNS, 2), dtype=np.uint64)
            matrix[there] = self._flat[(starts[rows][:, None] + wanted)[there]]
            keys, before = matrix.reshape(len(rows), -1), rank[places]
            new = np.lexsort((*keys.T[::-1], before))
            order[places], keys, before = rows[new], keys[new], before[new]
            changed = np.concatenate([[True], np.any(keys[1:] != keys[:-1], axis=1) | (before[1:] != before[:-1])])
            groups = np.cumsum(changed) - 1
            rank[places] = places[np.flatnonzero(changed)][groups]
            longer = lengths[order[places]] > column + COLUMNS
            tied = (np.bincount(groups)[groups] > 1) & (np.bincount(groups, weights=longer)[groups] > 0)
            places, column = places[tied], column + COLUMNS
        return order

    def _change_masks(self, from_last: int) -> np.ndarray:
        differs = np.zeros(len(self.conv), dtype=np.int64)
        differs[0] = from_last + 1
        same = np.arange(1, len(self.conv))  # rows whose accumulated mask is not set yet
        depth = 0
        while len(same):
            depth += 1
            differs[same] = depth
            same = same[(self.lengths[same] >= depth) & (self.lengths[same - 1] >= depth)]
            same = same[(self._turns(same, depth) == self._turns(same - 1, depth)).all(axis=1)]
        return differs

    def _turns(self, rows: np.ndarray, depth: int) -> np.ndarray:
        return self._flat[self._starts[rows] + depth - 1]

    def words(self, rows: np.ndarray, depth: int) -> np.ndarray:
        """Words of the turn at a depth, from 1, of rows that reach it."""
        return self._words[self._starts[rows] + depth - 1]

    def leaves(self, goes_on: bool) -> np.ndarray:
        """1 for a row that is the first to reach a node without children. ``goes_on``: what follows the
        shard continues its last row."""
        extends = (self.differs[1:] > self.lengths[:-1]) & (self.lengths[1:] > self.lengths[:-1])
        last_of_run = np.flatnonzero(np.append(self.runs[1:] != self.runs[:-1], True))
        extended = np.append(extends, goes_on)[last_of_run][self.runs]
        return ((self.differs <= self.lengths) & ~extended).astype(np.int64)

    def key(self, row: int, depth: int) -> bytes:
        """What a node is called where several shards have a part of it."""
        return hashlib.md5(self._ids[self._order[row]][: depth * ID_BYTES]).digest() + depth.to_bytes(8, "big")


@dataclass
class Level:
    """The nodes of one depth in a shard, by their first rows."""

    depth: int
    first: np.ndarray
    is_open: np.ndarray
    sums: dict[str, np.ndarray]


def levels(shard: Shard, from_last: int, to_next: int, goes_on: bool) -> list[Level]:
    """The nodes of a shard, root first.

    Rows that start a node at a depth are those whose change mask is set there; what lies between two
    starts belongs to the node. A row adds to all its nodes: itself, the children it starts, the leaf
    it is first to reach, and the words, at and below the depth, of turns it shares with the row above.
    Nodes that the row before or after the shard lies under too are open: the parts of all shards add
    up to the node, since a row's part depends on the row above only.
    """
    total, leaf = len(shard.conv), shard.leaves(goes_on)
    saved = np.zeros(total, dtype=np.int64)
    out = []
    for depth in range(int(shard.lengths.max()), -1, -1):
        rows = np.flatnonzero(shard.lengths >= depth)
        if depth:
            saved[rows] += np.where(shard.differs[rows] > depth, shard.words(rows, depth), 0)
        starts = shard.differs[rows] <= depth
        starts[0] = True
        at = np.flatnonzero(starts)
        stop = np.append(at[1:], len(rows))
        first, last = rows[at], rows[stop - 1]
        child = (shard.lengths[rows] > depth) & (shard.differs[rows] <= depth + 1)
        is_open = ((first == 0) & (from_last >= depth)) | ((last == total - 1) & (to_next >= depth))
        sums = {
            "conv_id": np.minimum.reduceat(shard.conv[rows], at),
            "n_convs": stop - at,
            "n_children": np.add.reduceat(child.astype(np.int64), at),
            "n_leaves": np.add.reduceat(leaf[rows], at),
            "saved_tokens": np.add.reduceat(saved[rows], at),
        }
        out.append(Level(depth, first, is_open, sums))
    return out[::-1]


def _batch(n: int, **columns) -> pa.RecordBatch:
    """A batch of NODES; columns that are not given are null."""
    arrays = [
        pa.nulls(n, kind) if (given := columns.get(name)) is None else given if isinstance(given, pa.Array) else pa.array(given, kind)
        for name, kind in NODES.items()
    ]
    return pa.RecordBatch.from_arrays(arrays, names=list(NODES))


def _shard_batches(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """All output rows of one shard."""
    number, from_last, to_next, goes_on = (table.column(k)[0].as_py() for k in ("shard", "from_last", "to_next", "goes_on"))
    words = table.column("words").combine_chunks()
    lengths = np.diff(words.offsets.to_numpy()).astype(np.int64)
    flat = words.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    shard = Shard(table.column("conv_id").to_numpy(), table.column("ids").to_pylist(), flat, lengths, from_last)
    total = len(shard.conv)
    above = np.zeros(total, dtype=np.int64)  # by row: the smallest member of the node above, and whether that is open
    open_above = np.zeros(total, dtype=bool)
    for level in levels(shard, from_last, to_next, goes_on):
        depth, first, n = level.depth, level.first, len(level.first)
        rows_open = zip(first.tolist(), level.is_open.tolist(), open_above[first].tolist(), strict=True)
        keys = [
            (shard.key(row, depth) if own else None, shard.key(row, depth - 1) if up and depth else None)
            for row, own, up in rows_open
        ]
        stop = np.where(shard.lengths[first] == depth, np.searchsorted(shard.runs, shard.runs[first], side="right"), first)
        # a list of ends that touches the border may go on in the next shard
        split = level.is_open & (stop > first) & ((first == 0) & (from_last == depth) | (stop == total) & (to_next >= depth))
        hashes = [
            None if cut or (own and a == b) else hashlib.sha256(",".join(map(str, shard.conv[a:b].tolist())).encode()).hexdigest()
            for a, b, own, cut in zip(first.tolist(), stop.tolist(), level.is_open.tolist(), split.tolist(), strict=True)
        ]
        yield _batch(
            n, kind=np.where(level.is_open, OPEN, INNER), node=[k for k, _ in keys], parent=[k for _, k in keys],
            depth=np.full(n, depth), ends_sha256=hashes, **level.sums,
            parent_conv_id=pa.array(above[first], mask=open_above[first] if depth else np.ones(n, dtype=bool)),
        )
        for k in np.flatnonzero(split).tolist():
            yield _chunks(shard.conv[first[k] : stop[k]], keys[k][0], number)
        rows = np.flatnonzero(shard.lengths >= depth)
        of = np.searchsorted(first, rows, side="right") - 1
        above[rows], open_above[rows] = level.sums["conv_id"][of], level.is_open[of]


def _chunks(convs: np.ndarray, node: bytes, number: int) -> pa.RecordBatch:
    """A list of ends in pieces."""
    step = CHUNK_BYTES // 20
    parts = [",".join(map(str, convs[k : k + step].tolist())) for k in range(0, len(convs), step)]
    n = len(parts)
    return _batch(n, kind=[ENDS] * n, node=[node] * n, shard=[number] * n, place=list(range(n)), chunk=parts)


def _hash_ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per node of chunks that come in order; holds one hash at a time."""
    node, digest = None, None
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for found, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if found != node:
                if node is not None:
                    done.append((node, digest.hexdigest()))
                node, digest = found, hashlib.sha256(chunk.encode())
            else:
                digest.update(b"," + chunk.encode())
        if done:
            yield _hashes(done)
    if node is not None:
        yield _hashes([(node, digest.hexdigest())])


def _hashes(done: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([n for n, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())], names=["node", "sha"]
    )


def prefix_trie(rows: DataFrame, shard_rows: int = SHARD_ROWS, work_folder: str | None = None) -> DataFrame:
    """The trie of ``rows(conv_id, ids, words)``, the result of ``sequences``: one row per distinct prefix.

    Conversations are dealt to shards by ranges of (ids, conv_id), so one that very many share is cut
    like any other. A shard sorts its rows as padded matrices and aggregates every depth. Nodes that
    neighbours share are added up by their prefix; they are at most the paths of the rows at the
    borders. The lists of ends that cross a border are hashed in pieces, in order.

    Columns: conv_id (the smallest member), depth, parent_conv_id (null for the root), n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256. No conversations give no rows, not even a root.
    """
    rows = stage(rows, "sequences", work_folder)
    total, tasks = rows.count(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_shards = max(1, -(-total // shard_rows), min(tasks, total // LEAST_ROWS))
    dealt = rows.repartitionByRange(n_shards, "ids", "conv_id").withColumn("shard", F.spark_partition_id())
    sharded = stage(dealt, "shards", work_folder)
    bordered = sharded.join(F.broadcast(shard_borders(sharded)), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _shard_batches(pa.Table.from_batches(list(batches)))

    schema = from_arrow_schema(pa.schema(list(NODES.items())))
    parts = stage(bordered.groupBy("shard").applyInArrow(run, schema), "nodes", work_folder)
    hashed = (
        parts.filter(F.col("kind") == ENDS)
        .repartition("node")
        .sortWithinPartitions("node", "shard", "place")
        .select("node", "chunk")
        .mapInArrow(_hash_ends, "node binary, sha string")
    )
    opened = parts.filter(F.col("kind") == OPEN).groupBy("node").agg(
        F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"),
        *[F.sum(k).alias(k) for k in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max("ends_sha256").alias("ends_sha256"),
    )
    merged = stage(
        opened.join(hashed, "node", "left").select(
            "node", "parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("sha", "ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
        ),
        "open-nodes", work_folder,
    )
    values = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inner = parts.filter(F.col("kind") == INNER)
    whole = inner.filter(F.col("parent").isNull()).select(*values, "parent_conv_id")
    below = inner.filter(F.col("parent").isNotNull()).select("parent", *values)
    below = below.unionByName(merged.select("parent", *values))
    lookup = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    found = balanced_lookup(
        below, lookup.withColumnRenamed("n_children", "_weight"), ["parent"], "_weight", "conv_id", ["parent_conv_id"]
    )
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return whole.select(columns).unionByName(found.select(columns))


def conversation_trie(
    conversations: DataFrame, group: int = 20, heads: int = 4, shard_rows: int = SHARD_ROWS, work_folder: str | None = None
) -> DataFrame:
    """The prefix trie of rebuilt conversations (see ``rebuilt`` and ``prefix_trie``).

    A conversation's turns are its rows by turn, a null turn first; rows with the same turn number are
    ordered by a digest of role and text, and repeated rows are turns of their own. Null roles and texts
    are empty. Rows without a conv_id belong to no conversation and are left out. Other columns are not
    read. A conversation travels as 16 bytes and a word count per turn, never as text.
    """
    lists = turn_lists(conversations, group)
    return prefix_trie(sequences(rebuilt(lists, heads)), shard_rows, work_folder)
