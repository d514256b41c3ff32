"""Cost-balanced packing of documents into training sequences."""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from galley.llm.words import texts_of

#: White space of this length goes to the library whose pattern takes runs of any length.
LONG_BLANK = 10_000
#: Sequences of one task share the upper bits of their ids.
TASK_BITS = 33
PIECES = (
    "doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


@dataclass(frozen=True)
class AttentionCost:
    """Estimated cost of a document of n tokens inside a sequence: linear * n + quadratic * n * n."""

    linear: float = 1.0
    quadratic: float = 1.0 / 2048

    def of(self, tokens: int) -> float:
        return self.linear * tokens + self.quadratic * tokens * tokens


@dataclass(frozen=True)
class Piece:
    document: int
    start: int
    length: int
    sequence: int
    offset: int


# Fixed value: the pattern that byte-level vocabularies of this family cut text with before they merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes for
    themselves, the others in order for the letters from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


class Encoder:
    """Token ids of whole texts, those of the ``tokenizers`` library for a byte-level BPE file.

    Its vocabulary also serves as merge ranks for ``tiktoken``, which gives the same ids about three
    times as fast. Texts that hold a special token's string or letters past the Armenian block, where
    the two libraries may class characters differently, go to ``tokenizers`` itself, and so do texts
    with LONG_BLANK blanks in a row, on which the pattern of ``tiktoken`` runs out of stack.
    """

    _other_letters = re.compile("[^\x00-\u058f]")
    _blanks = re.compile(r"\s++")

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        special = [token.content for token in self._tokenizer.get_added_tokens_decoder().values()]
        byte_of = _byte_of_letter()
        ranks = {
            bytes(map(byte_of.__getitem__, token)): number
            for token, number in self._tokenizer.get_vocab(with_added_tokens=False).items()
            if token not in special
        }
        self._special = special
        self._fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _is_plain(self, text: str) -> bool:
        return (
            not self._other_letters.search(text)
            and not any(token in text for token in self._special)
            and not self._has_long_blank(text)
        )

    def _has_long_blank(self, text: str) -> bool:
        # a run this long covers one of the places looked at first
        places = range(0, len(text) if len(text) >= LONG_BLANK else 0, LONG_BLANK // 2)
        return any(text[k].isspace() for k in places) and max(map(len, self._blanks.findall(text)), default=0) >= LONG_BLANK

    def _quick(self, text: str) -> list[int] | None:
        """Ids by ``tiktoken``; None where it is not to be used or gives up."""
        if not self._is_plain(text):
            return None
        try:
            return self._fast.encode_ordinary(text)
        except BaseException as error:  # a panic of the library is no Exception
            if type(error).__name__ != "PanicException":
                raise
            return None

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids = [self._quick(text) for text in texts]
        rest = [k for k, found in enumerate(ids) if found is None]
        encodings = self._tokenizer.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False)
        for k, encoding in zip(rest, encodings, strict=True):
            ids[k] = encoding.ids
        return [np.array(found, dtype=np.uint32) for found in ids]


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """One encoder per worker process and file."""
    return Encoder(path)


def assign(lengths: list[int], capacity: int, cost: AttentionCost) -> list[Piece]:
    """Cut and place documents of the given lengths into as few sequences as can hold them.

    Full sequences are cut off long documents first. The rest go, longest first, each to the
    sequence of lowest cost that still has room for the whole of it. Where none has, the document
    is cut: its head fills the emptiest sequence and its tail goes back in line.
    """
    pieces: list[Piece] = []
    sequence = 0
    waiting: list[tuple[int, int, int]] = []  # (-length, document, start)
    for document, length in enumerate(lengths):
        full = length // capacity
        for k in range(full):
            pieces.append(Piece(document, k * capacity, capacity, sequence, 0))
            sequence += 1
        if length > full * capacity:
            waiting.append((full * capacity - length, document, full * capacity))
    heapq.heapify(waiting)
    open_sequences = -(-sum(-n for n, _, _ in waiting) // capacity)
    # sequences by the room left in them, cheapest first; lowest[r] is the cost of the cheapest with room r
    by_room: dict[int, list[tuple[float, int]]] = {capacity: [(0.0, sequence + k) for k in range(open_sequences)]}
    lowest = np.full(capacity + 1, np.inf)
    if open_sequences:
        lowest[capacity] = 0.0
    while waiting:
        negative, document, start = heapq.heappop(waiting)
        length = -negative
        room = length + int(np.argmin(lowest[length:]))
        if np.isinf(lowest[room]):
            room = int(np.flatnonzero(np.isfinite(lowest))[-1])
            heapq.heappush(waiting, (room - length, document, start + room))
            length = room
        spent, chosen = heapq.heappop(by_room[room])
        lowest[room] = by_room[room][0][0] if by_room[room] else np.inf
        pieces.append(Piece(document, start, length, chosen, capacity - room))
        left = room - length
        if left:
            heapq.heappush(by_room.setdefault(left, []), (spent + cost.of(length), chosen))
            lowest[left] = by_room[left][0][0]
    return pieces


def _packed(ids: pa.Array, tokens: list[np.ndarray], capacity, cost, base: int, keep_ids: bool):
    """One packing group as a batch, and the number of its sequences."""
    lengths = [len(t) for t in tokens]
    pieces = assign(lengths, capacity, cost)
    slices = [tokens[p.document][p.start : p.start + p.length] for p in pieces]
    of = pa.array([p.document for p in pieces], type=pa.int64())
    columns = {
        "doc_id": ids.take(of),
        "start": pa.array([p.start for p in pieces], type=pa.int64()),
        "length": pa.array([p.length for p in pieces], type=pa.int64()),
        "ids_crc32": pa.array([zlib.crc32(s) for s in slices], type=pa.int64()),
        "doc_tokens": pa.array([lengths[p.document] for p in pieces], type=pa.int64()),
        "sequence_id": pa.array([base + p.sequence for p in pieces], type=pa.int64()),
        "offset": pa.array([p.offset for p in pieces], type=pa.int64()),
    }
    if keep_ids:
        columns["ids"] = pa.array([s.astype(np.int32) for s in slices], type=pa.list_(pa.int32()))
    return pa.RecordBatch.from_pydict(columns), 1 + max((p.sequence for p in pieces), default=-1)


def pack(
    documents: DataFrame,
    tokenizer_path: str,
    end_id: int,
    capacity: int = 2048,
    cost: AttentionCost | None = None,
    group_tokens: int = 4_000_000,
    keep_ids: bool = False,
) -> DataFrame:
    """Tokenize whole documents, end each with ``end_id`` and pack them into sequences.

    One row per piece. A task packs what it reads in groups of about ``group_tokens`` tokens, so
    nothing is shuffled, memory is bounded by a group (or one document), and at most the last
    sequence of a group is not full. Padding is below ``capacity`` ids for each group, and every
    partition with rows ends with a group of its own however small: many small partitions cost up
    to ``capacity`` - 1 ids each. A lost task runs again on the same rows and gives the same pieces.

    Null or empty text: the end token alone. Null and repeated ids: every row is a document of its
    own. Ties of length keep the order of the rows. Very long texts become full sequences and a
    rest. An empty table gives no rows. Columns other than ``doc_id`` and ``text`` are not read.
    With ``keep_ids`` the token ids of each piece are returned as ``ids``.
    """
    cost = cost or AttentionCost(quadratic=1.0 / capacity)
    rows = documents.select("doc_id", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path)
        end = np.array([end_id], dtype=np.uint32)
        base = TaskContext.get().partitionId() << TASK_BITS
        ids: list[pa.Array] = []
        tokens: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                encoded = [np.concatenate([t, end]) for t in encoder.encode(texts_of(part.column(1)))]
                ids.append(part.column(0))
                tokens += encoded
                held += sum(map(len, encoded))
                if held >= group_tokens:
                    packed, used = _packed(pa.concat_arrays(ids), tokens, capacity, cost, base, keep_ids)
                    yield packed
                    base, ids, tokens, held = base + used, [], [], 0
        if tokens:
            yield _packed(pa.concat_arrays(ids), tokens, capacity, cost, base, keep_ids)[0]

    schema = PIECES.format(id_type=rows.schema["doc_id"].dataType.simpleString())
    return rows.mapInArrow(run, schema + (", ids array<int>" if keep_ids else ""))
