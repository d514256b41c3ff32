"""Byte-level BPE by a transducer that is made deterministic as texts need it, and streaming decoding."""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import insort
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from galley.llm.packing import PATTERN
from galley.llm.words import chunks, texts_of

#: The pattern for texts of ASCII characters only, where the classes of letters, digits and blanks are short.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
#: Pre-tokens a worker remembers, twice, and the bytes of the longest it remembers.
MEMORY, REMEMBERED_BYTES = 250_000, 64
#: Transducer states and pairs of tokens a worker keeps.
STATES, BESIDE = 200_000, 200_000
#: Ids that are decoded at once.
DECODE_IDS = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a rank file: one base64 token and its rank on a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merged(data: bytes, ranks: dict[bytes, int], until: int = 1) -> list[bytes]:
    """Tokens of a short byte string by the definition: the merge of lowest rank, leftmost first, until none is left."""
    parts = [data[k : k + 1] for k in range(len(data))]
    while len(parts) > until:
        found = [ranks.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        least = min((rank for rank in found if rank is not None), default=None)
        if least is None:
            break
        at = found.index(least)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Merges:
    """Which vocabulary entries, and which neighbours, the merges leave as they are.

    Merges come in the order of their ranks since a token ranks after its two parts; a vocabulary in
    which one does not is refused. So only the parts of two neighbours that touch their border decide:
    each of them is there from its own rank until that of the token it goes into, and the border goes
    if two of them that are there at once merge earlier than either goes.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self._parts: dict[bytes, tuple[bytes, bytes] | None] = {}
        self._edges: tuple[dict, dict] = {}, {}
        self._beside: dict[tuple[bytes, bytes], bool] = {}

    def parts(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts a token is merged from; None for a byte and for entries the merges never make."""
        if token not in self._parts:
            parts = merged(token, self.ranks, until=2) if len(token) > 1 else []
            if len(parts) == 2 and max(self.ranks.get(part, -1) for part in parts) > self.ranks[token]:
                raise ValueError("a token of this vocabulary ranks before its parts")
            self._parts[token] = tuple(parts) if len(parts) == 2 else None
        return self._parts[token]

    def is_whole(self, token: bytes) -> bool:
        return token in self.ranks and (len(token) == 1 or self.parts(token) is not None)

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, float]]:
        """Parts that touch the left (0) or right (1) end of a token, with the rank at which each goes."""
        known = self._edges[side]
        if token not in known:
            edge, part = [(token, float("inf"))], token
            while (halves := self.parts(part)) is not None:
                until, part = self.ranks[part], halves[side]
                edge.append((part, until))
            known[token] = edge
        return known[token]

    def beside(self, left: bytes, right: bytes) -> bool:
        """The merges leave the two tokens as they are, side by side."""
        known = self._beside.get((left, right))
        if known is not None:
            return known
        get = self.ranks.get
        # equal ranks: the merge on the left comes first
        stays = not any(
            (rank := get(a + b)) is not None and rank < a_until and rank <= b_until
            for a, a_until in self._edge(left, 1) for b, b_until in self._edge(right, 0)
        )
        if len(self._beside) > BESIDE:
            self._beside.clear()
        self._beside[left, right] = stays
        return stays


class Transducer:
    """The merges of a vocabulary as a finite-state transducer from bytes to token ids.

    A sequence of tokens is what the merges make of a text exactly if the merges leave every token
    and every two neighbours as they are. So every prefix of a text has one last token: the one whose
    start is such a prefix too and whose neighbour there gets along with it. After a byte, a cut is
    live while some token could still run from it over the bytes held. What all live cuts have in
    common on their way back is settled and is emitted; the lookahead is what is left, bounded by the
    vocabulary. The state is the bytes after the settled place, and the token before it as long as
    that place is live; they decide all that follows.

    States are numbered and made when a text first needs them. For each there are the bytes held and
    the cuts in use, in order: the place, the token that ends there, the place where that token starts.
    Arcs are numbered 256 times the state plus the byte.
    """

    _BEGINS, _IS_TOKEN = 1, 2

    def __init__(self, ranks: dict[bytes, int]):
        self._merges = Merges(ranks)
        self._number = {token: rank.to_bytes(4, "little") for token, rank in ranks.items()}
        self._kind = {token[:k]: self._BEGINS for token in ranks for k in range(1, len(token))}
        for token in ranks:
            self._kind[token] = self._kind.get(token, 0) | self._IS_TOKEN
        self._states: dict[tuple[bytes, bytes] | bytes, int] = {}
        self._held: list[bytes] = []
        self._cuts: list[tuple] = []
        self._next: dict[int, int] = {}
        self._out: dict[int, bytes] = {}
        self._state(b"", (0, b"", -1))

    def _forget(self) -> None:
        """Drop the younger states; common texts come early, so the older half is what most texts need."""
        kept = STATES // 2
        self._states = {key: number for key, number in self._states.items() if number < kept}
        self._next = {arc: to for arc, to in self._next.items() if arc >> 8 < kept and to >> 1 < kept}
        self._out = {arc: out for arc, out in self._out.items() if arc in self._next}
        del self._held[kept:], self._cuts[kept:]

    def _state(self, held: bytes, cuts: tuple) -> int:
        is_live = not held or self._kind.get(held, 0) & self._BEGINS
        key = (cuts[1], held) if is_live and cuts[1] else held
        number = self._states.get(key)
        if number is None:
            number = self._states[key] = len(self._held)
            self._held.append(held)
            self._cuts.append(cuts)
        return number

    def _ids(self, cuts: tuple, place: int) -> bytes:
        """Ids on the way from the settled place to ``place``."""
        rows = {cuts[at]: at for at in range(0, len(cuts), 3)}
        out = []
        while place:
            out.append(self._number[cuts[rows[place] + 1]])
            place = cuts[rows[place] + 2]
        return b"".join(reversed(out))

    def _arc(self, state: int, byte: int) -> int:
        """Twice the state a byte leads to, and 1 more if it settles something: the output of the arc."""
        held, cuts, merges = self._held[state] + bytes((byte,)), self._cuts[state], self._merges
        kind, end, last = self._kind, len(held), None
        front, rows = [], {}
        for at in range(0, len(cuts), 3):
            place, before = cuts[at], cuts[at + 1]
            rows[place] = at
            tail = held[place:]
            what = kind.get(tail, 0)
            if what & 1:
                front.append(place)
            if what & 2 and last is None and merges.is_whole(tail) and (not before or merges.beside(before, tail)):
                last = (end, tail, place)
        if last is None:
            raise ValueError("the vocabulary lacks a byte")
        rows[end] = len(cuts)
        cuts += last
        front.append(end)
        used = []
        while len(front) > 1:
            latest = front.pop()
            used.append(latest)
            before = cuts[rows[latest] + 2]
            if before not in front:
                insort(front, before)
        settled = front[0]
        at = rows[settled]
        rest = [0, cuts[at + 1], -1]
        for place in reversed(used):
            at = rows[place]
            rest += (place - settled, cuts[at + 1], cuts[at + 2] - settled)
        arc = self._state(held[settled:], tuple(rest)) << 1
        if settled:
            self._out[state << 8 | byte] = self._ids(cuts, settled)
            arc |= 1
        self._next[state << 8 | byte] = arc
        return arc

    def ids(self, data: bytes) -> bytes:
        """Ids of the bytes as little-endian 32-bit numbers, read from left to right once."""
        if len(self._held) > STATES:
            self._forget()
        state, follow, out = 0, self._next.get, []
        for byte in data:
            number = state << 8 | byte
            arc = follow(number)
            if arc is None:
                arc = self._arc(state, byte)
            state = arc >> 1
            if arc & 1:
                out.append(self._out[number])
                if len(self._held) > 2 * STATES:  # one text alone makes this many
                    held, cuts = self._held[state], self._cuts[state]
                    self._forget()
                    state, follow = self._state(held, cuts), self._next.get
        out.append(self._ids(self._cuts[state], len(self._held[state])))
        return b"".join(out)


class Encoder:
    """Ids of whole texts: every match of the pattern through the transducer by itself.

    A match that is a vocabulary entry is one token whatever the merges would do, as in the library.
    """

    def __init__(self, path: str, pattern: str = PATTERN):
        import regex

        ranks = read_ranks(path)
        self._find = regex.compile(pattern).findall
        self._find_ascii = re.compile(ASCII_PATTERN, re.ASCII).findall if pattern == PATTERN else self._find
        self._transducer = Transducer(ranks)
        self._tokens = {}
        for token, rank in ranks.items():
            try:
                self._tokens[token.decode()] = rank.to_bytes(4, "little")
            except UnicodeDecodeError:
                continue  # no match is half a character
        self._known, self._before = dict(self._tokens), {}  # those of the time before stay until the next change

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        pieces = (self._find_ascii if text.isascii() else self._find)(text)
        ids = list(map(self._known.get, pieces))
        if None in ids:
            for at in [k for k, found in enumerate(ids) if found is None]:
                ids[at] = self._of(pieces[at])
        return b"".join(ids)

    def _of(self, piece: str) -> bytes:
        """Ids of a piece that is not among the last ones remembered."""
        found = self._known.get(piece) or self._before.get(piece)
        if found is None:
            data = piece.encode()
            found = self._transducer.ids(data)
            if len(data) > REMEMBERED_BYTES:
                return found
        self._known[piece] = found
        if len(self._known) > MEMORY:
            self._known, self._before = dict(self._tokens), self._known
        return found


def _utf8_steps() -> np.ndarray:
    """Next state of the UTF-8 machine by state and byte.

    State 0: between characters. 1, 2, 3: so many continuation bytes are due. 4 and 5: after E0 and
    ED, 6 and 7: after F0 and F4, where the next byte is bound further. 8: no UTF-8.
    """
    step = np.full((9, 256), 8, dtype=np.uint8)
    step[0, :0x80] = 0
    step[0, 0xC2:0xE0], step[0, 0xE0:0xF0], step[0, 0xF0:0xF5] = 1, 2, 3
    step[0, 0xE0], step[0, 0xED], step[0, 0xF0], step[0, 0xF4] = 4, 5, 6, 7
    for due in (1, 2, 3):
        step[due, 0x80:0xC0] = due - 1
    step[4, 0xA0:0xC0] = step[5, 0x80:0xA0] = 1
    step[6, 0x90:0xC0] = step[7, 0x80:0x90] = 2
    return step


class Utf8Machine:
    """The UTF-8 machine over whole tokens: the state after a token and the end of the last whole character in it.

    Both are tables by token and state, filled for a token when it first comes up.
    """

    UNKNOWN = 9
    BAD = 8

    def __init__(self, tokens: list[bytes | None]):
        self._tokens, self._step = tokens, _utf8_steps()
        self.after = np.full((len(tokens), 8), self.UNKNOWN, dtype=np.uint8)
        self.complete = np.zeros((len(tokens), 8), dtype=np.int64)

    def learn(self, numbers: np.ndarray) -> None:
        for number in numbers.tolist():
            for begin in range(8):
                state, whole = begin, 0
                for at, byte in enumerate(self._tokens[number]):
                    state = int(self._step[state, byte])
                    if state == 0:
                        whole = at + 1
                    elif state == self.BAD:
                        break
                self.after[number, begin], self.complete[number, begin] = state, whole


class StreamDecoder:
    """Bytes of token ids as they arrive, given out up to the last whole character.

    What was given out so far is always whole UTF-8 text. Ids that are no UTF-8 raise an error, as do
    numbers that no token has.
    """

    def __init__(self, tokens: list[bytes | None], machine: Utf8Machine):
        self._tokens, self._machine = tokens, machine
        self._state, self._held = 0, b""

    def feed(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        after, complete = self._machine.after, self._machine.complete
        new = ids[after[ids, 0] == Utf8Machine.UNKNOWN]
        if len(new):
            self._machine.learn(np.unique(new))
        parts = list(map(self._tokens.__getitem__, ids.tolist()))
        state, cut = self._state, -1 if self._state else len(ids)
        # tokens of whole characters keep the machine between characters; only the others are stepped through
        odd = np.flatnonzero(after[ids, 0] != 0).tolist()
        at = 0 if state else (odd[0] if odd else len(ids))
        following = iter(odd)
        while at < len(ids):
            number = int(ids[at])
            if state == 0:
                cut = at
            whole = int(complete[number, state])
            state = int(after[number, state])
            if state == Utf8Machine.BAD:
                raise ValueError("token ids are no UTF-8")
            if whole:
                cut = at
            if state:
                at += 1
            else:
                at = next((k for k in following if k > at), len(ids))
        self._state = state
        data = self._held + b"".join(parts)
        if state == 0:
            self._held = b""
            return data
        end = self._start_of_open(data)
        self._held = data[end:]
        return data[:end]

    @staticmethod
    def _start_of_open(data: bytes) -> int:
        """Where the unfinished character at the end starts."""
        at = len(data) - 1
        while data[at] & 0xC0 == 0x80:
            at -= 1
        return at

    def close(self) -> None:
        """The end of the stream; an unfinished character is an error."""
        if self._state:
            raise ValueError("token ids end inside a character")


class Decoder:
    """Texts of token ids, by the streaming decoder in slices of bounded size."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        self._tokens: list[bytes | None] = [None] * (1 + max(ranks.values()))
        for token, rank in ranks.items():
            self._tokens[rank] = token
        self._machine = Utf8Machine(self._tokens)

    def stream(self) -> StreamDecoder:
        return StreamDecoder(self._tokens, self._machine)

    def decode(self, ids: bytes) -> bytes:
        stream, numbers = self.stream(), np.frombuffer(ids, dtype="<u4")
        found = [stream.feed(numbers[k : k + DECODE_IDS]) for k in range(0, len(numbers), DECODE_IDS)]
        stream.close()
        return b"".join(found)


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """One encoder per worker process and file."""
    return Encoder(path)


@lru_cache(maxsize=2)
def decoder_of(path: str) -> Decoder:
    """One decoder per worker process and file."""
    return Decoder(path)


def encode_documents(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids) per row: ids as little-endian unsigned 32-bit numbers, one after another.

    Ids are those of the ``tiktoken`` library for the rank file at ``path``, without special tokens.
    Every task encodes what it reads and shuffles nothing. Null text counts as empty: no ids. Ids of
    rows may be null or repeated. A very long text, or one very long word, is read from left to right
    once; memory grows with one text, and remembered pieces and states are bounded. No rows give no
    rows. Other columns are not read.
    """
    rows = documents.select("doc_id", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in chunks(batches, 256):
            ids = [encoder.encode(text) for text in texts_of(batch.column(1))]
            counts = pa.array([len(found) // 4 for found in ids], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), counts, pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"]
            )

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of ``encode_documents`` with the ``text`` that the ids stand for.

    All columns stay; a column of that name gives way. Null ids give a
    null text, no ids an empty one. Ids outside the vocabulary or that are no UTF-8 are an error.
    """
    kept = encoded.drop("text")
    place = kept.columns.index("ids")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = decoder_of(path)
        for batch in chunks(batches, 256):
            texts = [None if ids is None else decoder.decode(ids) for ids in batch.column(place).to_pylist()]
            column = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{fields}, text string")


def round_trip(documents: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, n_tokens, and the SHA-256 digests of the ids and of the bytes they decode to.

    What ``encode_documents`` and ``decode_documents`` do one after the other, in one worker, so that a
    task has one Python process and neither ids nor texts travel back. Odd rows as there.
    """
    rows = documents.select("doc_id", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = encoder_of(path), decoder_of(path)
        for batch in chunks(batches, 256):
            ids = [encoder.encode(text) for text in texts_of(batch.column(1))]
            columns = [
                pa.array([len(found) // 4 for found in ids], pa.int64()),
                pa.array([hashlib.sha256(found).hexdigest() for found in ids], pa.string()),
                pa.array([hashlib.sha256(decoder.decode(found)).hexdigest() for found in ids], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
