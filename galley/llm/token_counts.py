"""Token counts of whole texts by a sentence-piece vocabulary, mostly without running its merges."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.llm.words import chunks, texts_of

#: The mark a sentence-piece vocabulary writes for a space.
SPACE = "▁"
#: Segments whose count a worker remembers before it starts over.
MEMORY = 200_000


def whole_tokens(model) -> frozenset[str]:
    """Segments, without their leading space mark, that the model encodes as one token.

    Every vocabulary entry that is a space mark and more is encoded alone: it is kept if its own id
    is all that comes out. The list depends on the vocabulary only.
    """
    found = []
    for number in range(model.get_piece_size()):
        piece = model.id_to_piece(number)
        if len(piece) > 1 and piece[0] == SPACE and SPACE not in piece[1:] and model.encode(piece[1:]) == [number]:
            found.append(piece[1:])
    return frozenset(found)


def cuts_are_safe(model) -> bool:
    """No vocabulary entry has a space mark after another character, so merges never cross a word start."""
    pieces = (model.id_to_piece(number) for number in range(model.get_piece_size()))
    return not any(SPACE in piece.lstrip(SPACE) for piece in pieces)


class Counter:
    """Counts tokens segment by segment: a run of space marks and what follows it, up to the next.

    The model puts a space mark before a text. Segments that are whole tokens count one; the merges
    run once for every other segment, which is then remembered.
    """

    _segment = re.compile(f"{SPACE}+[^{SPACE}]*")

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        if not cuts_are_safe(self._model):
            raise ValueError("this vocabulary merges across word starts; segments cannot be counted alone")
        # a space mark by itself, as at the end of a text, is a token or else its bytes
        alone = 1 if self._model.piece_to_id(SPACE) != self._model.unk_id() else len(SPACE.encode())
        self._whole = dict.fromkeys(whole_tokens(self._model), 1) | {"": alone}
        self._known = dict(self._whole)

    def segments(self, text: str) -> list[str]:
        """Segments without their first space mark; empty for a mark by itself."""
        if not text:
            return []
        if "  " not in text and SPACE not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [found[1:] for found in self._segment.findall(SPACE + text.replace(" ", SPACE))]

    def count(self, texts: list[str]) -> list[int]:
        if len(self._known) > MEMORY + len(self._whole):
            self._known = dict(self._whole)
        known = self._known
        cut = [self.segments(text) for text in texts]
        new = list({segment for segments in cut for segment in segments if segment not in known})
        known.update(zip(new, map(len, self._model.encode(new, num_threads=1)), strict=True))
        return [sum(map(known.__getitem__, segments)) for segments in cut]


def token_counts(documents: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """Bytes and tokens of every whole text, and whether it has more than ``limit`` tokens.

    One row per row of ``documents``, in the task that reads it. Null text counts as empty: no
    bytes, no tokens. Ids may be null or repeated. Very long texts are counted whole, in memory
    that grows with one text. Other columns are not read.
    """
    rows = documents.select("doc_id", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(model_path)
        for batch in chunks(batches):
            counts: list[int] = []
            for start in range(0, batch.num_rows, 256):
                counts += counter.count(texts_of(batch.column(1).slice(start, 256)))
            sizes = [len(text.encode()) for text in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    id_type = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
