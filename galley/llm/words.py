"""What the operators share: the word rule, held-out parts, Arrow passes."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")
WORD_SPACE = " \t\n\x0b\x0c\r"
#: Rows that become Python texts at once.
CHUNK_ROWS = 1_000


def words_column(text: Column) -> Column:
    """The words of a text as an array; none for a null or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WORD_SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \t-\r]+"))


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def texts_of(column: pa.Array) -> list[str]:
    """Python texts of an Arrow column; null is empty."""
    return [text or "" for text in column.to_pylist()]


def with_columns(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with columns added; a column of the same name gives way."""
    names = [name for name in batch.schema.names if name not in columns]
    arrays = [batch.column(batch.schema.get_field_index(name)) for name in names]
    return pa.RecordBatch.from_arrays([*arrays, *columns.values()], names=[*names, *columns])


def chunks(batches: Iterable[pa.RecordBatch], rows: int = CHUNK_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that a worker holds few texts at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    pa.default_memory_pool().release_unused()


def field_types(frame: DataFrame, replaced: Iterable[str] = ()) -> str:
    """The schema of a frame as DDL, without the columns that get replaced."""
    gone = set(replaced)
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields if f.name not in gone)
