"""Scoring of texts with a model of the user's, in Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Generator, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

ERROR_FIELDS = [T.StructField("error_type", T.StringType()), T.StructField("error_message", T.StringType())]

Model = Callable[[pd.DataFrame], pd.DataFrame]

# the model this worker process holds, by the call of score_with that asked for it
_held: dict[str, Model] = {}


def _model(name: str, load: Callable[[], Model]) -> Model:
    """The model of a call, opened once a worker process; the one before it is let go."""
    if name not in _held:
        _held.clear()
        _held[name] = load()
    return _held[name]


def _budgeted(part: pd.DataFrame, text: str | None, chars: int | None, rows: int | None) -> Iterator[pd.DataFrame]:
    """The rows in order, in parts within both budgets; a text over the budget goes alone and whole."""
    sizes = part[text].str.len().fillna(0).to_numpy(dtype=np.int64) if chars is not None else np.zeros(len(part), np.int64)
    limit = chars if chars is not None else 0
    most = rows if rows is not None else len(part)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and (held + size > limit or i - start >= most):
            yield part.iloc[start:i]
            start, held = i, 0
        held += size
    if start < len(part):
        yield part.iloc[start:]


def score_with(
    frame: DataFrame,
    fn: Model | None = None,
    schema: T.StructType | str = "",
    key: str = "doc_id",
    *,
    load: Callable[[], Model] | None = None,
    text: str | None = None,
    batch_chars: int | None = None,
    batch_rows: int | None = None,
) -> DataFrame:
    """Apply a model to batches of rows; ``key``, the result columns and an error pair come back.

    The model is ``fn``, or what ``load()`` returns; that is opened once a worker process. With
    ``batch_chars``, a batch holds at most so many characters of the column ``text`` (NULL has none), with
    ``batch_rows`` at most so many rows; a longer text is a batch of its own, whole. Without either, a batch is
    what Arrow delivers.

    A batch that raises, or gives another number of rows than it got, is halved until the rows at fault stand
    alone: one bad row in n costs about 2 log2(n) more calls at most. Such a row keeps its key, gets NULL
    results and the error, and the job goes on. A model that can't be opened fails the job.
    """
    if (fn is None) == (load is None):
        raise ValueError("give either fn or load")
    if (batch_chars is not None) != (text is not None):
        raise ValueError("batch_chars and text belong together")
    result = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    out = T.StructType([frame.schema[key], *result.fields, *ERROR_FIELDS])
    names = [f.name for f in result.fields]
    call = uuid.uuid4().hex

    def scored(model: Model, part: pd.DataFrame) -> pd.DataFrame:
        values = model(part)[names].reset_index(drop=True)
        if len(values) != len(part):
            raise ValueError(f"{len(values)} results for {len(part)} rows")
        values.insert(0, key, part[key].reset_index(drop=True))
        return values.assign(error_type=None, error_message=None)

    def settled(model: Model, part: pd.DataFrame, faulty: bool = False) -> Generator[pd.DataFrame, None, bool]:
        """Results of a part; returns whether a row was at fault. A ``faulty`` part need not be tried whole."""
        if not faulty or len(part) == 1:
            try:
                values = scored(model, part)
            except Exception as error:
                if len(part) == 1:
                    failed = {key: part[key].iloc[0], **dict.fromkeys(names)}
                    failed |= {"error_type": type(error).__name__, "error_message": str(error)}
                    yield pd.DataFrame([failed])
                    return True
            else:
                yield values
                return False
        middle = len(part) // 2
        first = yield from settled(model, part.iloc[:middle])
        # where the first half is right, the other one holds the row at fault
        second = yield from settled(model, part.iloc[middle:], not first)
        return first or second

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = fn if load is None else _model(call, load)
        for batch in batches:
            for part in _budgeted(batch, text, batch_chars, batch_rows):
                yield from settled(model, part)

    return frame.mapInPandas(run, out)
