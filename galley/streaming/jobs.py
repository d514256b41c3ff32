"""The same jobs over files that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from galley.operators.normalized_store import NormalizedStore
from galley.plans.articles import extract_articles
from galley.sources.pages import PAGES


def _start(stream, write_batch, checkpoint: str, once: bool, mode: str = "append") -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def stream_pages(
    spark: SparkSession,
    folder: str,
    out: str,
    checkpoint: str,
    rules: DataFrame | None = None,
    pattern: str = "*.parquet",
    files_per_batch: int | None = None,
    once: bool = True,
) -> StreamingQuery:
    """Extract articles from page files as they arrive.

    A batch writes its own folder and overwrites it when it is run again after a failure, so every
    page is written exactly once.
    """
    reader = spark.readStream.schema(PAGES).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        extract_articles(batch, rules).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return _start(reader.parquet(folder), write_batch, checkpoint, once)


def stream_alarms(
    alarms: DataFrame, out: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Write what ``rolling_error_alarm`` or ``rolling_duration_alarm`` say of a stream, as it changes.

    Every batch writes the windows it changed, open ones included, into a folder of its own, which it
    overwrites when it is run again after a failure. So an alarm is out with the batch that raises it,
    and a finite run leaves no window unwritten. ``read_alarms`` gives the present state.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return _start(alarms, write_batch, checkpoint, once, "update")


def read_alarms(spark: SparkSession, out: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The windows that ``stream_alarms`` wrote, each as the last batch that changed it left it."""
    written = spark.read.parquet(out)
    keys = [*by, "window_start"]
    values = [name for name in written.columns if name not in (*keys, "batch")]
    last = written.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_last"))
    return last.select(*keys, "_last.*")


def stream_normalized(texts: DataFrame, store: NormalizedStore, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keep a store of normalised texts up to date with a stream of texts; see ``NormalizedStore``.

    A batch that failed is run again under its number and replaces what it left.
    """
    return _start(texts, store.update, checkpoint, once)
