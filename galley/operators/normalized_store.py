"""Normalised texts that are kept up to date as texts arrive in batches.

The store is a folder of tables, each with one part per batch: the texts, their line hashes, by how
much each line's count changed, and the normalised forms that were written. A last table names the
batches that are complete; nothing of any other is ever read. So a run that fails shows nothing, and the
same batch run again replaces what it left.

A batch reads the counts of the lines it touches, finds those that now are common or no longer are,
and writes again the texts that hold them, besides its own. Everything else stays as it was written.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.functions.text import eligible_for_llm
from galley.operators.normalization import LINE_KEY, SEEN_IN, line_rows, without_common

VALUES = ["normalized_text", "original_length", "normalized_length", "compression_ratio"]


@dataclass(frozen=True)
class NormalizedStore:
    """A store in a folder that all machines share.

    ``key`` names a text: a later batch with the same key replaces it, and its lines count no longer. A key
    comes at most once in a batch. ``source``, ``k`` and ``limit`` are those of ``normalize_corpus``
    and must stay the same for all batches of a store.
    """

    spark: SparkSession
    folder: str
    key: str = "doc_id"
    text: str = "text"
    source: str = "source"
    k: int = SEEN_IN
    limit: int | None = None

    def _path(self, table: str, batch: int) -> str:
        return f"{self.folder}/{table}/batch={batch}"

    def _write(self, frame: DataFrame, table: str, batch: int) -> DataFrame:
        path = self._path(table, batch)
        frame.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def _read(self, table: str, batches: list[int], like: DataFrame) -> DataFrame:
        """Parts of some batches, with the number of the batch; ``like`` gives the columns where there is none."""
        parts = [
            self.spark.read.schema(like.schema).parquet(self._path(table, b)).withColumn("batch", F.lit(b)) for b in batches
        ]
        return reduce(DataFrame.unionByName, parts) if parts else like.limit(0).withColumn("batch", F.lit(0))

    def batches(self) -> list[int]:
        """The complete batches, in order: a row per batch reaches the driver."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/complete")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return []
        return sorted(row.batch for row in self.spark.read.parquet(f"{self.folder}/complete").select("batch").distinct().collect())

    def update(self, texts: DataFrame, batch: int) -> None:
        """Take in a batch of texts. Batches come in the order of their numbers; only the last can be run again."""
        done = self.batches()
        if any(b > batch for b in done):
            raise ValueError(f"batch {batch} comes after batch {max(done)}")
        before, key = [b for b in done if b < batch], self.key
        own = self._write(texts.select(key, self.text, self.source), "texts", batch)
        usable = own.filter(eligible_for_llm(F.col(self.text), self.limit))
        lines = self._write(line_rows(usable, key, self.text, self.source), "lines", batch)

        old_texts, old_lines = self._read("texts", before, own), self._read("lines", before, lines)
        latest = old_texts.groupBy(key).agg(F.max("batch").alias("batch"))
        replaced = latest.join(own.select(key), key, "left_semi")
        lost = old_lines.join(replaced, [key, "batch"], "left_semi")
        change = lines.select(*LINE_KEY, F.lit(1).alias("by")).unionByName(lost.select(*LINE_KEY, F.lit(-1).alias("by")))
        counts = change.groupBy(*LINE_KEY).agg(F.sum("by").alias("by")).filter("by <> 0")
        counts = self._write(counts, "counts", batch)

        old_counts = self._read("counts", before, counts).select(*LINE_KEY, "by")
        touched = old_counts.join(counts, LINE_KEY, "left_semi").groupBy(*LINE_KEY).agg(F.sum("by").alias("was"))
        totals = counts.join(touched, LINE_KEY, "left").withColumn("was", F.coalesce("was", F.lit(0)))
        turned = totals.filter((F.col("was") >= self.k) != (F.col("was") + F.col("by") >= self.k)).select(*LINE_KEY)
        holders = old_lines.join(turned, LINE_KEY, "left_semi").select(key, "batch").distinct()
        again = holders.join(latest, [key, "batch"], "left_semi").join(own.select(key), key, "left_anti")
        again = self._write(again, "again", batch)

        rewritten = old_texts.join(again, [key, "batch"], "left_semi").drop("batch")
        wanted = own.unionByName(rewritten).filter(eligible_for_llm(F.col(self.text), self.limit))
        wanted_lines = lines.unionByName(old_lines.join(again, [key, "batch"], "left_semi").drop("batch"))
        all_counts = old_counts.unionByName(counts.select(*LINE_KEY, "by"))
        common = (
            all_counts.join(wanted_lines.select(*LINE_KEY).distinct(), LINE_KEY, "left_semi")
            .groupBy(*LINE_KEY)
            .agg(F.sum("by").alias("seen"))
            .filter(F.col("seen") >= self.k)
        )
        forms = without_common(wanted, wanted_lines, common, key, self.text)
        refused = own.join(usable.select(key), key, "left_anti").select(key)
        self._write(forms.unionByName(refused, allowMissingColumns=True), "forms", batch)
        self.spark.range(1).select(F.lit(batch).alias("batch")).write.mode("overwrite").parquet(f"{self.folder}/complete/part={batch}")

    def rewritten(self, batch: int) -> DataFrame:
        """Keys of earlier texts that a complete batch wrote again."""
        return self.spark.read.parquet(self._path("again", batch)).select(self.key)

    def read(self) -> DataFrame:
        """What ``normalize_corpus`` gives for the last version of every text."""
        done = self.batches()
        if not done:
            raise ValueError(f"no batch is complete in {self.folder}")
        first = self.spark.read.parquet(self._path("forms", done[0]))
        forms = self._read("forms", done, first)
        last = forms.groupBy(self.key).agg(F.max_by(F.struct(*VALUES), "batch").alias("_last"))
        return last.select(self.key, "_last.*").filter("normalized_length > 0")
