"""From documents to packed training sequences, in stages that are written between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm.decontamination import clean_documents
from galley.llm.packing import pack
from galley.llm.registry import BYTE_BPE, TOXIC_FROM, vocabulary
from galley.llm.simhash import keep_one_of_each, simhash_groups
from galley.llm.substring import remove_repeats
from galley.llm.toxicity import fit_toxicity, with_toxicity
from galley.session import new_path


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = with_toxicity(docs, model)
    return scored.filter(F.col("score") < TOXIC_FROM).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays, the one with the smallest id."""
    return keep_one_of_each(docs, simhash_groups(docs, shingle=3, radius=2))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside repeated passages go; a text that repeats nothing stays as it is."""
    cleaned = remove_repeats(docs, length=20)
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    size = F.when(changed, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumns({"text": text, "n_chars": size}).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that give a benchmark item away go."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), seed=5, threshold=0.6)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of training sequences."""
    return pack(docs, vocabulary(BYTE_BPE), end_id=1, capacity=2048)


#: Each function takes (spark, docs, sf_dir); what it returns is written and read as the next one's docs.
STAGES = [
    ("toxicity", toxicity_filter),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: A learned model, components and tokenizers are not SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
