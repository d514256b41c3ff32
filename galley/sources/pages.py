"""The page corpus and its invalid part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galley.functions.text import is_blank

PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A page table, read with a declared schema so no file is opened for inference."""
    return spark.read.schema(PAGES).parquet(path)


def page_error(html: Column, max_chars: int | None = None) -> Column:
    """Why a page cannot be processed: NULL_INPUT, empty_input, CONTENT_TOO_LONG or NULL (usable)."""
    error = F.when(html.isNull(), "NULL_INPUT").when(is_blank(html), "empty_input")
    if max_chars is not None:
        error = error.when(F.length(html) > max_chars, "CONTENT_TOO_LONG")
    return error


def split_invalid(pages: DataFrame, max_chars: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(usable pages, error rows). A size limit is off unless one is given: whole pages by default."""
    error = page_error(F.col("html"), max_chars)
    errors = (
        pages.select("page_id", "url", error.alias("error_type"))
        .filter("error_type IS NOT NULL")
        .withColumn(
            "message",  # fixed values
            F.when(F.col("error_type") == "NULL_INPUT", "HTML input is None")
            .when(F.col("error_type") == "empty_input", "Empty HTML input")
            .otherwise("HTML input exceeds the content length limit"),
        )
        .withColumn("step", F.lit("scraping"))
    )
    return pages.filter(error.isNull()), errors
