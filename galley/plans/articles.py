"""The article job: pages in, one article row per page out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.functions.urls import is_valid_url
from galley.operators.extraction import extract
from galley.operators.parsing import parse
from galley.operators.records import page_records
from galley.sources.pages import split_invalid

ARTICLE_COLUMNS = (
    "page_id", "url", "domain", "title", "author", "publish_date", "content", "clean_content",
    "word_count", "paragraph_count", "extraction_method", "confidence_score",
    "extractor_method", "extraction_confidence", "warning", "formatting", "removed_reasons",
)


def article_rows(pages: DataFrame, rules: DataFrame | None = None, **options) -> DataFrame:
    """Parsed and extracted fields of every usable page, intermediate columns included.

    Both branches read the same page record, so a page is broken up once and shuffled once.
    """
    usable, _ = split_invalid(pages)
    return parse(extract(page_records(usable, rules, **options)))


def extract_articles(pages: DataFrame, rules: DataFrame | None = None, **options) -> DataFrame:
    """The article table. Rows with an unusable URL or no HTML are in ``article_errors``."""
    valid = pages.filter(is_valid_url(F.col("url")))
    return article_rows(valid, rules, **options).select(*ARTICLE_COLUMNS)


def article_errors(pages: DataFrame) -> DataFrame:
    """Pages that give no article, with the reason."""
    invalid_url = pages.filter(~is_valid_url(F.col("url"))).select(
        "page_id",
        "url",
        F.lit("SCRAPING_ERROR").alias("error_type"),
        F.lit("Invalid URL format").alias("message"),
        F.lit("scraping").alias("step"),
    )
    _, unusable = split_invalid(pages.filter(is_valid_url(F.col("url"))))
    return invalid_url.unionByName(unusable)
