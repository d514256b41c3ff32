"""Sinks: article tables, response tables and the delivery outbox."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_articles(articles: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write articles partitioned by domain.

    A domain may hold a third of all articles. The rebalance hint places rows by domain and lets
    adaptive execution cut what is large into even tasks and put small domains together.
    """
    articles.hint("rebalance", "domain").write.mode(mode).partitionBy("domain").parquet(path)


def write_responses(responses: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write response rows (JSON text) as a table."""
    responses.write.mode(mode).parquet(path)


def outbox(responses: DataFrame, requests: DataFrame | None = None, key: str = "request_id") -> DataFrame:
    """Payload rows of the requests that ask for delivery; a sender works them off.

    The flag ``external_api`` is read from the responses, or from ``requests`` where they lack it.
    """
    if requests is not None:
        responses = responses.join(requests.filter(F.col("external_api")).select(key), key, "left_semi")
    else:
        responses = responses.filter(F.col("external_api"))
    return responses.select(key, F.col("response").alias("payload"))
