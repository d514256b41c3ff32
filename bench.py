"""Time the headline queries; one JSON line on stdout.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local threads.
Every query runs whole into a sink that takes all rows and columns and keeps none.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

from checks import inputs
from galley.operators.alarms import error_alarm, step_metrics
from galley.operators.enrichment import enrich
from galley.operators.fetches import resolve_fetches
from galley.operators.normalization import normalize_corpus
from galley.operators.phrases import key_phrases, topics
from galley.operators.pii import pii_entities, redact
from galley.operators.sentiment import sentiment
from galley.operators.summary import summarize
from galley.plans.articles import extract_articles
from galley.plans.requests import process_requests
from galley.session import build_session
from galley.sources.pages import read_pages

#: Copies of the page table in the run that shows what a page costs beside what a query costs.
COPIES = 4


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "galley-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(2 * int(cpus)),
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            "spark.python.sql.dataFrameDebugging.enabled": "false",
            # the page shuffle is a few megabytes here but the work behind it is not
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
            "spark.log.level": "ERROR",
        },
    )
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    flags = ("sentiment", "pii", "topics", "summary")
    flagged = docs.select("doc_id", "text", *[F.lit(True).alias(f) for f in flags])
    pages_table = read_pages(spark, f"{sf_dir}/pages.parquet")
    copies = pages_table.crossJoin(F.broadcast(spark.range(COPIES))).withColumn("page_id", F.col("page_id") * COPIES + F.col("id"))
    requests = inputs.request_bodies(spark, sf_dir)
    queries = {
        "articles": lambda: extract_articles(read_pages(spark, f"{sf_dir}/pages.parquet")),
        "articles_dated_known_sites": lambda: extract_articles(inputs.dated_pages(spark, sf_dir)),
        "normalize": lambda: normalize_corpus(docs),
        "sentiment": lambda: sentiment(docs),
        "pii_entities": lambda: pii_entities(docs),
        "redact": lambda: redact(docs),
        "key_phrases": lambda: key_phrases(docs),
        "topics": lambda: topics(key_phrases(docs)),
        "summaries": lambda: summarize(docs),
        "fetches": lambda: resolve_fetches(inputs.fetch_log(spark, sf_dir)),
        "error_alarm": lambda: error_alarm(events),
        "step_metrics": lambda: step_metrics(events),
        "articles_copies": lambda: extract_articles(copies.drop("id")),
        "enrich": lambda: enrich(flagged),
        "process_requests": lambda: process_requests(requests, pages_table, "2024-02-01T00:00:00Z").responses,
    }
    seconds = {}
    for name, build in queries.items():
        start = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    pages, texts = pages_table.count(), docs.count()
    result = {
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "pages_per_second": round(pages / seconds["articles"], 1),
        "pages_per_second_copies": round(COPIES * pages / seconds["articles_copies"], 1),
        "requests_per_second": round(pages / seconds["process_requests"], 1),
        "documents_per_second_key_phrases": round(texts / seconds["key_phrases"], 1),
        "cpus": int(cpus),
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
