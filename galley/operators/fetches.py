"""Resolution of a fetch-attempt log, one outcome per URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.operators.skew import salted_join


# The messages of failed attempts.
def failure_message(status: Column, exception: Column) -> Column:
    """The message of a failed attempt."""
    return (
        F.when(exception == "Timeout", "Request timeout")
        .when(exception == "ConnectionError", "Connection error - unable to reach server")
        .when(exception == "TooManyRedirects", "Too many redirects")
        .when(exception.isNotNull(), F.concat(F.lit("Request failed: "), exception))
        .when(status == 403, "Access forbidden (403) - possible bot detection")
        .when(status == 404, "Page not found (404)")
        .when(status == 429, "Rate limited (429) - too many requests")
        .when(status.isNotNull(), F.concat(F.lit("HTTP "), status))
        .otherwise("Unknown error occurred")
    )


def is_final(status: Column, exception: Column) -> Column:
    """After this attempt no other is made: success, a client error but 429, or a redirect loop."""
    client_error = (status >= 400) & (status < 500) & (status != 429)
    return F.coalesce((status == 200) | client_error | (exception == "TooManyRedirects"), F.lit(False))


def resolve_fetches(log: DataFrame, max_attempt: int | None = None) -> DataFrame:
    """``url, success, status_code, attempts, fetch_time_ms, error_message``, one row per URL.

    All attempts count, whatever their numbers: the outcome is the first final one, else the last,
    and the time is that of all attempts up to it. ``max_attempt`` leaves later attempts out, as a
    policy of the caller. Of several rows for one attempt the largest counts; an attempt without a
    number comes before all others. Log rows are combined before each shuffle, and a URL with very
    many attempts is cut into parts for the join with its outcome.
    """
    attempt = F.coalesce(F.col("attempt"), F.lit(-1))
    tries = log.select("url", attempt.alias("attempt"), "status_code", "exception", "duration_ms")
    if max_attempt is not None:
        tries = tries.filter(F.col("attempt") <= max_attempt)
    tries = tries.groupBy("url", "attempt").agg(F.max(F.struct("status_code", "exception", "duration_ms")).alias("o"))
    final = F.when(is_final(F.col("o.status_code"), F.col("o.exception")), F.col("attempt"))
    chosen = tries.groupBy("url").agg(F.coalesce(F.min(final), F.max("attempt")).alias("attempts"))
    made = salted_join(tries, chosen, ["url"], "attempt").filter("attempt <= attempts")
    rows = made.groupBy("url", "attempts").agg(
        F.round(F.sum(F.coalesce("o.duration_ms", F.lit(0.0))), 6).alias("fetch_time_ms"),
        F.max(F.when(F.col("attempt") == F.col("attempts"), F.col("o"))).alias("o"),
    )
    ok = F.coalesce(F.col("o.status_code") == 200, F.lit(False))
    return rows.select(
        "url",
        ok.alias("success"),
        F.when(ok, F.lit(200)).otherwise(F.lit(0)).alias("status_code"),
        "attempts",
        "fetch_time_ms",
        F.when(~ok, failure_message(F.col("o.status_code"), F.col("o.exception"))).alias("error_message"),
    )
