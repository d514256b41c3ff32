"""Alarms over five-minute windows, and step metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Period, thresholds and the number of periods in a row that raise an alarm.
PERIOD = "5 minutes"
PERIOD_SECONDS = 300
ERROR_THRESHOLD = 5
DURATION_THRESHOLD_MS = 240_000.0
PERIODS = 2


def error_windows(events: DataFrame) -> DataFrame:
    """Errors per window; windows without errors have no row."""
    errors = events.filter(F.col("event_type") == "error")
    counts = errors.groupBy(F.window("ts", PERIOD)).agg(F.count("*").alias("errors"))
    return counts.select(F.col("window.start").alias("window_start"), "errors")


def duration_windows(events: DataFrame) -> DataFrame:
    """Mean duration per window."""
    means = events.groupBy(F.window("ts", PERIOD)).agg(F.avg("value").alias("mean_ms"))
    return means.select(F.col("window.start").alias("window_start"), F.round("mean_ms", 6).alias("mean_ms"))


def consecutive_alarm(windows: DataFrame, breach: Column) -> DataFrame:
    """Add ``breach`` and ``alarm``: this window and the one before it breach; a missing one does not.

    The window before is found by an equi join on its start, so no task sees all windows.
    """
    marked = windows.withColumn("breach", breach)
    before = marked.filter("breach").select(
        (F.col("window_start") + F.make_dt_interval(secs=F.lit(PERIOD_SECONDS))).alias("window_start"),
        F.lit(True).alias("_before"),
    )
    joined = marked.join(before, "window_start", "left")
    return joined.withColumn("alarm", F.col("breach") & F.coalesce("_before", F.lit(False))).drop("_before")


def error_alarm(events: DataFrame, threshold: int = ERROR_THRESHOLD) -> DataFrame:
    return consecutive_alarm(error_windows(events), F.col("errors") > threshold)


def duration_alarm(events: DataFrame, threshold: float = DURATION_THRESHOLD_MS) -> DataFrame:
    return consecutive_alarm(duration_windows(events), F.col("mean_ms") > threshold)


def rolling_alarm(
    events: DataFrame,
    name: str,
    measure: Callable[[Column], Column],
    counted: Column,
    breach: Callable[[Column], Column],
    by: tuple[str, ...] = (),
    periods: int = PERIODS,
    lateness_seconds: int | None = None,
) -> DataFrame:
    """``by, window_start, name, breach, alarm`` by one windowed aggregate, for tables and streams alike.

    An event counts in its own window and, as the past, in the ``periods - 1`` windows that follow. So
    the aggregate of a window knows the windows before it, and what a stream keeps between batches
    is its ordinary windowed state, combined before the shuffle, until the watermark passes.
    ``measure`` aggregates the rows for which its argument holds; a window has a row if one of its
    own events is ``counted``. A missing window does not breach.

    ``lateness_seconds`` sets the watermark of a stream: events that are later by more are dropped.
    """
    one = F.make_dt_interval(secs=F.lit(PERIOD_SECONDS))
    kept = events.withColumns({"_ts": F.col("ts").cast("timestamp"), "_counted": counted})
    turns = F.array(*[F.struct((F.col("_ts") + one * k).alias("at"), F.lit(k).alias("back")) for k in range(periods)])
    spread = kept.withColumn("_turn", F.explode(turns)).withColumns({"_at": F.col("_turn.at"), "_back": F.col("_turn.back")})
    if lateness_seconds is not None:
        spread = spread.withWatermark("_at", f"{lateness_seconds + (periods - 1) * PERIOD_SECONDS} seconds")
    known = spread.groupBy(*by, F.window("_at", PERIOD)).agg(
        F.count_if((F.col("_back") == 0) & F.col("_counted")).alias("_n"),
        *[measure(F.col("_back") == k).alias(f"_{k}") for k in range(periods)],
    )
    before = F.lit(True)
    for k in range(1, periods):
        before = before & F.coalesce(breach(F.col(f"_{k}")), F.lit(False))
    return known.filter("_n > 0").select(
        *by, F.col("window.start").alias("window_start"), F.col("_0").alias(name),
        breach(F.col("_0")).alias("breach"), (breach(F.col("_0")) & before).alias("alarm"),
    )


def rolling_error_alarm(events: DataFrame, threshold: int = ERROR_THRESHOLD, **options) -> DataFrame:
    """``error_alarm`` in one aggregate; see ``rolling_alarm``."""
    is_error = F.coalesce(F.col("event_type") == "error", F.lit(False))
    return rolling_alarm(
        events, "errors", lambda here: F.count_if(here & F.col("_counted")), is_error, lambda n: n > threshold, **options
    )


def rolling_duration_alarm(events: DataFrame, threshold: float = DURATION_THRESHOLD_MS, **options) -> DataFrame:
    """``duration_alarm`` in one aggregate; see ``rolling_alarm``."""
    return rolling_alarm(
        events, "mean_ms", lambda here: F.round(F.avg(F.when(here, F.col("value"))), 6), F.lit(True), lambda x: x > threshold, **options
    )


def exact_percentile(rows: DataFrame, key: str, value: str, percent: int) -> DataFrame:
    """``key, value``: the smallest value that at least ``percent`` of 100 values of its key do not exceed.

    Exact, and no task sees all values of a key: a sketch gives two values that surely enclose the
    rank, everything below is only counted, and only the few distinct values between, already
    counted before the shuffle, are put in order.
    """
    known = rows.select(F.col(key).alias("_k"), F.col(value).alias("_v")).filter("_v IS NOT NULL")
    counted = known.groupBy("_k", "_v").agg(F.count("*").alias("_n"))
    share, slack, accuracy = percent / 100, 5e-5, 100_000
    around = known.groupBy("_k").agg(
        F.percentile_approx("_v", F.array(F.lit(share - slack), F.lit(min(1.0, share + slack))), accuracy).alias("_p"),
        F.count("*").alias("_total"),
    )
    joined = counted.join(around.withColumnRenamed("_k", "_j"), F.col("_k").eqNullSafe(F.col("_j")))
    below = joined.groupBy("_k").agg(F.sum(F.when(F.col("_v") < F.get("_p", F.lit(0)), F.col("_n")).otherwise(0)).alias("_below"))
    middle = joined.filter(F.col("_v").between(F.get("_p", F.lit(0)), F.get("_p", F.lit(1))))
    order = Window.partitionBy("_k").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = middle.withColumn("_upto", F.sum("_n").over(order)).join(
        below.withColumnRenamed("_k", "_b"), F.col("_k").eqNullSafe(F.col("_b"))
    )
    reached = (F.col("_below") + F.col("_upto")) * 100 >= F.col("_total") * percent
    return placed.filter(reached).groupBy(F.col("_k").alias(key)).agg(F.min("_v").alias(value))


def step_metrics(events: DataFrame) -> DataFrame:
    """Count, mean, extremes and the exact 95th percentile of durations per step."""
    metrics = events.groupBy(F.col("event_type").alias("step")).agg(
        F.count("*").alias("calls"),
        F.round(F.avg("value"), 6).alias("mean_ms"),
        F.min("value").alias("min_ms"),
        F.max("value").alias("max_ms"),
    )
    p95 = exact_percentile(events, "event_type", "value", 95).select(
        F.col("event_type").alias("_step"), F.col("value").alias("p95_ms")
    )
    return metrics.join(p95, F.col("step").eqNullSafe(F.col("_step")), "left").drop("_step")
