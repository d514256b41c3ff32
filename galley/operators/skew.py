"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds at least the rows of an average task: one part in as many as there are
# shuffle partitions, or in HOT_SHARE if that is more. So there are at most that many of them.
HOT_SHARE = 2_000


def hot_share(frame: DataFrame) -> int:
    return max(HOT_SHARE, int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def balanced_lookup(
    rows: DataFrame, lookup: DataFrame, keys: list[str], weight: str, spread: str, values: list[str]
) -> DataFrame:
    """Left join of ``rows`` with ``lookup`` (one row per ``keys``) that no hot key can unbalance.

    ``weight`` is the lookup column that says how many rows carry the key. Keys with at least
    1/hot_share of the total weight, at most hot_share of them by that definition, are joined by
    broadcast (short rows: pass hashes, not long texts, as keys). Rows resolved that way are spread by ``spread`` through the shuffle of the second
    join, where they match nothing, so every row passes once and none is dropped.
    """
    share = hot_share(rows)
    total = lookup.agg(F.sum(weight)).scalar()
    hot_names = {name: f"_hot_{name}" for name in values}
    hot = lookup.filter(F.col(weight) * share >= total).select(
        *keys, *[F.col(n).alias(h) for n, h in hot_names.items()], F.lit(True).alias("_is_hot")
    )
    cold = lookup.filter(F.col(weight) * share < total).select(
        *keys, F.lit(0).cast("long").alias("_spread"), *values
    )
    marked = rows.join(F.broadcast(hot), keys, "left").withColumn(
        "_spread",
        F.when(F.col("_is_hot"), F.xxhash64(spread).bitwiseOR(F.lit(1))).otherwise(F.lit(0)).cast("long"),
    )
    joined = marked.join(cold, [*keys, "_spread"], "left")
    out = [F.coalesce(F.col(hot_names[n]), F.col(n)).alias(n) for n in values]
    return joined.select(*rows.columns, *out)


def salted_join(rows: DataFrame, lookup: DataFrame, keys: list[str], spread: str) -> DataFrame:
    """Left join where ``rows`` may hold one key very often and ``lookup`` rows are too wide to broadcast.

    A key that holds 1/hot_share or more of the rows is cut into as many parts as it has such shares,
    and its lookup row is copied once per part. What is broadcast is the list of hot keys with their
    number of parts: at most hot_share short rows.
    """
    share = hot_share(rows)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = rows.agg(F.count("*")).scalar()
    hot = F.broadcast(
        counts.filter(F.col("_n") * share >= total).select(
            *keys, F.ceil(F.col("_n") * share / total).cast("int").alias("_parts")
        )
    )
    parts = F.coalesce("_parts", F.lit(1))
    salted = rows.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), parts).cast("int"))
    copies = lookup.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    joined = salted.drop("_parts").join(copies.drop("_parts"), [*keys, "_salt"], "left")
    return joined.drop("_salt")


def spread_join(
    rows: DataFrame, lookup: DataFrame, keys: list[str], spread: str, parts: int = 64, tasks: int | None = None
) -> DataFrame:
    """Left join of rows that are dear to make with a short dimension, any key of which may be hot.

    Every key is cut into ``parts`` by a hash of ``spread`` and the lookup rows are copied as often, so
    nothing has to be counted first and ``rows`` is evaluated once. Given ``tasks``, there are so many,
    whatever the number of shuffle partitions.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(parts)).cast("int"))
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    if tasks:
        salted, copies = (side.repartition(tasks, *keys, "_salt") for side in (salted, copies))
    return salted.join(copies, [*keys, "_salt"], "left").drop("_salt")


# Characters of text a task breaks up at once, and what is not worth cutting to fill all cores.
PART_CHARS = 1 << 21
LEAST_CHARS = 1 << 18


def sized_parts(frame: DataFrame, size: Column) -> int:
    """How many parts keep the texts of a part at about ``PART_CHARS`` characters.

    Texts that are broken into rows take many times their size in sorts and windows, so a task must not
    grow with the input. Adaptive execution joins small parts by their size before they are broken up,
    and the number of shuffle partitions may be any; a number that is given holds. One pass over the
    lengths of the texts finds it.
    """
    return parts_for(frame, frame.agg(F.sum(size.cast("long"))).first()[0] or 0)


def parts_for(frame: DataFrame, chars: int) -> int:
    """The number of ``sized_parts`` where the sum of the lengths is known."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return max(2, -(-chars // PART_CHARS), min(cores, -(-chars // LEAST_CHARS)))
