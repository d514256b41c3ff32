"""URL rules: host-suffix and path-prefix expressions joined on short hashes, then confirmed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.operators.skew import salted_join

#: Rules given as a list are at most this many, so their table can be broadcast.
MAX_LISTED = 100_000
DEFAULT_VERDICT = "allow"


def _upper_to_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    return _upper_to_lower(F.coalesce(rest, F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``; empty where there is no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1))
    return F.coalesce(rest, F.lit(""))


def host_suffixes(host: Column, most_labels: Column) -> Column:
    """The host and its parent domains of at most ``most_labels`` labels; an empty host has none."""
    labels = F.split(F.call_function("substring_index", host, F.lit("."), -most_labels), r"\.")
    every = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(every)


def folders(path: Column, most_slashes: Column) -> Column:
    """The empty prefix and the prefixes of the path that end in one of its first ``most_slashes`` slashes."""
    cut = F.split(F.call_function("substring_index", path, F.lit("/"), most_slashes + 1), "/")
    every = F.transform(
        F.sequence(F.lit(1), F.size(cut) - 1), lambda i: F.concat(F.array_join(F.slice(cut, F.lit(1), i), "/"), F.lit("/"))
    )
    return F.when(F.size(cut) > 1, F.concat(F.array(F.lit("")), every)).otherwise(F.array(F.lit("")))


def folder_of(path: Column) -> Column:
    """The longest prefix that ends in a slash, or nothing."""
    return F.regexp_extract(path, r"(?s)^(.*/)?", 1)


def short_hash(host: Column, folder: Column) -> Column:
    """32 bits of an expression."""
    return F.hash(host, folder)


def digest(host: Column, path: Column) -> Column:
    """The full digest of a host and a path, NUL between them."""
    return F.sha2(F.concat_ws("\u0000", host, path), 256)


def rule_depth(table: DataFrame) -> tuple[Column, Column]:
    """The most labels a rule's host has, and the most slashes a rule's path has: 1 and 0 without rules."""
    labels = F.max(F.size(F.split("host", r"\.")))
    slashes = F.max(F.size(F.split("path", "/")) - 1)
    most = table.dropna().agg(F.coalesce(labels, F.lit(1)).alias("labels"), F.coalesce(slashes, F.lit(0)).alias("slashes"))
    return most.select("labels").scalar(), most.select("slashes").scalar()


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules as (host, path, verdict) from a list of at most MAX_LISTED."""
    if len(rules) > MAX_LISTED:
        raise ValueError(f"pass more than {MAX_LISTED} rules as a DataFrame")
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def judge_urls(pages: DataFrame, rules: DataFrame | Sequence[tuple[str, str, str]]) -> DataFrame:
    """Host, path, the longest rule that fits, and its verdict, for every row of ``pages``.

    A rule fits its host and all subdomains when the path starts with the rule's. The longest rule
    text wins, then the longer host, then ``block``; repeated rules count once. Where none fits, the
    verdict is ``allow``. A URL becomes expressions (host suffix, folder prefix), a rule one of them;
    they meet on 32-bit hashes, and the SHA-256 of host and path as long as the rule's confirms.

    No expression is longer than the deepest rule, so a long URL has no more of them than a short one.
    Rules given as a list are few and broadcast. A rule frame of any size is joined by shuffle, with
    expressions that hold many rows salted. One row per input row: null or odd URLs have empty host
    and path, repeated rows stay, other columns are not read. Rules with null parts are left out.
    """
    listed = not isinstance(rules, DataFrame)
    table = rule_table(pages.sparkSession, rules) if listed else rules
    keyed = (
        table.select("host", "path", "verdict").dropna().groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    ).select(
        short_hash(F.col("host"), folder_of(F.col("path"))).alias("_hash"),
        digest(F.col("host"), F.col("path")).alias("_digest"),
        F.char_length("path").alias("_length"),
        F.concat("host", "path").alias("rule"),
        F.char_length("host").alias("_host_length"),
        "verdict",
    )
    rows = pages.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    ).withColumn("_row", F.monotonically_increasing_id())
    labels, slashes = rule_depth(table.select("host", "path", "verdict"))
    rows = rows.withColumns({"_labels": labels, "_slashes": slashes})
    expressions = F.flatten(
        F.transform(
            host_suffixes(F.col("host"), F.col("_labels")),
            lambda suffix: F.transform(
                folders(F.col("path"), F.col("_slashes")), lambda folder: F.struct(suffix.alias("suffix"), short_hash(suffix, folder).alias("hash"))
            ),
        )
    )
    expanded = rows.select("*", F.explode_outer(expressions).alias("_e")).select(
        "_row", "page_id", "host", "path", F.col("_e.suffix").alias("_suffix"), F.col("_e.hash").alias("_hash")
    )
    met = (
        expanded.join(F.broadcast(keyed), "_hash", "left")
        if listed
        else salted_join(expanded, keyed, ["_hash"], "_row")
    )
    confirmed = F.col("_digest") == digest(F.col("_suffix"), F.expr("substring(path, 1, _length)"))
    best = F.max(
        F.when(
            confirmed,
            F.struct(F.char_length("rule").alias("n"), F.col("_host_length"), F.col("verdict"), F.col("rule")),
        )
    ).alias("_best")
    chosen = met.groupBy("_row", "page_id", "host", "path").agg(best)
    return chosen.select(
        "page_id", "host", "path", F.col("_best.rule").alias("rule"),
        F.coalesce(F.col("_best.verdict"), F.lit(DEFAULT_VERDICT)).alias("verdict"),
    )
