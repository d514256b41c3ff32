"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.operators.skew import balanced_lookup
from galley.session import stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest in its neighbourhood.

    A node that most edges touch, the root of a large component, is one row of the look-up, so
    its edges stay where they are.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    lookup = least.select("a", F.least("a", "m").alias("m"), "n")
    found = balanced_lookup(both, lookup, ["a"], "n", "b", ["m"])
    return found.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them. Edges go from large to small."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    found = balanced_lookup(edges, least, ["a"], "n", "b", ["m"])
    onward = found.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b")
    return onward.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, work_folder: str | None = None) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)`` that is not the smallest of its component.

    Each round is written to the work folder; rounds go on until the edges no longer change, which
    takes a logarithmic number of them. Nothing but a count and a checksum reaches the driver.
    Self-links and links with a null are ignored; no edges give no rows.
    """
    known = edges.dropna().select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = stage(known.filter("a > b").distinct(), "links", work_folder)
    seen = None
    while True:
        mark = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen or not mark[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark
        links = stage(_small_star(_large_star(links)), "links", work_folder)
