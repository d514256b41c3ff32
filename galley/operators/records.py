"""One record per page: its tokens in order and its selector hits.

The record is built by one aggregate that reuses the placement of the raw pages. Tokens are dense,
so a running count at a node's start or end is an array look-up, and the text of a node is a slice of
the page's runs: the cost of a page is its length plus the length of the texts that are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions.markup import attribute
from galley.functions.text import clean_block, clean_text
from galley.operators.boilerplate import class_and_id
from galley.operators.dom import dom_rows, page_parts, with_places
from galley.operators.reports import counted_reason
from galley.operators.selectors import attach_site, match_rows
from galley.operators.skew import spread_join
from galley.sources.rules import BUILT_IN_STEPS, built_in_rules, selector_rows, site_table

# Containers that may hold an article, in the order ties are resolved.
CONTAINERS = ("article", "main", "section", "div")
# Class and id substrings of content.
CONTENT_PATTERNS = ("article", "content", "main", "story", "post", "body", "text", "paragraph", "section")


def content_hits(attrs: Column) -> Column:
    """How many content patterns occur in class and id."""
    text = class_and_id(attrs)
    total = F.lit(0)
    for pattern in CONTENT_PATTERNS:
        total = total + F.when(text.contains(pattern), 1).otherwise(0)
    return F.when(F.size(attrs) > 0, total).otherwise(0)


def page_records(
    pages: DataFrame, rules: DataFrame | None = None, mode: str = "substring", clustered: bool = False
) -> DataFrame:
    """``page_id, url, domain, site, supported, toks, hits, removed_reasons, fallback_selectors, rule_domain``.

    Without ``rules`` the built-in ones are used: a fixed handful of rows that is always broadcast.
    Given rules may be any number; while the plan is made, the lengths of the pages are added up and no rule is read.
    """
    sites = site_table(built_in_rules(pages.sparkSession) if rules is None else rules)
    selectors = selector_rows(sites)
    small = rules is None
    placed = attach_site(pages.select("page_id", "url", "html"), sites, small)
    keep = ("url", "domain", "site", "supported")
    parts = None if small and clustered else page_parts(pages)
    dom = dom_rows(placed, keep, mode, clustered, parts)
    # the built-in rules ask for no parents or siblings
    rows = match_rows(dom, selectors, small, BUILT_IN_STEPS) if small else match_rows(with_places(dom), selectors, small, parts=parts)
    is_token = F.col("field").isNull()
    is_node = F.col("kind") == "open"
    hits_of_node = F.when(is_node & F.col("tag").isin(*CONTAINERS), content_hits(F.col("attrs"))).otherwise(0)
    token = F.struct(
        "pos", "kind", "tag", "end", "gone", "kept", "run",
        "n_runs", "n_words", "n_p", "n_a", "n_text", hits_of_node.alias("content_hits"),
    )
    hit = F.struct("field", "priority", "pos", "end", "gone", attribute(F.col("attrs"), "datetime").alias("datetime"))
    records = rows.groupBy("page_id").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in keep],
        F.array_sort(F.collect_list(F.when(is_token, token))).alias("toks"),
        F.array_sort(F.array_distinct(F.collect_list(F.when(~is_token, hit)))).alias("hits"),
        F.array_sort(F.collect_set(F.when(is_token, counted_reason()))).alias("removed_reasons"),
    )
    records = records.select(
        "*",
        F.transform(F.filter("toks", lambda t: t.kept), lambda t: t.run).alias("kept_runs"),
        F.transform(F.filter("toks", lambda t: t.kind == "text"), lambda t: t.run).alias("all_runs"),
    )
    # The join also keeps the arrays above from being folded into the lambdas that read them, where
    # they would be rebuilt for every node.
    site_columns = sites.select("site", F.col("domain").alias("rule_domain"), "fallback_selectors")
    if small:
        return records.join(F.broadcast(site_columns), "site", "left")
    return spread_join(records, site_columns, ["site"], "page_id")


def token_at(pos: Column) -> Column:
    return F.get(F.col("toks"), pos)


def kept_text(start: Column, end: Column) -> Column:
    """Cleaned text of a node after boilerplate removal, runs joined by one space."""
    first, last = token_at(start).n_runs, token_at(end).n_runs
    return clean_text(F.array_join(F.slice(F.col("kept_runs"), first + 1, last - first), " "))


def whole_text(start: Column, end: Column) -> Column:
    """Cleaned text of a node with nothing removed, runs joined as they stand."""
    first, last = token_at(start).n_text, token_at(end).n_text
    return clean_block(F.array_join(F.slice(F.col("all_runs"), first + 1, last - first), ""))


def hits_of(field: str, priority: Column | int | None = None) -> Column:
    """Hits of a field in document order, over all priorities or of one."""
    wanted = F.filter(
        "hits",
        lambda h: (h.field == field) & (F.lit(True) if priority is None else (h.priority == priority)),
    )
    return wanted
