"""Which nodes are boilerplate, and what lies inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions.markup import attribute, class_list

# Elements that are boilerplate by name.
BOILERPLATE_TAGS = (
    "nav", "header", "footer", "aside", "menu", "menuitem",
    "script", "style", "noscript", "iframe", "embed", "object",
    "form", "input", "button", "select", "textarea", "label",
)
# Class and id substrings of boilerplate.
BOILERPLATE_PATTERNS = (
    "nav", "navigation", "menu", "sidebar", "aside", "header", "footer", "banner", "toolbar",
    "ad", "advertisement", "promo", "sponsored", "social", "share", "sharing", "follow",
    "comment", "discussion", "feedback", "related", "recommend", "suggestion",
    "widget", "plugin", "embed", "breadcrumb", "pagination", "pager",
    "search", "filter", "sort", "cookie", "gdpr", "privacy",
    "newsletter", "subscribe", "signup",
)


def class_and_id(attrs: Column) -> Column:
    """The lower-cased class tokens and id that patterns are matched against."""
    return F.lower(
        F.concat_ws(" ", F.array_join(class_list(attrs), " "), F.coalesce(attribute(attrs, "id"), F.lit("")))
    )


def boilerplate_reason(tag: Column, attrs: Column, mode: str = "substring") -> Column:
    """``tag:x``, ``script_style:x`` or ``pattern:x``; NULL for a node that stays.

    ``mode='substring'`` matches a pattern anywhere in class and id; ``'token'`` only whole tokens.
    """
    patterns = "|".join(BOILERPLATE_PATTERNS)
    if mode == "token":
        patterns = rf"(^|\s)({patterns})(\s|$)"
    style = F.lower(F.replace(F.coalesce(attribute(attrs, "style"), F.lit("")), F.lit(" "), F.lit("")))
    marked = (
        class_and_id(attrs).rlike(patterns)
        | (F.coalesce(attribute(attrs, "data-ad"), F.lit("")) != "")
        | (F.coalesce(attribute(attrs, "data-widget"), F.lit("")) != "")
        | style.contains("display:none")
        | style.contains("visibility:hidden")
    )
    return (
        F.when(tag.isin("script", "style", "noscript"), F.concat(F.lit("script_style:"), tag))
        .when(tag.isin(*BOILERPLATE_TAGS), F.concat(F.lit("tag:"), tag))
        .when((F.size(attrs) > 0) & marked, F.concat(F.lit("pattern:"), tag))
    )


def boilerplate_nodes(nodes: DataFrame, mode: str = "substring") -> DataFrame:
    """Nodes that are boilerplate themselves, with the reason."""
    return nodes.withColumn("reason", boilerplate_reason(F.col("tag"), F.col("attrs"), mode)).filter(
        "reason IS NOT NULL"
    )
