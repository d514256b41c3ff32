"""Feature flags of a request."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the features a request can switch on, in their documented order.
FEATURES = ("llm_normalization", "sentiment", "pii", "topics", "summary", "external_api")
ENRICHMENTS = ("sentiment", "pii", "topics", "summary")
TRUE_WORDS = ("true", "1", "yes", "on")


def flag_value(raw: Column) -> Column:
    """One flag from its raw JSON text: ``true``, ``"yes"``, ``0``, ``2.5``, ``null`` and so on.

    A JSON string counts when it is a true word; a number counts when it is not zero.
    """
    text = F.trim(raw)
    is_string = text.startswith('"')
    word = F.lower(F.regexp_replace(text, '^"|"$', ""))
    number = text.try_cast("double")
    return F.coalesce(
        F.when(is_string, word.isin(*TRUE_WORDS))
        .when(text == "true", F.lit(True))
        .when(number.isNotNull() & text.rlike(r"^-?[0-9]"), number != 0),
        F.lit(False),
    )


def parse_flags(features: Column) -> dict[str, Column]:
    """Six boolean columns from a map of raw JSON values."""
    return {name: flag_value(F.try_element_at(features, F.lit(name))) for name in FEATURES}


def enabled_features(flags: dict[str, Column]) -> Column:
    """Names of the enabled features, in the documented order."""
    marks = [F.when(flags[name], F.lit(name)) for name in FEATURES]
    return F.filter(F.array(*marks), lambda name: name.isNotNull())


def is_basic_only(flags: dict[str, Column]) -> Column:
    """True when a request asks for plain extraction."""
    return F.size(enabled_features(flags)) == 0
