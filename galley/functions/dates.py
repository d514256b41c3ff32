"""Dates printed in news pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from galley.functions.text import collapse

# The accepted formats in the order they are tried (shape, Spark pattern).
DATE_FORMATS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}(Z|[+-]\d{2}:?\d{2})$", "yyyy-M-d'T'H:m:sXX"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-M-d H:m:s"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^[A-Z][a-z]+ \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^\d{1,2} [A-Z][a-z]+ \d{4}$", "d MMMM yyyy"),
)


def parse_date(text: Column) -> Column:
    """The first format that fits wins, so 03/04/2024 is 3 April; NULL when none does.

    An offset is honoured and the result is an instant; a date without one is read in the session
    time zone (UTC in our sessions).
    """
    # bound once by the outer transform: the text may be a costly expression
    cleaned = F.transform(F.array(text), collapse)
    return F.get(F.transform(cleaned, _first_fit), F.lit(0))


def _first_fit(value: Column) -> Column:
    # month names match in any case; a colon in the offset is optional
    attempts = []
    for shape, pattern in DATE_FORMATS:
        if "XX" in pattern:
            candidate = F.regexp_replace(value, r"([+-]\d{2}):(\d{2})$", "$1$2")
        elif "MMMM" in pattern:
            candidate = F.initcap(value)
        else:
            candidate = value
        attempts.append(F.when(candidate.rlike(shape), F.try_to_timestamp(candidate, F.lit(pattern))))
    return F.coalesce(*attempts)
