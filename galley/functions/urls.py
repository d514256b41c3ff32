"""URL predicates and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VALID_URL = r"^(?i:https?)://[^/?#]+"
AUTHORITY = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)"


def is_valid_url(url: Column) -> Column:
    """True for an http or https URL that names a host."""
    return F.coalesce(url.rlike(VALID_URL), F.lit(False))


def domain_of(url: Column) -> Column:
    """The lower-cased authority part (port and user info included), '' when there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, AUTHORITY, 1)), F.lit(""))


def site_key(domain: Column) -> Column:
    """The key site rules are looked up by: the domain without one leading ``www.``."""
    return F.regexp_replace(F.lower(domain), r"^www\.", "")
