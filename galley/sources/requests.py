"""Requests: JSON bodies to URLs and feature flags, faults to error columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions.flags import FEATURES, enabled_features, parse_flags

VALIDATION_ERROR = "VALIDATION_ERROR"


def _kind(variant: Column, path: str) -> Column:
    """The JSON type at a path; NULL when nothing is there."""
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get(variant, path, "variant")), r"^[A-Z]+", 0)


def _once(rows: DataFrame, key: str, **columns: Column) -> DataFrame:
    """``key`` and the columns, computed once a row.

    A plain projection is folded into everything that uses it, so a body would be parsed again for
    each flag and filter. A generator of one row is not.
    """
    return rows.select(key, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def read_requests(requests: DataFrame, key: str = "request_id", body: str = "body") -> DataFrame:
    """``key, url``, the six flags, ``enabled``, ``error_type`` and ``message``.

    A body is a JSON object with ``url`` and ``features``, or an envelope whose ``body`` holds one, as
    a string or an object. A faulty request keeps its row, with the error and no flags set.
    """
    rows = _once(requests, key, _outer=F.try_parse_json(body))
    outer = F.col("_outer")
    inner = F.when(
        _kind(outer, "$.body") == "STRING", F.try_parse_json(F.try_variant_get(outer, "$.body", "string"))
    ).otherwise(F.coalesce(F.try_variant_get(outer, "$.body", "variant"), outer))
    rows = _once(rows, key, _json=inner)
    v = F.col("_json")
    url = F.trim(F.try_variant_get(v, "$.url", "string"))
    url_kind, features_kind = _kind(v, "$.url"), _kind(v, "$.features")
    # fixed values: the messages
    message = (
        F.when(v.isNull(), "Invalid JSON in request body")
        .when(F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0) != "OBJECT", "Failed to parse request")
        .when(url_kind.isNull() | (url_kind == "VOID"), "Missing required field: url")
        .when((url_kind != "STRING") | (url == ""), "URL must be a non-empty string")
        .when(features_kind.isNotNull() & (features_kind != "OBJECT"), "Failed to parse request")
    )
    raw = F.create_map(
        *[
            part
            for name in FEATURES
            for part in (F.lit(name), F.to_json(F.try_variant_get(v, f"$.features.{name}", "variant")))
        ]
    )
    rows = _once(rows, key, url=url, message=message, _raw=raw)
    fine = F.col("message").isNull()
    rows = _once(
        rows,
        key,
        url=F.when(fine, F.col("url")),
        error_type=F.when(~fine, VALIDATION_ERROR),
        message=F.col("message"),
        **parse_flags(F.when(fine, F.col("_raw"))),
    )
    return rows.withColumn("enabled", enabled_features({n: F.col(n) for n in FEATURES}))
