"""All registered queries and their SQL."""

from __future__ import annotations

from checks import html, jobs, text

QUERIES = {**html.QUERIES, **text.QUERIES, **jobs.QUERIES}
ORACLE = {**html.ORACLE, **text.ORACLE, **jobs.ORACLE}
