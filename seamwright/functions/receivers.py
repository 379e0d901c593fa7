"""Which receivers of a verb call look like an HTTP client."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
NOT_HTTP = ("headers", "searchparams", "map")
HTTP_PARTS = ("axios", "api", "client", "http")


def looks_like_other(receiver: Column) -> Column:
    """C14: a denied name, or one after the last dot."""
    return F.lower(receiver).rlike(r"(^|\.)(" + "|".join(NOT_HTTP) + ")$")


def looks_like_http(receiver: Column) -> Column:
    """C15."""
    return F.lower(receiver).rlike("|".join(HTTP_PARTS))
