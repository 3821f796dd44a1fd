"""What a recorded response is worth: body checks, retry classes, outages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Response codes that are tried again.
RETRYABLE = [429, 500, 502, 503, 504]


def declared_length(header: Column) -> Column:
    """A Content-Length header as a number; null if it is none or negative."""
    n = F.regexp_replace(header, r"(?U)^\s+|\s+$", "").try_cast("bigint")
    return F.when(n >= 0, n)


def body_verdict(body: Column, header: Column, encoding: Column, magic: bytes = b"%PDF-") -> Column:
    """ok, or why not: empty, not_magic, or short (the length differs where no encoding makes that usual)."""
    n = F.coalesce(F.octet_length(body), F.lit(0))
    want = F.when(F.coalesce(encoding, F.lit("")) == "", declared_length(header))
    starts = F.substring(body, 1, len(magic)) == F.lit(magic)
    return F.when(n == 0, "empty").when(~starts, "not_magic").when(want.isNotNull() & (want != n), "short").otherwise("ok")


def is_retryable(status: Column) -> Column:
    """No status at all is a broken transport or a timeout."""
    return status.isNull() | status.isin(RETRYABLE)


def is_alive(status: Column) -> Column:
    return F.coalesce(status < 500, F.lit(False))


def failure_class(status: Column, phase: Column, empty_grid: Column, bad_body: Column) -> Column:
    """outage, retry or item: metadata pages without a grid, and downloads that are no document, count as outages."""
    outage = ((phase == "metadata") & empty_grid) | ((phase == "download") & bad_body)
    return F.when(is_retryable(status), "retry").when(outage, "outage").when(status >= 400, "item").otherwise("none")
