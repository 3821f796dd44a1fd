"""Slugs of citations and people, and file names."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from foliary.functions.text import trimmed

_CITATION = r"^\[(\d{4})\]\s+((?i:IE[A-Za-z]+))\s+(\d+)"


def citation_slug(c: Column) -> Column:
    """2026_IESC_36 of '[2026] IESC 36', whatever follows; null if it does not begin like that."""
    t = trimmed(c)
    part = lambda k: F.regexp_extract(t, _CITATION, k)
    return F.when(part(1) != "", F.concat_ws("_", part(1), F.upper(part(2)), part(3)))


@F.pandas_udf(StringType())
def _ascii(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def person_slug(c: Column) -> Column:
    """ASCII letters and digits joined by '-', at most 80 characters; accents are dropped, other scripts vanish."""
    joined = F.regexp_replace(F.regexp_replace(_ascii(trimmed(c)), r"[^A-Za-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.left(joined, F.lit(80)), "-+$", "")


def file_stem(citation: Column, person: Column) -> Column:
    slug = person_slug(person)
    return F.concat(citation_slug(citation), F.when(slug != "", F.concat(F.lit("_"), slug)).otherwise(""))


def is_safe_name(c: Column) -> Column:
    """Whether a file of that name stays in its folder: not empty, no leading dot, no separator."""
    return F.coalesce((c != "") & ~c.startswith(".") & ~c.rlike(r"[/\\\x00]"), F.lit(False))
