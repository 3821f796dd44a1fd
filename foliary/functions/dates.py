"""Day-first dates, durations and clock times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliary.functions.text import trimmed

# The English month names that dates may hold.
MONTHS = "January February March April May June July August September October November December".split()


def day_first(c: Column) -> Column:
    """The date of dd/mm/yyyy or 'd Month yyyy'; null if there is none, or not such a day."""
    t = trimmed(c)
    slashed = F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_timestamp(t, F.lit("d/M/yyyy")).cast("date"))
    words = F.regexp_replace(F.initcap(F.lower(t)), r"(?U)\s+", " ")
    named = F.when(words.rlike(rf"^\d{{1,2}} (?:{'|'.join(MONTHS)}) \d{{4}}$"), F.try_to_timestamp(words, F.lit("d MMMM yyyy")).cast("date"))
    return F.coalesce(slashed, named)


def strict_day_first(c: Column) -> Column:
    """As day_first, but text that is no date is an error; null and blank stay null."""
    d = day_first(c)
    bad = c.isNotNull() & (trimmed(c) != "") & d.isNull()
    return F.when(bad, F.raise_error(F.concat(F.lit("not a date: "), c)).cast("date")).otherwise(d)


def estimate_seconds(requests: Column, delay: float, jitter: float) -> Column:
    return requests * F.lit(delay + jitter / 2)


def duration_text(seconds: Column) -> Column:
    """12s, 3m, 3m 40s or 2h 5m; halves round to even, seconds beside minutes show from 30."""
    n = F.bround(seconds, 0).cast("long")
    m, s = F.floor(n / 60), n % 60
    minutes = F.when(s >= 30, F.concat(m.cast("string"), F.lit("m "), s.cast("string"), F.lit("s"))).otherwise(F.concat(m.cast("string"), F.lit("m")))
    hours = F.concat(F.floor(m / 60).cast("string"), F.lit("h "), (m % 60).cast("string"), F.lit("m"))
    return F.when(n < 60, F.concat(n.cast("string"), F.lit("s"))).when(m < 60, minutes).otherwise(hours)


def clock_text(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm")


def run_name(created: Column, members: Column) -> Column:
    """A folder's name: UTC time, then the members joined by '-'."""
    return F.concat(F.date_format(created, "yyyyMMdd'T'HHmmss'Z'"), F.lit("__"), F.array_join(members, "-"))
