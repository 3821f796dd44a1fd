"""Trimming, panels, labels, spreadsheet safety and other text rules as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(c: Column) -> Column:
    """Without white space of any script at either end; Spark's own trim removes plain spaces only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def panel(c: Column) -> Column:
    """Members of a ';'-separated panel in their order, trimmed, without empty ones; [] for null."""
    members = F.filter(F.transform(F.split(c, ";"), trimmed), lambda x: x != "")
    return F.coalesce(members, F.array().cast("array<string>"))


def label_key(c: Column) -> Column:
    """A label for comparison: no outer white space, no trailing spaces or full stops, lower case."""
    return F.lower(F.regexp_replace(trimmed(c), r"[ .]+$", ""))


def in_vocabulary(c: Column, vocabulary: list[str]) -> Column:
    """True for null and for members, whatever their case and trailing stops."""
    known = sorted({v.strip().rstrip(" .").casefold() for v in vocabulary})
    return c.isNull() | label_key(c).isin(known)


def _escaped(c: Column) -> Column:
    """Control, format, unassigned and separating characters but the plain space as their hexadecimal codes."""
    hidden = r"[\p{C}\p{Z}&&[^ ]]"

    def shown(x: Column) -> Column:
        code = F.lower(F.hex(F.ascii(x)))
        wide = lambda mark, n: F.concat(F.lit(mark), F.lpad(code, n, "0"))
        return F.when(~x.rlike(hidden), x).when(F.length(code) < 3, wide("\\x", 2)).when(F.length(code) < 5, wide("\\u", 4)).otherwise(wide("\\U", 8))

    return F.when(c.rlike(hidden), F.array_join(F.transform(F.split(c, ""), shown), "")).otherwise(c)


def drift_flag(c: Column, vocabulary: list[str], label: str) -> Column:
    """Null for members; else a warning with the value quoted, in double quotes only if it has a single one and no double."""
    plain = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for char, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        plain = F.replace(plain, F.lit(char), F.lit(shown))
    plain = _escaped(plain)
    double = F.concat(F.lit('"'), plain, F.lit('"'))
    single = F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'"))
    quoted = F.when(c.contains("'") & ~c.contains('"'), double).otherwise(single)
    return F.when(~in_vocabulary(c, vocabulary), F.concat(F.lit(f"{label} not in controlled vocabulary: "), quoted))


def csv_safe(c: Column) -> Column:
    """Text that a spreadsheet would take for a formula gets a leading quote."""
    text = c.cast("string")
    return F.when(text.rlike("^[=+\\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def csv_cell(c: Column, kind: str) -> Column:
    """The text of one CSV cell: null is empty, booleans are true or false, text is made safe."""
    if kind == "boolean":
        return F.coalesce(F.when(c, "true").when(~c, "false"), F.lit(""))
    return F.coalesce(csv_safe(c), F.lit(""))


def clipped(c: Column, width: int) -> Column:
    """At most width characters; what is cut off shows as an ellipsis."""
    return F.when(F.length(c) > width, F.concat(F.left(c, F.lit(width - 1)), F.lit("…"))).otherwise(c)


def identity(document_uuid: Column, pdf_url: Column) -> Column:
    """What a document is published under: its id, or its address if that is missing or empty."""
    return F.coalesce(blank_to_null(document_uuid), pdf_url)
