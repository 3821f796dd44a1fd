"""Addresses, ids in them, counts and page numbers in text, and search queries."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from foliary.functions.text import trimmed

UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"

# Tokens and names of the courts, and the groups of them.
COURTS = {
    "SUPREME": "Supreme Court",
    "COURT_OF_APPEAL": "Court of Appeal",
    "HIGH": "High Court",
    "COURT_OF_CRIMINAL_APPEAL": "Court of Criminal Appeal",
    "COURTS_MARTIAL_APPEAL": "Courts-Martial Appeal Courts",
    "CENTRAL_CRIMINAL": "Central Criminal Court",
    "SPECIAL_CRIMINAL": "Special Criminal Court",
    "CIRCUIT": "Circuit Court",
    "DISTRICT": "District Court",
}
COURT_GROUPS = {"superior": ["SUPREME", "COURT_OF_APPEAL", "HIGH"], "all": list(COURTS)}


def without_fragment(c: Column) -> Column:
    return F.replace(F.substring_index(c, "#", 1), F.lit(" "), F.lit("%20"))


def resolver(base: str) -> Callable[[str], str]:
    """href against base as RFC 3986 has it, without fragment, spaces encoded."""

    def resolved(href: str) -> str:
        bare = href.partition("#")[0]
        return (bare if bare.startswith(("http://", "https://")) else urljoin(base, bare)).replace(" ", "%20")

    return resolved


def absolute(base: str, href: Column) -> Column:
    """The same as a column; absolute addresses need no Python."""
    of = resolver(base)

    @F.pandas_udf(StringType())
    def joined(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else of(x))

    bare = without_fragment(href)
    return F.when(bare.rlike("^https?://"), bare).otherwise(joined(bare))


def plain_absolute(base: str, href: Column) -> Column:
    """The same without Python: of whole addresses and of plain paths from the root; null for others."""
    bare = F.substring_index(href, "#", 1)
    rooted = bare.startswith("/") & ~bare.startswith("//") & ~bare.rlike(r"[?;\\\t\n\r]|/\.")
    whole = F.when(bare.startswith("http://") | bare.startswith("https://"), bare).when(rooted, F.concat(F.lit(urljoin(base, "/x").removesuffix("/x")), bare))
    return F.replace(whole, F.lit(" "), F.lit("%20"))


def uuids_in_path(url: Column) -> tuple[Column, Column]:
    """The first and second id in the address's path, '' where there is none."""
    found = F.regexp_extract_all(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit(f"({UUID})"), F.lit(1))
    nth = lambda k: F.coalesce(F.get(found, k), F.lit(""))
    return nth(0), nth(1)


def result_count(text: Column) -> Column:
    """n of 'n results' with its thousands separators; null if the text has none."""
    return F.replace(F.regexp_extract(text, r"(?i)(\d[\d,]*)\s+results?", 1), F.lit(","), F.lit("")).try_cast("bigint")


def page_number(url: Column) -> Column:
    return F.regexp_extract(url, r"[?&]page=(\d+)", 1).try_cast("bigint")


def last_page(total: Column, first_page_rows: Column, pager: Column, max_pages: int | None = None) -> Column:
    """The last page's index (from 0) by the count of results, or by the pager if that goes further; at most max_pages pages."""
    by_count = F.when(first_page_rows > 0, F.ceil(total / first_page_rows) - 1)
    last = F.greatest(F.coalesce(by_count, F.lit(0)), F.coalesce(pager, F.lit(0)))
    return last if max_pages is None else F.least(last, F.lit(max_pages - 1))


def encoded(c: Column) -> Column:
    """Percent-encoded with nothing held safe but letters, digits and -._~."""
    out = F.url_encode(c)
    for was, now in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(was), F.lit(now))
    return out


def facet_query(courts: Column, doc_type: str = "Judgment") -> Column:
    """The search text for an array of court names; repeated facets are united by the site."""
    facets = F.transform(courts, lambda x: F.concat(F.lit('"filter:alfresco_Court.'), x, F.lit('"')))
    return F.array_join(F.concat(F.array(F.lit(f'" type:{doc_type}"'), F.lit('"filter:alfresco_radio.title"')), facets), " AND ")


def search_url(base: str, query: Column, page: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/search/Judgments/"), encoded(query), F.lit("?page="), page.cast("string"))


def court_tokens(token: Column) -> Column:
    """Array of court tokens that a token stands for, groups expanded; null if it is unknown."""
    key = F.translate(F.upper(trimmed(token)), "- ", "__")
    out = F.when(key.isin(list(COURTS)), F.array(key))
    for group, members in COURT_GROUPS.items():
        out = F.when(F.lower(trimmed(token)) == group, F.array(*map(F.lit, members))).otherwise(out)
    return out


def known_court_tokens(token: Column) -> Column:
    """As court_tokens, but an unknown token is an error that lists the known ones."""
    out = court_tokens(token)
    known = ", ".join([*COURTS, *COURT_GROUPS])
    return F.when(out.isNull() & token.isNotNull(), F.raise_error(F.concat(F.lit("unknown court "), token, F.lit(f"; known are {known}"))).cast("array<string>")).otherwise(out)
