import pytest
from pyspark.sql import functions as F

from foliary.functions import dates, links, names, text, transfer


def values(spark, rows, build):
    rows = [(r,) for r in rows]
    return [r[0] for r in spark.createDataFrame(rows, "x string").coalesce(1).select(build(F.col("x"))).collect()]


def test_dates(spark):
    raw = ["02/07/2026", " 2 July 2026", "2  JULY\t2026", "31 February 2026", "July 2nd, 2026", "02 Jullyy 2026", "002/07/2026", "", None, "29/02/2024", "29/02/2023"]
    want = ["2026-07-02"] * 3 + [None] * 6 + ["2024-02-29", None]
    assert values(spark, raw, lambda c: dates.day_first(c).cast("string")) == want
    assert values(spark, [None, " ", "1/1/2020"], lambda c: dates.strict_day_first(c).cast("string")) == [None, None, "2020-01-01"]
    with pytest.raises(Exception, match="not a date"):
        values(spark, ["soon"], dates.strict_day_first)


def test_durations(spark):
    got = values(spark, ["0", "2.5", "59.4", "60", "89", "90", "3599", "3600", "7501"], lambda c: dates.duration_text(c.cast("double")))
    assert got == ["0s", "2s", "59s", "1m", "1m", "1m 30s", "59m 59s", "1h 0m", "2h 5m"]


def test_slugs(spark):
    got = values(spark, ["[2026] IESC 36", " [2025]  iehc 7 (unapproved)", "2026 IESC 36", "[2026] XX 1", None, "[26] IESC 1"], names.citation_slug)
    assert got == ["2026_IESC_36", "2025_IEHC_7", None, None, None, None]
    got = values(spark, ["Ó Donnell C.J.", "../../etc", "  ", None, "Ní Raifeartaigh J", "日本", "a" * 79 + " b"], names.person_slug)
    assert got == ["O-Donnell-C-J", "etc", "", None, "Ni-Raifeartaigh-J", "", "a" * 79]
    assert values(spark, ["a.pdf", "", ".x", "..", "a/b", "a\\b", None], names.is_safe_name) == [True] + [False] * 6
    assert values(spark, ["[2026] IESC 36"], lambda c: names.file_stem(c, F.lit("Dunne J."))) == ["2026_IESC_36_Dunne-J"]


def test_panels_and_labels(spark):
    assert values(spark, ["A J.;;B J.; A J. ", None, "", " ; ", "C"], text.panel) == [["A J.", "B J.", "A J."], [], [], [], ["C"]]
    vocabulary = ["Approved", "Allow Appeal"]
    assert values(spark, ["approved.", " ALLOW APPEAL . ", "Allow", None, " "], lambda c: text.in_vocabulary(c, vocabulary)) == [True, True, False, True, False]
    got = values(spark, ["Draft", "it's", "a'\"b", "approved", None, "x\ny"], lambda c: text.drift_flag(c, vocabulary, "status"))
    assert [g and g.split(": ")[1] for g in got] == ["'Draft'", '"it\'s"', "'a\\'\"b'", None, None, "'x\\ny'"]


def test_spreadsheet_guard(spark):
    assert values(spark, ["=1", "+1", "-1", "@x", "\tx", "\rx", "x=1", "", None], text.csv_safe) == ["'=1", "'+1", "'-1", "'@x", "'\tx", "'\rx", "x=1", "", None]
    assert values(spark, [None, "-5"], lambda c: text.csv_cell(c, "string")) == ["", "'-5"]
    assert values(spark, ["true", "false", None], lambda c: text.csv_cell(c.cast("boolean"), "boolean")) == ["true", "false", ""]
    assert values(spark, ["abcdef", "abc", None], lambda c: text.clipped(c, 4)) == ["abc…", "abc", None]


def test_links(spark):
    assert values(spark, ["/a b#c", "http://x/y#z", "?page=2", None], lambda c: links.absolute("https://h/p/q", c)) == ["https://h/a%20b", "http://x/y", "https://h/p/q?page=2", None]
    u, v = "0123abcd-0000-4000-8000-0123456789ab", "FFFFFFFF-0000-4000-8000-0123456789ab"
    urls = [f"https://h/view/{u}/{v}/x", f"https://h/{u}?id={v}", "https://h/", "not a url", None]
    assert values(spark, urls, lambda c: F.concat_ws("|", *links.uuids_in_path(c))) == [f"{u}|{v}", f"{u}|", "|", "|", "|"]
    assert values(spark, ["2,561 results", "about 1 RESULT", "none", None], links.result_count) == [2561, 1, None, None]
    assert values(spark, ["a?x=1&page=12", "a?page=", "a"], links.page_number) == [12, None, None]
    got = values(spark, ["Supreme Court"], lambda c: links.search_url("https://h/", links.facet_query(F.array(c)), F.lit(0)))
    assert got == ["https://h/search/Judgments/%22%20type%3AJudgment%22%20AND%20%22filter%3Aalfresco_radio.title%22%20AND%20%22filter%3Aalfresco_Court.Supreme%20Court%22?page=0"]
    got = values(spark, ["court-of appeal", " Superior ", "all", "moot"], lambda c: F.size(links.court_tokens(c)))
    assert got[:3] == [1, 3, 9] and got[3] in (None, -1)
    assert values(spark, ["2561"], lambda c: links.last_page(c.cast("long"), F.lit(100), F.lit(3))) == [25]


def test_transfers(spark):
    rows = [(b"%PDF-1", "6", None), (b"", "0", None), (None, None, None), (b"<html>", None, None), (b"%PDF-1", "9", None), (b"%PDF-1", "9", "gzip"), (b"%PDF-1", "-2", None), (b"%PDF-1", "x", "")]
    frame = spark.createDataFrame(rows, "b binary, l string, e string").coalesce(1)
    got = [r[0] for r in frame.select(transfer.body_verdict(F.col("b"), F.col("l"), F.col("e"))).collect()]
    assert got == ["ok", "empty", "empty", "not_magic", "short", "ok", "ok", "ok"]
    got = values(spark, ["200", "404", "429", "503", None], lambda c: F.struct(transfer.is_retryable(c.cast("int")).alias("r"), transfer.is_alive(c.cast("int")).alias("a")))
    assert [tuple(x) for x in got] == [(False, True), (False, True), (True, True), (True, False), (True, False)]
