import hashlib

import pytest
from pyspark.sql import functions as F
from test_markup import listing_html

from foliary import schema
from foliary.operators import crawl, progress
from foliary.operators import versions as V

RESPONSE = "url string, attempt int, status int, body binary, content_length string, content_encoding string, etag string, last_modified string"
PDF = b"%PDF-1.7"


def responses(spark, rows):
    return spark.createDataFrame([(u, a, s, b if b is None or isinstance(b, bytes) else b.encode(), None, None, None, None) for u, a, s, b in rows], RESPONSE)


def rows_of(*rows):
    return [{f.name: r.get(f.name) for f in schema.RECORD} | {k: v for k, v in {"meta_status": "pending", "download_status": "pending", "judge": "Dunne J."}.items() if k not in r} for r in rows]


def make(spark, *rows):
    full = rows_of(*rows)
    return spark.createDataFrame([tuple(r[f.name] for f in schema.RECORD) for r in full], schema.RECORD)


def test_listing(spark):
    got = crawl.list_pages(responses(spark, [("https://h/?page=0", 1, 500, None), ("https://h/?page=0", 2, 200, listing_html(3)), ("https://h/?page=1", 1, 200, listing_html(4)), ("https://h/?page=2", 1, 503, "x")]), "https://h")
    assert sorted(r.page for r in got.collect()) == [0, 0, 0, 1]


def page(citation):
    return f"<td><span class='cell-title'>Neutral Citation</span> {citation}</td><td><span class='cell-title'>Court</span> High</td>"


def test_metadata(spark):
    rec = make(spark, *[{"id": i, "view_url": f"v{i}"} for i in range(7)], {"id": 9, "view_url": "v0", "meta_status": "ok"})
    resp = responses(spark, [("v0", 1, 200, page("[2026] IESC 1")), ("v1", 1, 200, page("[2026] IESC 1")), ("v2", 1, 200, "<p>down</p>"), ("v3", 1, 503, "x"), ("v4", 1, 404, page("")), ("v5", 1, 200, page("")), ("v6", 1, 200, page("odd"))])
    out = crawl.resolve_metadata(rec, resp, "https://h")
    got = {r.id: (r.outcome, r.filename, r.error_reason) for r in out.collect()}
    assert got[0] == ("ok", "2026_IESC_1_Dunne-J.pdf", None) and got[1] == ("ok", "2026_IESC_1_Dunne-J_2.pdf", None)
    assert got[2][0] == got[3][0] == "deferred" and got[4] == ("error", None, "status 404") and got[5][2] == "no neutral citation" and got[6][2] == "unknown form of citation"
    after = {r.id: r for r in crawl.after_metadata(rec, out, F.lit("now")).collect()}
    assert after[0].meta_status == "ok" and after[0].meta_retrieved_at == "now" and after[2].meta_status == "pending" and after[5].meta_status == "error" and after[9].meta_status == "ok"
    again, n = crawl.requeued(crawl.after_metadata(rec, out, F.lit("now")))
    assert n.first().n == 3 and again.where("meta_status = 'error'").count() == 0
    assert crawl.error_log(out, "metadata", F.lit("now")).count() == 3


def test_downloads(spark):
    rec = make(spark, *[{"id": i, "pdf_url": f"p{i}", "meta_status": "ok"} for i in range(4)], {"id": 5, "pdf_url": "p0"})
    out = crawl.downloads(rec, responses(spark, [("p0", 1, 200, PDF), ("p1", 1, 200, "<html>"), ("p2", 1, 503, None)]))
    got = {r.id: (r.download_status, r.error_reason, r.sha256) for r in out.collect()}
    assert got == {0: ("done", None, hashlib.sha256(PDF).hexdigest()), 1: ("error", "not_magic", None), 2: ("error", "status 503", None), 3: ("error", "no response", None)}
    assert crawl.downloads(rec, responses(spark, [("p0", 1, 200, PDF)]), limit=1).count() == 1


def test_revalidation(spark):
    sha = hashlib.sha256(PDF).hexdigest()
    rec = make(spark, *[{"id": i, "pdf_url": f"p{i}", "meta_status": "ok", "download_status": "done", "sha256": sha, "filename": f"f{i}", "pdf_retrieved_at": "t0", "last_revalidated_at": "t9" if i == 4 else None} for i in range(5)])
    live = spark.createDataFrame([("f0", sha), ("f1", "broken"), ("f2", sha), ("f3", sha), ("f4", sha)], "filename string, live_sha string")
    resp = responses(spark, [("p0", 1, 200, PDF), ("p1", 1, 200, PDF), ("p2", 1, 200, PDF + b"2"), ("p3", 1, 500, None), ("p4", 1, 200, PDF)])
    decisions, history, after = crawl.revalidate(rec, spark.createDataFrame([], schema.VERSION), resp, live, "t5", cutoff="t5")
    assert {r.id: r.action for r in decisions.collect()} == {0: "keep", 1: "heal", 2: "supersede", 3: "error"}
    assert V.superseded_count(history).first().n == 1 and history.count() == 6
    got = {r.id: (r.sha256 == sha, r.last_revalidated_at) for r in after.collect()}
    assert got == {0: (True, "t5"), 1: (True, "t5"), 2: (False, "t5"), 3: (True, None), 4: (True, "t9")}


def test_event_lines(spark):
    rows = spark.createDataFrame([("PhaseStarted", "metadata", None, None, None), ("ItemFinished", "x", "error", "boom", None), ("ItemFinished", "x", "ok", None, None), ("OutageProbing", None, None, None, 60.0)], "k string, l string, s string, r string, n double").coalesce(1)
    got = [r[0] for r in rows.select(progress.event_text(F.col("k"), F.col("l"), F.col("s"), F.col("r"), F.col("n"))).collect()]
    assert got == ["started: metadata", "error x (boom)", None, "site down, next look in 1m"]
    eta = spark.createDataFrame([(1, 1, 10.0, 60.0, ""), (1, 2, 20.0, 55.0, "paused"), (1, 3, 30.0, 40.0, "")], "u int, i int, now double, left double, o string")
    assert [r.done_at for r in progress.done_at(eta, ["u"], "i", "now", "left", "o").orderBy("i").collect()] == [70.0, 70.0, 70.0]
    assert [r[0] for r in spark.createDataFrame([(0.0, 5.0), (3.0, 5.0)], "a double, b double").coalesce(1).select(progress.final_elapsed(F.col("a"), F.col("b"))).collect()] == [5.0, 3.0]


def test_names_in_use_are_not_given_again(spark):
    old = {"id": 90, "view_url": "z", "filename": "2026_IESC_1_Dunne-J.pdf", "meta_status": "ok"}
    rec = make(spark, *[{"id": i, "view_url": f"v{i}"} for i in range(2)], old)
    out = crawl.resolve_metadata(rec, responses(spark, [(f"v{i}", 1, 200, page("[2026] IESC 1")) for i in range(2)]), "https://h")
    assert sorted(r.filename for r in out.collect()) == ["2026_IESC_1_Dunne-J_2.pdf", "2026_IESC_1_Dunne-J_3.pdf"]


def test_fetch_guards_and_update(spark):
    none = responses(spark, [])
    rec = make(spark, {"id": 1, "pdf_url": "p1"})
    for options, said in [(dict(courts=["a"], records=rec), "resume"), (dict(courts=None), "neither"), (dict(courts=["a"], retry_skipped=True), "skipped"), (dict(courts=None, records=rec, list_only=True), "listing alone"), (dict(courts=["a"], list_only=True, limit=3), "limit")]:
        with pytest.raises(ValueError, match=said):
            crawl.fetch(spark, responses=none, base="https://h", now="t", **options)
    done = spark.createDataFrame([("r1", ["a"], True, False)], "run string, courts array<string>, catalog_complete boolean, truncated boolean")
    with pytest.raises(ValueError, match="r1"):
        crawl.fetch(spark, ["a"], none, "https://h", "t", catalog=done)
    seen = responses(spark, [("https://h/?page=0", 1, 200, listing_html(3))])
    listed = crawl.fetch(spark, ["a"], seen, "https://h", "t", list_only=True, catalog=done.where("run = ''"))
    assert listed.count() > 0 and {r.meta_status for r in listed.collect()} == {"pending"} and sorted(r.id for r in listed.collect()) == list(range(1, listed.count() + 1))
    with pytest.raises(ValueError, match="no listing"):
        crawl.update(rec.where("false"), spark.createDataFrame([], schema.VERSION), none, "https://h", "t", run="r")
    failed = make(spark, {"id": 1, "pdf_url": "p1", "meta_status": "error", "error_reason": "x"})
    told, state, _ = crawl.update(failed, spark.createDataFrame([], schema.VERSION), seen, "https://h", "t", run="r", retry_skipped=True)
    assert told["requeued"] == 1 and told["new"] == listed.count() and told["revisions"] == 0 and state.count() == 1 + listed.count()


def test_pages_are_parsed_once(spark, monkeypatch):
    """What later steps read of parsed pages is staged, and pages without a listing's table are not parsed for one."""
    from foliary.plans import archive, catalog
    from foliary.sources import markup

    plans = {"details": [], "listing": []}
    for name in plans:
        real = getattr(markup, name)
        monkeypatch.setattr(markup, name, lambda *a, real=real, name=name: plans[name].append(a[0]) or real(*a))
    for query in ("crawl_requeued", "crawl_metadata", "crawl_errors", "crawl_after_metadata"):
        plan = archive.QUERIES[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "ArrowEvalPython" not in plan, query
    answers, known = catalog._visit(spark, "/root/testdata/sf0.001")
    fresh = crawl.listed(known, crawl.list_pages(answers, "https://h.example"), F.lit("2024"))
    assert "ArrowEvalPython" not in fresh._jdf.queryExecution().optimizedPlan().toString()
    assert plans["listing"][0].count() == 1500


def test_listed_rows_are_numbered_in_segments(spark):
    """New ids go by page and address, and no task counts all pages."""
    pages = spark.createDataFrame([(p, f"p{u}", f"t{u}") for p, u in [(3, 1), (None, 9), (3, 0), (1, 7), (2, 5), (1, 8), (2, 40)]], "page long, pdf_url string, title string")
    out = crawl.listed(make(spark, {"id": 4, "pdf_url": "p40"}), pages, F.lit("t"))
    assert [(r.id, r.pdf_url) for r in out.orderBy("id").collect()] == [(4, "p40"), (5, "p9"), (6, "p7"), (7, "p8"), (8, "p5"), (9, "p0"), (10, "p1")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_scan_segment" in plan and "Aggregate [page" not in plan
