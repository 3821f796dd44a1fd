import random

import pytest
from pyspark.sql import functions as F

from foliary import schema
from foliary.operators import ingest, merge, progress, versions


def test_merge_equals_a_plain_restatement(spark):
    rng = random.Random(7)
    rows = []
    for run in range(4):
        for k in range(60):
            stamp = lambda: rng.choice([None, "", "2026-01-01", "2026-01-02"])
            rows.append((run, k, rng.choice(["", "a", "b", "c", "d"]), rng.choice(["u1", "u2"]), rng.choice([None, "X", "Y"]), rng.choice([None, "", "s1", "s2", "s3"]), stamp(), stamp(), stamp(), f"run{run}"))
    cols = "run_ord int, id int, document_uuid string, pdf_url string, neutral_citation string, sha256 string, pdf_retrieved_at string, meta_retrieved_at string, listed_at string, run string"
    best, seen, shas = {}, {}, {}
    for r in sorted(rows, key=lambda r: r[:2]):
        ident, when = r[2] or r[3], tuple(x or "" for x in r[6:9])
        seen.setdefault(ident, r[:2])
        if ident not in best or when > best[ident][0]:
            best[ident] = (when, r)
        if r[5]:
            shas.setdefault(ident, {})[r[5]] = r[9]
    frame = merge.identity(spark.createDataFrame(rows, cols))
    won = merge.latest_wins(frame, "ident", ["pdf_retrieved_at", "meta_retrieved_at", "listed_at"], ["run_ord", "id"])
    got = [(r.ident, r.run_ord, r.id) for r in won.orderBy(*merge.merged_order(won)).collect()]
    order = sorted(best, key=lambda i: (best[i][1][4] or "", best[i][1][2] or "", seen[i]))
    assert got == [(i, *best[i][1][:2]) for i in order]
    found = {r.ident: (r.shas, r.runs) for r in merge.content_conflicts(frame, ["ident"], "sha256", "run", "run_ord").collect()}
    assert found == {i: (sorted(s), sorted(set(s.values()))) for i, s in shas.items() if len(s) > 1}


def test_revisions(spark):
    chain = [(0, 1, k, s) for k, s in enumerate("ABABC")] + [(1, 9, 0, "A"), (1, 9, 1, "B"), (1, 9, 2, "B")]
    rows = spark.createDataFrame([(o, r, f"t{k}", k, "i", s) for o, r, k, s in chain], "run_ord int, record_id int, fetched_at string, id int, ident string, sha256 string")
    got = merge.revisions(rows, ["run_ord", "record_id"], ["fetched_at", "id"], ["ident"], "sha256", ["fetched_at"], ["fetched_at"])
    assert sorted((r.old_sha, r.new_sha, r.new_fetched_at) for r in got.collect()) == [("A", "B", "t1"), ("B", "A", "t2"), ("B", "B", "t2"), ("B", "C", "t4")]


def plain_names(names):
    taken, out = set(), []
    for n in names:
        head, dot, tail = n.partition(".")
        new, k = n, 1
        while new in taken:
            k += 1
            new = f"{head}__{k}{dot}{tail}"
        taken.add(new)
        out.append(new)
    return out


def test_bag_names_with_clashes(spark):
    rng = random.Random(3)
    for _ in range(4):
        names = [rng.choice(["a.pdf", "a__2.pdf", "a__3.pdf", "b.v1.pdf", "b__2.v1.pdf", "c"]) for _ in range(rng.randint(3, 14))]
        frame = spark.createDataFrame(list(enumerate(names)), "ident int, filename string")
        made = merge.resolve_clashes(merge.bag_names(frame, F.col("filename"), ["ident"]), "filename", "bag_name", ["ident"])
        assert [r.bag_name for r in made.orderBy("ident").collect()] == plain_names(names)


def plain_files(stems, taken):
    taken, out = set(taken), []
    for s in stems:
        new, k = f"{s}.pdf", 1
        while new in taken:
            k += 1
            new = f"{s}_{k}.pdf"
        taken.add(new)
        out.append(new)
    return out


def test_file_names_with_clashes_and_names_in_use(spark):
    rng = random.Random(5)
    for taken in ([], ["a.pdf", "a_3.pdf", "c_2.pdf", "zz.pdf"]):
        for stems in (["a", "a", "a_2"], ["a_2", "a", "a"], *([rng.choice(["a", "a_2", "a_2_2", "b", "c"]) for _ in range(12)] for _ in range(3))):
            frame = spark.createDataFrame(list(enumerate(stems)) + [(99, None)], "id int, stem string")
            used = spark.createDataFrame([(t,) for t in taken], "filename string") if taken else None
            got = merge.file_names(frame, F.col("stem"), ["id"], taken=used).orderBy("id").collect()
            assert [r.filename for r in got] == [*plain_files(stems, taken), None]


def test_first_known_and_spacing(spark):
    rows = spark.createDataFrame([(1, 1, None), (1, 2, "b"), (1, 3, "c"), (2, 1, None)], "g int, n int, v string")
    assert {r.g: r.v for r in merge.first_known(rows, ["g"], "v", [F.col("n")]).collect()} == {1: "b", 2: None}
    calls = spark.createDataFrame([(1, 0.0), (1, 5.0), (1, 9.0), (2, 1.0)], "u int, t double")
    assert [(r.t, r.gap) for r in progress.spacing(calls, ["u"], "t", 5.0).collect()] == [(9.0, 4.0)]


def test_ingest(spark):
    known = spark.createDataFrame([("u1", "old", "done")], "pdf_url string, listed_at string, download_status string")
    batch = spark.createDataFrame([("u1", "new", 1), ("u2", "b", 3), ("u2", "a", 2), ("u3", "c", 4)], "pdf_url string, listed_at string, id int")
    got = {r.pdf_url: (r.listed_at, r.download_status) for r in ingest.upsert_ignore(known, batch, "pdf_url", ["id"]).collect()}
    assert got == {"u1": ("old", "done"), "u2": ("a", None), "u3": ("c", None)}
    with pytest.raises(ValueError, match="not allowed"):
        ingest.count_where(known, "pdf_url", "u1")


def test_transitions(spark):
    records = spark.createDataFrame([(1, "pending", None), (2, "pending", "x"), (3, "ok", "y")], "id int, meta_status string, error_reason string")
    types, cols = {"meta_status": "string", "error_reason": "string"}, ["meta_status", "error_reason"]
    at = lambda ids, t, **ch: ingest.transition(records.where(F.col("id").isin(ids)), "id", F.lit(t), {k: F.lit(v) for k, v in ch.items()}, cols, types)
    log = at([1, 2], 1, meta_status="error", error_reason="boom").union(at([2], 2, meta_status="pending", error_reason=None)).union(at([1], 3, meta_status="ok"))
    got = sorted(map(tuple, ingest.apply_transitions(records, log, "id", ["at"], cols).collect()))
    assert got == [(1, "ok", "boom"), (2, "pending", None), (3, "ok", "y")]


def test_history(spark):
    records = schema.conform(spark.createDataFrame([(1, "done", "s0", "t0", None), (2, "done", "z", "t0", 5), (3, "pending", None, None, None)], "id bigint, download_status string, sha256 string, pdf_retrieved_at string, bytes bigint"), schema.RECORD)
    history = versions.backfill(records, spark.createDataFrame([], schema.VERSION))
    assert sorted((r.record_id, r.sha256, r.bytes) for r in history.collect()) == [(1, "s0", 0), (2, "z", 5)]
    assert versions.backfill(records, history).count() == 0
    changes = spark.createDataFrame([(1, "s1", "s0")], "record_id bigint, sha256 string, old_sha string")
    after = versions.superseded(history, changes, F.lit("t9"))
    got = sorted((r.record_id, r.sha256, r.superseded_at, r.filename) for r in after.collect())
    assert got == sorted([(1, "s0", "t9", "versions/s0.pdf"), (1, "s1", None, None), (2, "z", None, None)], key=str) or set(got) == {(1, "s0", "t9", "versions/s0.pdf"), (1, "s1", None, None), (2, "z", None, None)}
    assert versions.superseded_count(after).first().n == 1 and versions.current(after).count() == 2
    assert [r.name for r in versions.archived_names(after).collect()] == ["s0.pdf"]


def test_coverage_is_judged_by_todays_total(spark):
    rows = spark.createDataFrame([("r", 1, 3, 27), ("r", 2, 26, 26), ("r", 3, 5, 40)], "run string, n int, covered int, available int")
    got = ingest.listing_verdicts(rows, "run", "n", "covered", "available").orderBy("n").collect()
    assert [(r.pages_covered, r.truncated) for r in got] == [(3, True), (26, False), (26, True)]


def test_outages_and_schedule(spark):
    rng = random.Random(8)
    rows = [(u, i, rng.random() < 0.7) for u in range(20) for i in range(30)]
    want = 0
    for u in range(20):
        run = 0
        for _, _, bad in (r for r in rows if r[0] == u):
            run = run + 1 if bad else 0
            if run == 3:
                want, run = want + 1, 0
    got = progress.outages(spark.createDataFrame(rows, "u int, i int, bad boolean"), ["u"], ["i"], F.col("bad"))
    assert sum(r.pauses for r in got.collect()) == want
    waits = progress.probe_schedule()
    assert [w for w, _ in waits[:4]] == [60, 120, 300, 300] and waits[-1][1] >= 3600 > waits[-2][1]


def test_eta(spark):
    one = spark.range(1)
    at = lambda n, s: one.select(progress.eta(F.lit(100), F.lit(n), progress.pace(F.lit(5.0), F.lit(2.0), F.lit(n), F.lit(s)), F.lit(False))).first()[0]
    assert at(90, 0.0) == 10 * 3.0 and at(19, 0.0) == 81 * 6.0 and at(20, 60.0) == 80 * 4.5 and at(120, 10.0) == 0
    assert one.select(progress.eta(F.lit(0), F.lit(1), F.lit(1.0), F.lit(False))).first()[0] is None


def test_throttle(spark):
    rows = spark.createDataFrame([(1, float(t)) for t in (0, 1, 2, 3, 4, 30, 31, 61)], "u int, t double")
    assert sorted(r.t for r in progress.throttled(rows, ["u"], "t", "t", 3, 20.0).collect()) == [0.0, 3.0, 30.0, 61.0]
