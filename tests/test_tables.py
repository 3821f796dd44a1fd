import os

from pyspark.sql import functions as F

from foliary import schema, tables


def stamps(path):
    return {os.path.basename(d): sorted(os.stat(f"{d}/{n}").st_mtime_ns for n in names if n.startswith("part-")) for d, _, names in os.walk(path) if "key_bucket" in d}


def test_changes_rewrite_only_their_buckets(spark, tmp_path):
    log = tables.version_log(spark, f"file://{tmp_path}/log", 16)
    done = schema.conform(spark.range(2000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("sha256"), F.lit("done").alias("download_status"), F.lit("t0").alias("pdf_retrieved_at")), schema.RECORD)
    assert len(tables.record_first(log, done)) == 16 and log.read().count() == 2000
    before = stamps(f"{tmp_path}/log")
    assert len(before) == 16 and all(len(x) == 1 for x in before.values())
    changes = spark.createDataFrame([(7, "new7", None), (7, "new7", None), (8, "new8", None)], "record_id long, sha256 string, old_sha string")
    mine = tables.supersede(log, changes, F.lit("t1"))
    after = stamps(f"{tmp_path}/log")
    assert 1 <= len(mine) <= 2 and {k for k in before if before[k] != after[k]} == {f"key_bucket={b}" for b in mine}
    rows = {(r.record_id, r.sha256, r.superseded_at) for r in log.read().where("record_id in (7, 8, 9)").collect()}
    own = {r.id: r.sha256 for r in done.where("id in (7, 8, 9)").collect()}
    assert rows == {(7, own[7], "t1"), (7, "new7", None), (8, own[8], "t1"), (8, "new8", None), (9, own[9], None)}
    assert log.read().count() == 2002 and tables.supersede(log, changes.where("false"), F.lit("t2")) == [] and stamps(f"{tmp_path}/log") == after


def test_upserts_keep_what_is_known(spark, tmp_path):
    table = tables.Keyed(spark, f"file://{tmp_path}/records", "pdf_url", schema.RECORD, 4)
    rows = lambda *x: schema.conform(spark.createDataFrame(list(x), "id long, pdf_url string, meta_status string"), schema.RECORD)
    tables.upsert_records(table, rows((1, "a", "ok"), (2, "a", "late"), (3, "b", "ok")))
    tables.upsert_records(table, rows((9, "a", "pending"), (4, "c", "pending")))
    assert sorted((r.id, r.pdf_url, r.meta_status) for r in table.read().collect()) == [(1, "a", "ok"), (3, "b", "ok"), (4, "c", "pending")]


def test_no_join_of_versions_goes_through_the_driver(spark):
    """Tables of few columns look small to the planner; they are not broadcast all the same."""
    from foliary.operators import versions

    records = schema.conform(spark.range(9).select("id", F.lit("s").alias("sha256"), F.lit("done").alias("download_status")), schema.RECORD)
    history = versions.backfill(records, spark.createDataFrame([(1,)], "record_id long"))
    after = versions.superseded(history, spark.createDataFrame([(7, "n", None)], "record_id long, sha256 string, old_sha string"), F.lit("t"))
    assert "Broadcast" not in after._jdf.queryExecution().executedPlan().toString() and after.count() == 9
