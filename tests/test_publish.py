import hashlib
import json
import os
import subprocess

import pytest

from foliary import publish, schema, store
from foliary.sources import runs


def make_run(spark, root, name, rows, versions=(), listing=None, files=()):
    os.makedirs(f"{root}/{name}", exist_ok=True)
    spark.createDataFrame(rows).write.mode("overwrite").parquet(f"{root}/{name}/records.parquet")
    if versions:
        frame = spark.createDataFrame(versions)
        schema.conform(frame, schema.VERSION).write.mode("overwrite").parquet(f"{root}/{name}/versions.parquet")
    manifest = {"tool": "t", "base_url": "https://h", "courts": ["Supreme Court"], "query": "q"} | ({"listing": listing} if listing else {})
    with open(f"{root}/{name}/manifest.json", "w") as f:
        json.dump(manifest, f, indent=1)
    for file, content in files:
        os.makedirs(os.path.dirname(f"{root}/{name}/{file}"), exist_ok=True)
        with open(f"{root}/{name}/{file}", "wb") as f:
            f.write(content)


def record(i, uuid, sha, at, **more):
    return {"id": i, "document_uuid": uuid, "pdf_url": f"https://h/{uuid}", "sha256": sha, "pdf_retrieved_at": at, "meta_status": "ok", "download_status": "done", "filename": "a.pdf", "title": "=T", "composition": "A;B", "status_field": "Draft", "date_delivered": "2026-01-02", "meta_json": '{"fields":{"Court":"x"},"supplementary":[]}', **more}


@pytest.fixture
def root(spark, tmp_path):
    old, new = b"%PDF-old", b"%PDF-new"
    so, sn = (hashlib.sha256(x).hexdigest() for x in (old, new))
    make_run(spark, f"{tmp_path}/data", "20260101T000000Z__a", [record(1, "u1", so, "t1"), record(2, "u2", "zz", "t1")], files=[("pdfs/a.pdf", old)], listing={"complete": True, "truncated": False, "pages_fetched": 2, "pages_available": 2})
    v = [{"id": 1, "record_id": 1, "document_uuid": "u1", "pdf_url": "x", "sha256": so, "bytes": 8, "fetched_at": "t1", "superseded_at": "t2", "filename": f"versions/{so}.pdf"}, {"id": 2, "record_id": 1, "document_uuid": "u1", "pdf_url": "x", "sha256": sn, "bytes": 8, "fetched_at": "t2", "superseded_at": None, "filename": "a.pdf"}]
    make_run(spark, f"{tmp_path}/data", "20260201T000000Z__a", [record(1, "u1", sn, "t2")], versions=[dict(x, superseded_at=x["superseded_at"] or "") if False else x for x in v], files=[("pdfs/a.pdf", new), (f"pdfs/versions/{so}.pdf", old)])
    return f"{tmp_path}/data"


def test_catalog(spark, root):
    assert runs.names(spark, root) == ["20260201T000000Z__a", "20260101T000000Z__a"] and runs.latest(spark, root).startswith("202602")
    assert runs.names(spark, root + "/none") == [] and runs.latest(spark, root + "/none") is None
    got = {r.run: r for r in runs.catalog(spark, root).collect()}
    assert got["20260101T000000Z__a"].pages_text == "2 pages" and got["20260201T000000Z__a"].pages_text == "unverified"
    assert got["20260101T000000Z__a"].total == 2 and got["20260101T000000Z__a"].catalog_complete
    assert runs.matching(runs.catalog(spark, root), ["Supreme Court"]).count() == 2 and runs.resumable(runs.catalog(spark, root)).count() == 0
    with pytest.raises(ValueError, match="no such run"):
        runs.selected(spark, root, ["x"])
    with open(f"{root}/20260101T000000Z__a/manifest.json", "w") as f:
        f.write("[1")
    assert runs.manifests(spark, root).where("manifest.base_url is null").count() == 1
    assert runs.run_config(spark, root, "20260201T000000Z__a")["base_url"] == "https://h"


def test_export(spark, root, tmp_path):
    out = f"{tmp_path}/out"
    got = publish.export(spark, root, "20260101T000000Z__a", out, ["csv", "json", "parquet", "csv"])
    assert got["record_count"] == 2 and got["formats"] == ["csv", "json", "parquet"]
    rows = spark.read.csv(f"{out}/documents.csv", header=True, escape='"').collect()
    assert rows[0].title == "'=T" and rows[0].panel == "A; B" and rows[0].panel_count == "2" and rows[0].status_in_vocab == "false"
    assert rows[0].vocab_flags == "status not in controlled vocabulary: 'Draft'"
    item = json.load(open(f"{out}/documents.json"))[0]
    assert item["panel"] == ["A", "B"] and item["metadata_fields"] == {"Court": "x"} and item["http_etag"] is None
    about = json.load(open(f"{out}/datapackage.json"))
    assert about["resources"][0]["format"] == "csv" and about["coverage"]["date_delivered_max"] == "2026-01-02" and len(about["resources"][0]["schema"]["fields"]) == 30
    publish.json_document(publish.nested(runs.records(spark, root)), f"{tmp_path}/one.json")
    assert len(json.load(open(f"{tmp_path}/one.json"))) == 3
    publish.json_document(publish.nested(runs.records(spark, root).where("false")), f"{tmp_path}/none.json")
    assert json.load(open(f"{tmp_path}/none.json")) == []
    with pytest.raises(ValueError, match="unknown formats"):
        publish.export(spark, root, "x", out, ["xml"])


def test_corpus(spark, root, tmp_path):
    out = f"{tmp_path}/bag"
    got = publish.corpus(spark, root, out, ["parquet"], archive_as=".TGZ")
    assert (got["record_count"], got["run_count"], got["conflicts"], got["revisions"], got["missing_files"], got["unverified_versions"]) == (2, 2, 1, 1, 0, 0)
    names = sorted(r.filename for r in spark.read.parquet(f"{out}/data/documents.parquet").collect())
    assert names == ["a.pdf", "a__2.pdf"]
    check = subprocess.run(["sha256sum", "-c", "manifest-sha256.txt"], cwd=out, capture_output=True, text=True)
    assert check.returncode == 0, check.stderr
    assert subprocess.run(["sha256sum", "-c", "tagmanifest-sha256.txt"], cwd=out, capture_output=True).returncode == 0
    assert len(os.listdir(f"{out}/data/versions")) == 1 and open(f"{out}/data/files/a.pdf", "rb").read() == b"%PDF-new"
    assert os.path.exists(got["archive"] + ".sha256") and got["archive"].endswith(".tar.gz")
    snapshot = json.load(open(f"{out}/data/snapshot.json"))
    assert {k: snapshot["listing"][k] for k in ("all_verified", "any_truncated")} == {"all_verified": False, "any_truncated": False} and snapshot["revisions"]["count"] == 1
    assert snapshot["listing"]["sources"]["20260101T000000Z__a"]["pages_fetched"] == 2 and snapshot["conflict_count"] == 1
    with pytest.raises(ValueError, match="no runs"):
        publish.corpus(spark, f"{tmp_path}/nothing", out, ["csv"])
    os.unlink(f"{root}/20260101T000000Z__a/pdfs/a.pdf")
    with open(next(iter(__import__("glob").glob(f"{root}/20260201T000000Z__a/pdfs/versions/*.pdf"))), "wb") as f:
        f.write(b"damaged")
    again = publish.corpus(spark, root, out, ["csv"])
    assert again["missing_files"] == 1 and open(f"{out}/data/missing-files.txt").read() == "a.pdf\n" and again["unverified_versions"] == 1 and not os.listdir(f"{out}/data/versions")


def test_record_without_uuid_keeps_what_is_nested(spark):
    rows = schema.conform(spark.createDataFrame([(1, None, "A;B", '{"fields":{"Court":"x"},"supplementary":[]}')], "id bigint, document_uuid string, composition string, meta_json string"), schema.RECORD)
    got = publish.nested(rows).first()
    assert got.panel == ["A", "B"] and got.metadata_fields == {"Court": "x"}


def test_store(spark, tmp_path):
    folder = f"file://{tmp_path}/files"
    bodies = lambda *rows: spark.createDataFrame([(n, b, None, None) for n, b in rows], "filename string, body binary, content_length string, content_encoding string")
    assert store.publish(spark, folder, bodies(("a.pdf", b"%PDF-1"), ("b.pdf", b"<html>"), ("../c.pdf", b"%PDF-1"))) == 1
    assert [r.filename for r in store.live(spark, folder).collect()] == ["a.pdf"]
    old = hashlib.sha256(b"%PDF-1").hexdigest()
    changed = spark.createDataFrame([("a.pdf", "supersede", old)], "filename string, action string, old_sha string")
    assert store.keep_superseded(spark, folder, changed) == 1 and store.keep_superseded(spark, folder, changed) == 0
    open(f"{tmp_path}/files/x.123.part", "w").close()
    assert store.publish(spark, folder, bodies(("a.pdf", b"%PDF-2"))) == 1
    assert sorted(os.listdir(f"{tmp_path}/files")) == sorted(os.listdir(f"{tmp_path}/files")) and not [n for n in os.listdir(f"{tmp_path}/files") if n.endswith(".part")]
    assert os.listdir(f"{tmp_path}/files/versions")[0] in (f"{old}.pdf", f".{old}.pdf.crc") and open(f"{tmp_path}/files/a.pdf", "rb").read() == b"%PDF-2"


def test_archive_names():
    assert publish.archive_format(" .Tar.GZ") == "gztar"
    with pytest.raises(ValueError, match="unknown archive"):
        publish.archive_format("rar")
    assert len(schema.dictionary().splitlines()) == 36


def test_large_json_is_a_folder_of_arrays(spark, tmp_path):
    path = f"{tmp_path}/large.json"
    publish.json_document(spark.range(0, 95, 1, 4).selectExpr("id", "cast(null as string) as x").orderBy("id"), path, most=50, each=10)
    parts = [json.load(open(f"{path}/{n}")) for n in sorted(os.listdir(path)) if n.startswith("part-")]
    assert all(len(p) <= 10 for p in parts) and [r["id"] for p in parts for r in p] == list(range(95)) and parts[0][0] == {"id": 0, "x": None}
    assert spark.read.schema("id long").option("multiLine", "true").json(path).count() == 95
    publish.json_document(spark.range(3).select("id"), path, most=50)
    assert [r["id"] for r in json.load(open(path))] == [0, 1, 2]
