import hashlib
import os

import pytest

from foliary import files, store
from foliary.functions import text
from foliary.operators import merge
from foliary.sources import markup, runs
from pyspark.sql import functions as F


def test_copies_by_tasks_are_whole(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    names = ["a.pdf", "sp ace.pdf", "plus+%41.pdf", "ü#?.pdf", "empty.pdf"]
    for n in names:
        (source / n).write_bytes(b"" if n == "empty.pdf" else n.encode() * 300_000)
    pairs = spark.createDataFrame([(f"file://{source}/{n}", n) for n in names], "source string, name string")
    assert store.copy_files(spark, f"file://{target}", pairs) == 5 and sorted(os.listdir(target)) == sorted(names)
    assert all((target / n).read_bytes() == (source / n).read_bytes() for n in names)
    (target / "a.pdf").write_bytes(b"old")
    assert store.copy_files(spark, f"file://{target}", pairs) == 5 and (target / "a.pdf").read_bytes() == (source / "a.pdf").read_bytes()
    assert store.copy_files(spark, f"file://{target}", pairs.where("false")) == 0


def test_attempts_that_fail_leave_no_file(tmp_path):
    def broken():
        yield b"half"
        raise OSError("gone")

    with pytest.raises(OSError, match="gone"):
        files._write(f"file://{tmp_path}/x.pdf", broken())
    assert os.listdir(tmp_path) == []
    assert files._write(f"{tmp_path}/x.pdf", [b"a", b"b"]) == (2, hashlib.sha256(b"ab").hexdigest()) and os.listdir(tmp_path) == ["x.pdf"]


def test_digest_of_a_file_over_two_gigabytes(spark, tmp_path):
    """A sparse file of 2.2 GB, which no reader of whole files can take."""
    size = 2_200_000_000
    with open(tmp_path / "big.bin", "wb") as f:
        f.truncate(size)
    (tmp_path / "small.bin").write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[-1]: (r.length, r.sha256) for r in files.digests(files.listing(spark, f"file://{tmp_path}")).collect()}
    want = hashlib.sha256()
    for _ in range(size // 1_000_000):
        want.update(bytes(1_000_000))
    assert got == {"big.bin": (size, want.hexdigest()), "small.bin": (1, hashlib.sha256(b"x").hexdigest())}


def test_rows_of_one_place_keep_one_name_each(spark):
    rows = [("a", "f.pdf", 1), ("a", "f.pdf", 2), ("b", "f__2.pdf", 1), ("a", "f.pdf", 2)]
    named = merge.bag_names(spark.createDataFrame(rows, "ident string, filename string, n int"), F.col("filename"), ["ident"])
    got = merge.resolve_clashes(named, "filename", "bag_name", ["ident"]).collect()
    assert len(got) == 4 and len({r.bag_name for r in got}) == 4


def test_identity_of_a_revision_is_the_older_ones(spark):
    rows = [(0, 1, 1, "http://old", "s1", "t1", 10), (0, 1, 2, "http://new", "s2", "t2", 20), (1, 1, 1, "http://old", "s1", "t1", 10), (1, 1, 2, "http://other", "s2", "t2", 20)]
    history = spark.createDataFrame(rows, "run_ord int, record_id int, id int, ident string, sha256 string, fetched_at string, bytes int")
    got = merge.revisions(history, ["run_ord", "record_id"], ["fetched_at", "id"], ["ident"], "sha256", ["run_ord", "fetched_at", "bytes"], ["bytes"])
    assert [tuple(r[c] for c in ("ident", "old_sha", "new_sha", "run_ord", "fetched_at", "bytes", "new_bytes")) for r in got.collect()] == [("http://old", "s1", "s2", 0, "t1", 10, 20)]


def test_links_of_a_page_are_resolved_once_each():
    absolute = markup.links.resolver("https://h.example/view/p/q")
    page = "<a href='../acc/alfresco/1/a.pdf'>A</a><a href='/view/acc/alfresco/1/a.pdf#x'>B</a><a href='//cdn.example/acc/alfresco/2/b c.pdf'></a>"
    assert markup.detail_of(page, absolute)["supplementary"] == [{"label": "A", "url": "https://h.example/view/acc/alfresco/1/a.pdf"}, {"label": "2", "url": "https://cdn.example/acc/alfresco/2/b%20c.pdf"}]
    many = "".join(f"<a href='/acc/alfresco/{i}/x'>l</a>" for i in range(20_000))
    assert len(markup.detail_of(many, absolute)["supplementary"]) == 20_000


def test_hidden_characters_show_as_codes(spark):
    values = ["Draft", "a\x00b", "n b", "z​w", "l x", "p\U000e0001q", "t\tn\n", "it's", 'both \' and "', "back\\slash", "é 😀"]
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    shown = [r[0] for r in frame.select(text.drift_flag(F.col("v"), ["Known"], "status")).collect()]
    assert shown == [f"status not in controlled vocabulary: {v!r}" for v in values]


def test_run_that_cannot_be_read(spark, tmp_path):
    from foliary import schema

    root = f"file://{tmp_path}/data"
    for n, run in enumerate(("20240101T000000Z__a", "20240201T000000Z__a")):
        schema.conform(spark.createDataFrame([(1, "pending", "pending")], "id bigint, meta_status string, download_status string"), schema.RECORD).write.parquet(f"{root}/{run}/records.parquet")
    part = next(tmp_path.glob("data/20240101*/records.parquet/part-*"))
    part.write_bytes(part.read_bytes()[:-20])
    listed = runs.listing(runs.catalog(spark, root), root)
    assert [(r.name, r.readable, r.total) for r in listed.collect()] == [("20240201T000000Z__a", True, 1), ("20240101T000000Z__a", False, 0)]
    assert runs.summaries(listed).where("name like '202401%'").first().summary == "20240101T000000Z__a  (unreadable database)"


def test_what_a_resumed_run_has_before_it(spark):
    rows = [("a", 1500, 1200, 200, 100, 1100, 7), ("b", 10, 10, 0, 0, 10, 0), ("c", 3, 2, 0, 1, 1, 0)]
    frame = spark.createDataFrame(rows, "run string, total bigint, meta_ok bigint, meta_pending bigint, meta_error bigint, download_done bigint, download_error bigint")
    got = {r.run: (r.complete, r.lines) for r in runs.resume_lines(frame).collect()}
    assert got["a"] == (False, ["Metadata:  1,200/1,500 resolved (200 to fetch, 100 skipped).", "Downloads: 1,100/1,200 PDFs done (7 to retry)."])
    assert got["b"] == (True, ["Nothing left to do: this run is complete."]) and got["c"] == (False, ["Metadata:  2/3 resolved (1 skipped).", "Downloads: 1/2 PDFs done."])
