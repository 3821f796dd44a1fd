import gzip
import hashlib
import zlib

import pytest

from foliary.llm import warc
from foliary.llm.common import Scratch


def one(payload=b"x" * 200, page_id=1, refers_to=None, url="http://a/é b\r\nX: y"):
    digest = hashlib.sha256(payload).hexdigest()
    return warc._member(warc.record_bytes(page_id, url, payload, digest, refers_to, "1970-01-01T00:00:00Z"), 6)


def expected(rows):
    first = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if len(p) >= 100 and i is not None:
            first[p] = min(first.get(p, i), i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        f = first.get(p)
        ref = f if len(p) >= 100 and f is not None and i != f else None
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "response" if ref is None else "revisit", ref))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = [(i, f"http://h/{i}", "é" * (i % 70) * 3) for i in range(300)]
    rows += [(400, None, None), (401, "", ""), (402, "u", "y" * 99), (403, "u", "y" * 99), (404, "a\nb c\0", "z\0\r\n\r\n" * 50), (None, "n", "é" * 60), (405, "big", "q" * 300_000), (7, "again", "é" * 21), (406, "W", "WARC/1.1\r\n\r\n" * 20), (406, "W", "WARC/1.1\r\n\r\n" * 20)]
    frame = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    scratch = Scratch(spark, "t")
    path = warc.write(frame, scratch, "a", file_bytes=3000)
    got = warc.read(spark, path, with_payload=True).collect()
    assert all(r.error is None for r in got)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows)
    assert sorted(bytes(r.payload) for r in got if r.record_type == "response" and r.page_id != 406)[-1] == b"\xc3\xa9" * 207
    files = [r.path for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").collect()]
    assert len(files) > 3
    for f in files:  # ordinary gzip tools read the archives
        gzip.decompress(open(f.removeprefix("file:"), "rb").read())


def test_empty(spark):
    frame = spark.createDataFrame([], "page_id long, url string, html string")
    scratch = Scratch(spark, "t")
    assert warc.read(spark, warc.write(frame, scratch, "a")).count() == 0


def test_damage():
    good, other = one(), one(b"y" * 150, 2)
    assert [r[6] for r in warc.records(good + other)] == [None, None]
    wrong = warc._member(warc.record_bytes(3, None, b"abc", hashlib.sha256(b"abd").hexdigest(), None, "d"), 6)
    assert [(r[0], r[6]) for r in warc.records(wrong + other)] == [(3, "the digest differs"), (2, None)]
    assert [r[6] for r in warc.records(good + other[:-20])] == [None, "the member is cut"]
    bad = bytearray(good)
    bad[len(bad) // 2] ^= 0xFF
    assert next(warc.records(bytes(bad)))[6] is not None
    raw = zlib.decompress(good, 31)
    for change in (raw[:-4], raw + b"!", raw.replace(b"Content-Length: 2", b"Content-Length: 9", 1)[:400], b"no headers"):
        found = list(warc.records(warc._member(change, 6) + other))
        assert found[0][6] is not None and found[-1][0] == 2 and found[-1][6] is None
    assert list(warc.records(b"")) == []


def test_revisit_and_long_records():
    r = next(warc.records(one(b"p" * 500, 9, refers_to=4)))
    assert (r[0], r[2], r[3], r[4]) == (9, "revisit", 4, 500)
    big = one(b"\0" * (1 << 24), 5)
    assert big[-1] == 0
    assert [(r[0], r[4], r[6]) for r in warc.records(big + one())] == [(5, 1 << 24, None), (1, 200, None)]


@pytest.mark.parametrize("cut", range(0, 400, 37))
def test_any_cut_is_noticed(cut):
    data = one(bytes(range(256)) * 3)
    found = list(warc.records(data[:cut]))
    assert len(data) > 400 and (not found if cut == 0 else found[-1][6] is not None)


def test_long_addresses_and_files_by_bytes(spark):
    import random

    rng = random.Random(1)
    noise = lambda n: "".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(n))
    rows = [(1, "http://h/" + "p" * 1_200_000, "é" * 90), (2, "http://h/" + "é" * 300_000, "é" * 90), *((10 + i, None, noise(20_000)) for i in range(12))]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = warc.write(frame, Scratch(spark, "t"), "a", file_bytes=100_000)
    got = {r.page_id: r for r in warc.read(spark, path).collect()}
    assert all(r.error is None for r in got.values()) and len(got) == 14 and got[2].refers_to == 1 and got[1].url == rows[0][1]
    sizes = [r.length for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("length").collect()]
    assert len(sizes) > 4 and max(sizes) < 200_000


def test_query(spark):
    from foliary.llm import queries

    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    got = queries.op3_warc(spark, "/root/testdata/sf0.001").collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows)
