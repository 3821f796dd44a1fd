"""WARC archives: writer and sequential reader (operator 3).

Writing: one gzip member per record. Of pages with equal payloads of at least `least` bytes, the one with the least id is a
response and the others are revisits that name it. Spark's own text sink commits the files, so a lost task leaves none
behind and any file system that Spark knows will do: a gzip member ends in the high byte of its length, which is 0 below
16 MiB, and that byte is written as the sink's separator. A longer record is followed by an empty member, which is.

Reading: each file is one pass with zlib's incremental decompressor. Records are framed by their content lengths, payloads are
hashed as they stream by and held only if they are asked for, and a record's `error` says what does not fit: a cut or
corrupt member, a length that is not met, a digest that differs. What follows a corrupt member in its file is not read.

A null payload is empty. A null id has no header and reads back as null; it is never what others refer to. Rows that
share the least id of a group are all responses. Null addresses have no header; others are percent-encoded where a
header cannot hold them, and may be of any length. An empty table makes archives without records. Files are closed when their
members reach `file_bytes`, so that a reader's task holds little more than that, however large pages are.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm.common import Scratch, spread_join

CHUNK = 1 << 16
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, error string"
_EMPTY = zlib.compressobj(9, zlib.DEFLATED, 31)
_EMPTY_MEMBER = _EMPTY.compress(b"") + _EMPTY.flush()


def _member(record: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = z.compress(record) + z.flush()
    return out if out[-1] == 0 else out + _EMPTY_MEMBER


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~' + chr(39), errors='replace')}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def write(
    pages: DataFrame, scratch: Scratch, label: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100, level: int = 3, file_bytes: int = 1 << 26, date: str = "1970-01-01T00:00:00Z",
) -> str:
    """Writes the archives and returns their folder. Equal payloads are found by digests alone; payloads meet only their own id's revisits."""
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).cast("binary").alias("p")).withColumn("digest", F.sha2("p", 256))
    digests = scratch.stage(rows.where(F.octet_length("p") >= least).select("id", "digest"), f"{label}-digests")
    equal = digests.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("c")).where("c > 1 and first is not null")
    equal = scratch.stage(equal, f"{label}-equal")
    revisits = scratch.stage(spread_join(digests, equal, "digest", "c").where("id is null or id > first").select("id", "digest", "first").distinct(), f"{label}-revisits")
    of = revisits.select(F.col("id").alias("of"), F.col("digest").alias("same"), F.col("first").alias("refers_to"))
    rows = rows.join(of, F.col("id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("same")), "left").select("id", "url", "p", "digest", "refers_to")

    def run(batches):
        volume, size = 0, 0
        for batch in batches:
            members, volumes = [], []
            for page_id, url, p, digest, refers_to in zip(*batch.columns, strict=True):
                record = record_bytes(page_id.as_py(), url.as_py(), p.as_py(), digest.as_py(), refers_to.as_py(), date)
                members.append(_member(record, level)[:-1])
                volumes.append(volume)
                size += len(members[-1]) + 1
                if size >= file_bytes:
                    volume, size = volume + 1, 0
            yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary()), pa.array(volumes, pa.int32())], names=["member", "volume"])

    path = scratch.path(label)
    made = rows.mapInArrow(run, "member binary, volume int").select(F.col("member").cast("string").alias("value"), "volume")
    made.write.mode("overwrite").option("lineSep", "\0").partitionBy("volume").text(path)
    scratch.drop(f"{label}-digests", f"{label}-equal", f"{label}-revisits")
    return path


class _Stream:
    """Bytes of one gzip member, decompressed a chunk at a time."""

    def __init__(self, data: memoryview, at: int) -> None:
        self.data, self.at, self.z, self.held = data, at, zlib.decompressobj(31), bytearray()

    def _more(self) -> bool:
        """Adds up to a chunk of decompressed bytes; False at the member's end."""
        if self.z.eof:
            return False
        fed = self.z.unconsumed_tail
        if not fed:
            fed = self.data[self.at : self.at + CHUNK]
            if not len(fed):
                raise ValueError("the member is cut")
            self.at += len(fed)
        self.held += self.z.decompress(fed, CHUNK)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to the mark and with it; None if the member holds no more bytes at all."""
        seen = 0
        while (k := self.held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.held)
            if not self._more():
                if self.held:
                    raise ValueError("a header has no end")
                return None
        out = bytes(self.held[: k + len(mark)])
        del self.held[: len(out)]
        return out

    def take(self, n: int):
        """The next n bytes, in chunks."""
        while n:
            if not self.held and not self._more():
                raise ValueError("the record is shorter than its content length")
            out = bytes(self.held[:n])
            del self.held[: len(out)]
            n -= len(out)
            if out:
                yield out

    def end(self) -> int:
        """Where the next member begins; nothing may be left of this one."""
        while self._more():
            pass
        if self.held:
            raise ValueError("the record is longer than its content length")
        return self.at - len(self.z.unused_data)


def _headers(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:] if line)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _number(x: str | None) -> int | None:
    return int(x) if x is not None and x.lstrip("-").isdigit() else None


def records(data: bytes | memoryview, with_payload: bool = False):
    """The records of one archive, in order: tuples as RECORD has them, and the payload or None."""
    data, at = memoryview(data), 0
    while at < len(data):
        h: dict[str, str] = {}
        size, digest, error, body = None, None, None, None
        try:
            stream = _Stream(data, at)
            head = stream.until(b"\r\n\r\n")
            if head is None:
                at = stream.end()
                continue
            h = _headers(head)
            if not head.startswith(b"WARC/1."):
                raise ValueError("the record has no version line")
            length = _number(h.get("content-length"))
            if length is None or length < 0:
                raise ValueError("the record has no content length")
            hashed, n, parts, before = hashlib.sha256(), 0, [], bytearray()
            in_payload = not h.get("content-type", "").startswith("application/http")
            for chunk in stream.take(length):
                if not in_payload:
                    before += chunk
                    k = before.find(b"\r\n\r\n")
                    if k < 0:
                        continue
                    in_payload, chunk = True, bytes(before[k + 4 :])
                hashed.update(chunk)
                n += len(chunk)
                if with_payload:
                    parts.append(chunk)
            if b"".join(stream.take(4)) != b"\r\n\r\n":
                raise ValueError("the record does not end in two line ends")
            at = stream.end()
            said = h.get("warc-payload-digest", "").removeprefix("sha256:")
            if h.get("warc-type") == "revisit":
                size, digest = _number(h.get("x-payload-length")), said
                if n:
                    error = "the revisit holds a payload"
            else:
                size, digest = n, hashed.hexdigest()
                body = b"".join(parts) if with_payload else None
                if said and said != digest:
                    error = "the digest differs"
                elif h.get("x-payload-length", str(n)) != str(n):
                    error = "the payload's length differs"
        except (ValueError, zlib.error) as e:
            error, at = str(e), len(data) if isinstance(e, zlib.error) or "cut" in str(e) else _next(data, at)
        yield _number(h.get("x-page-id")), h.get("warc-target-uri"), h.get("warc-type"), _number(h.get("x-refers-to-page-id")), size, digest, error, body


def _next(data: memoryview, at: int) -> int:
    """Where the member after the one at `at` begins."""
    stream = _Stream(data, at)
    try:
        while stream._more():
            stream.held.clear()
    except (ValueError, zlib.error):
        return len(data)
    return stream.at - len(stream.z.unused_data)


def read(spark, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives in a folder. Columns: RECORD, and with `with_payload` the payload."""
    schema = RECORD + (", payload binary" if with_payload else "")
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()][: 7 + with_payload]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        def batch_of(rows):
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for r in records(content.as_buffer(), with_payload):
                    rows.append(r[: len(names)])
                    held += len(r[7] or b"")
                    if len(rows) >= 5000 or held > 1 << 25:
                        yield batch_of(rows)
                        rows, held = [], 0
                yield batch_of(rows)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, schema)
