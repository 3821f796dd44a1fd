"""Files of any file system that Spark knows: small ones by the driver, large ones by tasks."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager, suppress
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def at(spark: SparkSession, path: str):
    """The file system of a path, and the path as it takes it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = at(spark, path)
    return fs.exists(p)


def size(spark: SparkSession, path: str) -> int:
    fs, p = at(spark, path)
    return fs.getFileStatus(p).getLen()


def tail(spark: SparkSession, path: str, n: int) -> bytes:
    """The last n bytes of a file, or all of a shorter one."""
    fs, p = at(spark, path)
    length = fs.getFileStatus(p).getLen()
    source = fs.open(p)
    try:
        source.seek(max(0, length - n))
        return bytes(source.read() for _ in range(min(n, length)))
    finally:
        source.close()


_plain = 0


@contextmanager
def plain(spark: SparkSession, path: str) -> Iterator[None]:
    """Within it, a file system that would put a checksum file beside each file (the local one) writes the files alone."""
    global _plain
    fs, _ = at(spark, path)
    _plain += 1
    fs.setWriteChecksum(False)
    try:
        yield
    finally:
        _plain -= 1
        fs.setWriteChecksum(not _plain)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted."""
    fs, p = at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p))


def delete(spark: SparkSession, path: str) -> None:
    fs, p = at(spark, path)
    fs.delete(p, True)


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """Writes a small file beside its place, forces it out, and only then moves it there."""
    fs, p = at(spark, path)
    part = at(spark, f"{path}.{uuid.uuid4().hex}.part")[1]
    out = fs.create(part, True)
    try:
        out.write(bytearray(content))
        out.hsync()
    finally:
        out.close()
    _replace(fs, part, p)


def put_text(spark: SparkSession, path: str, value: str) -> None:
    put(spark, path, value.encode())


def _replace(fs, part, p) -> None:
    if not fs.rename(part, p):  # some file systems do not replace
        fs.delete(p, True)
        if not fs.rename(part, p):
            raise OSError(f"{part} cannot take the place of {p}")


def put_lines(lines: DataFrame, path: str) -> None:
    """Writes one text column as one file, in the order of its rows; a single task streams them through."""
    spark = lines.sparkSession
    made = f"{path}.{uuid.uuid4().hex}.parts"
    lines.coalesce(1).write.text(made)
    fs, p = at(spark, path)
    part = next((n for n in names(spark, made) if n.startswith("part-")), None)
    if part is None:
        put(spark, path, b"")
    else:
        fs.delete(p, True)
        _replace(fs, at(spark, f"{made}/{part}")[1], p)
    fs.delete(at(spark, made)[1], True)


def copy(spark: SparkSession, pairs: list[tuple[str, str]], threads: int = 16) -> None:
    """Copies files (from, to), several at a time, buffer by buffer; what is there is replaced only by a whole file."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def one(pair: tuple[str, str]) -> None:
        (fs, p), (to_fs, to) = at(spark, pair[0]), at(spark, pair[1])
        part = at(spark, f"{pair[1]}.{uuid.uuid4().hex}.part")[1]
        jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, to_fs, part, False, True, conf)
        _replace(to_fs, part, to)

    with ThreadPoolExecutor(threads) as pool:
        list(pool.map(one, pairs))


def content(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """path, name, length and content of the files under a folder, or under several; columns not asked for are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    found = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content")


def sweep(spark: SparkSession, folder: str) -> int:
    """Deletes the .part files that writers that were stopped have left in a folder; returns how many."""
    left = [n for n in names(spark, folder) if n.endswith(".part")]
    for n in left:
        delete(spark, f"{folder}/{n}")
    return len(left)


# ---- files that tasks read and write, a chunk at a time

CHUNK = 1 << 20


@lru_cache(maxsize=64)
def _store(scheme: str, host: str):
    return stores.LocalFileSystem() if scheme in ("", "file") else stores.FileSystem.from_uri(f"{scheme}://{host}/")[0]


def _task_path(path: str):
    """The file system of a path for a task, and the path in it. file:/x, file:///x and /x are one."""
    at = urlsplit(path.replace("#", "%23").replace("?", "%3F"))
    plain = at.path.replace("%23", "#").replace("%3F", "?")
    return _store(at.scheme, at.netloc), plain if at.scheme in ("", "file", "hdfs", "viewfs") else f"{at.netloc}{plain}"


def in_tasks(path: str) -> bool:
    """Whether tasks can open files there by themselves. What only Spark's readers know (viewfs, say) goes through the driver."""
    try:
        _task_path(path)
    except Exception:  # a scheme without a library
        return False
    return True


def _chunks(path: str) -> Iterator[bytes]:
    store, p = _task_path(path)
    with store.open_input_stream(p) as source:
        while chunk := source.read(CHUNK):
            yield chunk


def _write(target: str, chunks) -> tuple[int, str]:
    """Writes a file under a name of this attempt's own and moves it to its place when it is whole; its length and digest.

    An attempt that ends early leaves at most a .part file, which no reader takes for the file and `sweep` deletes; two attempts at
    one file both write it whole, and either may come last.
    """
    store, p = _task_path(target)
    part, size, digest = f"{p}.{uuid.uuid4().hex}.part", 0, hashlib.sha256()
    try:
        with store.open_output_stream(part) as out:
            for chunk in chunks:
                out.write(chunk)
                digest.update(chunk)
                size += len(chunk)
        store.move(part, p)
    except BaseException:
        with suppress(Exception):
            store.delete_file(part)
        raise
    return size, digest.hexdigest()


_DONE = "path string, length long, sha256 string"


def _each(rows: DataFrame, key: str, one) -> DataFrame:
    """one(row as columns) -> (path, length, sha256), dealt evenly to tasks by the key."""
    n = max(2, 4 * rows.sparkSession.sparkContext.defaultParallelism)

    def run(batches):
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                path, size, digest = one(*(x.as_py() for x in row))
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([digest])], names=["path", "length", "sha256"])

    return rows.repartition(n, F.xxhash64(key)).mapInArrow(run, _DONE)


def listing(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    """path, name and length of the files under a folder, or under several, without reading them."""
    return content(spark, path, pattern).select("path", "name", "length")


def digests(found: DataFrame, of: str = "path") -> DataFrame:
    """path, length and sha256 of listed files, read by tasks a chunk at a time, however long they are."""

    def one(path: str):
        size, digest = 0, hashlib.sha256()
        for chunk in _chunks(path):
            digest.update(chunk)
            size += len(chunk)
        return path, size, digest.hexdigest()

    return _each(found.select(of), of, one)


def copied(pairs: DataFrame) -> DataFrame:
    """Copies files by tasks. pairs: source, target. path, length and sha256 of each file written; a lazy frame, so stage it once."""
    return _each(pairs.select("source", "target"), "target", lambda source, target: (target, *_write(target, _chunks(source))))


def written(rows: DataFrame) -> DataFrame:
    """Writes bodies by tasks. rows: target, body. As `copied`."""
    return _each(rows.select("target", F.col("body").cast("binary")), "target", lambda target, body: (target, *_write(target, [body or b""])))
