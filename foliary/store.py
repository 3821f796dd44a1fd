"""The store of fetched files: verified bodies are published whole, superseded ones are kept under their digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary import files
from foliary.functions import names, transfer
from foliary.staging import Scratch, discarded


def judged(bodies: DataFrame) -> DataFrame:
    """bodies (filename, body, content_length, content_encoding) with verdict, sha256 and size; an unsafe name is no verdict but one."""
    safe = names.is_safe_name(F.col("filename"))
    verdict = F.when(~safe, "unsafe").otherwise(transfer.body_verdict(F.col("body"), F.col("content_length"), F.col("content_encoding")))
    ok = verdict == "ok"
    return bodies.withColumn("verdict", verdict).withColumn("sha256", F.when(ok, F.sha2("body", 256))).withColumn("bytes", F.when(ok, F.octet_length("body").cast("bigint")))


def live(spark: SparkSession, folder: str) -> DataFrame:
    """filename and live_sha of the files of a folder, read by tasks a chunk at a time."""
    if not files.exists(spark, folder):
        return spark.createDataFrame([], "filename string, live_sha string")
    own = F.regexp_replace("path", "/[^/]*$", "").endswith("/" + folder.rstrip("/").rsplit("/", 1)[-1])
    if not files.in_tasks(folder):
        return files.content(spark, folder).where(own).select(F.col("name").alias("filename"), F.sha2("content", 256).alias("live_sha"))
    return files.digests(files.listing(spark, folder).where(own)).select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("sha256").alias("live_sha"))


def _kept(spark: SparkSession, folder: str) -> DataFrame:
    if not files.exists(spark, folder):
        return spark.createDataFrame([], "name string")
    return files.listing(spark, folder).select("name")


def keep_superseded(spark: SparkSession, folder: str, decisions: DataFrame) -> int:
    """Copies the live files of changed documents to versions/<digest>.pdf, where that is not there yet; returns how many.

    decisions: filename, action, old_sha. A file is kept under the digest of its own bytes, so a name never lies. Tasks copy.
    """
    old = live(spark, folder).join(decisions.where("action = 'supersede'").select("filename").distinct(), "filename", "left_semi")
    once = old.groupBy(F.concat("live_sha", F.lit(".pdf")).alias("name")).agg(F.min("filename").alias("filename")).join(_kept(spark, f"{folder}/versions"), "name", "left_anti")
    return copy_files(spark, f"{folder}/versions", once.select(F.concat(F.lit(f"{folder}/"), "filename").alias("source"), "name"))


def copy_files(spark: SparkSession, folder: str, pairs: DataFrame) -> int:
    """Copies files (source, name) into a folder, by tasks; returns how many. No byte and no name passes through the driver.

    Where only Spark's own readers know the file systems, the driver's JVM copies, buffer by buffer.
    """
    fs, p = files.at(spark, folder)
    fs.mkdirs(p)
    first = pairs.select("source").first()
    if first is None:
        return 0
    with discarded():
        wanted = Scratch(spark, "copy").stage(pairs.select("source", F.concat(F.lit(f"{folder}/"), "name").alias("target")), "pairs")
        if files.in_tasks(folder) and files.in_tasks(first.source):
            n = Scratch(spark, "copied").stage(files.copied(wanted), "files").count()
        else:
            n, batch = 0, []
            for row in wanted.toLocalIterator():
                batch.append(tuple(row))
                if len(batch) == 1000:
                    files.copy(spark, batch)
                    n, batch = n + len(batch), []
            files.copy(spark, batch)
            n += len(batch)
    files.sweep(spark, folder)
    return n


def publish(spark: SparkSession, folder: str, bodies: DataFrame) -> int:
    """Puts the bodies that are ok under their names, each at once when it is whole; returns how many. Tasks write them."""
    fs, p = files.at(spark, folder)
    fs.mkdirs(p)
    good = judged(bodies).where("verdict = 'ok'")
    if files.in_tasks(folder):
        with discarded():
            n = Scratch(spark, "publish").stage(files.written(good.select(F.concat(F.lit(f"{folder}/"), "filename").alias("target"), "body")), "files").count()
    else:
        n = 0
        for row in good.select("filename", "body").toLocalIterator():
            files.put(spark, f"{folder}/{row.filename}", bytes(row.body))
            n += 1
    files.sweep(spark, folder)
    return n
