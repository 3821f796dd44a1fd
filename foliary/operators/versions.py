"""Version history of documents: slowly changing rows, closed and opened by set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.schema import VERSION, conform


def backfill(records: DataFrame, history: DataFrame) -> DataFrame:
    """First versions for records that are done and have none; running it again adds nothing."""
    # a few columns of a large table look small to the planner, which would send them all through the driver
    lack = records.where("download_status = 'done' and sha256 is not null").join(history.select(F.col("record_id").alias("id")).hint("merge"), "id", "left_anti")
    first = lack.withColumn("record_id", F.col("id")).withColumn("fetched_at", F.col("pdf_retrieved_at")).withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    return conform(first, VERSION)


def recheck_action(same: Column, live_ok: Column, failed: Column) -> Column:
    """What a look at the source leads to: keep, heal (the live file is bad), supersede, or error."""
    return F.when(failed, "error").when(same & live_ok, "keep").when(same, "heal").otherwise("supersede")


def old_digest(live: Column, stored: Column, new: Column) -> Column:
    return F.coalesce(live, stored, new)


def superseded(history: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """The whole history after changes: (record_id, sha256, bytes, old_sha, archived, ...) close and open versions.

    Rows of other records pass unchanged. The file of a closed version is kept under its digest.
    """
    ch = changes.select(F.col("record_id").alias("_r"), F.col("old_sha").alias("_old")).hint("merge")  # as in backfill
    joined = history.join(ch, (F.col("record_id") == F.col("_r")) & F.col("superseded_at").isNull(), "left")
    hit = F.col("_r").isNotNull()
    closed = joined.select(*[
        F.when(hit, now).otherwise(F.col(c)).alias(c) if c == "superseded_at"
        else F.when(hit, F.coalesce("_old", "sha256")).otherwise(F.col(c)).alias(c) if c == "sha256"
        else F.when(hit, F.concat(F.lit("versions/"), F.coalesce("_old", "sha256"), F.lit(".pdf"))).otherwise(F.col(c)).alias(c) if c == "filename"
        else F.col(c) for c in history.columns
    ])
    opened = conform(changes.withColumn("fetched_at", now), VERSION)
    return closed.unionByName(opened, allowMissingColumns=True)


def current(history: DataFrame) -> DataFrame:
    return history.where("superseded_at is null")


def superseded_count(history: DataFrame) -> DataFrame:
    return history.agg(F.count_if(F.col("superseded_at").isNotNull()).alias("n"))


def archived_names(history: DataFrame) -> DataFrame:
    """Last path components of the files of superseded versions."""
    old = history.where("superseded_at is not null and coalesce(filename, '') <> ''")
    return old.select(F.element_at(F.split("filename", "/"), -1).alias("name")).distinct()


def verified_and_gaps(names: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Archived files whose content has the digest that is their name, and names that no run can show verified.

    files: name, and sha256 or else content (binary).
    """
    digest = F.col("sha256") if "sha256" in files.columns else F.sha2("content", 256)
    good = files.join(names, "name", "left_semi").where(digest == F.substring_index("name", ".", 1)).select("name").distinct()
    return good, names.join(good, "name", "left_anti")
