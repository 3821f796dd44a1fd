"""Tables that stay between runs: Parquet dealt into buckets by a hash of the key, so that a change rewrites only the buckets of its keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from foliary import files, schema
from foliary.operators import versions
from foliary.staging import Scratch, discarded

BUCKET = "key_bucket"


class Keyed:
    """A table in a folder, partitioned by a hash of its key. The number of buckets is fixed when it is made.

    A bucket should hold as much as a task can; one of 100 TB has some hundred thousand. Readers of a key and writers of
    changes read the buckets of those keys alone.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, kind: StructType, buckets: int = 64) -> None:
        self.spark, self.path, self.key, self.kind, self.buckets = spark, path, key, kind, buckets

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(F.col(self.key).cast(self.kind[self.key].dataType)), F.lit(self.buckets)).cast("int"))

    def _all(self) -> DataFrame:
        kind = StructType([*self.kind.fields, StructField(BUCKET, IntegerType())])
        return self.spark.read.schema(kind).parquet(self.path) if files.exists(self.spark, self.path) else self.spark.createDataFrame([], kind)

    def read(self) -> DataFrame:
        return self._all().drop(BUCKET)

    def touched(self, changes: DataFrame) -> list[int]:
        """The buckets of the changes' keys: at most as many numbers as there are buckets."""
        return sorted(r[0] for r in self._bucketed(changes).select(BUCKET).distinct().collect())

    def change(self, changes: DataFrame, merged: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Puts merged(old rows, changes) in the place of the rows of the buckets that the changes touch; returns those buckets.

        The new rows are staged whole before any old file goes, and the writer moves its files into place when all tasks have
        ended, so a task or an executor that is lost loses nothing. Writers take turns: two at a time would undo each other.
        """
        with discarded():
            held = Scratch(self.spark, "change")
            changes = held.stage(changes, "changes")
            mine = self.touched(changes)
            if mine:
                old = self._all().where(F.col(BUCKET).isin(mine)).drop(BUCKET)
                new = held.stage(self._bucketed(schema.conform(merged(old, changes), self.kind)), "new")
                # each bucket in one file: rows of a bucket come to one task
                new.repartition(len(mine), BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        return mine


def version_log(spark: SparkSession, path: str, buckets: int = 64) -> Keyed:
    return Keyed(spark, path, "record_id", schema.VERSION, buckets)


def record_first(log: Keyed, records: DataFrame) -> list[int]:
    """First versions of records that are done and have none; again, it changes nothing."""
    due = records.where("download_status = 'done' and sha256 is not null").withColumn("record_id", F.col("id"))
    return log.change(due, lambda old, rows: old.unionByName(versions.backfill(rows, old), allowMissingColumns=True))


def supersede(log: Keyed, changes: DataFrame, now: Column) -> list[int]:
    """Closes the open versions of the changed records and opens the next. changes: as versions.superseded; given twice, one record's change counts once."""
    once = changes.dropDuplicates(["record_id"])
    return log.change(once, lambda old, rows: versions.superseded(old, rows, now))


def upsert_records(table: Keyed, batch: DataFrame) -> list[int]:
    """Records whose key the table lacks, the first of each; what is known keeps its progress. Only the batch's buckets are read."""
    from foliary.operators import ingest

    return table.change(batch, lambda known, rows: ingest.upsert_ignore(known, rows, table.key, ["id"]))
