"""Idempotent ingest, work queues and status transitions over append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliary.operators.scans import Running, running


def first_of(rows: DataFrame, key: str, order: list) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def new_rows(batch: DataFrame, known: DataFrame, key: str, order: list) -> DataFrame:
    """Rows of a batch whose key the table lacks, the first of each; what is known keeps its progress."""
    return first_of(batch.join(known.select(key), key, "left_anti"), key, order)


def upsert_ignore(known: DataFrame, batch: DataFrame, key: str, order: list) -> DataFrame:
    return known.unionByName(new_rows(batch, known, key, order), allowMissingColumns=True)


def metadata_queue(records: DataFrame) -> DataFrame:
    return records.where("meta_status = 'pending'").orderBy("id")


def download_queue(records: DataFrame, limit: int | None = None) -> DataFrame:
    queue = records.where(F.col("meta_status").eqNullSafe("ok") & F.col("download_status").isin("pending", "error")).orderBy("id")
    return queue if limit is None else queue.limit(limit)


def revalidation_targets(rows: DataFrame, due: Column, stamp: str, cutoff: Column | None, tie: str) -> DataFrame:
    """Rows due for another look, never looked at first, then the longest ago."""
    old = F.lit(True) if cutoff is None else F.col(stamp).isNull() | (F.col(stamp) < cutoff)
    return rows.where(due & old).orderBy(F.col(stamp).asc_nulls_first(), tie)


def status_counts(rows: DataFrame, conditions: dict[str, Column], by: list[str] = ()) -> DataFrame:
    """All counters in one pass."""
    return rows.groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in conditions.items()])


def record_counts(records: DataFrame, by: list[str] = ()) -> DataFrame:
    of = lambda col, s: F.col(col) == s
    names = {f"meta_{s}": of("meta_status", s) for s in ("pending", "ok", "error")} | {f"download_{s}": of("download_status", s) for s in ("pending", "done", "error")}
    return status_counts(records, names, by)


def count_where(rows: DataFrame, column: str, value: str, allowed=("meta_status", "download_status")) -> DataFrame:
    if column not in allowed:
        raise ValueError(f"counting by {column} is not allowed; one of {', '.join(allowed)}")
    return rows.where(F.col(column) == value).agg(F.count("*").alias("n"))


def apply_transitions(records: DataFrame, log: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The records after an append-only log of transitions: each column takes its last logged value.

    The log has, for each column, a struct of its new value (`set_<column>`), null where a transition leaves it.
    """
    last = log.groupBy(F.col(key).alias("_k")).agg(*[F.max_by(F.col(f"set_{c}"), F.when(F.col(f"set_{c}").isNotNull(), F.struct(*order))).alias(f"_{c}") for c in columns])
    joined = records.join(last, records[key] == last["_k"], "left")
    return joined.select(*[F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}.value")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in records.columns])


def transition(rows: DataFrame, key: str, at: Column, changes: dict[str, Column], all_columns: list[str], types: dict[str, str]) -> DataFrame:
    """Rows of a transition log: what changes is set, the rest is left."""
    cells = [F.struct(changes[c].cast(types[c]).alias("value")).alias(f"set_{c}") if c in changes else F.lit(None).cast(f"struct<value:{types[c]}>").alias(f"set_{c}") for c in all_columns]
    return rows.select(key, at.alias("at"), *cells)


def complete(counts: DataFrame) -> DataFrame:
    """The two notions of a finished run, under names of their own, and its errors."""
    return counts.withColumns({
        "catalog_complete": (F.col("total") > 0) & (F.col("download_done") >= F.col("total")),
        "queues_empty": (F.col("meta_pending") == 0) & (F.col("download_done") >= F.col("meta_ok")),
        "errors": F.col("meta_error") + F.col("download_error"),
    })


def listing_verdicts(passes: DataFrame, run: str, order: str, covered: str, available: str) -> DataFrame:
    """Each pass's coverage so far, and whether it falls short of the number of pages known today."""
    out = running(passes, [run], [order], {"pages_covered": Running("max", F.col(covered)), "pages_known": Running("last", F.col(available))})
    return out.withColumn("truncated", F.coalesce(F.col("pages_covered") < F.col("pages_known"), F.lit(False)))


def snapshot_verdict(runs: DataFrame) -> DataFrame:
    """all_verified, and any_truncated among those that are verified; runs has complete and truncated, null if unknown."""
    verified = F.coalesce(F.col("complete"), F.lit(False))
    return runs.agg(F.coalesce(F.bool_and(verified), F.lit(True)).alias("all_verified"), F.coalesce(F.bool_or(verified & F.coalesce(F.col("truncated"), F.lit(False))), F.lit(False)).alias("any_truncated"))
