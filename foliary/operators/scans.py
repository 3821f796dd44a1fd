"""Running values over long ordered groups, each group spread over many tasks."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliary.staging import Scratch


class Running(NamedTuple):
    """What is carried along a group: how is "sum", "max" or "last" (of the values that are not null).

    before leaves the row itself out. Rows whose order ties have the same sum, max and last of all of them, if before is not set.
    """

    how: str
    value: Column
    before: bool = False


def previous(value: Column) -> Running:
    """The value of the row before, null or not, as field `value` of a struct; the struct is null on a group's first row."""
    return Running("last", F.struct(value.alias("value")), before=True)


def running(rows: DataFrame, by: list[str], order: list[str], values: dict[str, Running], segments: int | None = None) -> DataFrame:
    """The rows with a column for each running value, as a window over (by, order) has them.

    Rows are ranged by (by, order) into segments and written, so that a lost executor finds the same segments again. A segment's total
    for a group is one row; the totals before it become the head of the segment, a row that goes first and is dropped at the end. So no
    task sorts more than a segment, however long a group is, and a group costs one small row for each segment that it lies in. Rows that
    tie in all of (by, order) lie in one segment, so the order should tell rows apart. Null keys are a group, null orders come first.
    An empty table gives no rows. A column of the rows that has the name of a running value is replaced by it.
    """
    spark, names = rows.sparkSession, [c for c in rows.columns if c not in values]
    scratch = Scratch(spark, "scan")
    n = segments or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = {f"_scan_{i}": r.value for i, r in enumerate(values.values())}
    ranged = rows.select(*[F.col(f"`{c}`") for c in rows.columns], *[v.alias(c) for c, v in cells.items()]).select(*[F.col(f"`{c}`") for c in names], *cells)
    ranged = ranged.repartitionByRange(n, *[F.col(f"`{c}`") for c in (*by, *order)]).withColumn("_scan_segment", F.spark_partition_id())
    ranged = scratch.stage(ranged, "ranged")

    keys, at = [F.col(f"`{c}`") for c in by], F.struct(*[F.col(f"`{c}`") for c in order])
    total = {"sum": F.sum, "max": F.max, "last": lambda x: F.max_by(x, F.when(F.col(x).isNotNull(), at))}
    earlier = Window.partitionBy(*keys).orderBy("_scan_segment").rowsBetween(Window.unboundedPreceding, -1)
    over = {"sum": F.sum, "max": F.max, "last": lambda x: F.last(x, ignorenulls=True)}
    kinds = dict(zip(cells, (r.how for r in values.values()), strict=True))
    totals = ranged.groupBy(*keys, "_scan_segment").agg(*[total[how](c).alias(c) for c, how in kinds.items()])
    heads = totals.select(*keys, "_scan_segment", *[over[how](c).over(earlier).alias(c) for c, how in kinds.items()], F.lit(0).alias("_scan_row"))

    both = ranged.withColumn("_scan_row", F.lit(1)).unionByName(heads, allowMissingColumns=True)
    within = Window.partitionBy(*keys, "_scan_segment").orderBy("_scan_row", *[F.col(f"`{c}`") for c in order])
    made = [over[r.how](c).over(within.rowsBetween(Window.unboundedPreceding, -1) if r.before else within).alias(name) for (name, r), c in zip(values.items(), cells, strict=True)]
    return both.select(*[F.col(f"`{c}`") for c in names], "_scan_row", *made).where("_scan_row = 1").drop("_scan_row")
