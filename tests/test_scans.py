import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliary.operators import progress
from foliary.operators.scans import Running, previous, running

ROWS = "run string, at int, id int, x int, s string, reached string"


def some_rows(n, seed):
    """One run holds most rows; keys, orders and values may be null; orders tie until id tells them apart."""
    rng = random.Random(seed)
    maybe = lambda v: None if rng.random() < 0.2 else v
    return [(maybe("hot" if rng.random() < 0.8 else f"r{rng.randrange(5)}"), maybe(rng.randrange(n // 2)), i, maybe(rng.randrange(-50, 50)), maybe(rng.choice("abc")), "old") for i in range(n)]


def test_running_values_equal_the_windows(spark):
    rows = spark.createDataFrame(some_rows(3000, 5), ROWS)
    w = Window.partitionBy("run").orderBy("at", "id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    want = rows.drop("reached").withColumns({
        "total": F.sum("x").over(w), "total_before": F.sum("x").over(before), "top": F.max("x").over(w), "said": F.last("s", ignorenulls=True).over(w), "said_before": F.last("s", ignorenulls=True).over(before),
        "x_before": F.lag("x").over(w), "reached": F.count("x").over(w),
    })
    values = {
        "total": Running("sum", F.col("x")), "total_before": Running("sum", F.col("x"), True), "top": Running("max", F.col("x")), "said": Running("last", F.col("s")), "said_before": Running("last", F.col("s"), True), "x_before": previous(F.col("x")),
        "reached": Running("sum", F.when(F.col("x").isNotNull(), 1).otherwise(0)),
    }
    for segments in (1, 3, 16):
        got = running(rows, ["run"], ["at", "id"], values, segments).withColumn("x_before", F.col("x_before.value"))
        assert sorted(got.columns) == sorted(want.columns)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())), segments


def test_ties_and_no_rows(spark):
    rows = spark.createDataFrame([("a", 1, 1), ("a", 1, 1), ("a", 2, 5)], "run string, at int, x int")
    got = running(rows, ["run"], ["at"], {"n": Running("sum", F.col("x"))}, 4)
    assert sorted(map(tuple, got.collect())) == [("a", 1, 1, 2), ("a", 1, 1, 2), ("a", 2, 5, 7)]
    assert running(rows.where("false"), ["run"], ["at"], {"n": Running("sum", F.col("x"))}).collect() == []


def test_one_long_run_lies_in_many_tasks(spark):
    """The window's tasks get parts of the one run; its own key alone places only the heads, a row for each segment."""
    rows = spark.range(200_000).select(F.lit("only").alias("run"), F.col("id").alias("at"), (F.col("id") % 3 == 0).alias("bad"))
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        got = running(rows, ["run"], ["at"], {"n": Running("sum", F.when(F.col("bad"), 1).otherwise(0))}, 16)
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set(name, before)
    assert sum(sizes) == 200_000 and max(sizes) < 150_000 and len(sizes) > 1 and got.where("n <> floor(at / 3) + 1").count() == 0
    placed = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning(" in line]
    assert "_scan_segment" in placed[0] and sum("_scan_segment" not in line for line in placed) == 1
    assert progress.milestones(rows, ["run"], ["at"], F.col("bad"), 500).count() == 66_667 // 500
    assert progress.outages(rows.withColumn("bad", F.col("at") >= 150_000), ["run"], ["at"], F.col("bad")).first().pauses == 50_000 // 3
