from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from foliary import files, staging


def session(master, folder=None):
    conf = SimpleNamespace(get=lambda key, default=None: folder if key == "spark.checkpoint.dir" else default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda key, default=None: default)))


def test_a_cluster_needs_a_shared_folder():
    assert staging.shared_dir(session("spark://h:7077", "hdfs://n/c/")) == "hdfs://n/c"
    assert staging.shared_dir(session("local[4]")).startswith("file://")
    for master in ("spark://h:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
            staging.shared_dir(session(master))


def test_staged_tables_go(spark):
    outer = staging.Scratch(spark, "outer")
    kept = outer.stage(spark.range(5), "kept")
    with staging.discarded():
        inner = staging.Scratch(spark, "inner")
        inner.stage(spark.range(3), "x")
        assert files.exists(spark, inner.path("x"))
    assert not files.exists(spark, inner.root) and kept.count() == 5
    outer.drop("kept")
    assert not files.exists(spark, outer.path("kept")) and files.exists(spark, outer.root)


def test_files(spark, tmp_path):
    at = f"file://{tmp_path}"
    files.put_text(spark, f"{at}/a.txt", "é")
    files.put_text(spark, f"{at}/a.txt", "é2")
    assert open(f"{tmp_path}/a.txt", encoding="utf-8").read() == "é2" and files.size(spark, f"{at}/a.txt") == 3
    lines = spark.range(0, 1000, 1, 7).orderBy(F.desc("id")).select(F.col("id").cast("string").alias("value"))
    files.put_lines(lines, f"{at}/lines.txt")
    assert open(f"{tmp_path}/lines.txt").read().split() == [str(n) for n in range(999, -1, -1)]
    files.put_lines(lines.where("false"), f"{at}/none.txt")
    assert files.size(spark, f"{at}/none.txt") == 0
    files.copy(spark, [(f"{at}/a.txt", f"{at}/b.txt")])
    open(f"{tmp_path}/c.part", "w").close()
    assert files.sweep(spark, at) == 1 and [n for n in files.names(spark, at) if not n.startswith(".")] == ["a.txt", "b.txt", "lines.txt", "none.txt"]
