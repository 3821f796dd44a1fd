"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from foliary import files


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="foliary-")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir. Only a local session may do without; its own folder is used then."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not named and master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir is not set: on {master} it must name a folder that the driver and all executors share")
    return (named or _own_dir()).rstrip("/")


_open: list[Scratch] = []


class Scratch:
    """Tables written under one folder of the shared directory, so that a lost executor costs no lineage.

    The folder goes with the session's JVM, or with the `discarded` block in which it was made.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/foliary-{name}-{uuid.uuid4().hex}"
        fs, root = files.at(spark, self.root)
        fs.mkdirs(root)
        fs.deleteOnExit(root)
        _open.append(self)

    def path(self, label: str) -> str:
        return f"{self.root}/{label}"

    def stage(self, df: DataFrame, label: str) -> DataFrame:
        """Writes df and returns the table read back; its size on disk is then known to the planner."""
        df.write.mode("overwrite").parquet(self.path(label))
        return self.spark.read.schema(df.schema).parquet(self.path(label))

    def drop(self, *labels: str) -> None:
        """Deletes staged tables that no later step reads."""
        for label in labels:
            files.delete(self.spark, self.path(label))

    def close(self) -> None:
        files.delete(self.spark, self.root)
        _open.remove(self)


@contextmanager
def discarded() -> Iterator[None]:
    """Deletes at its end what was staged by Scratch objects made within it; what is to be read later must be written before."""
    before = set(map(id, _open))
    try:
        yield
    finally:
        for scratch in [s for s in _open if id(s) not in before]:
            scratch.close()
