"""What several operators share: staged tables in the shared folder, row filters, hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import suppress
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.staging import Scratch, discarded, shared_dir

__all__ = ["Scratch", "bit_filter", "discarded", "fresh", "held_out", "portions", "shared_dir", "spread_join", "table", "tidy"]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(id_col: str, buckets: int, remainder: int):
    """Whether crc32 of the id as text falls in the remainder; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % buckets == remainder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bit_filter(rows: DataFrame, key, wanted: DataFrame, wanted_key: str, words: int = 1 << 16) -> DataFrame:
    """Rows whose key may be among wanted's, by a bitmap of 2**22 bits: at most 65,536 broadcast rows (`words`, up to 2**20), whatever the tables hold."""
    word = lambda h: F.pmod(h, F.lit(words))
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, 20), F.lit(64)).cast("int"))
    h = F.xxhash64(F.col(wanted_key))
    bits = wanted.groupBy(word(h).alias("_word")).agg(F.bit_or(bit(h)).alias("_bits"))
    mine = F.xxhash64(key)
    return rows.withColumn("_h", mine).join(F.broadcast(bits), word(F.col("_h")) == F.col("_word")).where(F.col("_bits").bitwiseAND(bit(F.col("_h"))) != 0).drop("_h", "_word", "_bits")


def spread_join(rows: DataFrame, keys: DataFrame, key: str | list[str], count: str) -> DataFrame:
    """rows joined to keys (one row per key, with the number of rows that have it), without a hot key.

    Keys that hold a ten-thousandth of the counted rows or more are at most ten thousand: these are broadcast, the others
    joined as the planner sees fit. rows are read twice, so they should be cheap to read.
    """
    total = keys.agg(F.sum(count)).first()[0] or 0
    common, rare = keys.where(F.col(count) * 10_000 >= total), keys.where(F.col(count) * 10_000 < total)
    return rows.join(F.broadcast(common), key).unionByName(rows.join(F.broadcast(common.select(*([key] if isinstance(key, str) else key))), key, "left_anti").join(rare, key))


def portions(texts: pa.Array, rows: int = 256, chars: int = 1_000_000) -> Iterator[list[str | None]]:
    """The texts as Python strings, few at a time."""
    held, size = [], 0
    for text in texts:
        held.append(text.as_py())
        size += len(held[-1] or "")
        if len(held) == rows or size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def tidy(run):
    """A task's generator that gives freed memory back to the system at its end: Python workers outlive tasks, and what they keep adds up."""

    @wraps(run)
    def whole(*args):
        try:
            yield from run(*args)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(AttributeError, OSError):  # other systems' libraries lack it
                ctypes.CDLL(None).malloc_trim(0)

    return whole
