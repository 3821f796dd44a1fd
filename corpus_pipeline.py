"""From raw documents to packed training sequences, in five stages; each is written and read again by the next.

quality: documents that score under 0.3 go. line_dedup: lines that an equal or nearly equal line precedes go, and documents
that lose all their text with them. near_duplicates: of documents that links of Jaccard similarity 0.8 on five-word shingles
join, the one with the least id stays. decontamination: documents of which a twentieth or more lies in 13-word windows of
benchmark items go, and from the others the runs of 13 or more such words. packing: what is left is cut and packed into sequences of 1024 ids.

Null and empty texts score as the classifier's bias, have no lines, link with nothing, hold no benchmark and are packed as the end
id alone. Texts are worked on whole, however long. Rows that repeat in id and text are one document; rows of one id that hold
other texts are documents of their own, and of linked ones the first by (id, hash of the text) stays. Rows without an id stay
and link nothing away. Ties go by id, then by hash, so results do not depend on the order of rows. An empty table gives no rows;
without labels every text scores 0.5, without benchmark items nothing is cut. Columns of documents may have any names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.llm import decontam, jaccard_join, line_dedup, packing, quality
from foliary.llm.common import Scratch, discarded, fresh, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from labelled documents whose crc32 of the id is no multiple of 5; null texts score as empty ones."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), lambda c: F.crc32(c.cast("string").cast("binary")) % 5 != 0)
    return quality.keep_good(docs, model, 0.3)


def deduped_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the text. Documents that were empty before, or null, stay."""
    lines = fresh(docs, "_lines")
    found = line_dedup.dedup(docs, Scratch(spark, "lines"), out=lines, distance=1, min_chars=16)
    removed = F.col(f"{lines}.n_removed")
    left = found.where((removed == 0) | F.col("text").rlike(r"\S"))
    return left.select(*[F.when(removed > 0, F.length("text").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts of fewer than five words are one shingle. Rows without an id stay."""
    return jaccard_join.keep_one(docs, Scratch(spark, "near"), size=5, num=80, den=100)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the text. Null texts stay null."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), length_col="n_chars" if "n_chars" in docs.columns else None, window=13, coverage=(1, 20))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece; other columns of documents are not carried on."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"), capacity=1024)


STAGES = [("quality", good_quality), ("line_dedup", deduped_lines), ("near_duplicates", one_of_near_duplicates), ("decontamination", without_benchmarks), ("packing", packed)]

#: A trained classifier, connected components and a tokenizer have no SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage's table and what the stage itself has staged go as soon as the next stage's table is written."""
    kept, docs, last = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with discarded():
            docs = kept.stage(stage(spark, docs, sf_dir), name)
        if last:
            kept.drop(last)
        last = name
    return STAGES[-1][1](spark, docs, sf_dir)
