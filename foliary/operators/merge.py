"""Merging collection runs: latest rows, conflicts, revisions, order and unique names. Rows carry run_ord and id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliary.functions.text import blank_to_null


def _stamp(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def latest_wins(rows: DataFrame, ident: str, recency: list[str], tie: list[str]) -> DataFrame:
    """The latest row of each identity by the recency columns; among equals the first by `tie`, which are numbers.

    A null stamp is as old as an empty one. Also first_seen: the identity's least tie values over all of its rows, the key
    of a stable order. Rows are combined before they are shuffled, so an identity with very many rows is no hot key.
    """
    text = {f.name for f in rows.schema if f.dataType.typeName() == "string"}
    order = F.struct(*[(_stamp(c) if c in text else F.col(c)).alias(f"r{k}") for k, c in enumerate(recency)], *[(-F.col(c)).alias(f"t{k}") for k, c in enumerate(tie)])
    best = rows.groupBy(ident).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), order).alias("_best"), F.min(F.struct(*tie)).alias("first_seen"))
    return best.select("_best.*", "first_seen")


def merged_order(winners: DataFrame) -> list[Column]:
    """Order of the merged corpus: citation, then id, then who was seen first."""
    return [_stamp("neutral_citation"), _stamp("document_uuid"), F.col("first_seen")]


def content_conflicts(rows: DataFrame, ident: list[str], sha: str, run: str, run_ord: str) -> DataFrame:
    """Identities with more than one content; shas, and of each sha the last run that showed it, sorted."""
    last = rows.where(F.coalesce(F.col(sha), F.lit("")) != "").groupBy(*ident, sha).agg(F.max_by(run, run_ord).alias("_run"))
    return last.groupBy(*ident).agg(F.sort_array(F.collect_set(sha)).alias("shas"), F.sort_array(F.collect_set("_run")).alias("runs")).where(F.size("shas") > 1)


def revisions(history: DataFrame, part: list[str], order: list[str], ident: list[str], sha: str, keep: list[str], newer: list[str] = ()) -> DataFrame:
    """Pairs of consecutive versions; a pair of contents counts once for an identity, where it is first seen.

    Identity and the columns to keep are the older version's, whose document it was; columns of `newer` are the newer one's, as new_<column>.
    """
    w = Window.partitionBy(*part).orderBy(*order)
    cells = list(dict.fromkeys([*ident, *keep, *part, *order]))
    rows = history.select(F.lag(F.struct(*cells, F.col(sha).alias("old_sha"))).over(w).alias("_old"), F.col(sha).alias("new_sha"), *[F.col(c).alias(f"new_{c}") for c in newer])
    pairs = rows.where("_old.old_sha is not null").select("_old.*", "new_sha", *[f"new_{c}" for c in newer])
    first = Window.partitionBy(*ident, "old_sha", "new_sha").orderBy(*part, *order)
    return pairs.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*dict.fromkeys([*ident, "old_sha", "new_sha", *keep, *[f"new_{c}" for c in newer]]))


def first_seen_union(rows: DataFrame, by: list[str], values: str, order: list[Column]) -> DataFrame:
    """Distinct elements of the arrays of a group, in the order in which they are first seen."""
    each = rows.select(*by, F.struct(*order).alias("_o"), F.posexplode(values).alias("_p", "_v"))
    once = each.groupBy(*by, "_v").agg(F.min(F.struct("_o", "_p")).alias("_at"))
    return once.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_v"))), lambda x: x["_v"]).alias(values))


def first_known(rows: DataFrame, by: list[str], value: str, order: list[Column]) -> DataFrame:
    """Of each group the first value that is not null."""
    return rows.groupBy(*by).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias(value))


def suffixed(rows: DataFrame, stem: Column, order: list, shape, out: str) -> DataFrame:
    """Names made unique: the nth row of a stem (n > 1) takes shape(stem, n)."""
    n = F.row_number().over(Window.partitionBy("_stem").orderBy(*order))
    rows = rows.withColumn("_stem", stem).withColumn("_k", n)
    return rows.withColumn(out, F.when(F.col("_k") > 1, shape(F.col("_stem"), F.col("_k"))).otherwise(F.col("_stem"))).drop("_stem", "_k")


def file_names(rows: DataFrame, stem: Column, order: list[str], out: str = "filename", taken: DataFrame | None = None) -> DataFrame:
    """stem.pdf, or the first of stem_2.pdf, stem_3.pdf, ... that no row before has and that is not in `taken` (a column of names).

    A null stem has no name.
    """
    rows = rows.withColumn("_name", F.concat(stem, F.lit(".pdf")))
    some = rows.where("_name is not null")
    shape = lambda s, n: F.concat(F.substring(s, F.lit(1), F.length(s) - 4), F.lit("_"), n.cast("string"), F.lit(".pdf"))
    made = resolve_clashes(suffixed(some, F.col("_name"), order, shape, out), "_name", out, order, "_", taken)
    return made.unionByName(rows.where("_name is null").withColumn(out, F.lit(None).cast("string"))).drop("_name")


def bag_names(rows: DataFrame, name: Column, order: list, out: str = "bag_name") -> DataFrame:
    """name.ext, name__2.ext, ...: the suffix goes before the first dot.

    A made name may be another's own: resolve_clashes deals the names of such stems again.
    """
    def shape(s: Column, n: Column) -> Column:
        head = F.substring_index(s, ".", 1)
        return F.concat(head, F.lit("__"), n.cast("string"), F.substring(s, F.length(head) + 1, F.length(s)))

    return suffixed(rows, name, order, shape, out)


def clashing(named: DataFrame, out: str, taken: DataFrame | None = None) -> DataFrame:
    """Made names that are not unique, or taken: they need a sequential pass."""
    twice = named.groupBy(out).count().where("count > 1").select(out)
    if taken is None:
        return twice
    return twice.union(named.select(out).join(taken.toDF(out), out, "left_semi")).distinct()


def resolve_clashes(named: DataFrame, name: str, out: str, order: list[str], mark: str = "__", taken: DataFrame | None = None) -> DataFrame:
    """Deals the names of whole families (a name's part before its first dot, without numbers after `mark`) that hold a clash again, in order.

    Families without one are untouched; the others go through one sequential pass each, which holds names and places alone.
    """
    def family(c: str) -> Column:
        return F.regexp_replace(F.substring_index(F.col(c), ".", 1), f"({mark}[0-9]+)+$", "")

    used = None if taken is None else taken.toDF("used").where("used is not null").distinct()
    marked = named.withColumn("_f", family(name)).withColumn("_row", F.struct(*order)).withColumn("_all", F.struct(*[F.col(f"`{c}`") for c in named.columns]))
    bad = clashing(marked.select(out), out, used).select(family(out).alias("_f")).distinct()
    # rows of equal place are told apart by all that they hold; rows that are equal in all may take each other's names
    place = F.row_number().over(Window.partitionBy("_f").orderBy("_row", *[F.col(f"_all.`{c}`") for c in named.columns]))
    numbered = marked.join(bad, "_f", "left_semi").withColumn("_key", place).drop("_row", "_all")
    fine = marked.join(bad, "_f", "left_anti").drop("_f", "_row", "_all")

    def deal(mine, theirs):
        seen = set(theirs["used"])
        made, after = [], {}
        mine = mine.sort_values("_key", kind="stable")
        for s in mine["_own"]:
            head, dot, tail = s.partition(".")
            new, k = s, after.get(s, 1)
            while new in seen:
                k += 1
                new = f"{head}{mark}{k}{dot}{tail}"
            after[s] = k
            seen.add(new)
            made.append(new)
        return mine.assign(_new=made)[["_f", "_key", "_new"]]

    others = (used if used is not None else named.sparkSession.createDataFrame([], "used string")).withColumn("_f", family("used")).join(bad, "_f", "left_semi")
    dealt = numbered.select("_f", "_key", F.col(name).alias("_own")).groupBy("_f").cogroup(others.groupBy("_f")).applyInPandas(deal, "_f string, _key int, _new string")
    again = numbered.join(dealt, ["_f", "_key"]).select(*[F.col("_new").alias(c) if c == out else F.col(f"`{c}`") for c in named.columns])
    return fine.unionByName(again)


def coverage(rows: DataFrame, date: str) -> DataFrame:
    return rows.agg(F.count("*").alias("record_count"), F.min(date).alias("date_min"), F.max(date).alias("date_max"))


def identity(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ident", F.coalesce(blank_to_null(F.col("document_uuid")), F.col("pdf_url")))
