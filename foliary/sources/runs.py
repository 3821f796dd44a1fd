"""The archive as a catalog of runs: each is a folder with records, history and a manifest. Nothing here writes."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary import files, schema
from foliary.operators import ingest


def names(spark: SparkSession, root: str) -> list[str]:
    """Folders of root that hold records, newest name first; none if root is missing."""
    if not files.exists(spark, root):
        return []
    return [n for n in reversed(files.names(spark, root)) if files.exists(spark, f"{root}/{n}/records.parquet")]


def latest(spark: SparkSession, root: str) -> str | None:
    return next(iter(names(spark, root)), None)


def _named(rows: DataFrame, chosen: list[str]) -> DataFrame:
    """Rows with run and run_ord (0 for the oldest) by the file they come from."""
    run = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -3)
    ords = F.create_map(*[F.lit(x) for k, r in enumerate(chosen) for x in (r, k)])
    return rows.select("*", F.url_decode(run).alias("run")).withColumn("run_ord", ords[F.col("run")])


def records(spark: SparkSession, root: str, runs: list[str] | None = None) -> DataFrame:
    """All runs' records with run and run_ord; columns that an older run lacks are null. One scan, however many runs there are."""
    chosen = sorted(names(spark, root) if runs is None else runs)
    paths = [f"{root}/{run}/records.parquet" for run in chosen]
    if missing := [p for p in paths if not files.exists(spark, p)]:
        raise FileNotFoundError(missing[0])
    if not paths:
        return spark.createDataFrame([], schema.RECORD).withColumns({"run": F.lit("").cast("string"), "run_ord": F.lit(0)})
    return _named(spark.read.schema(schema.RECORD).parquet(*paths), chosen)


def history(spark: SparkSession, root: str, run: str | list[str]) -> DataFrame:
    """Versions of a run, by record and time, or of several with run and run_ord, in no order.

    None where a run has no such table. Of a damaged file what comes before the damage is kept, and the rest passed over.
    """
    chosen = [run] if isinstance(run, str) else sorted(run)
    paths = [p for r in chosen if files.exists(spark, p := f"{root}/{r}/versions.parquet")]
    if not paths:
        none = spark.createDataFrame([], schema.VERSION)
        return none if isinstance(run, str) else none.withColumn("run", F.lit("")).withColumn("run_ord", F.lit(0))
    rows = spark.read.option("ignoreCorruptFiles", "true").schema(schema.VERSION).parquet(*paths)
    return rows.orderBy("record_id", "fetched_at", "id") if isinstance(run, str) else _named(rows, chosen)


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """run and its manifest; a missing, broken or non-object manifest is a row of nulls."""
    runs = names(spark, root)
    listed = spark.createDataFrame([(r,) for r in runs], "run string")
    paths = [f"{root}/{r}/manifest.json" for r in runs if files.exists(spark, f"{root}/{r}/manifest.json")]
    if not paths:
        return listed.withColumn("manifest", F.lit(None).cast(f"struct<{_typed(schema.MANIFEST)}>"))
    text = spark.read.text(paths, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("run"), F.from_json("value", schema.MANIFEST).alias("manifest"))
    return listed.join(text, "run", "left")


def _typed(ddl: str) -> str:
    return ",".join(part.replace(" ", ":", 1) for part in ddl.split(", "))


def run_config(spark: SparkSession, root: str, run: str) -> dict:
    """A manifest that must be there, as for going on with a run."""
    row = manifests(spark, root).where(F.col("run") == run).select("manifest.*").first()
    if row is None or row["base_url"] is None:
        raise FileNotFoundError(f"{root}/{run}/manifest.json")
    return row.asDict(recursive=True)


def readable(spark: SparkSession, root: str) -> list[str]:
    """The runs whose files of records are whole: each ends as such a file must. Their few last bytes are read, no more."""

    def whole(folder: str) -> bool:
        parts = [n for n in files.names(spark, folder) if n.endswith(".parquet")]
        try:
            return bool(parts) and all(files.tail(spark, f"{folder}/{n}", 4) == b"PAR1" for n in parts)
        except Py4JJavaError:  # its file system says that a file is damaged
            return False

    return [r for r in names(spark, root) if whole(f"{root}/{r}/records.parquet")]


def catalog(spark: SparkSession, root: str) -> DataFrame:
    """Runs with their counters, both notions of completeness, and what their manifests say; a run that cannot be read has no counts."""
    good = readable(spark, root)
    counts = ingest.complete(ingest.record_counts(records(spark, root, good), ["run"]))
    listing = "manifest.listing"
    told = manifests(spark, root).select("run", "manifest.created", "manifest.courts", f"{listing}.complete", f"{listing}.truncated", f"{listing}.pages_fetched", f"{listing}.pages_available")
    pages = F.when(F.col("pages_fetched").isNull(), "unverified").when(F.col("truncated"), F.concat("pages_fetched", F.lit(" of "), "pages_available", F.lit(" pages"))).otherwise(F.concat("pages_fetched", F.lit(" pages")))
    # a run whose table holds no rows is one, too
    return told.join(counts, "run", "left").na.fill(0, [x for x in counts.columns if x != "run"]).na.fill(False, ["catalog_complete"]).withColumn("readable", F.col("run").isin(good) if good else F.lit(False)).withColumn("pages_text", pages).orderBy(F.desc("run"))


def listing(runs: DataFrame, root: str) -> DataFrame:
    """The catalog as `runs` prints it: thirteen columns, newest run first. A listing counts only if it was verified."""
    verified = F.coalesce(F.col("complete"), F.lit(False))
    return runs.select(
        F.col("run").alias("name"), F.coalesce("courts", F.array().cast("array<string>")).alias("courts"), "created", "total", F.col("download_done").alias("done"), F.col("errors").alias("error"),
        "readable", F.col("catalog_complete").alias("complete"), verified.alias("listing_verified"), (verified & F.coalesce("truncated", F.lit(False))).alias("listing_truncated"),
        F.when(verified, F.col("pages_fetched")).alias("pages_fetched"), F.when(verified, F.col("pages_available")).alias("pages_available"), F.concat(F.lit(f"{root}/"), "run").alias("path"),
    ).orderBy(F.desc("name"))


def summaries(listed: DataFrame) -> DataFrame:
    """name and one line about each run of a listing."""
    span = F.when(F.col("pages_fetched").isNotNull() & F.col("pages_available").isNotNull(), F.format_string(" at %d of %d pages", "pages_fetched", "pages_available")).otherwise("")
    parts = F.array_compact(F.array(F.format_string("%d/%d downloaded", "done", "total"), F.when(F.col("error") > 0, F.format_string("%d error(s)", "error")), F.when(F.col("listing_truncated"), "listing truncated")))
    said = F.when(~F.col("readable"), "unreadable database").when(F.col("complete") & F.col("listing_truncated"), F.concat(F.lit("downloads complete; listing truncated"), span)).when(F.col("complete"), F.format_string("complete, %d PDFs", "total")).otherwise(F.array_join(parts, ", "))
    return listed.select("name", F.concat(F.col("name"), F.lit("  ("), said, F.lit(")")).alias("summary"))


def sources(spark: SparkSession, root: str, chosen: list[str]) -> DataFrame:
    """Of each run what is known of its listing: verified, and only then truncated and the counts of pages."""
    told = manifests(spark, root).where(F.col("run").isin(chosen)).select("run", "manifest.listing.*")
    verified = F.coalesce(F.col("complete"), F.lit(False))
    when = lambda c: F.when(verified, c)
    return told.select("run", verified.alias("verified"), when(F.coalesce("truncated", F.lit(False))).alias("truncated"), when(F.col("pages_fetched")).alias("pages_fetched"), when(F.col("pages_available")).alias("pages_available")).orderBy("run")


def matching(runs: DataFrame, courts: list[str]) -> DataFrame:
    """Runs of just these courts, in whatever order."""
    return runs.where(F.array_sort(F.array_distinct("courts")) == F.array(*map(F.lit, sorted(set(courts)))))


def resumable(runs: DataFrame) -> DataFrame:
    return runs.where((F.col("total") > 0) & ~F.col("catalog_complete"))


def canonical(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("catalog_complete") & ~F.coalesce("truncated", F.lit(False)))


def selected(spark: SparkSession, root: str, explicit: list[str] | None = None, chosen: list[str] | None = None) -> list[str]:
    """Runs to merge: the explicit ones, else the chosen, else all; each must be there."""
    there = names(spark, root)
    want = explicit or chosen or there
    if missing := sorted(set(want) - set(there)):
        raise ValueError(f"no such run: {', '.join(missing)}")
    return [r for r in there if r in set(want)]


def fresh_requests(pages: Column, results: Column, first_rows: Column, downloads: bool = True) -> Column:
    """Requests of a new crawl: each page of the listing, and for each result its page and its file. An unknown number of results counts as the first page's."""
    return pages + 2 * F.coalesce(results, first_rows) if downloads else pages


def resume_lines(runs: DataFrame) -> DataFrame:
    """What going on with a run has before it: whether nothing is left, and the lines that say how far metadata and downloads are."""
    n = lambda c: F.format_number(F.col(c), 0)
    some = lambda c, words: F.when(F.col(c) > 0, F.concat(n(c), F.lit(words)))

    def line(head: str, done: str, of: str, words: str, extras: list[Column]) -> Column:
        told = F.array_join(F.array_compact(F.array(*extras)), ", ")
        return F.concat(F.lit(head), n(done), F.lit("/"), n(of), F.lit(words), F.when(told != "", F.concat(F.lit(" ("), told, F.lit(")"))).otherwise(""), F.lit("."))

    metadata = line("Metadata:  ", "meta_ok", "total", " resolved", [some("meta_pending", " to fetch"), some("meta_error", " skipped")])
    downloads = line("Downloads: ", "download_done", "meta_ok", " PDFs done", [some("download_error", " to retry")])
    nothing = (F.col("meta_pending") == 0) & (F.col("download_done") >= F.col("meta_ok"))
    return runs.select("run", nothing.alias("complete"), F.when(nothing, F.array(F.lit("Nothing left to do: this run is complete."))).otherwise(F.array(metadata, downloads)).alias("lines"))


def status(spark: SparkSession, root: str, run: str) -> dict:
    """The seven counters of one run and its name."""
    return {**ingest.record_counts(records(spark, root, [run])).first().asDict(), "run": run}
