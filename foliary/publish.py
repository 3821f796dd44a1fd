"""Publishing: derived tables, CSV, JSON and Parquet packages, descriptors, fixity manifests and archives."""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary import files, schema, store
from foliary.functions import text
from foliary.functions.names import is_safe_name
from foliary.operators import merge, versions
from foliary.sources import runs
from foliary.staging import Scratch, discarded

FORMATS = ("csv", "json", "parquet")
RIGHTS_NOTE = "Documents may hold personal data or be under reporting restrictions; check before passing them on."
# Archive formats and what else they are called.
ARCHIVES = {"zip": "zip", "tar": "tar", "tar.gz": "gztar", "tgz": "gztar", "tar.bz2": "bztar", "tbz2": "bztar", "tar.xz": "xztar", "txz": "xztar", "gztar": "gztar", "bztar": "bztar", "xztar": "xztar"}


def derived(records: DataFrame) -> DataFrame:
    """The published columns of raw records; the records themselves stay as they are."""
    return _derived(records, [])


def _derived(records: DataFrame, more: list) -> DataFrame:
    c, members = F.col, text.panel(F.col("composition"))
    status, result = text.blank_to_null(c("status_field")), text.blank_to_null(c("result"))
    flags = F.filter(F.array(text.drift_flag(status, schema.STATUS_VOCABULARY, "status"), text.drift_flag(result, schema.RESULT_VOCABULARY, "result")), lambda x: x.isNotNull())
    made = {
        "authoring_judge": F.coalesce("judge", F.lit("")), "panel": F.array_join(members, "; "), "panel_count": F.size(members).cast("long"), "status": status, "result": result,
        "status_in_vocab": text.in_vocabulary(status, schema.STATUS_VOCABULARY), "result_in_vocab": text.in_vocabulary(result, schema.RESULT_VOCABULARY), "vocab_flags": F.array_join(flags, "; "),
    }
    return records.select(*[(made[f.name] if f.name in made else c(f.name)).alias(f.name) for f in schema.EXPORT_FIELDS], *more)


def nested(records: DataFrame) -> DataFrame:
    """As derived, with the panel as an array and, where there is a detail page, its fields and links."""
    meta = F.from_json(text.blank_to_null(F.col("meta_json")), schema.META_JSON)
    more = [text.panel(F.col("composition")).alias("_panel"), meta["fields"].alias("metadata_fields"), meta["supplementary"].alias("supplementary")]
    flat = _derived(records, more)
    return flat.select(*[F.col("_panel").alias("panel") if f.name == "panel" else F.col(f.name) for f in schema.EXPORT_FIELDS], "metadata_fields", "supplementary")


def checked_formats(formats: list[str]) -> list[str]:
    """The formats once each in their order; an unknown one is an error before anything is read."""
    if bad := [f for f in formats if f not in FORMATS]:
        raise ValueError(f"unknown formats: {', '.join(bad)}; known are {', '.join(FORMATS)}")
    return list(dict.fromkeys(formats))


def write_csv(rows: DataFrame, path: str) -> None:
    kinds = {f.name: f.type for f in schema.EXPORT_FIELDS}
    cells = rows.select(*[text.csv_cell(F.col(c), kinds.get(c, "string")).alias(c) for c in rows.columns])
    cells.write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="", nullValue="")


def write_json(rows: DataFrame, path: str) -> None:
    """JSON lines, in as many files as there are tasks."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def json_document(rows: DataFrame, path: str, most: int = 100_000, each: int = 10_000) -> None:
    """One indented JSON array in one file, in the order of the rows; a task streams them through.

    More than `most` rows become a folder of such files instead, as CSV and Parquet are: each holds an array of at most `each` rows,
    and the names of the files have the rows' order. No task reads or writes more than its part of the rows.
    """
    files.delete(rows.sparkSession, path)
    if rows.count() > most:
        _json_folder(rows, path, each)
        return

    def shown(batches):
        first = True
        for batch in batches:
            lines = []
            for j in batch.column(0).to_pylist():
                item = json.dumps(json.loads(j), ensure_ascii=False, indent=2).replace("\n", "\n  ")
                lines.append(("[\n  " if first else "  ") + item + ",")
                first = False
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])

    def closed(batches):
        held = None
        for batch in batches:
            for line in batch.column(0).to_pylist():
                if held is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([held])], names=["value"])
                held = line
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if held is None else held[:-1] + "\n]"], pa.string())], names=["value"])

    one = rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).coalesce(1)
    files.put_lines(one.mapInArrow(shown, "value string").mapInArrow(closed, "value string"), path)
    if not files.size(rows.sparkSession, path):  # a table without partitions has no task
        files.put_text(rows.sparkSession, path, "[]\n")


def _json_folder(rows: DataFrame, path: str, each: int) -> None:
    def arrays(batches):
        held = []
        out = lambda: pa.RecordBatch.from_arrays([pa.array(["[\n  " + ",\n  ".join(held) + "\n]"])], names=["value"])
        for batch in batches:
            for j in batch.column(0).to_pylist():
                held.append(json.dumps(json.loads(j), ensure_ascii=False, indent=2).replace("\n", "\n  "))
                if len(held) == each:
                    yield out()
                    held = []
        if held:
            yield out()

    lines = rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j"))
    lines.mapInArrow(arrays, "value string").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def resource(formats: list[str]) -> tuple[str, str, str]:
    """path, format and media type of the first of csv, json, parquet that was written."""
    kind = next((f for f in FORMATS if f in formats), "csv")
    return f"documents.{kind}", kind, {"csv": "text/csv", "json": "application/json", "parquet": "application/vnd.apache.parquet"}[kind]


def descriptor(rows: DataFrame, formats: list[str], base_url: str | None = None, courts: list[str] | None = None, extra: dict | None = None) -> dict:
    """The package's descriptor. Keys of extra take the place of its own."""
    path, kind, media = resource(formats)
    cover = merge.coverage(rows, "date_delivered").first()
    return {
        "name": "documents", "title": "Documents", "profile": "tabular-data-package", "created": _now(), "tool": {"name": "foliary", "version": schema.VERSION_OF_TOOL}, "schema_version": schema.SCHEMA_VERSION,
        "derive_version": schema.DERIVE_VERSION, "courts": courts or [],
        "coverage": {"record_count": cover.record_count, "date_delivered_min": cover.date_min, "date_delivered_max": cover.date_max},
        "licenses": [{"title": "As the source states", "path": base_url}] if base_url else [], "rights_note": RIGHTS_NOTE,
        "sources": [{"title": "Source", "path": base_url}] if base_url else [],
        "resources": [{"name": "documents", "path": path, "profile": "tabular-data-resource", "format": kind, "mediatype": media, "encoding": "utf-8", "schema": schema.table_schema()}],
    } | (extra or {})


def _now() -> str:
    return datetime.now(UTC).isoformat()


def _json(value) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False, default=str)


def write_package(records: DataFrame, out: str, formats: list[str], **about) -> dict:
    """Tables in each format, the descriptor and the dictionary under the folder `out`.

    Formats are checked before anything is read. The records are staged once, in their order, and each format is written
    from there; what they were read from is read once.
    """
    formats = checked_formats(formats)
    spark = records.sparkSession
    with discarded(), files.plain(spark, out):
        staged = Scratch(spark, "package")
        ordered = records.withColumn("_at", F.monotonically_increasing_id())
        kept = staged.stage(ordered, "records").orderBy("_at").drop("_at")
        rows = derived(kept)
        for f in formats:
            path = f"{out}/documents.{f}"
            if f == "csv":
                write_csv(rows, path)
            elif f == "json":
                json_document(nested(kept), path)
            else:
                rows.write.mode("overwrite").parquet(path)
        told = descriptor(rows, formats, **about)
        files.put_text(spark, f"{out}/datapackage.json", _json(told))
        files.put_text(spark, f"{out}/dictionary.md", schema.dictionary())
    return {"record_count": told["coverage"]["record_count"], "out_dir": out, "files": files.names(spark, out), "formats": formats}


def export(spark: SparkSession, root: str, run: str, out: str, formats: list[str]) -> dict:
    formats = checked_formats(formats)
    told = runs.manifests(spark, root).where(F.col("run") == run).select("manifest.base_url", "manifest.courts").first()
    return write_package(runs.records(spark, root, [run]).orderBy("id"), out, formats, base_url=told and told.base_url, courts=told and told.courts)


def fixity(found: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, sha256 and length of each file, by path."""
    return found.select(path, F.sha2(content, 256).alias("sha256"), F.octet_length(content).cast("long").alias("length")).orderBy(path)


def payload_oxum(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.concat(F.coalesce(F.sum("length"), F.lit(0)).cast("string"), F.lit("."), F.count("*").cast("string")).alias("oxum"))


def _below(path: Column, folder: str) -> Column:
    """A file's path from the folder's last component on, without it."""
    return F.regexp_extract(path, rf"^.*?/{re.escape(folder.rstrip('/').rsplit('/', 1)[-1])}/(data/.*)$", 1)


def write_bag(spark: SparkSession, bag: str, about: dict[str, str] | None = None) -> dict:
    """Declaration, payload manifest, info and tag manifest over bag/data, written last. Tasks hash the files and write the manifest."""
    with discarded():
        decoded = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
        if files.in_tasks(bag):
            found = files.digests(files.listing(spark, f"{bag}/data")).select(_below(decoded("path"), bag).alias("path"), "sha256", "length")
        else:
            found = fixity(files.content(spark, f"{bag}/data").select(_below(decoded("path"), bag).alias("path"), "content"))
        made = Scratch(spark, "bag").stage(found, "fixity").orderBy("path")
        files.put_lines(made.select(F.concat("sha256", F.lit("  "), "path").alias("value")), f"{bag}/manifest-sha256.txt")
        oxum = payload_oxum(made).first().oxum
    info = {"Source-Organization": "foliary", "Bagging-Date": datetime.now(UTC).date().isoformat(), "Bag-Software-Agent": f"foliary {schema.VERSION_OF_TOOL}", "External-Description": "Documents corpus"} | (about or {}) | {"Payload-Oxum": oxum}
    files.put_text(spark, f"{bag}/bagit.txt", "BagIt-Version: 1.0\nTag-File-Character-Encoding: UTF-8\n")
    files.put_text(spark, f"{bag}/bag-info.txt", "".join(f"{k}: {v}\n" for k, v in info.items()))
    tags = ["bag-info.txt", "bagit.txt", "manifest-sha256.txt"]
    sums = spark.read.format("binaryFile").load([f"{bag}/{t}" for t in tags]).select(F.element_at(F.split("path", "/"), -1).alias("path"), F.sha2("content", 256).alias("sha256")).orderBy("path").collect()
    files.put_text(spark, f"{bag}/tagmanifest-sha256.txt", "".join(f"{r.sha256}  {r.path}\n" for r in sums))
    return {"files": int(oxum.split(".")[1]), "oxum": oxum}


def archive_format(name: str) -> str:
    key = name.strip().lower().lstrip(".")
    if key not in ARCHIVES:
        raise ValueError(f"unknown archive format {name!r}; known are {', '.join(ARCHIVES)}")
    return ARCHIVES[key]


def archive(bag: str, kind: str) -> tuple[str, str]:
    """The bag, in a local folder, as one archive beside it with a .sha256 file; its path and digest."""
    kind, bag = archive_format(kind), bag.removeprefix("file://")
    if "://" in bag:
        raise ValueError(f"archives are made of local folders only: {bag}")
    made = shutil.make_archive(bag, kind, os.path.dirname(os.path.abspath(bag)), os.path.basename(bag))
    digest = hashlib.sha256()
    with open(made, "rb") as f:
        while chunk := f.read(1 << 16):
            digest.update(chunk)
    with open(f"{made}.sha256", "w") as f:
        f.write(f"{digest.hexdigest()}  {os.path.basename(made)}\n")
    return made, digest.hexdigest()


def merged(records: DataFrame) -> DataFrame:
    """The latest row of each document over all runs, in order, with the names that the files of downloaded ones take in a bag."""
    rows = merge.identity(records)
    winners = merge.latest_wins(rows, "ident", ["pdf_retrieved_at", "meta_retrieved_at", "listed_at"], ["run_ord", "id"])
    order = [x.alias(f"_o{k}") for k, x in enumerate(merge.merged_order(winners))]
    named = winners.where((F.col("download_status") == "done") & text.blank_to_null(F.col("filename")).isNotNull()).select("ident", "filename", *order)
    keys = [f"_o{k}" for k in range(len(order))]
    named = merge.resolve_clashes(merge.bag_names(named, F.col("filename"), keys), "filename", "bag_name", keys)
    return winners.join(named.select("ident", "bag_name"), "ident", "left").orderBy(*merge.merged_order(winners))


#: What an entry says of the older version, by the name that the snapshot has for it, and of the newer one.
OLDER = {"document_uuid": "document_uuid", "pdf_url": "pdf_url", "neutral_citation": "neutral_citation", "old_sha256": "old_sha", "old_bytes": "bytes", "old_fetched_at": "fetched_at", "old_filename": "filename"}
NEWER = {"new_sha256": "new_sha", "new_bytes": "new_bytes", "detected_at": "superseded_at", "run": "run"}
SCAN = ["run_ord", "record_id", "fetched_at", "id"]


def revision_pairs(history: DataFrame) -> DataFrame:
    """Every revision in the versions of runs, with what an entry says of it and the columns of the scan."""
    told = [c for c in (*OLDER.values(), *NEWER.values()) if c not in ("old_sha", "new_sha", "new_bytes")]
    return merge.revisions(merge.identity(history), SCAN[:2], SCAN[2:], ["ident"], "sha256", [*told, *SCAN], ["bytes"])


def revision_scan(pairs: DataFrame, scan: list[str], sample: int) -> DataFrame:
    """A bounded sample of revisions: the first in the order of the scan, then by citation, document and when they were detected."""
    return pairs.orderBy(*scan).limit(sample).orderBy(*[F.coalesce(c, F.lit("")) for c in ("neutral_citation", "document_uuid", "superseded_at")])


def revision_entries(pairs: DataFrame, sample: int) -> DataFrame:
    """The sample as the snapshot lists it."""
    return revision_scan(pairs, SCAN, sample).select(*[F.col(c).alias(name) for name, c in (OLDER | NEWER).items()])


def corpus(spark: SparkSession, root: str, out: str, formats: list[str], explicit: list[str] | None = None, archive_as: str | None = None, sample: int = 1000) -> dict:
    """One deduplicated package of many runs: tables, conflicts, revisions, snapshot, the files and their fixity.

    Files that are wanted but missing, unsafe or not what their name says are left out; the result counts them, and data/missing-files.txt
    and data/unverified-versions.txt name them. data/conflicts.json holds every conflict, the snapshot the first `sample`.
    """
    formats = checked_formats(formats)
    if archive_as:
        archive_format(archive_as)
    chosen = sorted(runs.selected(spark, root, explicit))
    if not chosen:
        raise ValueError("there are no runs to merge")
    files.delete(spark, f"{out}/data")
    with discarded(), files.plain(spark, out):
        scratch = Scratch(spark, "corpus")
        records = runs.records(spark, root, chosen)
        winners = scratch.stage(merged(records).withColumn("_at", F.monotonically_increasing_id()), "winners").orderBy("_at")
        conflicts = scratch.stage(merge.content_conflicts(merge.identity(records), ["ident"], "sha256", "run", "run_ord"), "conflicts").orderBy("ident")
        history = runs.history(spark, root, chosen)
        pairs = scratch.stage(revision_pairs(history), "pairs")
        n_revisions, n_conflicts = pairs.count(), conflicts.count()
        entries = [r.asDict() for r in revision_entries(pairs, sample).collect()]
        told = conflicts.select(F.col("ident").alias("document_uuid"), F.col("shas").alias("sha256s"), "runs")
        json_document(told, f"{out}/data/conflicts.json")
        listed = [r.asDict() for r in told.limit(sample).collect()]
        verdict = merge_verdict(runs.manifests(spark, root).where(F.col("run").isin(chosen)))
        by_run = {r.run: r.asDict() for r in runs.sources(spark, root, chosen).collect()}
        snapshot = {
            "created": _now(), "tool_version": schema.VERSION_OF_TOOL, "schema_version": schema.SCHEMA_VERSION, "derive_version": schema.DERIVE_VERSION, "source_runs": chosen, "listing": verdict | {"sources": by_run},
            "record_count": winners.count(), "conflict_count": n_conflicts, "conflicts": listed, "conflicts_truncated": n_conflicts > sample, "conflicts_file": "conflicts.json",
            "revisions": {"count": n_revisions, "truncated": n_revisions > len(entries), "entries": entries},
        }
        told = runs.manifests(spark, root).where(F.col("run").isin(chosen)).select(F.lit(0).alias("all"), "run", "manifest.base_url", "manifest.courts")
        base = merge.first_known(told, ["all"], "base_url", [F.col("run")]).first()
        courts = merge.first_seen_union(told.where("courts is not null"), ["all"], "courts", [F.col("run")]).first()
        package = winners.withColumn("filename", F.coalesce("bag_name", "filename"))
        result = write_package(package, f"{out}/data", formats, base_url=base and base.base_url, courts=courts.courts if courts else [], extra={"snapshot": snapshot})
        missing = _copy_current(spark, root, out, winners, chosen, scratch)
        unverified = _copy_superseded(spark, root, out, history, chosen, scratch)
        cover = merge.coverage(winners, "date_delivered").first()
        files.put_text(spark, f"{out}/data/snapshot.json", _json(snapshot))
        files.put_text(spark, f"{out}/data/dataset.jsonld", _json(dataset(cover, formats, base and base.base_url)))
        files.put_text(spark, f"{out}/data/datasheet.md", datasheet(cover, chosen, n_conflicts, missing, unverified))
        bag = write_bag(spark, out)
    made, digest = archive(out, archive_as) if archive_as else (None, None)
    return {
        "record_count": result["record_count"], "run_count": len(chosen), "out_dir": out, "conflicts": n_conflicts, "revisions": n_revisions, "missing_files": missing, "unverified_versions": unverified,
        "oxum": bag["oxum"], "archive": made, "archive_sha256": digest,
    }


def merge_verdict(manifests: DataFrame) -> dict:
    from foliary.operators.ingest import snapshot_verdict

    return snapshot_verdict(manifests.select("manifest.listing.complete", "manifest.listing.truncated")).first().asDict()


def _run_files(spark: SparkSession, root: str, chosen: list[str]) -> DataFrame:
    """path, name, run of the document files of runs; old marks superseded ones. None is read."""
    found = files.listing(spark, [f"{root}/{r}" for r in chosen], "*.pdf")
    where = F.regexp_extract("path", rf"/{re.escape(root.rstrip('/').rsplit('/', 1)[-1])}/([^/]+)/", 1)
    return found.withColumn("run", where).withColumn("old", F.element_at(F.split("path", "/"), -2) == "versions")


def wanted_files(winners: DataFrame, there: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is to be copied (path, bag_name), and the names of what is wanted but unsafe or not there. there: run, name, path."""
    wanted = winners.where("bag_name is not null").select("run", F.col("filename").alias("name"), "bag_name", (is_safe_name(F.col("filename")) & is_safe_name(F.col("bag_name"))).alias("safe"))
    met = wanted.where("safe").join(there.select("run", "name", "path"), ["run", "name"])
    lost = wanted.where("safe").join(there, ["run", "name"], "left_anti").select("name").union(wanted.where("not safe").select("name"))
    return met.select("path", "bag_name"), lost


def _listed(scratch: Scratch, lost: DataFrame, path: str) -> int:
    """Writes names as lines of a file, sorted, by a task; how many there are."""
    kept = scratch.stage(lost, path.rsplit("/", 1)[-1])
    files.put_lines(kept.orderBy("name").select(F.col("name").alias("value")), path)
    return kept.count()


def _copy_current(spark: SparkSession, root: str, out: str, winners: DataFrame, chosen: list[str], scratch: Scratch) -> int:
    """A winner's file comes from the run that won."""
    there = _run_files(spark, root, chosen).where("not old").select("run", "name", "path")
    found, lost = wanted_files(winners, there)
    store.copy_files(spark, f"{out}/data/files", found.select(F.col("path").alias("source"), F.col("bag_name").alias("name")))
    return _listed(scratch, lost, f"{out}/data/missing-files.txt")


def _copy_superseded(spark: SparkSession, root: str, out: str, history: DataFrame, chosen: list[str], scratch: Scratch) -> int:
    safe = is_safe_name(F.col("name"))
    names = versions.archived_names(history)
    old = _run_files(spark, root, chosen).where("old").join(names, "name", "left_semi")
    sums = files.digests(old).select("path", "sha256") if files.in_tasks(root) else files.content(spark, [f"{root}/{r}" for r in chosen], "*.pdf").select("path", F.sha2("content", 256).alias("sha256"))
    there = scratch.stage(old.join(sums, "path").select("path", "name", "sha256"), "superseded")
    good, gaps = versions.verified_and_gaps(names.where(safe), there.select("name", "sha256"))
    own = there.where(F.col("sha256") == F.substring_index("name", ".", 1)).groupBy("name").agg(F.min("path").alias("path"))
    store.copy_files(spark, f"{out}/data/versions", good.join(own, "name").select(F.col("path").alias("source"), "name"))
    return _listed(scratch, gaps.union(names.where(~safe)), f"{out}/data/unverified-versions.txt")


def dataset(cover, formats: list[str], base_url: str | None) -> dict:
    """The package as schema.org has it."""
    path, _, media = resource(formats)
    return {
        "@context": "https://schema.org/", "@type": "Dataset", "name": "Documents", "description": "Records and files of documents from an archive of collection runs.", "creator": {"@type": "SoftwareApplication", "name": "foliary"},
        "license": base_url, "isAccessibleForFree": True, "temporalCoverage": f"{cover.date_min}/{cover.date_max}" if cover.date_min and cover.date_max else None,
        "variableMeasured": [{"@type": "PropertyValue", "name": f.name, "description": f.title} for f in schema.EXPORT_FIELDS], "distribution": [{"@type": "DataDownload", "encodingFormat": media, "contentUrl": path}],
    }


def datasheet(cover, chosen: list[str], n_conflicts: int, missing: int, unverified: int) -> str:
    span = f", delivered {cover.date_min} to {cover.date_max}" if cover.date_min else ""
    return f"""# Datasheet

Made by foliary {schema.VERSION_OF_TOOL} on {_now()}.

## What it holds

- {cover.record_count} documents{span}, one row each; of several fetches the latest.
- Runs: {', '.join(chosen)}.
- Documents whose fetches differ in content: {n_conflicts} (listed in conflicts.json).
- Files wanted but not there, or not safe to name: {missing} (listed in missing-files.txt).
- Superseded files that are missing or differ from their digest: {unverified} (listed in unverified-versions.txt).

## How it was made

Dates are ISO 8601. Panels, statuses and results are derived from what was served, as datapackage.json describes; what was
served is kept beside them. manifest-sha256.txt verifies every file.

## Rights

{RIGHTS_NOTE}
"""
