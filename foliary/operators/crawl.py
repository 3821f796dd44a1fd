"""What a crawl decides, over recorded responses: (url, attempt, status, body, content_length, content_encoding, etag, last_modified, fetched_at)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary import schema
from foliary.functions import names, transfer
from foliary.operators import ingest, merge, versions
from foliary.operators.scans import Running, running
from foliary.sources import markup, runs
from foliary.staging import Scratch


def last_responses(responses: DataFrame) -> DataFrame:
    """The last attempt at each address."""
    cols = [c for c in responses.columns if c != "url"]
    return responses.groupBy("url").agg(F.max_by(F.struct(*cols), "attempt").alias("r")).select("url", "r.*")


def list_pages(responses: DataFrame, base: str) -> DataFrame:
    """Rows of the listing pages that were answered, first of each document's address; `page` is the page's number."""
    pages = last_responses(responses).where("status = 200").select(F.coalesce(F.regexp_extract("url", r"[?&]page=(\d+)", 1).try_cast("bigint"), F.lit(0)).alias("page"), F.col("body").cast("string").alias("html"))
    # other pages have no rows; an entity could spell the name of the table's class
    return ingest.first_of(markup.listing(pages.where("contains(html, 'alfresco-table') or contains(html, '&')"), base), "pdf_url", ["page", "title"])


def resolve_metadata(records: DataFrame, responses: DataFrame, base: str, scratch: Scratch | None = None) -> DataFrame:
    """Outcomes of the metadata queue: ok with a file name, error without a citation, deferred where the page says nothing of the document.

    Names that the records use already are not given again. A page whose grid is empty is the shell of a site that is down, as is a response worth a retry: the record stays pending.
    """
    queue = ingest.metadata_queue(records)
    last = last_responses(responses).select("url", "status", F.col("body").cast("string").alias("html"))
    seen = markup.details(queue.join(last, queue.view_url == last.url, "left"), base)
    down = transfer.is_retryable(F.col("status")) | (F.size("meta.fields") == 0)
    citation = F.col("meta.neutral_citation")
    slug = names.citation_slug(citation)
    outcome = F.when(down, "deferred").when(F.col("status") >= 400, "error").when(citation.isNull(), "error").when(slug.isNull(), "error").otherwise("ok")
    reason = F.when(outcome != "error", F.lit(None).cast("string")).when(F.col("status") >= 400, F.concat(F.lit("status "), "status")).when(citation.isNull(), "no neutral citation").otherwise("unknown form of citation")
    judged = seen.select("id", outcome.alias("outcome"), reason.alias("error_reason"), citation.alias("neutral_citation"), F.to_json("meta").alias("meta_json"), F.when(outcome == "ok", names.file_stem(citation, F.col("judge"))).alias("stem"))
    judged = (scratch or Scratch(records.sparkSession, "metadata")).stage(judged, "judged")  # read in each pass over the names
    taken = records.where("filename is not null").select("filename")
    named = merge.file_names(judged.where("outcome = 'ok'"), F.col("stem"), ["id"], taken=taken).drop("stem")
    rest = judged.where("outcome <> 'ok'").drop("stem").withColumn("filename", F.lit(None).cast("string"))
    return named.unionByName(rest)


def after_metadata(records: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """The records with the outcomes entered; a failure keeps what was known, deferred ones are as before."""
    o = outcomes.where("outcome <> 'deferred'").select(F.col("id").alias("_id"), F.col("outcome").alias("_o"), *[F.col(c).alias(f"_{c}") for c in ("error_reason", "neutral_citation", "meta_json", "filename")])
    joined = records.join(o, records.id == F.col("_id"), "left")
    done, ok = F.col("_id").isNotNull(), F.col("_o") == "ok"
    new = {"meta_status": F.when(done, F.col("_o")).otherwise(F.col("meta_status")), "error_reason": F.when(done, F.col("_error_reason")).otherwise(F.col("error_reason")), "meta_retrieved_at": F.when(ok, now).otherwise(F.col("meta_retrieved_at"))}
    new |= {c: F.when(ok, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("neutral_citation", "meta_json", "filename")}
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in records.columns])


def downloads(records: DataFrame, responses: DataFrame, limit: int | None = None) -> DataFrame:
    """Outcomes of the download queue: done with digest and size, or error with the reason. A deferred one is an error here."""
    queue = ingest.download_queue(records, limit)
    last = last_responses(responses)
    got = queue.select("id", "pdf_url").join(last, F.col("pdf_url") == F.col("url"), "left")
    verdict = F.when(F.col("status").isNull() | (F.col("status") >= 400), F.coalesce(F.concat(F.lit("status "), "status"), F.lit("no response"))).otherwise(transfer.body_verdict(F.col("body"), F.col("content_length"), F.col("content_encoding")))
    return got.select("id", F.when(verdict == "ok", "done").otherwise("error").alias("download_status"), F.when(verdict != "ok", verdict).alias("error_reason"), F.when(verdict == "ok", F.sha2("body", 256)).alias("sha256"), F.when(verdict == "ok", F.octet_length("body").cast("bigint")).alias("bytes"), "etag", "last_modified")


def after_downloads(records: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """The records with the outcomes of downloads entered; a failure keeps what was known of an earlier file."""
    o = outcomes.select(F.col("id").alias("_id"), F.col("download_status").alias("_s"), F.col("error_reason").alias("_e"), F.col("sha256").alias("_sha"), F.col("bytes").alias("_n"), F.col("etag").alias("_t"), F.col("last_modified").alias("_m"))
    joined = records.join(o, records.id == F.col("_id"), "left")
    some, ok = F.col("_id").isNotNull(), F.col("_s") == "done"
    values = {"download_status": F.when(some, F.col("_s")).otherwise(F.col("download_status")), "error_reason": F.when(some, F.col("_e")).otherwise(F.col("error_reason")), "pdf_retrieved_at": F.when(ok, now).otherwise(F.col("pdf_retrieved_at"))}
    values |= {c: F.when(ok, F.col(v)).otherwise(F.col(c)) for c, v in (("sha256", "_sha"), ("bytes", "_n"), ("http_etag", "_t"), ("http_last_modified", "_m"))}
    return joined.select(*[values[c].alias(c) if c in values else F.col(c) for c in records.columns])


def requeued(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with failed metadata pending again, without their reason but with what was known; and how many those are."""
    failed = F.col("meta_status") == "error"
    out = records.withColumn("error_reason", F.when(~failed, F.col("error_reason"))).withColumn("meta_status", F.when(failed, "pending").otherwise(F.col("meta_status")))
    return out, records.where(failed).agg(F.count("*").alias("n"))


def revalidate(records: DataFrame, history: DataFrame, responses: DataFrame, live: DataFrame, now: str, cutoff: str | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A second look at what was fetched: (decisions, history, records). live: filename and live_sha of the files there are.

    An unchanged source leaves the version (a bad live file is healed); a changed one closes it and opens the next.
    """
    history = history.unionByName(versions.backfill(records, history), allowMissingColumns=True)
    due = (F.col("meta_status") == "ok") & (F.col("download_status") == "done") & F.col("sha256").isNotNull()
    targets = ingest.revalidation_targets(records, due, "last_revalidated_at", None if cutoff is None else F.lit(cutoff), "id")
    targets = targets if limit is None else targets.limit(limit)
    last = last_responses(responses)
    seen = targets.join(last, targets.pdf_url == last.url, "left").join(live, "filename", "left")
    ok = (F.col("status") == 200) & (transfer.body_verdict(F.col("body"), F.col("content_length"), F.col("content_encoding")) == "ok")
    new_sha = F.when(ok, F.sha2("body", 256))
    action = versions.recheck_action(new_sha == F.col("sha256"), F.col("live_sha").eqNullSafe(F.col("sha256")), ~F.coalesce(ok, F.lit(False)))
    decisions = seen.select("id", "document_uuid", "pdf_url", "neutral_citation", "filename", action.alias("action"), F.col("sha256").alias("stored"), versions.old_digest(F.col("live_sha"), F.col("sha256"), new_sha).alias("old_sha"), new_sha.alias("new_sha"), F.octet_length("body").cast("bigint").alias("n"))
    changed = decisions.where("action = 'supersede'").select(F.col("id").alias("record_id"), "document_uuid", "pdf_url", "neutral_citation", "filename", F.col("new_sha").alias("sha256"), F.col("n").alias("bytes"), "old_sha")
    after = versions.superseded(history, changed, F.lit(now))
    d = decisions.where("action <> 'error'").select(F.col("id").alias("_id"), "action", F.col("new_sha").alias("_sha"), F.col("n").alias("_n"))
    joined = records.join(d, records.id == F.col("_id"), "left")
    new = F.col("action") == "supersede"
    values = {"last_revalidated_at": F.when(F.col("_id").isNotNull(), F.lit(now)).otherwise(F.col("last_revalidated_at")), "sha256": F.when(new, F.col("_sha")).otherwise(F.col("sha256")), "bytes": F.when(new, F.col("_n")).otherwise(F.col("bytes"))}
    return decisions, after, joined.select(*[values[c].alias(c) if c in values else F.col(c) for c in records.columns])


def error_log(outcomes: DataFrame, phase: str, now: Column) -> DataFrame:
    """Rows for an append-only table of errors."""
    return outcomes.where("error_reason is not null").select(now.alias("at"), F.lit(phase).alias("phase"), "id", "error_reason")


def listed(records: DataFrame, pages: DataFrame, now: Column) -> DataFrame:
    """The records with the new rows of listing pages, pending; what is known keeps its progress. New ids go on from the highest, by page and address."""
    fresh = ingest.new_rows(pages, records, "pdf_url", ["page", "title"]).drop("id")
    fresh = Scratch(records.sparkSession, "fresh").stage(fresh, "fresh")  # read twice, and pages are parsed once
    top = records.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    place = running(fresh, [], ["page", "pdf_url"], {"_place": Running("sum", F.lit(1))})  # however many pages there are, no task counts them all
    numbered = place.crossJoin(F.broadcast(top)).withColumn("id", F.col("_top") + F.col("_place"))
    new = numbered.withColumn("meta_status", F.lit("pending")).withColumn("download_status", F.lit("pending")).withColumn("listed_at", now)
    return records.unionByName(schema.conform(new, schema.RECORD))


def _checked(records: DataFrame) -> DataFrame:
    return schema.conform(records, schema.RECORD)


def fetch(
    spark, courts: list[str] | None, responses: DataFrame, base: str, now: str, *, records: DataFrame | None = None, catalog: DataFrame | None = None, list_only: bool = False, retry_skipped: bool = False, limit: int | None = None,
) -> DataFrame:
    """The records of a crawl over recorded responses: a new one of `courts`, or one that goes on with `records`.

    Options that do not go together are errors, and so is a new crawl of courts that a complete run has (by the catalog).
    """
    resume = records is not None
    if courts and resume:
        raise ValueError("courts begin a new run; they do not go with records to resume")
    if not courts and not resume:
        raise ValueError("neither courts nor records to resume are given")
    if courts and retry_skipped:
        raise ValueError("a new run has skipped nothing that could be tried again")
    if list_only and resume:
        raise ValueError("listing alone begins a new run; it does not go with records to resume")
    if list_only and limit is not None:
        raise ValueError("a limit is on downloads, of which listing alone has none")
    if courts and catalog is not None:
        done = runs.canonical(runs.matching(catalog, courts)).select("run").first()
        if done:
            raise ValueError(f"the complete run {done.run} has these courts")
    at, scratch = F.lit(now), Scratch(spark, "fetch")
    state = _checked(records) if resume else spark.createDataFrame([], schema.RECORD)
    if not resume:
        state = listed(state, list_pages(responses, base), at)
        if list_only:
            return state
    if retry_skipped:
        state = requeued(state)[0]
    state = _resolved(scratch, scratch.stage(state, "listed"), responses, base, at)
    return after_downloads(state, downloads(state, responses, limit), at)


def _resolved(scratch: Scratch, state: DataFrame, responses: DataFrame, base: str, at: Column) -> DataFrame:
    """The records after their metadata. Outcomes are staged: pages are parsed once, though their names are dealt in several passes."""
    return scratch.stage(after_metadata(state, scratch.stage(resolve_metadata(state, responses, base, scratch), "outcomes"), at), "resolved")


def update(
    records: DataFrame, history: DataFrame, responses: DataFrame, base: str, now: str, *, run: str, live: DataFrame | None = None, revalidate_all: bool = False, retry_skipped: bool = False, limit: int | None = None,
) -> tuple[dict, DataFrame, DataFrame]:
    """What a later visit finds, over recorded responses: ({new, requeued, revisions, errors, run}, records, history).

    Records that are there before the visit are looked at again only with revalidate_all (the function `revalidate`); those that
    this visit itself fetches need no second look. Tables are staged between the steps, as each is read several times.
    """
    spark = records.sparkSession
    scratch = Scratch(spark, "update")
    before = scratch.stage(_checked(records), "before")
    n_before = before.count()
    if not n_before:
        raise ValueError(f"{run} has no listing to update; fetch it first")
    state = scratch.stage(listed(before, list_pages(responses, base), F.lit(now)), "listed")
    counts = {"new": state.count() - n_before, "requeued": 0}
    if retry_skipped:
        state, n = requeued(state)
        counts["requeued"] = n.first().n
    state = _resolved(scratch, scratch.stage(state, "queued"), responses, base, F.lit(now))
    state = scratch.stage(after_downloads(state, downloads(state, responses, limit), F.lit(now)), "done")
    known = schema.conform(history, schema.VERSION)
    seen = versions.superseded_count(known).first().n
    if revalidate_all:
        live = live if live is not None else spark.createDataFrame([], "filename string, live_sha string")
        older = state.where(F.col("pdf_retrieved_at").isNull() | (F.col("pdf_retrieved_at") < now))
        _, after, old = revalidate(older, known, responses, live, now, None, limit)
        known = scratch.stage(after, "history")
        state = scratch.stage(old.unionByName(state.where(F.col("pdf_retrieved_at") >= now)), "state")
    revisions = versions.superseded_count(known).first().n - seen
    errors = state.where("download_status = 'error'").count()
    return {**counts, "revisions": revisions, "errors": errors, "run": run}, state, known
