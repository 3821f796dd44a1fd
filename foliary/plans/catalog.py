"""The archive's catalog, crawl, corpus and publishing steps over runs that are made of the standard tables.

Three runs of records, versions and manifests are written once in the shared folder; the queries read them as they would an archive.
"""

from __future__ import annotations

import json
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliary import files, publish, schema, store, tables
from foliary.functions import dates, links, names
from foliary.operators import crawl, merge, progress, versions
from foliary.plans.archive import SQL, query, read
from foliary.sources import markup, runs
from foliary.staging import Scratch
from foliary.streaming import events, ordered

c, lit = F.col, F.lit
RUNS = ["20240101T000000Z__a", "20240201T000000Z__b", "20240301T000000Z__b-a"]

#: The records of all runs, as SQL has them. Run 1 is of an older layout, without composition and etag.
RECORDS = """
SELECT o_orderkey AS id, o_orderkey % 3 AS k, CASE o_orderkey % 3 WHEN 0 THEN '20240101T000000Z__a' WHEN 1 THEN '20240201T000000Z__b' ELSE '20240301T000000Z__b-a' END AS run, CAST(o_orderkey % 3 AS INTEGER) AS run_ord,
 CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'u' || o_custkey END AS document_uuid, 'https://h/' || o_custkey || '.pdf' AS pdf_url, '[2024] IESC ' || (o_custkey % 97) AS neutral_citation, 'f' || (o_custkey % 50) || '.pdf' AS filename,
 CASE WHEN o_orderstatus = 'F' THEN md5(o_orderpriority) END AS sha256, CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'O' THEN 'error' ELSE 'ok' END AS meta_status, CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'O' THEN 'error' ELSE 'done' END AS download_status,
 CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS pdf_retrieved_at, strftime(o_orderdate, '%Y-%m-%d') AS date_delivered, CASE WHEN o_orderkey % 3 <> 1 THEN ' A ;B' END AS composition,
 CASE WHEN o_orderkey % 4 = 0 THEN '=x, "y"' ELSE o_orderpriority END AS title, CASE WHEN o_orderkey % 2 = 0 THEN '{"fields":{"Court":"' || o_orderpriority || '"},"supplementary":[]}' ELSE '' END AS meta_json
FROM orders"""


def _records(spark: SparkSession, d: str) -> DataFrame:
    k, o = c("o_orderkey"), c("o_orderstatus")
    u = c("o_custkey").cast("string")
    at = F.when(k % 5 == 0, lit(None).cast("string")).when(k % 5 == 1, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    made = read(spark, d, "orders").select(
        k.alias("id"), (k % 3).alias("k"), F.when(k % 11 == 0, "").otherwise(F.concat(lit("u"), u)).alias("document_uuid"), F.concat(lit("https://h/"), u, lit(".pdf")).alias("pdf_url"),
        F.concat(lit("[2024] IESC "), c("o_custkey") % 97).alias("neutral_citation"), F.concat(lit("f"), c("o_custkey") % 50, lit(".pdf")).alias("filename"), F.when(o == "F", F.md5("o_orderpriority")).alias("sha256"),
        F.when(o == "P", "pending").when(o == "O", "error").otherwise("ok").alias("meta_status"), F.when(o == "P", "pending").when(o == "O", "error").otherwise("done").alias("download_status"),
        at.alias("pdf_retrieved_at"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_delivered"), lit(" A ;B").alias("composition"), F.when(k % 4 == 0, '=x, "y"').otherwise(c("o_orderpriority")).alias("title"),
        F.when(k % 2 == 0, F.concat(lit('{"fields":{"Court":"'), "o_orderpriority", lit('"},"supplementary":[]}'))).otherwise("").alias("meta_json"),
    )
    return made


#: Versions of the first and the last run: one, and for done records a second that superseded it.
VERSIONS = """
SELECT o_orderkey * 2 AS id, o_orderkey AS record_id, o_orderkey % 3 AS k, 'u' || o_custkey AS document_uuid, md5(o_orderpriority) AS sha256, '2024-01-01' AS fetched_at, CASE WHEN o_orderstatus = 'F' THEN '2024-02-01' END AS superseded_at,
 CASE WHEN o_orderstatus = 'F' THEN 'versions/' || md5(o_orderpriority) || '.pdf' ELSE 'f.pdf' END AS filename FROM orders WHERE o_orderkey % 3 <> 1
UNION ALL SELECT o_orderkey * 2 + 1, o_orderkey, o_orderkey % 3, CASE WHEN o_orderkey % 7 = 0 THEN 'w' ELSE 'u' END || o_custkey, md5(o_orderstatus || o_orderpriority), '2024-02-01', NULL, 'f.pdf' FROM orders WHERE o_orderkey % 3 <> 1 AND o_orderstatus = 'F'"""


def _versions(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders").where("o_orderkey % 3 <> 1")
    k, done, u = c("o_orderkey"), c("o_orderstatus") == "F", F.concat(lit("u"), "o_custkey")
    old = F.md5("o_orderpriority")
    first = rows.select((k * 2).alias("id"), k.alias("record_id"), (k % 3).alias("k"), u.alias("document_uuid"), old.alias("sha256"), lit("2024-01-01").alias("fetched_at"), F.when(done, "2024-02-01").alias("superseded_at"), F.when(done, F.concat(lit("versions/"), old, lit(".pdf"))).otherwise("f.pdf").alias("filename"))
    second = rows.where(done).select((k * 2 + 1).alias("id"), k.alias("record_id"), (k % 3).alias("k"), F.concat(F.when(k % 7 == 0, "w").otherwise("u"), "o_custkey").alias("document_uuid"), F.md5(F.concat("o_orderstatus", "o_orderpriority")).alias("sha256"), lit("2024-02-01").alias("fetched_at"), lit(None).cast("string").alias("superseded_at"), lit("f.pdf").alias("filename"))
    return first.union(second)


@lru_cache(maxsize=8)
def _root(spark: SparkSession, d: str) -> str:
    root = Scratch(spark, "archive").path("data")
    records, history = _records(spark, d), _versions(spark, d)
    listing = [{"complete": True, "truncated": False, "pages_fetched": 2, "pages_available": 2}, None, {"complete": True, "truncated": True, "pages_fetched": 3, "pages_available": 27}]
    for n, run in enumerate(RUNS):
        mine = schema.conform(records.where(c("k") == n), schema.RECORD)
        (mine.drop("composition", "http_etag") if n == 1 else mine).write.parquet(f"{root}/{run}/records.parquet")
        if n != 1:
            schema.conform(history.where(c("k") == n), schema.VERSION).write.parquet(f"{root}/{run}/versions.parquet")
        told = {"tool": "t", "created": f"2024-0{n + 1}-01", "base_url": f"https://h{n}", "courts": ["B", "A"] if n == 2 else ["A"], "query": "q", "listing": listing[n]}
        files.put_text(spark, f"{root}/{run}/manifest.json", json.dumps(told, indent=1) if n != 1 else "[1")
        for k in range(0, 50, 2):  # the files of even names are there
            files.put_text(spark, f"{root}/{run}/pdfs/f{k}.pdf", f"%PDF-{run}-{k}")
    return root


_R = f"WITH r AS ({RECORDS}) "
_IDENT = "coalesce(nullif(document_uuid, ''), pdf_url)"


# ---- the catalog


@query(_R + "SELECT run, run_ord, id, document_uuid, download_status, composition, sha256 FROM r")
def run_records(spark, d):
    return runs.records(spark, _root(spark, d)).select("run", "run_ord", "id", "document_uuid", "download_status", "composition", "sha256")


@query(f"SELECT id, record_id, sha256, fetched_at, superseded_at, filename FROM ({VERSIONS}) WHERE k = 2")
def run_history(spark, d):
    return runs.history(spark, _root(spark, d), RUNS[2]).select("id", "record_id", "sha256", "fetched_at", "superseded_at", "filename")


@query(f"SELECT CASE k WHEN 0 THEN '{RUNS[0]}' ELSE '{RUNS[2]}' END AS run, CAST(k / 2 * 2 AS INTEGER) AS run_ord, id, record_id, superseded_at FROM ({VERSIONS})")
def run_histories(spark, d):
    return runs.history(spark, _root(spark, d), RUNS).select("run", "run_ord", "id", "record_id", "superseded_at")


@query(f"SELECT * FROM (VALUES ('{RUNS[0]}', 'https://h0', 'A', true), ('{RUNS[1]}', NULL, NULL, NULL), ('{RUNS[2]}', 'https://h2', 'B,A', true)) AS t(run, base_url, courts, complete)")
def run_manifests(spark, d):
    return runs.manifests(spark, _root(spark, d)).select("run", "manifest.base_url", F.array_join("manifest.courts", ",").alias("courts"), "manifest.listing.complete")


@query("SELECT 'https://h2' AS base_url, 'B,A' AS courts, '2024-03-01' AS created")
def run_config(spark, d):
    told = runs.run_config(spark, _root(spark, d), RUNS[2])
    return spark.createDataFrame([(told["base_url"], ",".join(told["courts"]), told["created"])], "base_url string, courts string, created string")


_LIST = _R + f"""
, n AS (SELECT run AS name, count(*) AS total, count(*) FILTER (download_status = 'done') AS done, count(*) FILTER (meta_status = 'error') + count(*) FILTER (download_status = 'error') AS error FROM r GROUP BY run),
m AS (SELECT * FROM (VALUES ('{RUNS[0]}', 'A', '2024-01-01', true, false, 2, 2), ('{RUNS[1]}', '', NULL, false, false, NULL, NULL), ('{RUNS[2]}', 'B,A', '2024-03-01', true, true, 3, 27)) AS t(name, courts, created, listing_verified, listing_truncated, pages_fetched, pages_available)),
l AS (SELECT name, courts, created, coalesce(total, 0) AS total, coalesce(done, 0) AS done, coalesce(error, 0) AS error, true AS readable, coalesce(total > 0 AND done >= total, false) AS complete, listing_verified, listing_truncated,
 CAST(pages_fetched AS BIGINT) AS pages_fetched, CAST(pages_available AS BIGINT) AS pages_available FROM m LEFT JOIN n USING (name))"""


@query(_LIST + "SELECT *, '/' || name AS path FROM l")
def run_listing(spark, d):
    root = _root(spark, d)
    return runs.listing(runs.catalog(spark, root), root).withColumn("courts", F.array_join("courts", ",")).withColumn("path", F.substring("path", len(root) + 1, 1000))


@query(_LIST + """SELECT name, name || '  (' || CASE WHEN complete AND listing_truncated THEN 'downloads complete; listing truncated at ' || pages_fetched || ' of ' || pages_available || ' pages' WHEN complete THEN 'complete, ' || total || ' PDFs'
 ELSE done || '/' || total || ' downloaded' || CASE WHEN error > 0 THEN ', ' || error || ' error(s)' ELSE '' END || CASE WHEN listing_truncated THEN ', listing truncated' ELSE '' END END || ')' AS summary FROM l""")
def run_summaries(spark, d):
    root = _root(spark, d)
    return runs.summaries(runs.listing(runs.catalog(spark, root), root))


@query(_LIST + f"""SELECT 'matching' AS rule, '{RUNS[2]}' AS run UNION ALL SELECT 'resumable', name FROM l WHERE total > 0 AND NOT complete UNION ALL SELECT 'canonical', name FROM l WHERE complete AND NOT listing_truncated
 UNION ALL SELECT 'latest', '{RUNS[2]}' UNION ALL SELECT 'selected', '{RUNS[0]}' UNION ALL SELECT 'all', name FROM l""")
def run_choices(spark, d):
    root = _root(spark, d)
    known = runs.catalog(spark, root)
    of = lambda rule, frame: frame.select(lit(rule).alias("rule"), "run")
    picked = [("latest", runs.latest(spark, root)), *(("selected", r) for r in runs.selected(spark, root, [RUNS[0]], RUNS)), *(("all", r) for r in runs.names(spark, root))]
    return of("matching", runs.matching(known, ["A", "B", "A"])).union(of("resumable", runs.resumable(known))).union(of("canonical", runs.canonical(known))).union(spark.createDataFrame(picked, "rule string, run string"))


@query(_R + f"""SELECT '{RUNS[1]}' AS run, count(*) AS total, count(*) FILTER (meta_status = 'pending') AS meta_pending, count(*) FILTER (meta_status = 'ok') AS meta_ok, count(*) FILTER (meta_status = 'error') AS meta_error,
 count(*) FILTER (download_status = 'pending') AS download_pending, count(*) FILTER (download_status = 'done') AS download_done, count(*) FILTER (download_status = 'error') AS download_error FROM r WHERE k = 1""")
def run_status(spark, d):
    told = runs.status(spark, _root(spark, d), RUNS[1])
    return spark.createDataFrame([tuple(told.values())], ", ".join(f"{k} {'string' if k == 'run' else 'bigint'}" for k in told))


@query(_R + """, n AS (SELECT run, count(*) AS total, count(*) FILTER (meta_status = 'ok') AS ok, count(*) FILTER (meta_status = 'pending') AS todo, count(*) FILTER (meta_status = 'error') AS skipped, count(*) FILTER (download_status = 'done') AS done, count(*) FILTER (download_status = 'error') AS again FROM r GROUP BY run),
l AS (SELECT run, todo = 0 AND done >= ok AS complete, array_to_string([x FOR x IN [CASE WHEN todo > 0 THEN format('{:,}', todo) || ' to fetch' END, CASE WHEN skipped > 0 THEN format('{:,}', skipped) || ' skipped' END] IF x IS NOT NULL], ', ') AS extra, * FROM n)
SELECT run, complete, CASE WHEN complete THEN 'Nothing left to do: this run is complete.' ELSE 'Metadata:  ' || format('{:,}', ok) || '/' || format('{:,}', total) || ' resolved' || CASE WHEN extra <> '' THEN ' (' || extra || ')' ELSE '' END || '.|Downloads: ' || format('{:,}', done) || '/' || format('{:,}', ok) || ' PDFs done' || CASE WHEN again > 0 THEN ' (' || format('{:,}', again) || ' to retry)' ELSE '' END || '.' END AS lines FROM l""")
def resume_lines(spark, d):
    return runs.resume_lines(runs.catalog(spark, _root(spark, d))).withColumn("lines", F.array_join("lines", "|"))


@query(f"SELECT count(*) FILTER (superseded_at IS NOT NULL) AS n FROM ({VERSIONS})")
def superseded_total(spark, d):
    return versions.superseded_count(runs.history(spark, _root(spark, d), RUNS))


@query(f"SELECT * FROM (VALUES ('{RUNS[0]}', true, false, CAST(2 AS BIGINT)), ('{RUNS[1]}', false, NULL, NULL), ('{RUNS[2]}', true, true, CAST(27 AS BIGINT))) AS t(run, verified, truncated, pages_available)")
def run_sources(spark, d):
    return runs.sources(spark, _root(spark, d), RUNS).select("run", "verified", "truncated", "pages_available")


@query("SELECT n AS results, CAST(n // 10 + CASE WHEN n % 2 = 0 THEN 2 * n ELSE 2 * 3 END AS BIGINT) AS requests FROM (SELECT DISTINCT CAST(o_orderkey % 100 AS BIGINT) AS n FROM orders)")
def fresh_requests(spark, d):
    rows = read(spark, d, "orders").select((c("o_orderkey") % 100).alias("n")).distinct()
    told = runs.fresh_requests(F.floor(c("n") / 10), F.when(c("n") % 2 == 0, c("n")), lit(3))
    return rows.select(c("n").cast("bigint").alias("results"), told.cast("bigint").alias("requests"))


# ---- the merged corpus

_BEST = _R + f""", i AS (SELECT *, {_IDENT} AS ident FROM r), w AS (SELECT *, row_number() OVER (PARTITION BY ident ORDER BY coalesce(pdf_retrieved_at, '') DESC, run_ord, id) AS n, min((run_ord, id)) OVER (PARTITION BY ident) AS seen FROM i),
b AS (SELECT *, row_number() OVER (PARTITION BY filename, download_status = 'done' ORDER BY neutral_citation, document_uuid, seen) AS nth FROM w WHERE n = 1)"""
_BAG = "CASE WHEN download_status = 'done' THEN split_part(filename, '.', 1) || CASE WHEN nth > 1 THEN '__' || nth ELSE '' END || '.pdf' END"


@query(_BEST + f"SELECT ident, run, id, pdf_retrieved_at, {_BAG} AS bag_name FROM b")
def corpus_winners(spark, d):
    return publish.merged(runs.records(spark, _root(spark, d))).select("ident", "run", "id", "pdf_retrieved_at", "bag_name")


@query(_R + f""", s AS (SELECT {_IDENT} AS ident, sha256, arg_max(run, run_ord) AS run FROM r WHERE sha256 IS NOT NULL GROUP BY ALL), g AS (SELECT ident, list_sort(list(sha256)) AS shas, list_sort(list_distinct(list(run))) AS runs FROM s GROUP BY ident)
SELECT ident, array_to_string(shas, ',') AS shas, array_to_string(runs, ',') AS runs FROM g WHERE len(shas) > 1""")
def corpus_conflicts(spark, d):
    found = merge.content_conflicts(merge.identity(runs.records(spark, _root(spark, d))), ["ident"], "sha256", "run", "run_ord")
    return found.select("ident", F.array_join("shas", ",").alias("shas"), F.array_join("runs", ",").alias("runs"))


_PAIRS = f"""WITH v AS ({VERSIONS}), o AS (SELECT *, lag(sha256) OVER w AS old_sha, lag(document_uuid) OVER w AS was, lag(id) OVER w AS old_id, lag(fetched_at) OVER w AS old_at, lag(superseded_at) OVER w AS detected, lag(filename) OVER w AS old_name FROM v WINDOW w AS (PARTITION BY k, record_id ORDER BY fetched_at, id)),
p AS (SELECT * REPLACE (was AS document_uuid, old_id AS id, old_at AS fetched_at) FROM o WHERE old_sha IS NOT NULL),
f AS (SELECT detected, old_name, document_uuid AS ident, old_sha, sha256 AS new_sha, k, record_id, fetched_at, id, row_number() OVER (PARTITION BY document_uuid, old_sha, sha256 ORDER BY k, record_id, fetched_at, id) AS n FROM p WHERE old_sha IS NOT NULL)"""


def _pairs(spark, d):
    return publish.revision_pairs(runs.history(spark, _root(spark, d), RUNS)), publish.SCAN


@query(_PAIRS + "SELECT ident, old_sha, new_sha, record_id FROM f WHERE n = 1")
def corpus_revisions(spark, d):
    return _pairs(spark, d)[0].select("ident", "old_sha", "new_sha", "record_id")


@query(_PAIRS + " SELECT ident, old_sha, new_sha, record_id FROM f WHERE n = 1 ORDER BY k, record_id, fetched_at, id LIMIT 1000")
def corpus_revision_sample(spark, d):
    pairs, scan = _pairs(spark, d)
    return publish.revision_scan(pairs, scan, 1000).select("ident", "old_sha", "new_sha", "record_id")


@query(_PAIRS + """ SELECT ident AS document_uuid, old_sha AS old_sha256, fetched_at AS old_fetched_at, old_name AS old_filename, new_sha AS new_sha256, detected AS detected_at, CASE k WHEN 0 THEN '20240101T000000Z__a' ELSE '20240301T000000Z__b-a' END AS run
FROM (SELECT * FROM f WHERE n = 1 ORDER BY k, record_id, fetched_at, id LIMIT 1000)""")
def corpus_revision_entries(spark, d):
    """What a snapshot says of each revision; the limit is the snapshot's."""
    return publish.revision_entries(_pairs(spark, d)[0], 1000).select("document_uuid", "old_sha256", "old_fetched_at", "old_filename", "new_sha256", "detected_at", "run")


@query("SELECT 'B,A' AS courts, 'https://h0' AS base_url")
def corpus_sources(spark, d):
    told = runs.manifests(spark, _root(spark, d)).select(lit(0).alias("all"), "run", "manifest.base_url", "manifest.courts")
    late = told.where(c("run") != RUNS[0])
    courts = merge.first_seen_union(late.where("courts is not null"), ["all"], "courts", [c("run")])
    return courts.join(merge.first_known(told, ["all"], "base_url", [c("run")]), "all").select(F.array_join("courts", ",").alias("courts"), "base_url")


@query(_BEST + f", t AS (SELECT {_BAG} AS bag_name, run, filename FROM b), e AS (SELECT DISTINCT run, filename FROM r) SELECT bag_name, '/' || run || '/' || filename AS path FROM t JOIN e USING (run, filename) WHERE bag_name IS NOT NULL")
def corpus_files(spark, d):
    there = runs.records(spark, _root(spark, d)).select("run", c("filename").alias("name"), F.concat(lit("/"), "run", lit("/"), "filename").alias("path")).distinct()
    return publish.wanted_files(publish.merged(runs.records(spark, _root(spark, d))), there)[0]


@query(_BEST + f"SELECT filename AS name FROM (SELECT {_BAG} AS bag_name, filename FROM b) WHERE bag_name IS NOT NULL AND CAST(regexp_extract(filename, '(\\d+)', 1) AS INTEGER) % 2 = 1")
def corpus_missing_files(spark, d):
    winners = publish.merged(runs.records(spark, _root(spark, d)))
    there = runs.records(spark, _root(spark, d)).where(F.regexp_extract("filename", r"(\d+)", 1).cast("int") % 2 == 0).select("run", c("filename").alias("name"), lit("x").alias("path")).distinct()
    return publish.wanted_files(winners, there)[1]


_COUNTS = f"""
, m AS (SELECT {_BAG} AS bag_name, run, filename FROM b), s AS (SELECT {_IDENT} AS ident FROM r WHERE sha256 IS NOT NULL GROUP BY 1 HAVING count(DISTINCT sha256) > 1), v AS ({VERSIONS}),
p AS (SELECT sha256, lag(document_uuid) OVER w AS document_uuid, lag(sha256) OVER w AS old_sha FROM v WINDOW w AS (PARTITION BY k, record_id ORDER BY fetched_at, id)), q AS (SELECT DISTINCT document_uuid, old_sha, sha256 FROM p WHERE old_sha IS NOT NULL)"""


@query(_BEST + _COUNTS + """ SELECT (SELECT count(*) FROM b) AS record_count, CAST(3 AS BIGINT) AS run_count, (SELECT count(*) FROM s) AS conflicts, (SELECT count(*) FROM q) AS revisions,
 (SELECT count(*) FROM m WHERE bag_name IS NOT NULL AND CAST(regexp_extract(filename, '(\\d+)', 1) AS INTEGER) % 2 = 1) AS missing_files, (SELECT count(DISTINCT filename) FROM v WHERE superseded_at IS NOT NULL) AS unverified_versions,
 (SELECT count(*) FROM m WHERE bag_name IS NOT NULL AND CAST(regexp_extract(filename, '(\\d+)', 1) AS INTEGER) % 2 = 0) AS copied, (SELECT count(*) FROM s) AS told_conflicts, 'B,A' AS courts""".replace("'B,A'", "'A,B'"))
def corpus_result(spark, d):
    """The whole merge of the runs into a bag: what it returns, and what the bag holds."""
    out = Scratch(spark, "corpus").path("bag")
    got = publish.corpus(spark, _root(spark, d), out, ["csv"])
    told = json.loads(spark.read.text(f"{out}/data/datapackage.json", wholetext=True).first().value)
    counts = {k: got[k] if isinstance(got[k], int) else len(got[k]) for k in ("record_count", "run_count", "conflicts", "revisions", "missing_files", "unverified_versions")}
    counts |= {"copied": files.listing(spark, f"{out}/data/files").count(), "told_conflicts": spark.read.schema("document_uuid string").option("multiLine", "true").json(f"{out}/data/conflicts.json").count()}
    return spark.createDataFrame([(*counts.values(), ",".join(told["courts"]))], ", ".join(f"{k} bigint" for k in counts) + ", courts string")


@query(_BEST + f", t AS (SELECT {_BAG} AS bag_name, run, filename FROM b) SELECT 'data/files/' || bag_name AS path, sha256('%PDF-' || run || '-' || regexp_extract(filename, '(\\d+)', 1)) AS sha256 FROM t WHERE bag_name IS NOT NULL AND CAST(regexp_extract(filename, '(\\d+)', 1) AS INTEGER) % 2 = 0")
def corpus_manifest(spark, d):
    """The fixity that a bag states of its document files."""
    out = Scratch(spark, "corpus").path("bag")
    publish.corpus(spark, _root(spark, d), out, ["parquet"])
    lines = spark.read.text(f"{out}/manifest-sha256.txt").where("value like '%  data/files/%'")
    return lines.select(F.split("value", "  ")[1].alias("path"), F.split("value", "  ")[0].alias("sha256"))


# ---- packages


def _cell(x: str) -> str:
    return f"CASE WHEN {x} SIMILAR TO '[=+\\-@].*' THEN '''' || {x} ELSE coalesce({x}, '') END"


_FLAT = _R + f"SELECT document_uuid, neutral_citation, {_cell('title')} AS title, CASE WHEN k = 1 THEN '' ELSE 'A; B' END AS panel, CASE WHEN k = 1 THEN '0' ELSE '2' END AS panel_count, 'true' AS status_in_vocab, coalesce(sha256, '') AS sha256, date_delivered FROM r"


@query(_FLAT)
def package_csv(spark, d):
    path = Scratch(spark, "csv").path("documents.csv")
    publish.write_csv(publish.derived(runs.records(spark, _root(spark, d))), path)
    rows = spark.read.csv(path, header=True, escape='"', nullValue="\0", emptyValue="")
    shown = ["document_uuid", "neutral_citation", "title", "panel", "panel_count", "status_in_vocab", "sha256", "date_delivered"]
    return rows.select(*[F.coalesce(x, lit("")).alias(x) for x in shown])


@query(_R + "SELECT document_uuid, title, CASE WHEN k = 1 THEN '' ELSE 'A|B' END AS panel, CASE WHEN meta_json <> '' THEN json_extract_string(meta_json, '$.fields.Court') END AS field, sha256 FROM r")
def package_json(spark, d):
    path = Scratch(spark, "json").path("documents.json")
    publish.json_document(publish.nested(runs.records(spark, _root(spark, d)).orderBy("document_uuid", "run_ord", "id")), path)
    kind = "document_uuid string, title string, panel array<string>, metadata_fields map<string,string>, sha256 string"
    return spark.read.schema(kind).option("multiLine", "true").json(path).select("document_uuid", "title", F.array_join("panel", "|").alias("panel"), c("metadata_fields")["Court"].alias("field"), "sha256")


@query(_R + "SELECT document_uuid, title, CASE WHEN k = 1 THEN '' ELSE 'A; B' END AS panel, CAST(CASE WHEN k = 1 THEN 0 ELSE 2 END AS BIGINT) AS panel_count, sha256 FROM r")
def package_parquet(spark, d):
    out = Scratch(spark, "package").path("out")
    publish.write_package(runs.records(spark, _root(spark, d)), out, ["parquet"])
    return spark.read.parquet(f"{out}/documents.parquet").select("document_uuid", "title", "panel", "panel_count", "sha256")


@query(_R + """SELECT key, value FROM (SELECT count(*) AS n, min(date_delivered) AS a, max(date_delivered) AS b FROM r WHERE k = 0) CROSS JOIN LATERAL (VALUES ('record_count', CAST(n AS VARCHAR)), ('date_delivered_min', a), ('date_delivered_max', b), ('name', 'documents'),
 ('profile', 'tabular-data-package'), ('courts', 'A'), ('source', 'https://h0'), ('license', 'https://h0'), ('resource', 'documents.csv'), ('mediatype', 'text/csv'), ('fields', '30'), ('primaryKey', 'document_uuid'), ('files', 'datapackage.json,dictionary.md,documents.csv,documents.json,documents.parquet'), ('formats', 'parquet,csv,json'), ('result_count', CAST(n AS VARCHAR))) AS t(key, value)""")
def package_descriptor(spark, d):
    out = Scratch(spark, "export").path("out")
    got = publish.export(spark, _root(spark, d), RUNS[0], out, ["parquet", "csv", "json", "csv"])
    told = json.loads(spark.read.text(f"{out}/datapackage.json", wholetext=True).first().value)
    at = told["resources"][0]
    pairs = {**told["coverage"], "name": told["name"], "profile": told["profile"], "courts": ",".join(told["courts"]), "source": told["sources"][0]["path"], "license": told["licenses"][0]["path"], "resource": at["path"], "mediatype": at["mediatype"]}
    pairs |= {"fields": len(at["schema"]["fields"]), "primaryKey": at["schema"]["primaryKey"], "files": ",".join(got["files"]), "formats": ",".join(got["formats"]), "result_count": got["record_count"]}
    return spark.createDataFrame([(k, str(v)) for k, v in pairs.items()], "key string, value string")


# Names and types of the published columns, as the contract has them.
_COLUMNS = (
    "document_uuid string, collection_uuid string, neutral_citation string, title string, court string, authoring_judge string, panel string, panel_count integer, date_delivered date, date_uploaded date, record_number string, status string, "
    "status_in_vocab boolean, result string, result_in_vocab boolean, vocab_flags string, view_url string, pdf_url string, filename string, sha256 string, bytes integer, http_content_type string, http_content_length integer, http_last_modified string, "
    "http_etag string, listed_at datetime, meta_retrieved_at datetime, pdf_retrieved_at datetime, meta_status string, download_status string"
)
_TYPED = "SELECT n AS place, split_part(x, ' ', 1) AS name, split_part(x, ' ', 2) AS type FROM (SELECT unnest(string_split(s, ', ')) AS x, generate_subscripts(string_split(s, ', '), 1) AS n FROM (SELECT '" + _COLUMNS + "' AS s))"


@query(f"SELECT CAST(place AS INTEGER) AS place, name, type FROM ({_TYPED})")
def table_schema(spark, d):
    return spark.createDataFrame([(n, f["name"], f["type"]) for n, f in enumerate(schema.table_schema()["fields"], 1)], "place int, name string, type string")


@query(f"SELECT name, type FROM ({_TYPED})")
def dictionary(spark, d):
    lines = spark.createDataFrame([(x,) for x in schema.dictionary().splitlines()], "line string").where("line like '| `%'")
    return lines.select(F.regexp_extract("line", r"^\| `(\w+)` \| (\w+) \|", 1).alias("name"), F.regexp_extract("line", r"^\| `(\w+)` \| (\w+) \|", 2).alias("type"))


def _bag(spark, d) -> str:
    bag = Scratch(spark, "bag").path("corpus")
    for r in read(spark, d, "nation").collect():
        files.put_text(spark, f"{bag}/data/files/n{r.n_nationkey} +a.txt", r.n_name)
    publish.write_bag(spark, bag)
    return bag


@query("SELECT sha256(n_name) || '  data/files/n' || n_nationkey || ' +a.txt' AS line FROM nation")
def bag_manifest(spark, d):
    return spark.read.text(f"{_bag(spark, d)}/manifest-sha256.txt").select(c("value").alias("line"))


@query("SELECT 'Payload-Oxum: ' || CAST(sum(strlen(n_name)) AS VARCHAR) || '.' || CAST(count(*) AS VARCHAR) AS line FROM nation UNION ALL SELECT 'BagIt-Version: 1.0' UNION ALL SELECT 'Tag-File-Character-Encoding: UTF-8' UNION ALL SELECT 'true' ")
def bag_tags(spark, d):
    bag = _bag(spark, d)
    info = spark.read.text(f"{bag}/bag-info.txt").where("value like 'Payload-Oxum%'")
    tags = spark.read.text(f"{bag}/tagmanifest-sha256.txt").select(F.split("value", "  ")[0].alias("said"), F.split("value", "  ")[1].alias("name"))
    real = files.content(spark, bag, "*.txt").where(~c("path").contains("/data/")).select("name", F.sha2("content", 256).alias("real"))
    agree = tags.join(real, "name").agg((F.bool_and(c("said") == c("real")) & (F.count("*") == 3)).cast("string").alias("value"))
    return info.union(spark.read.text(f"{bag}/bagit.txt")).union(agree).withColumnRenamed("value", "line")


@query("SELECT n_name AS name, sha256(n_name) AS sha256 FROM nation")
def file_digests(spark, d):
    folder = Scratch(spark, "files").path("in")
    for r in read(spark, d, "nation").collect():
        files.put_text(spark, f"{folder}/{r.n_name}", r.n_name)
    return store.live(spark, folder).select(c("filename").alias("name"), c("live_sha").alias("sha256"))


# ---- crawls over recorded responses

_DETAIL = "<td><span class='cell-title'>Neutral Citation</span> {0}</td><td><span class='cell-title'>Court:</span> High  <b>Court</b></td><a href='/acc/alfresco/{1}/x y.pdf#p'>Rule {1}</a><a href='/acc/alfresco/{1}/x y.pdf'>again</a><a href='/acc/alfresco/seg/{1}'> </a><a href='/other'>no</a>"


def _fill(form: str, *cols) -> Column:
    parts, rest = [], form
    while "{" in rest:
        before, _, rest = rest.partition("{")
        n, _, rest = rest.partition("}")
        parts += [lit(before), cols[int(n)]]
    return F.concat(*parts, lit(rest))


@query("""SELECT o_orderkey AS id, '[2024] IESC ' || o_orderkey AS neutral_citation, 'High Court' AS court, 'Rule ' || o_orderkey || ' https://h.example/acc/alfresco/' || o_orderkey || '/x%20y.pdf|seg https://h.example/acc/alfresco/seg/' || o_orderkey AS supplementary FROM orders""")
def detail_fields(spark, d):
    key = c("o_orderkey").cast("string")
    pages = read(spark, d, "orders").select(c("o_orderkey").alias("id"), _fill(_DETAIL, F.concat(lit("[2024] IESC "), key), key).alias("html"))
    seen = markup.details(pages, "https://h.example")
    label = F.transform("meta.supplementary", lambda x: F.concat(x["label"], lit(" "), x["url"]))
    return seen.select("id", "meta.neutral_citation", c("meta.fields")["Court:"].alias("court"), F.array_join(label, "|").alias("supplementary"))


@query("""SELECT o_orderkey AS id, 'A https://h.example/view/acc/alfresco/' || o_orderkey || '/a.pdf|B https://cdn.example/acc/alfresco/' || o_orderkey || '/b.pdf|C https://h.example/acc/alfresco/' || o_orderkey || '/c.pdf|q https://h.example/view/p/acc/alfresco/q/' || o_orderkey AS supplementary FROM orders""")
def detail_links(spark, d):
    """Links that go up, name another host, come again in other words, or begin at the page's own folder."""
    key = c("o_orderkey").cast("string")
    form = "<a href='../acc/alfresco/{0}/a.pdf'>A</a><a href='//cdn.example/acc/alfresco/{0}/b.pdf#x'>B</a><a href='../../acc/alfresco/{0}/c.pdf'>C</a><a href='/view/acc/alfresco/{0}/a.pdf'>again</a><a href='./acc/alfresco/q/{0}'></a><a href='../p/acc/alfresco/q/{0}'>too</a><a href='/acc/alfresco'>no</a>"
    pages = read(spark, d, "orders").select(c("o_orderkey").alias("id"), _fill(form.replace("acc/alfresco'>no", "other'>no"), key).alias("html"))
    seen = markup.details(pages, "https://h.example/view/p/q")
    return seen.select("id", F.array_join(F.transform("meta.supplementary", lambda x: F.concat(x["label"], lit(" "), x["url"])), "|").alias("supplementary"))


@query("SELECT 'p' || page_id || '.pdf' AS filename, sha256(encode('%PDF-' || html)) AS sha256, CAST(octet_length(encode('%PDF-' || html)) AS BIGINT) AS length, page_id % 3 = 0 AS superseded FROM pages WHERE html IS NOT NULL")
def store_files(spark, d):
    """Bodies that tasks publish, and the files that then lie there; a third of them are superseded and kept under their digests."""
    folder = Scratch(spark, "store").path("files")
    nothing = lit(None).cast("string")
    bodies = read(spark, d, "pages").where("html is not null").select("page_id", F.concat(lit("p"), "page_id", lit(".pdf")).alias("filename"), F.concat(lit("%PDF-"), "html").cast("binary").alias("body"), nothing.alias("content_length"), nothing.alias("content_encoding"))
    store.publish(spark, folder, bodies)
    store.keep_superseded(spark, folder, bodies.select("filename", F.when(c("page_id") % 3 == 0, "supersede").otherwise("keep").alias("action"), nothing.alias("old_sha")))
    there = files.digests(files.listing(spark, folder)).withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("old", c("path").contains("/versions/"))
    kept = there.where("old").select(F.substring_index("name", ".", 1).alias("sha256"), c("sha256").alias("real")).where("sha256 = real").select("sha256", lit(True).alias("superseded"))
    return there.where("not old").join(kept, "sha256", "left").select(c("name").alias("filename"), "sha256", "length", F.coalesce("superseded", lit(False)).alias("superseded"))


@query("""SELECT o_orderkey AS record_id, md5(o_orderpriority) AS sha256, '2024-01-01' AS fetched_at, CASE WHEN o_orderkey % 10 = 1 THEN '2024-02-01' END AS superseded_at FROM orders
UNION ALL SELECT o_orderkey, 'a', '2024-02-01', CASE WHEN o_orderkey % 20 = 1 THEN '2024-03-01' END FROM orders WHERE o_orderkey % 10 = 1
UNION ALL SELECT o_orderkey, 'b', '2024-03-01', NULL FROM orders WHERE o_orderkey % 20 = 1""")
def version_log(spark, d):
    """A log that stays: first versions of all orders, entered twice, and two rounds of changes."""
    log = tables.version_log(spark, Scratch(spark, "log").path("versions"), 16)
    orders = read(spark, d, "orders")
    first = orders.select(c("o_orderkey").alias("id"), F.md5("o_orderpriority").alias("sha256"), lit("done").alias("download_status"), lit("2024-01-01").alias("pdf_retrieved_at"))
    records = schema.conform(first, schema.RECORD)
    tables.record_first(log, records)
    tables.record_first(log, records)
    changed = lambda rows, sha: rows.select(c("o_orderkey").alias("record_id"), lit(sha).alias("sha256"), lit(None).cast("string").alias("old_sha"))
    tables.supersede(log, changed(orders.where("o_orderkey % 10 = 1"), "a"), lit("2024-02-01"))
    tables.supersede(log, changed(orders.where("o_orderkey % 20 = 1"), "b"), lit("2024-03-01"))
    return log.read().select("record_id", "sha256", "fetched_at", "superseded_at")


_PENDING = "SELECT *, o_orderkey % 8 AS m FROM orders WHERE o_orderstatus = 'P'"


def _crawled(spark, d) -> tuple[DataFrame, DataFrame]:
    """Records whose metadata are due, some records that hold names already, and the responses to their pages."""
    orders = read(spark, d, "orders")
    key, m = c("o_orderkey").cast("string"), c("o_orderkey") % 8
    cite = F.concat(lit("[2024] IESC "), c("o_custkey") % 40)
    pending = orders.where("o_orderstatus = 'P'").select(c("o_orderkey").alias("id"), F.concat(lit("https://h/v/"), key).alias("view_url"), F.concat(lit("https://h/"), key, lit(".pdf")).alias("pdf_url"), lit("Ó Néill J.").alias("judge"), lit("pending").alias("meta_status"), lit("pending").alias("download_status"))
    taken = orders.where("o_orderkey % 100 = 7 and o_orderstatus <> 'P'").select(c("o_orderkey").alias("id"), F.concat(lit("https://h/"), key, lit(".pdf")).alias("pdf_url"), F.concat(lit("2024_IESC_"), c("o_custkey") % 40, lit("_O-Neill-J.pdf")).alias("filename"), lit("ok").alias("meta_status"), lit("done").alias("download_status"))
    records = schema.conform(pending, schema.RECORD).unionByName(schema.conform(taken.dropDuplicates(["filename"]), schema.RECORD))
    said = F.when(m == 5, "").when(m == 6, "odd").otherwise(cite)
    body = F.when(m == 3, "<p>down</p>").otherwise(_fill(_DETAIL, said, key))
    pages = orders.where("o_orderstatus = 'P' and o_orderkey % 8 <> 7").select(
        F.concat(lit("https://h/v/"), key).alias("url"), lit(1).alias("attempt"), F.when(m == 4, 404).when(m == 2, 503).otherwise(200).alias("status"), body.cast("binary").alias("body"), lit(None).cast("string").alias("content_length"), lit(None).cast("string").alias("content_encoding"), lit("e").alias("etag"), lit("m").alias("last_modified"))
    return records, pages


_OUT = f"""WITH p AS ({_PENDING}), o AS (SELECT o_orderkey AS id, o_custkey % 40 AS n, CASE WHEN m IN (2, 3, 7) THEN 'deferred' WHEN m IN (4, 5, 6) THEN 'error' ELSE 'ok' END AS outcome, CASE m WHEN 4 THEN 'status 404' WHEN 5 THEN 'no neutral citation' WHEN 6 THEN 'unknown form of citation' END AS error_reason FROM p),
t AS (SELECT DISTINCT o_custkey % 40 AS n FROM orders WHERE o_orderkey % 100 = 7 AND o_orderstatus <> 'P'),
g AS (SELECT o.*, row_number() OVER (PARTITION BY o.n, outcome ORDER BY id) + CASE WHEN t.n IS NULL THEN 0 ELSE 1 END AS nth FROM o LEFT JOIN t ON o.n = t.n),
f AS (SELECT id, outcome, error_reason, CASE WHEN outcome = 'ok' THEN '2024_IESC_' || n || '_O-Neill-J' || CASE WHEN nth > 1 THEN '_' || nth ELSE '' END || '.pdf' END AS filename FROM g)"""


@query(_OUT + " SELECT * FROM f")
def crawl_metadata(spark, d):
    records, pages = _crawled(spark, d)
    return crawl.resolve_metadata(records, pages, "https://h").select("id", "outcome", "error_reason", "filename")


@query(_OUT + " SELECT id, CASE outcome WHEN 'deferred' THEN 'pending' ELSE outcome END AS meta_status, error_reason, CASE WHEN outcome = 'ok' THEN 'now' END AS meta_retrieved_at FROM f")
def crawl_after_metadata(spark, d):
    records, pages = _crawled(spark, d)
    after = crawl.after_metadata(records, crawl.resolve_metadata(records, pages, "https://h"), lit("now"))
    return after.where("view_url is not null").select("id", "meta_status", "error_reason", "meta_retrieved_at")


@query(_OUT + " SELECT id, CASE outcome WHEN 'ok' THEN 'ok' ELSE 'pending' END AS meta_status, CAST(NULL AS VARCHAR) AS error_reason, (SELECT count(*) FROM f WHERE outcome = 'error') AS requeued FROM f")
def crawl_requeued(spark, d):
    records, pages = _crawled(spark, d)
    after = Scratch(spark, "requeued").stage(crawl.after_metadata(records, crawl.resolve_metadata(records, pages, "https://h"), lit("now")), "after")
    again, n = crawl.requeued(after)
    return again.where("view_url is not null").select("id", "meta_status", "error_reason").crossJoin(n.withColumnRenamed("n", "requeued"))


@query(_OUT + " SELECT 'now' AS logged_at, 'metadata' AS phase, id, error_reason FROM f WHERE error_reason IS NOT NULL")
def crawl_errors(spark, d):
    records, pages = _crawled(spark, d)
    return crawl.error_log(crawl.resolve_metadata(records, pages, "https://h"), "metadata", lit("now")).withColumnRenamed("at", "logged_at")


def _fetched(spark, d) -> tuple[DataFrame, DataFrame]:
    orders = read(spark, d, "orders")
    key, m = c("o_orderkey").cast("string"), c("o_orderkey") % 6
    records = schema.conform(orders.select(c("o_orderkey").alias("id"), F.concat(lit("p"), key).alias("pdf_url"), lit("ok").alias("meta_status"), F.when(c("o_orderstatus") == "F", "done").when(c("o_orderstatus") == "O", "error").otherwise("pending").alias("download_status"),
        F.concat(lit("f"), key).alias("filename"), F.sha2(F.concat(lit("%PDF-"), "o_orderpriority"), 256).alias("sha256"), lit("t0").alias("pdf_retrieved_at"), lit(3).cast("bigint").alias("bytes")), schema.RECORD)
    body = F.when(m == 1, "<html>").when(m == 2, F.concat(lit("%PDF-"), key)).otherwise(F.concat(lit("%PDF-"), "o_orderpriority"))
    answers = orders.where("o_orderkey % 6 <> 5").select(F.concat(lit("p"), key).alias("url"), lit(1).alias("attempt"), F.when(m == 3, 503).otherwise(200).alias("status"), body.cast("binary").alias("body"), F.when(m == 4, "5").alias("content_length"), lit(None).cast("string").alias("content_encoding"), lit("e").alias("etag"), lit("m").alias("last_modified"))
    return records, answers


_VERDICT = "CASE m WHEN 5 THEN 'no response' WHEN 3 THEN 'status 503' WHEN 1 THEN 'not_magic' WHEN 4 THEN 'short' END"
_GOT = f"WITH p AS (SELECT *, o_orderkey % 6 AS m, '%PDF-' || CASE o_orderkey % 6 WHEN 2 THEN CAST(o_orderkey AS VARCHAR) ELSE o_orderpriority END AS body FROM orders), v AS (SELECT *, {_VERDICT} AS reason FROM p)"


@query(_GOT + " SELECT o_orderkey AS id, CASE WHEN reason IS NULL THEN 'done' ELSE 'error' END AS download_status, reason AS error_reason, CASE WHEN reason IS NULL THEN sha256(body) END AS sha256, CASE WHEN reason IS NULL THEN CAST(strlen(body) AS BIGINT) END AS bytes FROM v WHERE o_orderstatus <> 'F'")
def crawl_downloads(spark, d):
    return crawl.downloads(*_fetched(spark, d)).select("id", "download_status", "error_reason", "sha256", "bytes")


@query(_GOT + " SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' OR reason IS NULL THEN 'done' ELSE 'error' END AS download_status, CASE WHEN o_orderstatus <> 'F' AND reason IS NULL THEN 'now' ELSE 't0' END AS pdf_retrieved_at, CASE WHEN o_orderstatus <> 'F' AND reason IS NULL THEN sha256(body) ELSE sha256('%PDF-' || o_orderpriority) END AS sha256 FROM v")
def crawl_after_downloads(spark, d):
    records, answers = _fetched(spark, d)
    return crawl.after_downloads(records, crawl.downloads(records, answers), lit("now")).select("id", "download_status", "pdf_retrieved_at", "sha256")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 = 0 THEN 'unsafe' WHEN o_orderkey % 6 = 1 THEN 'not_magic' WHEN o_orderkey % 6 = 4 THEN 'short' ELSE 'ok' END AS verdict FROM orders WHERE o_orderkey % 6 <> 5")
def store_verdicts(spark, d):
    _, answers = _fetched(spark, d)
    key = F.substring("url", 2, 100)
    bodies = answers.withColumn("filename", F.when(key.cast("bigint") % 13 == 0, F.concat(lit("../"), key)).otherwise(key))
    return store.judged(bodies).select(key.cast("bigint").alias("id"), "verdict")


def _revalidated(spark, d):
    records, answers = _fetched(spark, d)
    live = records.select("filename", F.when(c("id") % 4 == 0, "broken").otherwise(c("sha256")).alias("live_sha"))
    return crawl.revalidate(records, spark.createDataFrame([], schema.VERSION), answers, live, "t5", "t5")


_AGAIN = _GOT + ", a AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'error' WHEN m = 2 THEN 'supersede' WHEN o_orderkey % 4 = 0 THEN 'heal' ELSE 'keep' END AS action FROM v WHERE o_orderstatus = 'F')"


@query(_AGAIN + " SELECT o_orderkey AS id, action, CASE WHEN o_orderkey % 4 = 0 THEN 'broken' ELSE sha256('%PDF-' || o_orderpriority) END AS old_sha FROM a")
def crawl_rechecks(spark, d):
    return _revalidated(spark, d)[0].select("id", "action", "old_sha")


@query(_AGAIN + """ SELECT o_orderkey AS record_id, CASE WHEN action = 'supersede' AND o_orderkey % 4 = 0 THEN 'broken' ELSE sha256('%PDF-' || o_orderpriority) END AS sha256, CASE WHEN action = 'supersede' THEN 't5' END AS superseded_at FROM a
 UNION ALL SELECT o_orderkey, sha256(body), NULL FROM a WHERE action = 'supersede'""")
def crawl_rechecked_history(spark, d):
    return _revalidated(spark, d)[1].select("record_id", "sha256", "superseded_at")


@query(_AGAIN + """ SELECT v.o_orderkey AS id, CASE WHEN action = 'supersede' THEN sha256(v.body) ELSE sha256('%PDF-' || v.o_orderpriority) END AS sha256, CASE WHEN action <> 'error' THEN 't5' END AS last_revalidated_at FROM v LEFT JOIN a ON a.o_orderkey = v.o_orderkey""")
def crawl_rechecked_records(spark, d):
    return _revalidated(spark, d)[2].select("id", "sha256", "last_revalidated_at")


@query("SELECT CAST(o_custkey % 7 AS BIGINT) AS page, count(*) AS rows, CAST(1234 + o_custkey % 7 AS BIGINT) AS result_count, CAST(CASE WHEN o_custkey % 7 = 0 THEN 0 ELSE 9 END AS BIGINT) AS last_page FROM orders GROUP BY o_custkey % 7")
def listing_summary(spark, d):
    row = F.concat(lit("<tr><td>01/02/2024</td><td><a href='/view/"), "o_orderkey", lit("'>t</a></td><td><a href='/acc/"), "o_orderkey", lit(".pdf'>d</a></td><td>c</td><td>j</td><td></td></tr>"))
    # a listing is served in pages of some 20 rows each, so no page grows with the table
    place = F.struct((c("o_custkey") % 7).alias("listing"), F.floor(c("o_orderkey") / 140).alias("part")).alias("page")
    # pages are few bytes and much work, so the planner must not put many of them into one task
    orders = read(spark, d, "orders").withColumn("page", place).repartition(4 * spark.sparkContext.defaultParallelism, "page")
    pages = orders.groupBy("page").agg(F.array_join(F.collect_list(row), "").alias("rows"))
    pager = F.when(c("page.listing") == 0, "").otherwise("<div class='search-pager'><a href='/s?page=3'>3</a><a href='/s?page=9'>last</a></div>")
    html = F.concat(lit("<p>1,"), (c("page.listing") + 234).cast("string"), lit(" results</p><table class='alfresco-table'>"), "rows", lit("</table>"), pager)
    seen = markup.listing_summary(pages.select("page", html.alias("html")))
    return seen.groupBy(c("page.listing").alias("page")).agg(F.sum("rows").alias("rows"), F.max("result_count").alias("result_count"), F.max("last_page").cast("bigint").alias("last_page"))


def _visit(spark, d) -> tuple[DataFrame, DataFrame]:
    """A listing of the orders, one page for each; answers to their pages and files."""
    orders = read(spark, d, "orders")
    key = c("o_orderkey").cast("string")
    row = F.concat(lit("<table class='alfresco-table'><tr><td>01/02/2024</td><td><a href='/view/"), key, lit("'>t</a></td><td><a href='/acc/"), key, lit(".pdf'>d</a></td><td>c</td><td>Dunne J.</td><td></td></tr></table>"))
    detail = F.when(c("o_orderkey") % 3 == 0, _fill(_DETAIL, lit("odd"), key)).otherwise(_fill(_DETAIL, F.concat(lit("[2024] IESC "), key), key))
    base = "https://h.example"
    of = lambda url, body: orders.select(url.alias("url"), lit(1).alias("attempt"), lit(200).alias("status"), body.cast("binary").alias("body"), *[lit(None).cast("string").alias(x) for x in ("content_length", "content_encoding", "etag", "last_modified")])
    answers = of(F.concat(lit(f"{base}/search?page="), key), row).union(of(F.concat(lit(f"{base}/view/"), key), detail)).union(of(F.concat(lit(f"{base}/acc/"), key, lit(".pdf")), F.concat(F.when(c("o_orderkey") % 7 == 0, "<html>").otherwise("%PDF-"), key)))
    # few large files parse faster when their pages are dealt to more tasks
    answers = answers.repartition(max(32, 8 * spark.sparkContext.defaultParallelism), "url")
    known = schema.conform(orders.where("o_orderkey % 4 = 0").select(c("o_orderkey").alias("id"), F.concat(lit(f"{base}/acc/"), key, lit(".pdf")).alias("pdf_url"), lit("ok").alias("meta_status"), lit("done").alias("download_status"), F.concat(lit("f"), key).alias("filename"),
        F.sha2(F.concat(lit("%PDF-"), F.when(c("o_orderkey") % 8 == 0, key).otherwise("old")), 256).alias("sha256"), lit("2023").alias("pdf_retrieved_at"), lit("2023").alias("listed_at")), schema.RECORD)
    return answers, known


_STATE = "CASE WHEN o_orderkey % 3 = 0 THEN 'error' ELSE 'ok' END AS meta_status, CASE WHEN o_orderkey % 3 = 0 THEN 'pending' WHEN o_orderkey % 7 = 0 THEN 'error' ELSE 'done' END AS download_status"


@query(f"SELECT 'https://h.example/acc/' || o_orderkey || '.pdf' AS pdf_url, {_STATE}, CASE WHEN o_orderkey % 3 <> 0 THEN '2024_IESC_' || o_orderkey || '_Dunne-J.pdf' END AS filename, '2024' AS listed_at FROM orders")
def fetch_new(spark, d):
    answers, _ = _visit(spark, d)
    catalog = runs.catalog(spark, _root(spark, d))
    return crawl.fetch(spark, ["C"], answers, "https://h.example", "2024", catalog=catalog).select("pdf_url", "meta_status", "download_status", "filename", "listed_at")


@query("""WITH p AS (SELECT * FROM orders), n AS (SELECT * FROM p WHERE o_orderkey % 4 <> 0), k AS (SELECT * FROM p WHERE o_orderkey % 4 = 0)
SELECT (SELECT count(*) FROM n) AS new, CAST(0 AS BIGINT) AS requeued, (SELECT count(*) FROM k WHERE o_orderkey % 8 <> 0 AND o_orderkey % 7 <> 0) AS revisions, (SELECT count(*) FROM n WHERE o_orderkey % 3 <> 0 AND o_orderkey % 7 = 0) AS errors, 'r' AS run""")
def update_run(spark, d):
    answers, known = _visit(spark, d)
    live = known.select("filename", c("sha256").alias("live_sha"))
    told, _, _ = crawl.update(known, spark.createDataFrame([], schema.VERSION), answers, "https://h.example", "2024", run="r", live=live, revalidate_all=True)
    return spark.createDataFrame([tuple(told[k] for k in ("new", "requeued", "revisions", "errors", "run"))], "new bigint, requeued bigint, revisions bigint, errors bigint, run string")


# ---- functions that no other query calls


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day, strftime(o_orderdate, '%H:%M') AS clock FROM orders")
def strict_dates(spark, d):
    raw = F.when(c("o_orderkey") % 3 == 0, " ").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return read(spark, d, "orders").select("o_orderkey", dates.strict_day_first(raw).cast("string").alias("day"), dates.clock_text(c("o_orderdate")).alias("clock"))


@query("SELECT o_orderkey, o_orderkey % 6 >= 4 AS safe FROM orders")
def safe_names(spark, d):
    k = c("o_orderkey") % 6
    name = F.when(k == 0, "").when(k == 1, "..").when(k == 2, F.concat(lit("a/"), "o_orderkey")).when(k == 3, F.concat(lit("a\\"), "o_orderkey")).otherwise(F.concat(lit("a"), "o_orderkey"))
    return read(spark, d, "orders").select("o_orderkey", names.is_safe_name(name).alias("safe"))


_TOKENS = "(VALUES (0, 'SUPREME'), (1, 'SUPREME,COURT_OF_APPEAL,HIGH'), (2, 'COURT_OF_APPEAL'), (3, NULL), (4, 'SUPREME,COURT_OF_APPEAL,HIGH,COURT_OF_CRIMINAL_APPEAL,COURTS_MARTIAL_APPEAL,CENTRAL_CRIMINAL,SPECIAL_CRIMINAL,CIRCUIT,DISTRICT')) AS t(k, courts)"


@query(f"SELECT o_orderkey, courts FROM orders JOIN {_TOKENS} ON o_orderkey % 5 = k")
def court_tokens(spark, d):
    k = c("o_orderkey") % 5
    token = F.when(k == 0, " supreme ").when(k == 1, "Superior").when(k == 2, "court-of appeal").when(k == 3, "moon").otherwise("all")
    return read(spark, d, "orders").select("o_orderkey", F.array_join(links.court_tokens(token), ",").alias("courts"))


@query("SELECT o_orderkey, 'https://h/search/Judgments/a%2Ab%20' || o_orderkey || '?page=' || o_orderkey % 7 AS url FROM orders")
def search_urls(spark, d):
    return read(spark, d, "orders").select("o_orderkey", links.search_url("https://h/", F.concat(lit("a*b "), "o_orderkey"), c("o_orderkey") % 7).alias("url"))


_PLAIN = "regexp_replace(regexp_replace(regexp_replace(strip_accents(regexp_extract(text, '^\\s*(\\S+\\s+\\S+)', 1)), '[^\\x00-\\x7F]', '', 'g'), '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
SQL["judge_slug"] = f"SELECT doc_id, regexp_replace(left({_PLAIN}, 80), '-+$', '') AS slug FROM documents"


def _unescaped(x: str) -> str:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{char}')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


SQL["page_fields"] = f"""SELECT page_id, {_unescaped("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS title, {_unescaped("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")} AS h1, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
 CAST(len(regexp_extract_all(html, '<a [^>]*href="')) AS INTEGER) AS n_links FROM pages"""


_STEMS = "regexp_replace(lower(p_brand || ' ' || p_type), '[^a-z0-9]+', '-', 'g')"


@query(f"""WITH p AS (SELECT p_partkey, {_STEMS} AS stem FROM part), t AS (SELECT DISTINCT stem FROM p WHERE p_partkey % 3 = 0), g AS (SELECT p_partkey, p.stem, row_number() OVER (PARTITION BY p.stem ORDER BY p_partkey) + CASE WHEN t.stem IS NULL THEN 0 ELSE 1 END AS n FROM p LEFT JOIN t ON p.stem = t.stem WHERE p_partkey % 3 <> 0)
SELECT p_partkey, stem || CASE WHEN n > 1 THEN '_' || n ELSE '' END || '.pdf' AS filename FROM g""")
def filename_taken(spark, d):
    stem = F.regexp_replace(F.lower(F.concat_ws(" ", "p_brand", "p_type")), "[^a-z0-9]+", "-")
    rows = read(spark, d, "part")
    taken = rows.where("p_partkey % 3 = 0").select(F.concat(stem, lit(".pdf")).alias("filename"))
    return merge.file_names(rows.where("p_partkey % 3 <> 0"), stem, ["p_partkey"], taken=taken).select("p_partkey", "filename")


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'started: ' || event_id WHEN 'click' THEN 'retry in 1m' WHEN 'purchase' THEN 'error ' || event_id || ' (boom)' WHEN 'error' THEN 'site down, paused' END AS line, CASE WHEN event_type = 'view' THEN 'next request in ' || CAST(event_id % 9 AS VARCHAR) || '.5s' END AS wait, CASE WHEN event_type = 'view' THEN '…' ELSE '~' || (event_id % 50) || 's left' END AS eta FROM events")
def event_lines(spark, d):
    kind = F.create_map(*[lit(x) for kv in {"view": "PhaseStarted", "click": "RetryScheduled", "purchase": "ItemFinished", "error": "OutagePaused", "signup": "RequestStarted"}.items() for x in kv])[c("event_type")]
    view, label = c("event_type") == "view", c("event_id").cast("string")
    left = F.when(~view, (c("event_id") % 50).cast("double"))
    return read(spark, d, "events").select(
        "event_id", progress.event_text(kind, label, lit("error"), lit("boom"), lit(60.0)).alias("line"),
        progress.countdown_text(F.when(view, "politeness"), (c("event_id") % 9).cast("double") + 10.5, lit(10.0)).alias("wait"), progress.eta_text(left).alias("eta"),
    )


@query("WITH g AS (SELECT user_id, event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events) SELECT user_id, event_id, gap FROM g WHERE gap < 3600000000")
def spacing_faults(spark, d):
    rows = read(spark, d, "events").select("user_id", "event_id", F.unix_micros(c("ts").cast("timestamp")).alias("at"))
    return progress.spacing(rows, ["user_id"], "at", 3_600_000_000).select("user_id", "event_id", "gap")


@query("WITH e AS (SELECT user_id, event_id, ts, CASE WHEN event_type <> 'error' THEN event_id * 2.0 END AS fresh FROM events) SELECT user_id, event_id, CAST(last_value(fresh IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DOUBLE) AS done_at FROM e")
def frozen_finish(spark, d):
    rows = read(spark, d, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("at"), c("event_id").cast("double").alias("now"), c("event_id").cast("double").alias("left"), F.when(c("event_type") == "error", "paused").otherwise("").alias("outage"))
    return progress.done_at(rows, ["user_id"], "at", "now", "left", "outage").select("user_id", "event_id", "done_at")


_THROTTLE = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS secs, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
w(user_id, n, event_id, since, prev, emit) AS (SELECT user_id, n, event_id, 0, secs, true FROM e WHERE n = 1 UNION ALL
 SELECT e.user_id, e.n, e.event_id, CASE WHEN w.since + 1 >= 10 OR e.secs - w.prev >= 86400.0 THEN 0 ELSE w.since + 1 END, CASE WHEN w.since + 1 >= 10 OR e.secs - w.prev >= 86400.0 THEN e.secs ELSE w.prev END, w.since + 1 >= 10 OR e.secs - w.prev >= 86400.0 FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT user_id, event_id FROM w WHERE emit"""
SQL["throttle_lines"] = _THROTTLE


# ---- streams


def _event_rows(spark, d) -> DataFrame:
    kinds = {"view": "RequestStarted", "click": "ItemStarted", "purchase": "ItemFinished", "error": "OutagePaused", "signup": "PhaseStarted"}
    rows = read(spark, d, "events").withColumn("seq", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    kind = F.create_map(*[lit(x) for kv in kinds.items() for x in kv])[c("event_type")]
    label = c("event_id").cast("string")
    shaped = rows.select(c("user_id").cast("string").alias("run"), c("seq").cast("bigint").alias("seq"), kind.alias("event_type"), F.when(c("event_id") % 3 == 0, "ok").otherwise("skipped_no_citation").alias("status"), F.concat(lit("p"), c("event_id") % 4).alias("phase"), lit(1).cast("bigint").alias("items"), label.alias("label"), lit(0).cast("bigint").alias("est_total_requests"), c("seq").cast("double").alias("mono"))
    begin = rows.where("seq = 1").select(c("user_id").cast("string").alias("run"), lit(0).cast("bigint").alias("seq"), lit("RunStarted").alias("event_type"), F.array(lit("p2"), lit("p0")).alias("phases"), lit(0.0).alias("mono"), lit(500).cast("bigint").alias("est_total_requests"))
    return progress.events_of(shaped).unionByName(progress.events_of(begin))


_FOLDED = """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CASE event_id % 4 WHEN 2 THEN 1 WHEN 0 THEN 2 END AS listed FROM events),
l AS (SELECT *, max(seq) FILTER (event_type = 'signup') OVER w AS phase_at, max(seq) FILTER (event_type = 'signup' AND listed IS NOT NULL) OVER w AS listed_at FROM e WINDOW w AS (PARTITION BY user_id))
SELECT CAST(user_id AS VARCHAR) AS run, count(*) FILTER (event_type = 'purchase' AND event_id % 3 = 0) AS ok, count(*) FILTER (event_type = 'purchase' AND event_id % 3 <> 0) AS skipped, count(*) FILTER (event_type = 'view') AS requests_done,
 CAST(coalesce(max(listed) FILTER (event_type = 'signup' AND seq = listed_at), 0) + count(*) FILTER (event_type = 'signup' AND (listed_at IS NULL OR seq > listed_at)) AS BIGINT) AS phase_index, count(*) FILTER (event_type = 'purchase' AND (phase_at IS NULL OR seq > phase_at)) AS phase_done,
 coalesce(arg_max(CAST(event_id AS VARCHAR), seq) FILTER (event_type = 'click' AND (phase_at IS NULL OR seq > phase_at)), '') AS current_label, CASE WHEN bool_or(event_type = 'error') THEN 'paused' ELSE '' END AS outage_state,
 coalesce(arg_max(event_type = 'view', seq) FILTER (event_type IN ('view', 'purchase')), false) AS requesting, CAST(max(seq) AS DOUBLE) AS elapsed FROM l GROUP BY user_id"""
_SHOWN = ["run", "ok", "skipped", "requests_done", "phase_index", "phase_done", "current_label", "outage_state", "requesting"]


@query(_FOLDED)
def event_states(spark, d):
    return progress.fold(_event_rows(spark, d), "run", "seq").select(*_SHOWN, c("elapsed_seconds").alias("elapsed"))


@query(_FOLDED.replace(", CAST(max(seq) AS DOUBLE) AS elapsed", ", CAST(max(seq) AS BIGINT) AS seq"))
def stream_states(spark, d):
    """The same by a stream with state: two batches, and the last snapshot of each run."""
    scratch = Scratch(spark, "stream")
    rows = scratch.stage(_event_rows(spark, d), "events")
    for n, part in enumerate(("seq % 1000 < 10", "seq % 1000 >= 10")):
        rows.where(part).write.mode("append").parquet(scratch.path("in"))
        live = events.live_fold(spark.readStream.schema(rows.schema).parquet(scratch.path("in")), 5.0, 2.0)
        out = scratch.path(f"out-{n}")
        live.writeStream.foreachBatch(lambda b, _, out=out: b.write.mode("append").parquet(out)).outputMode("update").option("checkpointLocation", scratch.path("mark")).trigger(availableNow=True).start().awaitTermination()
    shown = [*_SHOWN, "seq"]
    seen = spark.read.parquet(scratch.path("out-0"), scratch.path("out-1"))
    return seen.groupBy("run").agg(F.max_by(F.struct(*shown), "seq").alias("s")).select("s.*")


@query("SELECT DISTINCT o_custkey FROM orders")
def stream_ingest(spark, d):
    """New keys as they arrive, in three visits, each key once."""
    scratch = Scratch(spark, "ingest")
    rows = read(spark, d, "orders").select("o_custkey", "o_orderkey")
    for part in range(3):
        rows.where(c("o_orderkey") % 3 == part).coalesce(1).write.mode("append").parquet(scratch.path("in"))
        events.ingest_available(spark.readStream.schema(rows.schema).parquet(scratch.path("in")), "o_custkey", scratch.path("out"), scratch.path("mark"))
    return spark.read.parquet(scratch.path("out")).select("o_custkey")


def _shuffled(spark, scratch: Scratch, rows: DataFrame, late: Column, make) -> DataFrame:
    """What a stream gives whose rows (with `at`) come in three batches, in no order of time, before one row that ends all waits."""
    end = rows.limit(1).select(*[lit("end").alias(x) if x == "run" else lit("2100-01-01").cast("timestamp").alias(x) if x == "at" else x for x in rows.columns])
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for n in range(4):
            (rows.where(late == n) if n < 3 else end).write.mode("append").parquet(scratch.path(f"in/n={n}"))
            live = make(spark.readStream.schema(rows.schema).parquet(scratch.path("in/*")))
            live.writeStream.option("checkpointLocation", scratch.path("mark")).option("path", scratch.path("out")).format("parquet").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
    return spark.read.schema(live.schema).parquet(scratch.path("out")).where(~c("run").eqNullSafe(lit("end")))


def _of_users(spark, d, *more: str) -> DataFrame:
    return read(spark, d, "events").selectExpr("CAST(user_id AS STRING) AS run", "CAST(ts AS TIMESTAMP) AS at", "event_id", *more)


@query(_THROTTLE.replace("SELECT user_id, event_id FROM w", "SELECT CAST(user_id AS VARCHAR) AS run, event_id FROM w"))
def stream_throttle(spark, d):
    """throttle_lines of a stream whose batches overlap in time."""
    rows = _of_users(spark, d, "event_id AS id")
    return _shuffled(spark, Scratch(spark, "throttle"), rows, c("event_id") % 3, lambda s: ordered.throttled(s, "run", "at", "event_id", ["id"], 10, 86400.0, "1000 days")).select("run", c("id").alias("event_id"))


@query(_FOLDED.replace(", CAST(max(seq) AS DOUBLE) AS elapsed", ", CAST(max(seq) AS BIGINT) AS seq"))
def stream_states_shuffled(spark, d):
    """stream_states of events that come out of order between batches."""
    scratch, began = Scratch(spark, "shuffled"), F.timestamp_seconds(c("mono") + 1_000_000)
    rows = scratch.stage(_event_rows(spark, d).withColumns({"at": began, "late": c("seq") * 7 % 3}), "events")
    out = _shuffled(spark, scratch, rows, c("late"), lambda s: ordered.ordered_fold(s, "at", 5.0, 2.0, "1000 days"))
    shown = [*_SHOWN, "seq"]
    return out.groupBy("run").agg(F.max_by(F.struct(*shown), "seq").alias("s")).select("s.*")


@query()
def stream_breaker(spark, d):
    """What a live breaker says of each user's events: errors are failures, views are items done, clicks find the site up, purchases down."""
    rows = _of_users(spark, d, "coalesce(map('error', 'failed', 'view', 'ok', 'click', 'up', 'purchase', 'down')[event_type], 'other') AS outcome")
    return _shuffled(spark, Scratch(spark, "breaker"), rows, c("event_id") % 3, lambda s: ordered.breaker(s, "run", "at", "event_id", "1000 days"))
