"""The operators as queries over the standard tables, and the SQL that some of them equal."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from foliary.llm import decontam, divergence, dual_tree, jaccard_join, langid, line_dedup, line_rules, mtree, packing, pii, quality, resharding, warc
from foliary.llm.common import Scratch, held_out, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~held_out("doc_id", 4, 2)))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "_lang.lang_pred", "_lang.score")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.link(table(spark, sf_dir, "documents"), Scratch(spark, "op2"), size=3, num=90, den=100)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


#: A-Z become a-z, and no other letter changes.
_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_SPACE, _WORD = r"[\x20\x09-\x0D]+", r"[0-9a-z\x{80}-\x{10FFFF}]+"

OP2_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_FOLDED}, '{_SPACE}'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS s FROM w WHERE len(w) > 0),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= 90 * (len(x.s) + len(y.s) - n)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT q.b, r.root FROM r JOIN (SELECT a, b FROM l UNION ALL SELECT b, a FROM l) q ON q.a = r.doc_id)
SELECT w.doc_id, CAST(coalesce(len(s.s), 0) AS BIGINT) AS n_shingles, c.component_id FROM w LEFT JOIN s ON s.doc_id = w.doc_id JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) c ON c.doc_id = w.doc_id
"""


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write(table(spark, sf_dir, "pages"), Scratch(spark, "op3"), "archives")
    whole = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("an archive that was just written is damaged: "), "error"))).otherwise(F.col("payload_digest"))
    return warc.read(spark, path).select("page_id", "payload_bytes", whole.cast("string").alias("payload_digest"), "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, d.payload_digest,
  CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest AND payload_bytes >= 100
"""


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.pseudonymize(docs, "key of the standard query", Scratch(spark, "op4"), n_col="n_found", kinds_col="kinds")
    return found.select("doc_id", "n_found", "kinds", "text")


def quality_model(spark: SparkSession, sf_dir: str):
    return quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), lambda c: F.crc32(c.cast("string").cast("binary")) % 5 != 0)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality_model(spark, sf_dir), score_col="score")
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_dedup.dedup(docs, Scratch(spark, "op6"), distance=1, min_chars=16)
    return found.select("doc_id", "_lines.n_lines", "_lines.n_removed", "text")


LINES_SQL = """
parts AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM {documents}),
lines AS (SELECT doc_id, i AS no, p[i] AS line FROM parts, unnest(range(1, len(p) + 1)) AS t(i)),
firsts AS (SELECT line, min((doc_id, no)) AS first FROM lines WHERE length(line) >= 16 GROUP BY line),
near AS (
  SELECT DISTINCT b.line FROM firsts a JOIN firsts b ON abs(length(a.line) - length(b.line)) <= 1 AND a.first < b.first
    AND (left(a.line, 6) = left(b.line, 6) OR right(a.line, 6) = right(b.line, 6))
  WHERE EXISTS (SELECT 1 FROM range(0, length(a.line) + 1) AS t(k) WHERE left(a.line, k) = left(b.line, k) AND
    (substr(a.line, k + 2) = substr(b.line, k + 2) OR substr(a.line, k + 1) = substr(b.line, k + 2) OR substr(a.line, k + 2) = substr(b.line, k + 1)))
),
judged AS (
  SELECT l.*, length(l.line) >= 16 AND ((l.doc_id, l.no) <> f.first OR n.line IS NOT NULL) AS goes
  FROM lines l LEFT JOIN firsts f ON l.line = f.line LEFT JOIN near n ON l.line = n.line
),
deduped AS (
  SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept, '') END AS text
  FROM {documents} d LEFT JOIN (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (goes) AS n_removed, string_agg(line, chr(10) ORDER BY no) FILTER (NOT coalesce(goes, false)) AS kept FROM judged GROUP BY doc_id) g ON g.doc_id = d.doc_id
)
"""
OP6_SQL = "WITH " + LINES_SQL.format(documents="documents") + "SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, text FROM deduped"


def op7_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op7")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    old = resharding.lay_out(docs, scratch, "old", n_shards=12, n_blocks=64)
    new = resharding.reshard(old, scratch, "new", 16)
    text = F.coalesce("text", F.lit(""))
    rows = new.select("doc_id", "shard", "block", "old_shard", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    found = resharding.numbered(rows, scratch, "rows", id_col="doc_id")
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mtree.top_k(table(spark, sf_dir, "embeddings"), lambda c: c % 50 == 0, Scratch(spark, "op8"), k=5, scale=256)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.scan(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "_scan.*")


_WORDS = f"regexp_extract_all({_FOLDED}, '{_WORD}')"

OP9_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
k AS (SELECT DISTINCT item, m, win FROM (SELECT item, least(len(w), 13) AS m, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: array_to_string(w[i:i + 12], ' '))) AS win FROM b WHERE len(w) > 0)),
x AS (SELECT doc_id, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: struct_pack(i := i, win := array_to_string(w[i:i + m - 1], ' ')))) AS o FROM d, (SELECT DISTINCT m FROM k) WHERE len(w) >= m),
h AS (SELECT doc_id, x.m, o.i AS i, item FROM x JOIN k ON k.m = x.m AND k.win = o.win),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), Scratch(spark, "op11"))


OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_FOLDED}, '[a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS df FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(df) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
m AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS n_lang, v, total FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT lang, source, term, n, CAST(1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + v) AS BIGINT) AS p, CAST(1 + (1000000000 * (n_lang + 1)) // (total + v) AS BIGINT) AS q FROM m),
x AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM s WHERE n > 0 AND p > q
), o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u)
SELECT * FROM o WHERE part = 'pair' OR rank <= 200
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return dual_tree.mine(table(spark, sf_dir, "embeddings").withColumn("label", moved), lambda c: c % 100 == 0, Scratch(spark, "op12"))


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT * FROM (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same) WHERE n <= 5
), r AS (
  SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
)
SELECT * FROM r WHERE rank <= 5
"""


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = line_rules.fit(docs, table(spark, sf_dir, "labels"), Scratch(spark, "op13"))
    return line_rules.judge(docs, field).select("doc_id", *[f"_rules.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")])


def queries():
    return {"op1_language_id": op1_language_id, "op2_ngram_jaccard_join": op2_ngram_jaccard_join, "op3_warc": op3_warc, "op4_pii": op4_pii, "op5_quality": op5_quality, "op6_line_dedup": op6_line_dedup, "op7_resharding": op7_resharding, "op8_exact_top_k": op8_exact_top_k, "op9_decontamination": op9_decontamination, "op10_packing": op10_packing, "op11_source_divergence": op11_source_divergence, "op12_hard_negatives": op12_hard_negatives, "op13_quality_rules": op13_quality_rules, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    known = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return {**known, "op2_ngram_jaccard_join": OP2_SQL, "op3_warc": OP3_SQL, "op6_line_dedup": OP6_SQL, "op8_exact_top_k": OP8_SQL, "op9_decontamination": OP9_SQL, "op11_source_divergence": OP11_SQL, "op12_hard_negatives": OP12_SQL}
