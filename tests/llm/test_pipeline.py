import public_tokenizers
from pyspark.sql import functions as F
from test_decontam import brute as contaminated
from test_jaccard_join import brute as near
from test_line_dedup import brute as lines
from tokenizers import Tokenizer

import corpus_pipeline
from foliary.llm import quality

DIR = "/root/testdata/sf0.001"


def test_equals_brute_force(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    model = quality.fit(docs, labels, lambda c: F.crc32(c.cast("string").cast("binary")) % 5 != 0)
    good = [(r.doc_id, r.text, 0) for r in quality.score(docs, model).collect() if r._score >= 0.3]
    before = {d: t for d, t, _ in good}
    rows = [(d, t) for d, t in lines(good, 1, 16) if t.split() or t == before[d]]
    rows = [(d, t) for d, t in rows if d in {x for x, _, c in near(rows, 5, 80, 100) if x == c}]
    dirty = {r[0] for r in contaminated(rows, bench, 13) if r[5]}
    rows = [(d, t) for d, t in rows if d not in dirty]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d: len(tok.encode(t, add_special_tokens=False).ids) + 1 for d, t in rows}
    got = corpus_pipeline.run(spark, DIR).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert {r.doc_id: r.n for r in got} == want == {r.doc_id: r.m for r in got}
    assert len(want) < docs.count()


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DIR).schema.names == docs.columns


def test_edges(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, ties, clashing ids and names: a defined result, and nothing is lost."""
    base = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    long = base[7][1].split("\n")[0] + " " + " ".join(f"word{i} of{i % 97}" for i in range(60_000))
    rows = [*base, (9001, None), (9002, ""), (9003, " \n "), (9004, long), base[3], base[3], (9005, base[4][1]), (None, base[5][1] + " and more of it"), (9006, base[6][1]), (9006, "another text of the same id, which no other document holds")]
    names = ["lang", "source", "n_chars", "_lines", "_lines_", "hits", "scan", "_n_removed", "th", "id", "doc", "d", "t", "drops", "__quality", "n_found"]
    kinds = ", ".join(f"{n} {'long' if n == 'n_chars' else 'string'}" for n in names)
    frame = spark.createDataFrame([(d, t, *("x" if n != "n_chars" else len(t or "") for n in names)) for d, t in rows], f"doc_id long, text string, {kinds}")
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DIR}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.names == docs.columns and out.count() > 0
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    plain = {r.doc_id: r.doc_tokens for r in corpus_pipeline.run(spark, DIR).collect()}
    tokens, pieces = {}, {}
    for r in got:
        tokens.setdefault(r.doc_id, set()).add(r.doc_tokens)
        pieces[r.doc_id] = pieces.get(r.doc_id, 0) + r.length
    assert {9001, 9002} & set(tokens) == {9001, 9002} or not {9001, 9002} & set(tokens)  # empty texts score alike
    assert all(len(x) == 1 for d, x in tokens.items() if d != 9006) and all(pieces[d] == next(iter(tokens[d])) for d in tokens if d not in (None, 9006))
    assert base[3][0] not in plain or pieces[base[3][0]] == plain[base[3][0]]  # once, though it is there three times
    assert 9005 not in tokens and tokens.get(9004, {60_000}).pop() > 50_000
    assert set(plain) - {base[7][0]} <= set(tokens)


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{DIR}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    spark.read.parquet(f"{DIR}/documents.parquet").limit(5).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0  # without labels all score 0.5, without items nothing is cut
