import zlib

import numpy as np
from pyspark.sql import functions as F

from foliary.llm import langid, quality
from foliary.llm.common import held_out

DIR = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    model = langid.fit(docs.where(~held_out("doc_id", 4, 2)), max_docs=240)
    got = langid.identify(docs.where(held_out("doc_id", 4, 2)).where("lang is not null"), model)
    right, n = got.agg(F.sum((F.col("lang") == F.col("_lang.lang_pred")).cast("int")), F.count("*")).first()
    assert n > 200 and right / n > 0.97


def small_model():
    rows = [("x", 0, "the", 9), ("x", 0, "and", 1), ("y", 0, "le", 9), ("y", 0, "et", 1), ("x", 2, "th", 5), ("x", 2, "aw", 3), ("y", 1, "q", 4), ("y", 1, "u", 1), ("x", 1, "z", 4), ("x", 1, "w", 1)]
    hashed = lambda n, g: langid.word_hashes([g])[0] if not n else next(h for h in [*langid.Framed([g]).grams(n)[1][1 : len(g) - n + 2]])
    return langid.Model(np.array(["xy".index(r[0]) for r in rows]), np.array([r[1] for r in rows]), np.array([hashed(r[1], r[2]) for r in rows], np.uint64), np.array([r[3] for r in rows]), ["x", "y"], 2)


def test_backoff():
    model = small_model()
    cost = dict(zip(["the", "thaw", "quz", "ooo"], model.costs(["the", "thaw", "quz", "ooo"]), strict=True))
    assert cost["the"][1] == 7.0 and cost["the"][0] < 0.1  # a known word
    assert np.allclose(cost["thaw"], [-(np.log10(5 / 8) + np.log10(3 / 8)) / 2, 7.0])  # its pairs
    assert np.allclose(cost["quz"], [(14 - np.log10(4 / 5)) / 3, (7 - np.log10(4 / 5) - np.log10(1 / 5)) / 3])  # its letters
    assert np.allclose(cost["ooo"], 7.0)
    judge = langid.Identifier(model)
    assert [x[0] for x in judge(["the the", "le q"])] == ["x", "y"] and judge(["ooo"]) == [("x", 0.5)]
    assert judge([None, "", "12 !? \u00b2"]) == [("und", 0.0)] * 3


def brute_language(train, texts, longest=5, penalty=7.0):
    """The rule on plain dictionaries."""
    import math
    from collections import Counter

    counts = {}
    for lang, text in train:
        for w in langid.words_of(text):
            counts.setdefault((lang, 0), Counter())[w] += 1
            for n in range(1, longest + 1):
                for i in range(len(w) + 2 - n + 1):
                    counts.setdefault((lang, n), Counter())[f" {w} "[i : i + n]] += 1
    langs = sorted({lang for lang, _ in counts})
    total = {k: sum(c.values()) for k, c in counts.items()}

    def cost(n, x):
        return [min(penalty, -math.log10(c[x] / total[lang, n])) if (c := counts.get((lang, n), {})) and x in c else penalty for lang in langs]

    def word(w):
        if any(w in counts.get((lang, 0), ()) for lang in langs):
            return cost(0, w)
        for n in range(longest, 0, -1):
            grams = [g for i in range(len(w) + 2 - n + 1) if any((g := f" {w} "[i : i + n]) in counts.get((lang, n), ()) for lang in langs)]
            if grams:
                return [sum(x) / len(grams) for x in zip(*(cost(n, g) for g in grams), strict=True)]
        return [penalty] * len(langs)

    out = []
    for text in texts:
        words = [word(w) for w in langid.words_of(text) if any(map(str.isalpha, w))]
        if not words or not langs:
            out.append(("und", 0.0))
            continue
        mean = [sum(x) / len(words) for x in zip(*words, strict=True)]
        like = [10 ** (min(mean) - m) for m in mean]
        best = mean.index(min(mean))
        out.append((langs[best], like[best] / sum(like)))
    return out


def test_language_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    learned = [(r.lang, r.text) for r in docs.where(~held_out("doc_id", 4, 2)).collect() if r.lang is not None and r.text is not None]
    rows = docs.select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], brute_language(learned, [r.text for r in rows]), strict=True))
    from foliary.llm import queries

    got = {r.doc_id: r for r in queries.op1_language_id(spark, "/root/testdata/sf0.001").collect()}
    assert got.keys() == want.keys()
    for d, (lang, score) in want.items():
        assert got[d].lang_pred == lang and abs(got[d].score - score) < 1e-5 and got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2)


def test_language_of_long_texts_and_clashing_names(spark):
    rows = [(1, "the cat and the dog " * 40_000, "en", "a"), (1, "le chat et le chien", "fr", "b"), (2, "der Hund " * 5, "de", "c"), (3, "x" * 300_000, None, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _l string")
    got = langid.identify(docs, langid.fit(docs, max_docs=100), out="_l").collect()
    assert sorted((r.doc_id, r._l.lang_pred) for r in got)[:3] == [(1, "en"), (1, "fr"), (2, "de")] and len(got) == 4
    assert langid.fit(docs, max_docs=100, words_per_lang=2, grams_per_lang=3).tables[0].hashes.size <= 6


def test_language_without_training_and_extra_columns(spark):
    rows = spark.createDataFrame([(1, "a b", None, "s"), (1, "a b", None, "s"), (None, None, None, "t")], "doc_id long, text string, lang string, score string")
    got = langid.identify(rows, langid.fit(rows))
    assert got.columns == ["doc_id", "text", "lang", "score", "_lang"] and {r._lang.lang_pred for r in got.collect()} == {"und"}
    assert langid.identify(rows.where("false"), langid.fit(rows.where("false"))).count() == 0


def test_quality_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    model = quality.fit(docs, labels, lambda c: F.crc32(c.cast("string").cast("binary")) % 5 != 0)
    got = quality.score(docs, model).join(labels, "doc_id").where(held_out("doc_id", 5, 0) & F.col("quality").isNotNull()).toPandas()
    assert ((got._score >= 0.3).astype(int) == got.quality).mean() > 0.97 and len(got) > 50
    again = quality.fit(docs.repartition(5), labels, lambda c: F.crc32(c.cast("string").cast("binary")) % 5 != 0)
    assert np.array_equal(model[0], again[0])


def test_quality_scores_do_not_depend_on_batches():
    rng = np.random.default_rng(0)
    model = (rng.normal(size=(1 << 12, 2)).astype(np.float32), np.array([0.1, -0.2], np.float32))
    texts = ["a b c", None, "", "é! " * 900, "a b c", "x" * 5000]
    whole = quality.Scorer(*model).score(texts)
    assert np.allclose(whole, [quality.Scorer(*model).score([t])[0] for t in texts]) and whole[1] == whole[2]
    for text, s in zip(texts, whole, strict=True):
        ids, w = quality.document_features((text or "").split(), 1 << 12)
        z = model[0][ids].T.astype(float) @ w + model[1]
        assert abs(s - 1 / (1 + np.exp(z[0] - z[1]))) < 1e-5


def test_quality_without_two_classes(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (None, "c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r._score for r in quality.score(docs, quality.fit(docs, none, lambda c: F.lit(True))).collect()} == {0.5}
    ones = spark.createDataFrame([(1, 1), (1, None), (None, 0)], "doc_id long, quality int")
    assert all(r._score > 0.99 for r in quality.score(docs, quality.fit(docs, ones, lambda c: F.lit(True))).collect())
    assert quality.keep_good(docs, quality.fit(docs, ones, lambda c: F.lit(True))).columns == ["doc_id", "text"]


def test_quality_learns_from_whole_texts(spark, monkeypatch):
    texts = {i: " ".join([f"w{i}.{k}" for k in range(1000)] + ["x" * 80]) for i in range(20)}
    docs = spark.createDataFrame([*texts.items(), (20, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(21)], "doc_id long, quality int")
    seen, train = [], quality.train
    monkeypatch.setattr(quality, "train", lambda samples, **options: seen.extend(samples) or train(samples, **options))
    quality.fit(docs, labels, lambda c: F.lit(True))
    words = lambda t: t.split() if isinstance(t, str) else list(t or ())
    assert [(words(t), y) for t, y in seen] == [(words(texts.get(i)), i % 2) for i in range(21)]


def test_quality_sample_is_bounded_in_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * 500 if i else "w " * 60_000) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "train", lambda samples, **options: seen.append(samples))
    for bound in (1 << 20, 63_999, 0):
        quality.fit(docs, labels, lambda c: F.lit(True), max_bytes=bound)
    quality.fit(docs, labels, lambda c: F.lit(True), max_bytes=64_000)
    assert len(seen.pop()) == 39
    assert [len(x) for x in seen] == [39, 0, 0]  # the first is over a 64th of any bound; the others have 1000 bytes, a 64th of 64,000


def test_quality_query(spark):
    from foliary.llm import queries

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").where("quality is not null").collect()}
    learned = sorted((r.doc_id, r.text or "", labels[r.doc_id]) for r in docs if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % 5)
    model = quality.train([(t, y) for _, t, y in learned], buckets=1 << 17, dim=8, epochs=6, rate=0.5, seed=7)
    got = {r.doc_id: r for r in queries.op5_quality(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    for r in docs:
        ids, w = quality.document_features((r.text or "").split(), 1 << 17)
        z = model[0][ids].T.astype(float) @ w + model[1]
        x = got[r.doc_id]
        assert abs(x.score - 1 / (1 + np.exp(z[0] - z[1]))) < 1e-4 and x.predicted == (x.score >= 0.3) and x.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
