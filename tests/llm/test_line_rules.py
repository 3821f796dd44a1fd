import itertools
import re
from collections import Counter

import numpy as np
import pytest

from foliary.llm import line_rules, queries
from foliary.llm.common import Scratch

DIR = "/root/testdata/sf0.01"


def brute(text):
    """The base counts by their plain reading."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(8)}
    lines, dup = text.split("\n"), 0
    for i, line in enumerate(lines):
        dup += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in lines[:i]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


TEXTS = [
    None, "", " \n\t\v ", "one", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "a " * 9, "x\nx\n x\nx \n\n\nx", "é😀 #*$%&|<>\r\nü ü　", "a b c d e f g h i a b c d e f g h j\x0b\x0ck", "\n".join(["same line here"] * 40), "w " * 30_000,
    "1 2 3 4 5 6 7 8 9 " * 3 + "tail", "퟿ \U0010ffff", "a\x1cb\x1d\x85 c",
]


def test_counts_equal_brute_force():
    rng = np.random.default_rng(2)
    texts = TEXTS + [" ".join(rng.choice(list("abc"), 60)) + rng.choice(["", "\n", " \n"]) + "\n".join(rng.choice(["l m", "n", ""], 9)) for _ in range(150)]
    for text in texts:
        x = line_rules.Lines(text)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == brute(text), text


@pytest.mark.parametrize("size", [1, 7, 64])
def test_slices_change_nothing(monkeypatch, size):
    whole = [line_rules.Lines(t) for t in TEXTS[:11]]
    monkeypatch.setattr(line_rules, "SLICE", size)
    for t, w in zip(TEXTS[:11], whole, strict=True):
        x = line_rules.Lines(t)
        assert x.features.tolist() == w.features.tolist() and x.words.tolist() == w.words.tolist() and x.word_chars == w.word_chars


def named(text):
    return [{n for k, n in enumerate(line_rules.FEATURES) if f >> k & 1} for f in line_rules.Lines(text).features.tolist()]


def test_features():
    a, b, c, d, e = named("This is a sentence of words.\n\nHOME | SHOP | CART | EXIT\nTHIS!! IS!! LOUD\nHOME | SHOP | CART | EXIT")
    assert a == {"always", "ends a sentence", "first"} and b == {"always", "no word"}
    assert {"three pipes", "symbols an eighth", "nearly all capitals"} <= c and "repeats a line" not in c and "repeats a line" in e and "last" in e
    assert "exclamation marks a thirtieth" in d and "ends a sentence" not in d


def random_field(seed):
    rng = np.random.default_rng(seed)
    return line_rules.Field(rng.normal(size=(len(line_rules.FEATURES), 2)), rng.normal(size=(2, 2)) * 2), rng.integers(0, 1 << len(line_rules.FEATURES), 7).astype(np.uint32)


def test_viterbi_and_marginals_equal_all_paths():
    for seed in range(20):
        field, features = random_field(seed)
        lines = field.scores(features)
        weight = {path: sum(lines[k, y] for k, y in enumerate(path)) + sum(field.pairs[a, b] for a, b in itertools.pairwise(path)) for path in itertools.product((0, 1), repeat=7)}
        assert tuple(field.viterbi(features)) == max(weight, key=weight.get)
        total = sum(map(np.exp, weight.values()))
        one, two = field.marginals(features)
        for k in range(7):
            assert np.isclose(one[k, 1], sum(np.exp(w) for p, w in weight.items() if p[k]) / total)
        assert np.isclose(two[0, 1], sum(np.exp(w) * sum(x == (0, 1) for x in itertools.pairwise(p)) for p, w in weight.items()) / total)
    assert line_rules.Field().viterbi(features[:1]).tolist() == [1] and line_rules.Field().viterbi(features).tolist() == [1] * 7


def test_learning_finds_the_neighbours():
    """Lines without a sign of their own take the label of their neighbours."""
    rng = np.random.default_rng(1)
    chains = []
    for _ in range(120):
        labels = np.repeat(rng.integers(0, 2, 4), 5).astype(np.int8)
        features = np.where(rng.random(20) < 0.6, np.where(labels == 1, 1 | 1 << 12, 1 | 1 << 8), 1).astype(np.uint32)
        chains.append((features, labels))
    field = line_rules.Field()
    field.learn(chains[:80], 6, 0.5, 1e-3, 1, True)
    right = sum((field.viterbi(f) == y).sum() for f, y in chains[80:]) / 800
    assert right > 0.9 and field.pairs[0, 0] > field.pairs[0, 1]


def test_query_on_a_whole_table(spark):
    """Base counts equal brute force; clean documents stay and bad ones go."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    got = {r.doc_id: r for r in queries.op13_quality_rules(spark, DIR).collect()}
    assert got.keys() == docs.keys()
    for i, r in got.items():
        n, chars, symbols, dup, repeats = brute(docs[i])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeats)
        assert r.base_failed == (n < 20 or 100 * repeats > 30 * n) and not (r.kept and r.base_failed)
    judged = [(quality[i], r.kept) for i, r in got.items() if i in quality and not r.base_failed]
    good, bad = [k for q, k in judged if q], [k for q, k in judged if not q]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.1


def test_nulls_repeats_names_and_empty(spark):
    prose = "A sentence of some words ends here. Another one of them ends here too.\nAnd a second line says more than the first line did, at last."
    rows = [(1, None, 5), (1, prose, 5), (1, prose, 5), (None, "", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    got = line_rules.judge(docs, None)
    assert got.columns == ["doc_id", "text", "n_words", "_rules"]
    assert sorted((r.doc_id or 0, r._rules.n_words, r._rules.kept) for r in got.collect()) == [(0, 0, False), (1, 0, False), (1, 27, True), (1, 27, True)]
    assert line_rules.keep_good(docs, None).columns == docs.columns and line_rules.keep_good(docs, None).count() == 2
    assert line_rules.judge(docs.where("false"), None).count() == 0
    none = spark.createDataFrame([(1, 1), (2, None)], "doc_id long, quality int")
    assert line_rules.fit(docs, none, Scratch(spark, "t")) is None and line_rules.fit(docs.where("false"), none, Scratch(spark, "t")) is None


def test_sample_is_bounded_by_lines(spark):
    docs = spark.createDataFrame([(i, "\n".join(["BUY | NOW | HERE | !!" if i % 2 else "A plain sentence ends here."] * (5 if i else 5000))) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, (i + 1) % 2) for i in range(40)], "doc_id long, quality int")
    field = line_rules.fit(docs, labels, Scratch(spark, "t"), max_lines=120)
    kept = {r.doc_id for r in line_rules.keep_good(docs, field, min_words=1, repeats=(100, 100)).collect()}
    assert kept == set(range(0, 40, 2))
