import re
from collections import Counter, defaultdict

from foliary.llm import divergence, queries
from foliary.llm.common import Scratch

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(LOWER) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(rows, min_docs=3, top=200, scale=10**9):
    """The rule term by term, over the whole vocabulary of each pair."""
    count, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        count[lang, source].update(terms(text))
        df[lang].update(set(terms(text)))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        whole = sum((count[lang, s] for s in sources), Counter())

        def share(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + scale * (c[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: share(count[lang, s]) for s in sources}
        q = share(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(x, sum(f(p[s][t], p[x][t]) for t in kept)) for x in sources - {s}]
            stands = [(t, f(p[s][t], q[t])) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", stands)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, r) for r, (item, v) in enumerate(found, 1) if part == "pair" or r <= top]
    return sorted(out)


def audited(spark, rows, **how):
    docs = spark.createDataFrame([(a, b, c, 1, "x") for a, b, c in rows], "lang string, source string, text string, n long, term string")
    found = divergence.audit(docs, Scratch(spark, "t"), **how)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, found.collect()))


ROWS = [
    ("a", "s1", "The cat sat. THE CAT's 2 cats"), ("a", "s1", "cat dog the"), ("a", "s2", "dog dog dog the été"), ("a", "s2", "Été été İx"), ("a", "s3", None), ("a", "s3", ""), ("a", "s4", "été cat the zebra"), ("a", None, "the cat dog été İx İx"),
    ("b", "s1", "once only"), ("b", "s2", "never"), (None, "s1", "a a a"), (None, "s1", "a b"), (None, "s1", "b a"), ("c", "x", "z"), ("a", "s4", "été cat the zebra"), ("a", "s1", "lone"), ("d", "x", "lone " * 9 + "word"),
]


def test_equals_brute_force(spark):
    assert audited(spark, ROWS) == brute(ROWS)
    assert audited(spark, ROWS, min_docs=1, top_terms=2, scale=1000) == brute(ROWS, 1, 2, 1000)


def test_standard_table(spark):
    rows = [(r.lang, r.source, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = queries.op11_source_divergence(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == brute(rows)


def test_empty_and_without_terms(spark):
    assert audited(spark, []) == []
    assert audited(spark, [("a", "s", None), ("a", "t", "12 !"), ("a", "t", None)]) == [("a", "s", "pair", "t", 0, 1), ("a", "t", "pair", "s", 0, 1)]


def test_pieces_cut_between_terms(monkeypatch):
    text = "Ab, cd! éf gh" * 40 + " " + "w" * 200
    monkeypatch.setattr(divergence, "PIECE", 33)
    assert [w.decode() for part in divergence.term_lists(text.encode()) for w in part] == terms(text)


def test_counts_beyond_a_long(spark):
    rows = spark.createDataFrame([(9_000_000_000_000, 10_000_000_000_000)], "n long, total long")
    assert rows.select(divergence._share("n", "total", 10**9)).first()[0] == 1 + 10**9 * 9_000_000_000_001 // 10_000_000_000_000


def test_flushes_add_up(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_TERMS", 3)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([a or "" for a, _, _ in ROWS]), pa.array([b or "" for _, b, _ in ROWS]), pa.array([(t or "").encode() for _, _, t in ROWS], pa.binary())], names=["lang", "source", "text"])
    total, docs = Counter(), Counter()
    for out in divergence._counted([batch]):
        for r in out.to_pylist():
            total[r["lang"], r["source"], r["term"]] += r["n"]
            docs[r["lang"], r["source"], r["term"]] += r["df"]
    assert total["a", "s2", "dog"] == 3 and docs["a", "s2", "dog"] == 1 and total["a", "s1", "the"] == 3 and docs["a", "s4", "été"] == 2 and ("a", "s3", None) in total
