import random

import pytest

from foliary.llm import jaccard_join
from foliary.llm.common import Scratch


def brute(rows, size, num, den):
    def grams(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()

    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(s), low[find(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def mutated(rng, words, rate):
    out = []
    for w in words:
        r = rng.random()
        if r < rate:
            out.append(rng.choice("qrstuv") * rng.randint(1, 3))
        elif r > rate / 2 + 1 - rate:
            continue
        else:
            out.append(w)
    return out


@pytest.mark.parametrize(("size", "num", "den"), [(3, 90, 100), (5, 80, 100)])
@pytest.mark.parametrize("block_docs", [1000, 7])
def test_equals_brute_force(spark, size, num, den, block_docs):
    rng = random.Random(size * 100 + block_docs)
    rows = []
    for _ in range(25):
        base = [rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(rng.choice([1, 2, 4, 9, 12, 30, 90, 200]))]
        for _ in range(rng.randint(1, 9)):
            rows.append((len(rows) * 3 % 1009, " ".join(mutated(rng, base, rng.choice([0, 0.01, 0.03])))))
    rows += [(5001, None), (5002, ""), (5003, " \t\n"), (5004, "A b C"), (5005, "a B c"), (5006, "é É"), (5007, "x " * 4000), (5008, rows[0][1]), (5009, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard_join.link(frame, Scratch(spark, "t"), size=size, num=num, den=den, block_docs=block_docs)
    assert sorted(map(tuple, got.drop("th", "grp").collect())) == brute(rows, size, num, den)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = jaccard_join.link(docs, Scratch(spark, "t"))
    assert sorted(map(tuple, got.drop("th", "grp").collect())) == brute(rows, 3, 90, 100)


def test_edges_of_input(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n long, component string, sigs int")
    assert jaccard_join.link(empty, Scratch(spark, "t")).count() == 0
    rows = [(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (9, "z y x w"), (None, None)]
    extra = spark.createDataFrame([(*r, "k", 7) for r in rows], "doc_id long, text string, component string, n int")
    got = sorted(((r.id or -1, r.n, r.component) for r in jaccard_join.link(extra, Scratch(spark, "t")).collect()), key=str)
    assert got == sorted([(-1, 2, 4), (4, 2, 4), (4, 2, 4), (9, 2, 9), (-1, 0, None)], key=str)
    kept = jaccard_join.keep_one(extra, Scratch(spark, "t"), size=3, num=90, den=100)
    assert kept.columns == extra.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, -1, 4, 9]


def test_chains_and_large_groups_over_blocks(spark):
    rng = random.Random(11)
    rows, words = [], [f"w{k}" for k in range(70)]
    for i in range(70):  # neighbours link, ends do not
        words = words[:]
        words[rng.randrange(70)] = f"x{i}"
        rows.append((i, " ".join(words)))
    for i in range(60):  # one group around a text, and some that only come near it
        w = [f"v{k}" for k in range(80)]
        for _ in range(rng.choice([0, 1, 1, 2, 5])):
            w[rng.randrange(80)] = f"y{rng.randrange(3)}"
        rows.append((1000 - i, " ".join(w)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for num, few in ((90, 12), (93, 2)):
        got = jaccard_join.link(frame, Scratch(spark, "t"), size=2, num=num, den=100, block_docs=9, few=few)
        assert sorted(map(tuple, got.drop("th", "grp").collect())) == brute(rows, 2, num, 100)


def test_merge_skip_equals_counting():
    rng = random.Random(8)
    for _ in range(300):
        lists = [sorted(rng.sample(range(40), rng.randint(0, 25))) for _ in range(rng.randint(0, 12))]
        for least in range(1, 8):
            counts = {v: sum(v in x for x in lists) for v in range(40)}
            assert jaccard_join.merge_skip(lists, least) == sorted((v, c) for v, c in counts.items() if c >= least)


def test_divide_skip_sets_lists_aside(monkeypatch):
    """Thresholds over 1 come up, and lists are skipped in, whatever mu."""
    import numpy as np

    rng = np.random.default_rng(2)
    base = np.sort(rng.choice(10**6, 300, replace=False)).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(300) < rate, rng.choice(10**6, 300), base).astype(np.uint64)) for rate in rng.choice([0.01, 0.03, 0.05, 0.3], 60)]
    seen, real = [], jaccard_join.merge_skip
    monkeypatch.setattr(jaccard_join, "merge_skip", lambda lists, least: seen.append(least) or real(lists, least))
    places = [jaccard_join.divide_skip(sets, np.ones(60, int), np.arange(60), 90, 100, mu=mu).tolist() for mu in (0.0, 0.01, 0.2)]
    assert places[0] == places[1] == places[2] and len(set(places[0])) > 1 and max(seen) > 20
    assert all(len(np.intersect1d(sets[i], sets[p])) for i, p in enumerate(places[0]))


def test_keep_one_of_an_id_with_several_texts(spark):
    rows = [(1, "a b c d e f g", "p"), (1, "z y x w v u t", "q"), (2, "A b c d e f g", "r"), (3, "z y x w v u t", "s"), (3, "k l m n o p q", "t"), (3, "k l m n o p q", "a"), (4, "", "u"), (4, "", "u"), (None, "k l m n o p q", "v")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, th string")
    kept = jaccard_join.keep_one(frame, Scratch(spark, "t"), size=3, num=90, den=100)
    assert kept.columns == frame.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, "a b c d e f g", "p"), (1, "z y x w v u t", "q"), (3, "k l m n o p q", "a"), (4, "", "u"), (None, "k l m n o p q", "v")], key=str)


def test_query(spark):
    from foliary.llm import queries

    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = queries.op2_ngram_jaccard_join(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_shingles", "component_id"] and sorted(map(tuple, got.collect())) == brute(rows, 3, 90, 100)


def test_passages_that_many_share_do_not_chain(spark, monkeypatch):
    """Documents that have but some shingles in common, each of them in all documents, are in no component together."""
    monkeypatch.setattr(Scratch, "drop", lambda *_: None)
    rows = [(i, " ".join(f"{' '.join(f'u{i}x{k}x{j}' for j in range(4))} p{k} q{k} r{k}" for k in range(10))) for i in range(40)]
    rows += [(100 + i, f"{rows[0][1]} z{i}") for i in range(20)]
    scratch = Scratch(spark, "t")
    got = jaccard_join.link(spark.createDataFrame(rows, "doc_id long, text string"), scratch, often=10**9)
    assert sorted(map(tuple, got.drop("th", "grp").collect())) == brute(rows, 3, 90, 100)
    assert spark.read.parquet(scratch.path("members")).count() == 21


def test_sets_that_link_have_a_part_in_common():
    import numpy as np

    rng = np.random.default_rng(5)
    for num, spare, rounds in ((90, None, 6), (93, None, 6), (90, 0, 1), (90, 0, 2), (90, 0, 6)):
        ranges, again = jaccard_join.Ranges(num, 100), 0
        ranges.ROUNDS = rounds
        if spare is not None:  # sets have more empty parts than that, so they are dealt again
            ranges.spare = [spare] * len(ranges.spare)
        for n in [*range(9, 60), *rng.integers(60, 6000, 60).tolist()]:
            pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            lost = int(rng.integers(0, (100 - num) * n // 100 + 1))  # the smaller set has n - lost of the n shingles, or as many others
            x, y = np.unique(pool[:n]), np.unique(pool[lost:n])
            if rng.random() < 0.5:
                lost = (100 - num) * n // (100 + num)
                y = np.unique(np.concatenate([pool[lost:n], pool[n : n + lost]]))
            same = len(np.intersect1d(x, y))
            assert 100 * same >= num * (len(x) + len(y) - same)
            if len(x) != same or len(y) != same:
                a, b = (ranges.signatures(s, None) for s in (x, y))
                assert len(np.intersect1d(a, b)), (num, spare, rounds, n, lost)
                again += len(a) > sum(ranges.differ(k) + 1 + ranges.spare[k] for k in ranges.of(len(x)))
        assert spare is None or rounds == 1 or again


def test_what_is_shared_by_chance_makes_no_pairs(spark, monkeypatch):
    """Texts of few words share shingles with many others; the pairs to compare stay as few as the near copies."""
    monkeypatch.setattr(Scratch, "drop", lambda *_: None)
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefghijklmnop") + "x" for _ in range(rng.randint(40, 120)))) for i in range(400)]
    rows += [(1000 + i, f"{rows[i][1]} z") for i in range(20)]
    scratch = Scratch(spark, "t")
    got = jaccard_join.link(spark.createDataFrame(rows, "doc_id long, text string"), scratch, often=10**9, few=10**6)
    assert sorted(map(tuple, got.drop("th", "grp").collect())) == brute(rows, 3, 90, 100)
    assert 20 <= spark.read.parquet(scratch.path("pairs")).count() <= 60


def test_homes_are_joined_to_sets_not_to_signatures(spark, monkeypatch):
    """Where a signature is in more than `many` classes, no outer join has more rows than there are documents."""
    monkeypatch.setattr(Scratch, "drop", lambda *_: None)
    rng = random.Random(4)
    rows = []
    for group, copies in enumerate([60] + [6] * 8):
        base = [f"w{group}x{k}" for k in range(300)]
        for k in rng.choices(range(300), k=copies):
            rows.append((len(rows), " ".join(base[:k] + [f"x{len(rows)}"] + base[k + 1 :])))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    left, real = [], type(frame).join

    def join(self, other, on=None, how=None):
        if how == "left":
            left.append(self)
        return real(self, other, on, how)

    monkeypatch.setattr(type(frame), "join", join)
    scratch = Scratch(spark, "t")
    got = jaccard_join.link(frame, scratch, few=12, many=30)
    assert sorted(map(tuple, got.drop("th", "grp").collect())) == brute(rows, 3, 90, 100)
    assert spark.read.parquet(scratch.path("hung-roots")).count() > 1
    assert max(x.count() for x in left) <= len(rows)
