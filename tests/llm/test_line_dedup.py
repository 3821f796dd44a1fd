import random

from pyspark.sql import functions as F

from foliary.llm import line_dedup
from foliary.llm.common import Scratch


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def brute(rows, distance, least):
    first = {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, rows[i][2]))
    for i in order:
        d, t, h = rows[i]
        for n, line in enumerate((t or "").split("\n")):
            if len(line) >= least and line not in first:
                first[line] = (d is not None, d or 0, h, n)
    gone = {b for a in first for b in first if a != b and first[a] < first[b] and abs(len(a) - len(b)) <= distance and edits(a, b) <= distance}
    out = []
    for d, t, h in rows:
        kept = [x for n, x in enumerate(t.split("\n")) if len(x) < least or (x not in gone and first[x] == (d is not None, d or 0, h, n))] if t is not None else None
        out.append((d, None if t is None else "\n".join(kept)))
    return sorted(out, key=str)


def check(spark, rows, distance, least=6):
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, drops string").repartition(3)
    hashes = {r[0]: r[1] for r in frame.select("text", F.xxhash64("text")).collect()}
    got = line_dedup.dedup(frame, Scratch(spark, "t"), distance=distance, min_chars=least)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == brute([(d, t, hashes[t]) for d, t in rows], distance, least)


def test_banded_distance(spark):
    rng = random.Random(5)
    for k in (1, 2, 3):
        rows = []
        for _ in range(400):
            a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 12)))
            b = list(a)
            for _ in range(rng.randint(0, k + 2)):
                at, r = rng.randint(0, len(b)), rng.random()
                b[at : at + (r < 0.6)] = [rng.choice("abé")] if r > 0.3 else []
            rows.append((a, "".join(b)))
        frame = spark.createDataFrame(rows, "a string, b string")
        got = frame.select("a", "b", line_dedup.within(F.col("a"), F.col("b"), k).alias("w")).collect()
        assert [(r.a, r.b, r.w) for r in got] == [(r.a, r.b, edits(r.a, r.b) <= k) for r in got]


def test_equals_brute_force(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcd é") for _ in range(rng.choice([3, 6, 7, 10, 21]))) for _ in range(30)]

    def line():
        s = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            at, r = rng.randint(0, len(s)), rng.random()
            s[at : at + (r < 0.6)] = [rng.choice("xyz")] if r > 0.3 else []
        return "".join(s)

    rows = [(i, "\n".join(line() for _ in range(rng.randint(1, 6)))) for i in range(60)]
    rows += [(5, rows[5][1]), (None, "a line without an id\n" + base[4]), (None, None), (70, None), (71, ""), (72, "\n\n"), (73, rows[3][1] + "\n" + rows[3][1]), (74, "q" * 3000 + "\n" + "q" * 3001)]
    for distance in (1, 2):
        check(spark, rows, distance)


def test_empty(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.dedup(frame, Scratch(spark, "t")).count() == 0


def test_threshold_by_length(spark):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(rng.choice([16, 25, 39, 41, 70, 130]))) for _ in range(12)]

    def line():
        s = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2, 3, 5, 6, 7, 8])):
            at, r = rng.randint(0, len(s)), rng.random()
            s[at : at + (r < 0.6)] = [rng.choice("xyz")] if r > 0.3 else []
        return "".join(s)

    lines = [line() for _ in range(240)] + ["q" * 400, "q" * 419, "q" * 441]
    frame = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    first = {}
    for i, x in enumerate(lines):
        if len(x) >= 16:
            first.setdefault(x, i)
    near = lambda a, b: abs(len(a) - len(b)) <= (k := max(1, max(len(a), len(b)) // 20)) and edits(a, b) <= k
    want = {i for i, x in enumerate(lines) if x in first and (first[x] != i or any(first[a] < i and a != x and near(a, x) for a in first))}
    got = {r.doc_id for r in line_dedup.dedup(frame, Scratch(spark, "t"), min_chars=16, per_chars=20).where("_lines.n_removed > 0").collect()}
    one = {r.doc_id for r in line_dedup.dedup(frame, Scratch(spark, "t"), min_chars=16).where("_lines.n_removed > 0").collect()}
    assert got == want and len(one) < len(want) < len(lines)


def test_crowded_buckets(spark):
    """Groups of near copies whose lines share segments: numbered lines, one-character variants, two edits apart."""
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefgh ") for _ in range(60))
    lines = [f"{base} item {n:04d}" for n in range(0, 400, 3)] + [f"{base[:30]}{chr(0x4E00 + n)}{base[31:]}" for n in range(50)]
    lines += [base[:i] + base[i + 1 :] for i in range(0, 60, 2)] + [base[:i] + "ZZ" + base[i:] for i in range(0, 60, 3)] + [base]
    lines += ["".join(base[k] if k not in (i, j) else "#" for k in range(60)) for i in range(0, 60, 7) for j in range(i, 60, 5)]
    lines += ["".join(p) for p in __import__("itertools").product("ab", repeat=7)]
    rng.shuffle(lines)
    check(spark, list(enumerate(lines)), 1)
    check(spark, list(enumerate(lines[::3])), 2)


def test_candidates_follow_the_lines(spark):
    """Twice the near copies make about twice the pairs, not four times."""
    rng = random.Random(3)
    made = []
    for n in (300, 600):
        base = [rng.choice("abcdefgh ") for _ in range(200)]
        lines = []
        for _ in range(n):
            s = base[:]
            for at in rng.sample(range(100), 6):
                s[at] = rng.choice("ijklmnop")
            lines.append("".join(s))
        frame = spark.createDataFrame(list(enumerate(lines)), "doc long, t string").withColumn("th", F.xxhash64("t"))
        scratch = Scratch(spark, "t")
        line_dedup.dropped_lines(frame, scratch)
        made.append(spark.read.parquet(scratch.path("pairs")).count())
    assert made[1] <= 3 * max(made[0], n)


def test_clashing_names(spark):
    names = ["doc_id", "text", "th", "doc", "drops", "t", "d", "of", "id", "_lines", "n_removed", "_n_removed"]
    frame = spark.createDataFrame([(1, "a line of twenty letters\nx", *"abcdefghij"), (2, "a line of twenty letters", *"abcdefghij")], ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names))
    got = line_dedup.dedup(frame, Scratch(spark, "t"), out="found")
    assert got.columns == [*names, "found"]
    assert [(r.doc_id, r.text, r.th, r.found.n_removed) for r in got.orderBy("doc_id").collect()] == [(1, "a line of twenty letters\nx", "a", 0), (2, "", "a", 1)]
    assert [tuple(r._lines) for r in line_dedup.dedup(frame, Scratch(spark, "t")).orderBy("doc_id").collect()] == [(2, 0), (1, 1)]
