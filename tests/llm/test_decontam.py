import hashlib
import random
import re

import pytest

from foliary.llm import decontam


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, window):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[x]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("window", "shortest", "max_words"), [(13, 14, 10**6), (5, 1, 10**6), (4, 3, 60), (6, 2, 10**6)])
def test_equals_brute_force(spark, window, shortest, max_words):
    rng = random.Random(window)
    sep = [" ", ", ", "\n", "--", "\t"]
    text = lambda n, a: "".join(rng.choice(a) + rng.choice(sep) for _ in range(n))
    items = [(i, text(rng.randint(shortest, 3 * window), ["ab", "Ba", "c", "É", "7"])) for i in range(40)] + [(50, None), (51, ""), (52, "., !"), (10, text(30, ["q", "r"])), (11, text(2 * window, ["s"]))]
    docs = []
    for d in range(120):
        t = text(rng.randint(0, 60), ["ab", "BA", "c", "é", "7", "z"])
        if d % 3 == 0:
            w = words(rng.choice(items)[1])
            t += " ".join(w[rng.randint(0, 3) :]) + " " + text(rng.randint(0, 400), ["n", "o"])
        docs.append((d, t))
    docs += [(200, None), (201, ""), (202, "?!"), (5, docs[5][1]), (203, "s " * 3000)]
    frame = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, n_hit int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.scan(frame, bench, window=window, max_words=max_words).select("doc_id", "_scan.*")
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, window)


def test_whole_table(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
    docs, items = ([(r[0], r.text) for r in read(t).collect()] for t in ("documents", "benchmark"))
    got = decontam.scan(read("documents"), read("benchmark")).select("doc_id", "_scan.*")
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, 13)


def test_empty_tables_and_filter(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, None, "y")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontam.scan(docs, none).select("_scan.*").collect()] == [0, 0]
    kept = decontam.decontaminate(docs, spark.createDataFrame([(1, "B")], "item_id long, text string"))
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [2]
    assert decontam.scan(docs.where("false"), none).count() == 0


def test_spans_below_the_coverage_rule(spark):
    item = " ".join(f"w{i}" for i in range(30))
    free = lambda n: " ".join(f"x{i}" for i in range(n))
    part = " ".join(item.split()[4:20])
    broken = " ".join(item.split()[:7]) + " " + part + " " + " ".join(item.split()[7:20])  # a cut joins its halves
    docs = [(1, f"É, {free(900)} ({part})! é {free(5)}", 0), (2, part + free(20), 0), (3, free(50), 7), (4, f"{free(900)}\n{broken}\n{free(900)}", 0), (5, None, 7), (6, f"{free(900)} short item", 7)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, n_chars long")
    bench = spark.createDataFrame([(1, item), (2, "short item")], "item_id long, text string")
    first = decontam.scan(frame, bench, spans=True).where("doc_id = 1").select("_scan.*").first()
    assert [tuple(x) for x in first.spans] == [(901, 16)]
    got = {r.doc_id: r for r in decontam.decontaminate(frame, bench, length_col="n_chars").collect()}
    assert sorted(got) == [1, 3, 4, 5, 6] and all(got[d].text == docs[d - 1][1] and got[d].n_chars == 7 for d in (3, 5, 6))
    assert "w5" not in got[1].text and got[1].text.startswith("É, x0 ") and got[1].text.endswith(f" é {free(5)}") and got[1].n_chars == len(got[1].text)
    assert decontam.scan(spark.createDataFrame([tuple(got[4])[:2]], "doc_id long, text string"), bench).select("_scan.n_hit").first().n_hit == 0
    assert decontam.decontaminate(frame, bench, max_span=40, length_col="n_chars").where("doc_id = 1").first().text == docs[0][1]
    assert "short item" not in decontam.decontaminate(frame, bench, max_span=0).where("doc_id = 6").first().text


def test_spans_of_several_automata(spark):
    """Items in automata of their own give what one automaton gives, cuts that bring halves together included."""
    rng = random.Random(4)
    items = [(i, " ".join(f"w{rng.randint(0, 400)}" for _ in range(30))) for i in range(12)] + [(20, "w1 w2")]
    docs = []
    for d in range(40):
        a, b = (rng.choice(items)[1].split() for _ in range(2))
        free = [f"x{rng.randint(0, 50)}" for _ in range(rng.randint(300, 800))]
        docs.append((d, " ".join([*free, *a[:8], *b[5:20], *a[8:], *free, *b[: rng.randint(0, 14)]]), "k"))
    docs += [(90, None, "k"), (91, "", "k"), (92, items[0][1], "k")]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string, hits string").repartition(2), spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted(map(tuple, decontam.decontaminate(frame, bench, max_words=n, window=6).collect()), key=str) for n in (10**6, 50))
    assert one == many and {r[0] for r in one} >= {90, 91} and 92 not in {r[0] for r in one}
    cut = {r[0]: r[1] for r in one}
    assert sum(cut[d] != t for d, t, _ in docs if d in cut) > 20
    left = brute([(d, t) for d, t in cut.items() if t], [x for x in items if x[0] != 20], 6)
    assert all(r[2] == 0 for r in left)


def test_searchers_are_arrays():
    built = decontam.Automaton(5)
    rng = random.Random(1)
    built.add("1", " ".join(str(rng.randint(0, 50)) for _ in range(4000)).encode())
    done = built.finish()
    assert not hasattr(done, "next") and done.keys.nbytes + done.to.nbytes + done.link.nbytes + done.length.nbytes < 4000 * 100
