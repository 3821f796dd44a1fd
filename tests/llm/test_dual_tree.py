import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliary.llm import dual_tree
from foliary.llm.common import Scratch


def brute(rows, step, positives=5, negatives=5, low=80):
    best = {}
    for i, label, v in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = ([math.floor(256 * x) for x in v], label)
        best[i] = min(best.get(i, q), q)
    out = []
    for a, (v, label) in best.items():
        if a % step:
            continue
        found = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), b, own) for b, (w, own) in best.items() if b != a and len(w) == len(v))
        for s, p, _ in [x for x in found if x[2] == label][:positives]:
            hard = [(b, -t) for t, b, own in found if own != label and low * -s <= 100 * -t <= 100 * -s][:negatives]
            out += [(a, p, r, b, -s, t) for r, (b, t) in enumerate(hard, 1)]
    return sorted(out)


def mined(spark, rows, step, **how):
    frame = spark.createDataFrame([(i, label, v, 1, "x") for i, label, v in rows], "vec_id long, label int, embedding array<float>, rank int, id string")
    found = dual_tree.mine(frame, lambda c: c % step == 0, Scratch(spark, "t"), **how)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, found.collect()))


def as_float32(rows):
    return [(i, label, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, label, v in rows]


@pytest.mark.parametrize(("part_rows", "block_asks"), [(4000, 2000), (90, 12)])
def test_equals_brute_force(spark, part_rows, block_asks):
    rng = np.random.default_rng(3)
    near = rng.normal(size=(6, 8))
    rows = [(i, int(rng.integers(3)), (near[i % 6] + 0.3 * rng.normal(size=8)).tolist()) for i in range(400)]
    rows += [(600 + i, i % 2, [0.25] * 8) for i in range(130)]  # equal vectors, so equal scores
    rows += [(800, 1, None), (804, 1, [float("nan")] * 8), (808, 1, [None] + [0.0] * 7), (812, None, [1.0] * 8), (816, 1, [1.0, 2.0]), (820, 2, [3.0, 1.0]), (824, 1, [2.0, 1.0]), (828, 1, []), (None, 1, [0.0] * 8)]
    rows += [(4, 0, [0.0] * 8), (4, 1, [0.0] * 8), (4, 0, [0.0] * 8), (900, 0, [0.0] * 8), (904, 7, [5.0] * 8), (908, 8, [-1.0] * 8), (912, 8, [-1.0] + [0.0] * 7)]
    assert mined(spark, rows, 4, part_rows=part_rows, block_asks=block_asks) == brute(as_float32(rows), 4)


def test_other_limits_and_empty(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 4, rng.random(5).tolist()) for i in range(200)]
    assert mined(spark, rows, 10, positives=2, negatives=7, low=(95, 100), part_rows=30) == brute(as_float32(rows), 10, 2, 7, 95)
    assert mined(spark, [], 10) == []
    assert mined(spark, [(0, 1, [1.0]), (1, 1, [1.0])], 10) == [] and mined(spark, [(5, 1, [1.0])], 10) == []


def tree(rows, vectors, labels):
    return dual_tree.Tree(np.arange(rows.start, rows.stop), labels, vectors, leaf=16)


def test_anchor_groups_are_passed_over():
    """Where vectors lie in clusters, few products are taken, and they are enough."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 12)) * 2000
    v = (centres[np.arange(3000) % 30] + rng.normal(size=(3000, 12)) * 20).astype(np.int64)
    labels = (np.arange(3000) // 30) % 2
    rows, asks = tree(range(3000), v, labels), tree(range(300), v[:300], labels[:300])
    search = dual_tree.Search(asks, np.full(300, -dual_tree.LAST), np.full(300, dual_tree.LAST), np.full(300, dual_tree.LAST), 5, True)
    search.run(dual_tree.Tree.load(rows.dump()))
    assert search.scored < 300 * 3000 / 5 and search.passed
    for at, i in enumerate(asks.ids.tolist()):
        want = sorted((-int(v[i] @ v[j]), j) for j in range(3000) if j != i and labels[j] == labels[i])[:5]
        assert [(-s, j) for s, j in search.best[at]] == want


def test_intervals_hold_all_products():
    rng = np.random.default_rng(6)
    a, c = (rng.normal(size=(200, 6)) * 500).astype(np.int64), (rng.normal(size=(300, 6)) * 500 + 90).astype(np.int64)
    x, y = tree(range(200), a, np.zeros(200, int)), tree(range(300), c, np.zeros(300, int))
    low, high = dual_tree.intervals(x.centre, x.radius, y.centre, y.radius)
    for i in range(len(x.start)):
        for j in range(len(y.start)):
            s = x.vectors[x.start[i] : x.end[i]] @ y.vectors[y.start[j] : y.end[j]].T
            assert low[i, j] <= s.min() and s.max() <= high[i, j]


def test_large_components_stay_exact():
    a = np.array([[2**31 - 1, 3], [5, 7]])
    assert dual_tree.products(a, a).tolist() == [[(2**31 - 1) ** 2 + 9, 5 * (2**31 - 1) + 21], [5 * (2**31 - 1) + 21, 74]]


def test_query_equals_brute_force(spark):
    from foliary.llm import queries

    rows = [(r.vec_id, None if r.label is None else (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    got = queries.op12_hard_negatives(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect())) == brute(rows, 100)
    assert got.select(F.max("rank")).first()[0] <= 5
