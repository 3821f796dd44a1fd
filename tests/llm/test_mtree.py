import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliary.llm import mtree
from foliary.llm.common import Scratch


def brute(rows, k, step):
    best = {}
    for i, v in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if i is None or v is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * x) for x in v]
        best[i] = min(best.get(i, q), q)
    out = []
    for a, v in best.items():
        if a % step == 0:
            found = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), b) for b, w in best.items() if b != a and len(w) == len(v))
            out += [(a, r + 1, b, -s) for r, (s, b) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("part_rows", [4000, 90])
def test_equals_brute_force(spark, part_rows):
    rng = np.random.default_rng(3)
    near = rng.normal(size=(6, 8))
    rows = [(i, (near[i % 6] + 0.3 * rng.normal(size=8)).tolist()) for i in range(500)]
    rows += [(600 + i, [0.25] * 8) for i in range(120)] + [(800, None), (801, [float("nan")] * 8), (802, [None] + [0.0] * 7), (803, [1.0, 2.0]), (804, [3.0, -1.0]), (805, []), (None, [0.0] * 8), (10, [0.0] * 8), (10, [0.0] * 8), (900, [0.0] * 8)]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, rank int, id string")
    rows32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = mtree.top_k(frame, lambda c: c % 4 == 0, Scratch(spark, "t"), part_rows=part_rows, block_queries=40)
    assert sorted(map(tuple, got.collect())) == brute(rows32, 5, 4)


def test_empty(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert mtree.top_k(frame, lambda c: F.lit(True), Scratch(spark, "t")).count() == 0


def clustered(n, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, 16)) * 4
    return [(i, (centres[i % 20] + 0.05 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(n)]


def test_clusters_are_passed_over(spark):
    rows = clustered(3000)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = mtree.top_k(frame, lambda c: c % 50 == 0, Scratch(spark, "t"), part_rows=150, stats=True).collect()
    assert sorted(tuple(r)[:4] for r in got) == brute(rows, 5, 50)
    computed = {r.query_id: r.computed for r in got}
    assert len(computed) == 60 and sum(computed.values()) / 60 < 3000 / 5


def test_tree_searches_with_a_floor():
    rows = clustered(900, 7)
    ids, v = np.array([r[0] for r in rows]), np.floor(256 * np.array([r[1] for r in rows], dtype=np.float64)).astype(np.int64)
    tree = mtree.MTree(ids, v, page=16)
    again = mtree.MTree.load(tree.dump())
    for q in range(0, 900, 90):
        scores = sorted(((-int(x), int(i)) for i, x in enumerate(v @ v[q]) if i != q))[:5]
        want = [(-s, i) for s, i in scores]
        assert tree.search(v[q], q, 5) == again.search(v[q], q, 5) == tree.search(v[q], q, 5, want[-1][0]) == want
        assert tree.search(v[q], q, 5, want[2][0]) == [x for x in want if x[0] >= want[2][0]]


def test_fewer_than_k_and_one_row(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5]), (50, [1.0])], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, mtree.top_k(frame, lambda c: c % 50 == 0, Scratch(spark, "t")).collect()))
    assert got == [(0, 1, 1, 128 * 256 + 128 * 512)]
