"""Hard negatives of anchors, by a dual-tree search over anchors and candidates (operator 12).

An anchor's positives are its highest-scoring rows of the same label; its hard negatives, for each positive, are the highest-scoring
rows of other labels whose score lies between `low` and all of the positive's. Scores are exact inner products of integers.

Rows are dealt to cells by the nearest of a bounded number of pivots, and cells to parts of bounded size by a hash of the id. Each part
is one tree of balls (centre, radius, least and greatest label); what is asked of the rows is dealt in blocks by the anchors' cells, a
tree each. For a node of each tree, all inner products lie in a.c +- (ra |c| + rc |a| + ra rc). A pair of nodes is passed over, with all its
anchors at once, if that interval lies under what every anchor there already has or above what it may take, or if the labels rule it
out; pairs of leaves are scored. The same intervals between cells say which parts a block visits at all. A block first visits a
part of its own cell; the scores found there go with it to the others as bounds.

Rows of one vector and label score alike, and of equal scores the smaller ids come first, so of each such group the k + 1 rows with the
smallest ids are all that any result can hold (the one more is for the anchor itself). The others are left out of the trees; all
anchors are asked for. How much the intervals pass over is the data's doing: vectors that are all equally far from each other leave nothing out.

Rows whose label or vector is null, whose vector is empty or holds a null or non-finite component, or that have no id take no part. Of
repeated rows of one id the one with the least (vector, label) counts. Vectors of different dimensions are not compared; their number is
taken to be small. Vectors may be long: a task holds a part and a block. Fewer rows than asked for give fewer; an empty table
gives none. Positives of negative score have no negatives, as no score lies in their range. Other columns may have any names.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliary.llm.common import Scratch, tidy

LAST = (1 << 63) - 1
EXACT = 1 << 53
_ASK = ["dim int", "cell int", "id long", "pos long", "label long", "v array<long>", "least long", "least_id long", "most long"]


class Tree:
    """A tree of balls over integer rows, in arrays. Rows of a node lie side by side; node 0 is the root."""

    FIELDS = ("ids", "labels", "vectors", "start", "end", "left", "right", "centre", "radius", "low", "high")

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, leaf: int = 64) -> None:
        order = np.arange(len(ids))
        nodes: list[list] = []
        todo = [(0, len(ids), -1, False)]
        while todo:
            start, end, parent, right = todo.pop()
            rows = vectors[order[start:end]].astype(np.float64)
            spread = rows.max(axis=0) - rows.min(axis=0)
            centre = rows.mean(axis=0) if spread.max() > 0 else rows[0]
            own = labels[order[start:end]]
            nodes.append([start, end, -1, -1, centre, np.sqrt(((rows - centre) ** 2).sum(axis=1).max()), own.min(), own.max()])
            if parent >= 0:
                nodes[parent][3 if right else 2] = len(nodes) - 1
            if end - start > leaf:
                one = rows[((rows - centre) ** 2).sum(axis=1).argmax()]
                other = rows[((rows - one) ** 2).sum(axis=1).argmax()]
                side = rows @ (other - one)  # between two far rows: each to the nearer, or by halves if one side is small
                near = int((side <= (other + one) @ (other - one) / 2).sum())
                middle = near if min(near, end - start - near) * 16 > end - start else (end - start) // 2
                order[start:end] = order[start:end][np.argpartition(side, middle)]
                todo += [(start, start + middle, len(nodes) - 1, False), (start + middle, end, len(nodes) - 1, True)]
        self.ids, self.labels, self.vectors, self.order = ids[order], labels[order], vectors[order], order
        self.start, self.end, self.left, self.right, self.centre, self.radius, self.low, self.high = map(np.array, zip(*nodes, strict=True))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{k: getattr(self, k) for k in self.FIELDS} | {"vectors": small(self.vectors)})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Tree:
        z, tree = np.load(io.BytesIO(data)), cls.__new__(cls)
        for k in cls.FIELDS:
            setattr(tree, k, z[k])
        return tree


def small(vectors: np.ndarray) -> np.ndarray:
    """The vectors in the shortest integers that hold them."""
    top = int(np.abs(vectors).max(initial=0))
    return vectors.astype(next(t for t in (np.int16, np.int32, np.int64) if top <= np.iinfo(t).max))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of rows, exact: in floating point as long as no sum can leave its integers."""
    size = lambda x: np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max(initial=0.0))
    if size(a) * size(b) < EXACT / 2:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def intervals(a: np.ndarray, ra: np.ndarray, c: np.ndarray, rc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest integer that the inner product of a row of ball a and a row of ball c can be."""
    na, nc = np.linalg.norm(a, axis=1)[:, None], np.linalg.norm(c, axis=1)[None, :]
    mid, reach = a @ c.T, ra[:, None] * nc + rc[None, :] * na + ra[:, None] * rc[None, :]
    slack = 1e-9 * ((na + ra[:, None]) * (nc + rc[None, :]) + 1)
    return np.ceil(mid - reach - slack), np.floor(mid + reach + slack)


class Search:
    """What the asks of one block find in one part. `scored` counts the products taken, `passed` the pairs of nodes passed over."""

    def __init__(self, asks: Tree, least: np.ndarray, least_id: np.ndarray, most: np.ndarray, k: int, same: bool) -> None:
        self.asks, self.k, self.same = asks, k, same
        self.least, self.least_id, self.most = least.copy(), least_id.copy(), most
        self.best: list[list[tuple[int, int]]] = [[] for _ in least]
        self.scored = self.passed = 0

    def run(self, rows: Tree) -> None:
        asks = self.asks
        low, high = intervals(asks.centre, asks.radius, rows.centre, rows.radius)
        # what the labels rule out
        if self.same:
            out = (asks.high[:, None] < rows.low[None, :]) | (asks.low[:, None] > rows.high[None, :])
        else:
            out = (asks.low[:, None] == rows.high[None, :]) & (asks.high[:, None] == rows.low[None, :])
        queue = [(-high[0, 0], 0, 0)]
        while queue:
            _, i, j = heapq.heappop(queue)
            mine = slice(asks.start[i], asks.end[i])
            if out[i, j] or high[i, j] < self.least[mine].min() or low[i, j] > self.most[mine].max():
                self.passed += 1
            elif asks.left[i] < 0 and rows.left[j] < 0:
                self._leaves(mine, rows, slice(rows.start[j], rows.end[j]))
            elif rows.left[j] < 0 or (asks.left[i] >= 0 and asks.radius[i] > rows.radius[j]):
                for x in (asks.left[i], asks.right[i]):
                    heapq.heappush(queue, (-high[x, j], x, j))
            else:
                for x in (rows.left[j], rows.right[j]):
                    heapq.heappush(queue, (-high[i, x], i, x))

    def _leaves(self, mine: slice, rows: Tree, theirs: slice) -> None:
        asks, ids = self.asks, rows.ids[theirs]
        scores = products(asks.vectors[mine], rows.vectors[theirs])
        self.scored += scores.size
        least = self.least[mine][:, None]
        good = (scores > least) | ((scores == least) & (ids[None, :] < self.least_id[mine][:, None]))
        good &= scores <= self.most[mine][:, None]
        good &= (asks.labels[mine][:, None] == rows.labels[theirs][None, :]) == self.same
        good &= asks.ids[mine][:, None] != ids[None, :]
        for r in np.flatnonzero(good.any(axis=1)).tolist():
            at, hit = mine.start + r, np.flatnonzero(good[r])
            found = heapq.nsmallest(self.k, [*((-s, x) for s, x in self.best[at]), *zip((-scores[r, hit]).tolist(), ids[hit].tolist(), strict=True)])
            self.best[at] = [(-s, x) for s, x in found]
            if len(found) == self.k:
                self.least[at], self.least_id[at] = -found[-1][0], found[-1][1]


class Space:
    """The pivots of each dimension, and how far and in how many parts their cells reach."""

    def __init__(self, dims: list[int], drawn: dict[int, np.ndarray]) -> None:
        self.pivots = {d: np.unique(drawn[d], axis=0).astype(np.float64) if d in drawn else np.zeros((1, d)) for d in dims}
        self.reach = {d: np.zeros(len(p)) for d, p in self.pivots.items()}
        self.parts = {d: np.zeros(len(p), np.int64) for d, p in self.pivots.items()}

    def cell(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of each vector, and how far that is."""
        pivots, x = self.pivots[vectors.shape[1]], vectors.astype(np.float64)
        nearest = np.concatenate([((pivots**2).sum(axis=1)[None, :] - 2 * part @ pivots.T).argmin(axis=1) for part in np.array_split(x, -(-len(x) // 1000))])
        return nearest, np.linalg.norm(x - pivots[nearest], axis=1)

    def visits(self, dim: int, cell: int, block: int, least: int, most: int, home: bool):
        """Cells and parts that a block of asks visits: first one of its own cell or the next that has any, then all others that may matter."""
        parts = self.parts[dim]
        own = cell if parts[cell] else int(np.where(parts > 0, ((self.pivots[dim] - self.pivots[dim][cell]) ** 2).sum(axis=1), np.inf).argmin())
        first = (own, block % int(parts[own]))
        if home:
            yield first
            return
        low, high = intervals(self.pivots[dim][cell : cell + 1], self.reach[dim][cell : cell + 1], self.pivots[dim], self.reach[dim])
        for c in np.flatnonzero((parts > 0) & (high[0] >= least) & (low[0] <= most)).tolist():
            yield from ((c, p) for p in range(int(parts[c])) if (c, p) != first)


def _matrix(column) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _long(column) -> np.ndarray:
    return column.to_numpy().astype(np.int64)


def _round(asks: DataFrame, trees: DataFrame, space: Space, scratch: Scratch, label: str, *, k: int, same: bool, home: bool, block_asks: int) -> DataFrame:
    """asks as _ASK. One row for each find: id, pos, hit, score."""
    spark = asks.sparkSession
    shared = spark.sparkContext.broadcast(space)
    sizes = asks.groupBy("dim", "cell").agg(F.ceil(F.count("*") / block_asks).alias("blocks"))  # as many as there are cells
    dealt = asks.join(F.broadcast(sizes), ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by([("id", "ascending"), ("pos", "ascending")])
        tree = Tree(_long(t.column("id")), _long(t.column("label")), _matrix(t.column("v")))
        more = {c: _long(t.column(c))[tree.order] for c in ("pos", "least", "least_id", "most")}
        out = io.BytesIO()
        np.savez(out, **more)
        one = lambda c: t.column(c)[:1]
        return pa.table({"dim": one("dim"), "cell": one("cell"), "block": one("block"), "least": pa.array([int(more["least"].min())]), "most": pa.array([int(more["most"].max())]), "asks": pa.array([tree.dump()], pa.binary()), "more": pa.array([out.getvalue()], pa.binary())})

    blocks = scratch.stage(dealt.groupBy("dim", "cell", "block").applyInArrow(build, "dim int, cell int, block long, least long, most long, asks binary, more binary"), f"{label}-blocks")

    def visiting(batches):
        for batch in batches:
            for b in batch.to_pylist():
                for_block = list(shared.value.visits(b["dim"], b["cell"], b["block"], b["least"], b["most"], home))
                for i in range(0, len(for_block), 10_000):
                    cells, parts = zip(*for_block[i : i + 10_000], strict=True)
                    same_for = lambda name, kind, n=len(cells), b=b: pa.array([b[name]] * n, kind)
                    yield pa.RecordBatch.from_arrays([same_for("dim", pa.int32()), same_for("cell", pa.int32()), same_for("block", pa.int64()), pa.array(cells, pa.int32()), pa.array(parts, pa.int64())], names=["dim", "cell", "block", "to_cell", "to_part"])

    visits = scratch.stage(blocks.select("dim", "cell", "block", "least", "most").mapInArrow(visiting, "dim int, cell int, block long, to_cell int, to_part long"), f"{label}-visits")
    met = visits.join(blocks.drop("least", "most"), ["dim", "cell", "block"]).join(trees, ["dim", "to_cell", "to_part"]).select("asks", "more", "tree")

    @tidy
    def run(batches):
        for batch in batches:
            for a, m, t in zip(*batch.columns, strict=True):
                asks, more = Tree.load(a.as_py()), np.load(io.BytesIO(m.as_py()))
                search = Search(asks, more["least"], more["least_id"], more["most"], k, same)
                search.run(Tree.load(t.as_py()))
                found = [(i, p, x, s) for i, p, best in zip(asks.ids.tolist(), more["pos"].tolist(), search.best, strict=True) for s, x in best]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["id", "pos", "hit", "score"])

    out = scratch.stage(met.mapInArrow(run, "id long, pos long, hit long, score long"), f"{label}-found")
    scratch.drop(f"{label}-blocks", f"{label}-visits")
    return out


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("id", "pos").orderBy(F.desc("score"), "hit")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _searched(asks: DataFrame, trees: DataFrame, space: Space, scratch: Scratch, label: str, **how) -> DataFrame:
    """id, pos, rank, hit, score: the k best of each ask over all parts."""
    asks = scratch.stage(asks, f"{label}-asks")
    near = _round(asks, trees, space, scratch, f"{label}-near", home=True, **how)
    last = _best(near, how["k"]).where(F.col("rank") == how["k"]).select("id", "pos", F.col("score").alias("_s"), F.col("hit").alias("_h"))
    bounded = asks.join(last, ["id", "pos"], "left").withColumn("least", F.coalesce("_s", "least")).withColumn("least_id", F.coalesce("_h", "least_id"))
    rest = _round(bounded.select(*[x.split()[0] for x in _ASK]), trees, space, scratch, f"{label}-rest", home=False, **how)
    return _best(near.union(rest), how["k"])


def mine(
    vectors: DataFrame, anchors: Callable[[Column], Column], scratch: Scratch, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256, positives: int = 5, negatives: int = 5,
    low: tuple[int, int] = (80, 100), part_rows: int = 4000, max_cells: int = 1000, block_asks: int = 2000,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, for the anchors that `anchors` (a Column of the id) admits.

    A negative's score is at least low[0] / low[1] of the positive's.
    """
    spark = vectors.sparkSession
    v = F.col("_v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("_v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad)
    rows = rows.select("id", F.struct(F.transform(v, lambda x: F.floor(x * F.lit(float(scale)))).alias("v"), "label").alias("r"))
    rows = scratch.stage(rows.groupBy("id").agg(F.min("r").alias("r")).select("id", "r.label", "r.v", F.size("r.v").alias("dim")), "rows")
    k = max(positives, negatives)
    alike = Window.partitionBy("dim", "label", "v").orderBy("id")
    kept = scratch.stage(rows.withColumn("_n", F.row_number().over(alike)).where(F.col("_n") <= k + 1).drop("_n"), "kept")
    sizes = {r["dim"]: r["n"] for r in kept.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not sizes:
        return spark.createDataFrame([], schema)
    rate = F.lit(0.0)
    for d, n in sizes.items():
        if n > part_rows:
            rate = F.when(F.col("dim") == d, F.lit(min(max_cells, -(-n // part_rows)) / n)).otherwise(rate)
    drawn: dict[int, list] = {}
    for r in kept.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 40)) < rate * (1 << 40)).select("dim", "v").collect():
        drawn.setdefault(r["dim"], []).append(r["v"])
    space = Space(list(sizes), {d: np.array(x, dtype=np.int64) for d, x in drawn.items()})
    pivots = spark.sparkContext.broadcast(space)

    def place(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                part = batch.take(pa.array(np.flatnonzero(dims == d)))
                cell, away = pivots.value.cell(_matrix(part.column("v")))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "label", "v", "dim")), pa.array(cell.astype(np.int32)), pa.array(away)], names=["id", "label", "v", "dim", "cell", "away"])

    placed_as = "id long, label long, v array<long>, dim int, cell int, away double"
    placed = scratch.stage(kept.select("id", "label", "v", "dim").mapInArrow(place, placed_as), "placed")
    asked = scratch.stage(rows.where(anchors(F.col("id"))).select("id", "label", "v", "dim").mapInArrow(place, placed_as).drop("away"), "anchors")
    cells = placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("away").alias("reach")).collect()  # at most max_cells a dimension, about
    for c in cells:
        space.reach[c["dim"]][c["cell"]], space.parts[c["dim"]][c["cell"]] = c["reach"] * (1 + 1e-9) + 1e-6, -(-c["n"] // part_rows)
    parts = spark.createDataFrame([(c["dim"], c["cell"], -(-c["n"] // part_rows)) for c in cells], "dim int, cell int, parts long")
    dealt = placed.join(F.broadcast(parts), ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        tree = Tree(_long(t.column("id")), _long(t.column("label")), _matrix(t.column("v")))
        return pa.table({"dim": t.column("dim")[:1], "to_cell": t.column("cell")[:1], "to_part": t.column("part")[:1], "tree": pa.array([tree.dump()], pa.binary())})

    trees = scratch.stage(dealt.select("id", "label", "v", "dim", "cell", "part").groupBy("dim", "cell", "part").applyInArrow(build, "dim int, to_cell int, to_part long, tree binary"), "trees")
    scratch.drop("placed", "kept")
    none = F.lit(-LAST)
    first = asked.select("dim", "cell", "id", F.col("id").alias("pos"), "label", "v", none.alias("least"), F.lit(LAST).alias("least_id"), F.lit(LAST).alias("most"))
    near = scratch.stage(_searched(first, trees, space, scratch, "positives", k=positives, same=True, block_asks=block_asks).select("id", F.col("hit").alias("pos"), F.col("score").alias("most")), "positive")
    least = F.expr(f"({low[0]} * most + {low[1] - 1}) div {low[1]}")  # rounded up
    second = near.where("most >= 0").join(asked, "id").withColumn("least", least).withColumn("least_id", F.lit(LAST)).select(*[x.split()[0] for x in _ASK])
    found = _searched(second, trees, space, scratch, "negatives", k=negatives, same=False, block_asks=block_asks)
    return found.join(near, ["id", "pos"]).select(F.col("id").alias("anchor_id"), F.col("pos").alias("positive_id"), "rank", F.col("hit").alias("negative_id"), F.col("most").alias("positive_score"), F.col("score").alias("negative_score"))
