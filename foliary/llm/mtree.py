"""Exact top-k by inner product, by best-first search in an M-tree (operator 8).

Inner products become distances: with R the largest squared length, a vector x gains the component sqrt(R - |x|^2) and a
query q gains 0, so the squared distance is |q|^2 + R - 2 q.x, and the largest products are the nearest vectors.

Vectors are dealt to cells by the nearest of a bounded number of pivots, drawn by a hash of the id; a cell knows how far its
vectors reach. Cells of more than `part_rows` vectors, as many equal ones make them, are split by a hash of the id. Each part
becomes one M-tree of fixed-size pages: a page's entries lie within its covering radius and each entry stores its distance
to the page's pivot. A search takes pages in ascending order of their least possible distance. Before the distance to an
entry is computed, the triangle inequality on the stored parent distance may rule it out. Bounds carry a margin for rounding;
the scores themselves are exact integers, and entries that tie with the k-th are kept until the smaller id decides.

A query first searches a part of the nearest cell. The k-th score found there goes with it to those parts alone whose
cells can hold as good a one, and is the bound that searches there begin with. Trees are staged in the shared folder; the
queries of a part come in blocks of bounded size. How much is avoided is the data's doing: where vectors lie in
clusters most cells are passed over, and where all are equally far from each other, none can be (`stats` counts).

Vectors that are null, or hold null or non-finite components, take no part. Vectors of different dimensions are not
compared, and their number is taken to be small. Of repeated rows of one id, the one with the least vector counts; rows
without an id take no part. Fewer than k other vectors give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliary.llm.common import Scratch, tidy

MARGIN = 1e-6


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id and v, the vector of floor(scale * component), for the rows that take part."""
    v = F.col("_v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("_v")).where(F.col("id").isNotNull() & v.isNotNull() & ~bad)
    return rows.select("id", F.transform(v, lambda x: F.floor(x * F.lit(float(scale)))).alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def lifted(vectors: np.ndarray, top: int) -> np.ndarray:
    norms = (vectors * vectors).sum(axis=1)
    return np.hstack([vectors.astype(np.float64), np.sqrt(np.maximum(0, top - norms).astype(np.float64))[:, None]])


def far(base: float, score: float) -> float:
    """The distance that belongs to a score, and a little more; base is |q|^2 + R."""
    return float(np.sqrt(max(0.0, base - 2.0 * score))) * (1 + MARGIN) + MARGIN


class MTree:
    """A bulk-loaded M-tree over integer vectors; node k has pivot, radius, children, and their parent distances."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, page: int = 64, top: int | None = None) -> None:
        self.ids, self.vectors = ids, vectors
        self.top = int((vectors * vectors).sum(axis=1).max()) if top is None else top
        self.points = lifted(vectors, self.top)
        self.pivot: list[np.ndarray] = []
        self.radius: list[float] = []
        self.leaf: list[bool] = []
        self.entries: list[np.ndarray] = []
        self.parent: list[np.ndarray] = []
        self.root = self._load(np.arange(len(ids)), page)
        self._finish()

    def _finish(self) -> None:
        self.pivots, self.radii, self.computed = np.array(self.pivot), np.array(self.radius), 0

    def _node(self, pivot: np.ndarray, radius: float, leaf: bool, entries: np.ndarray, parent: np.ndarray) -> int:
        self.pivot.append(pivot)
        self.radius.append(radius)
        self.leaf.append(leaf)
        self.entries.append(entries)
        self.parent.append(parent)
        return len(self.pivot) - 1

    def _load(self, rows: np.ndarray, page: int) -> int:
        """Splits rows by the nearest of a few far-apart pivots, to leaves of at most a page."""
        points = self.points[rows]
        centre = points[int(np.linalg.norm(points - points.mean(axis=0), axis=1).argmin())]
        if len(rows) <= page:
            d = np.linalg.norm(points - centre, axis=1)
            order = np.argsort(d, kind="stable")
            return self._node(centre, float(d.max()), True, rows[order], d[order])
        ways = int(min(page, max(2, -(-len(rows) // page))))
        near = np.full(len(rows), np.inf)
        nearest = np.zeros(len(rows), dtype=np.int64)
        at = 0
        for k in range(ways):
            d = np.linalg.norm(points - points[at], axis=1)
            closer = d < near
            near[closer], nearest[closer] = d[closer], k
            at = int(near.argmax())
        groups = [rows[nearest == k] for k in range(ways)]
        groups = [g for g in groups if len(g)]
        if len(groups) == 1:  # all points are equal
            groups = np.array_split(rows, -(-len(rows) // page))
        kids = [self._load(g, page) for g in groups]
        d = np.array([np.linalg.norm(self.pivot[k] - centre) for k in kids])
        radius = float(np.linalg.norm(points - centre, axis=1).max())
        return self._node(centre, radius, False, np.array(kids), d)

    def search(self, query: np.ndarray, own: int | None, k: int, floor: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, id), ties to the smaller id, without the row of id `own` and, with a floor, without lower scores.

        `computed` counts the distances and products that searches of this tree compute.
        """
        q = np.append(query.astype(np.float64), 0.0)
        base = float(query @ query) + self.top
        best: list[tuple[int, int]] = []  # a heap of (score, -id), the worst first
        reach = np.inf if floor is None else far(base, floor)
        first = float(np.linalg.norm(q - self.pivots[self.root]))
        self.computed += 1
        queue = [(max(0.0, first - self.radius[self.root]), self.root, first)]
        while queue:
            bound, node, to_pivot = heapq.heappop(queue)
            if bound > reach:
                break
            slack = MARGIN * (1.0 + to_pivot)
            entries, stored = self.entries[node], self.parent[node]
            if self.leaf[node]:
                entries = entries[np.abs(to_pivot - stored) <= reach + slack]
                self.computed += len(entries)
                scores = self.vectors[entries] @ query
                for s, i in zip(scores.tolist(), self.ids[entries].tolist(), strict=True):
                    if i != own and (floor is None or s >= floor) and (len(best) < k or (s, -i) > best[0]):
                        heapq.heappush(best, (s, -i))
                        if len(best) > k:
                            heapq.heappop(best)
                if len(best) == k:
                    reach = min(reach, far(base, best[0][0]))
                continue
            entries = entries[np.abs(to_pivot - stored) - self.radii[entries] <= reach + slack]
            self.computed += len(entries)
            away = np.linalg.norm(self.pivots[entries] - q, axis=1)
            low = np.maximum(0.0, away - self.radii[entries] - slack)
            for e, d, least in zip(entries.tolist(), away.tolist(), low.tolist(), strict=True):
                if least <= reach:
                    heapq.heappush(queue, (least, e, d))
        return [(s, -i) for s, i in sorted(best, key=lambda x: (-x[0], -x[1]))]

    def dump(self) -> bytes:
        """The pages in one block of bytes, without the points, which the vectors give again."""
        out = io.BytesIO()
        sizes = np.array([len(e) for e in self.entries])
        np.savez(
            out, ids=self.ids, vectors=self.vectors.astype(np.int64), pivot=np.array(self.pivot), radius=np.array(self.radius), leaf=np.array(self.leaf), sizes=sizes,
            entries=np.concatenate(self.entries), parent=np.concatenate(self.parent), meta=np.array([self.top, self.root]),
        )
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> MTree:
        z = np.load(io.BytesIO(data))
        tree = cls.__new__(cls)
        tree.ids, tree.vectors = z["ids"], z["vectors"]
        tree.pivot, tree.radius, tree.leaf = list(z["pivot"]), z["radius"].tolist(), z["leaf"].tolist()
        cuts = np.cumsum(z["sizes"])[:-1]
        tree.entries, tree.parent = np.split(z["entries"], cuts), np.split(z["parent"], cuts)
        tree.top, tree.root = (int(x) for x in z["meta"])
        tree._finish()
        return tree


class Space:
    """The pivots of each dimension, and later the reach and the number of parts of their cells."""

    def __init__(self, tops: dict[int, int], drawn: dict[int, np.ndarray]) -> None:
        self.tops = tops
        self.pivots = {d: lifted(np.unique(drawn[d], axis=0), top) if d in drawn else np.zeros((1, d + 1)) for d, top in tops.items()}
        self.reach = {d: np.zeros(len(p)) for d, p in self.pivots.items()}
        self.parts = {d: np.zeros(len(p), np.int64) for d, p in self.pivots.items()}

    def cell(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of each vector, and how far that is."""
        d = vectors.shape[1]
        away = self._away(lifted(vectors, self.tops[d]), d)
        nearest = away.argmin(axis=1)
        return nearest, away[np.arange(len(vectors)), nearest]

    def _away(self, points: np.ndarray, d: int) -> np.ndarray:
        pivots = self.pivots[d]
        square = (points * points).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * points @ pivots.T
        return np.sqrt(np.maximum(0.0, square))

    def first(self, query: np.ndarray) -> int:
        """The cell to search first: the nearest that holds anything."""
        d = len(query)
        away = self._away(np.append(query.astype(np.float64), 0.0)[None, :], d)[0]
        return int(np.where(self.parts[d] > 0, away, np.inf).argmin())

    def within(self, query: np.ndarray, floor: int | None) -> np.ndarray:
        """The cells that may hold a score of at least the floor."""
        d = len(query)
        away = self._away(np.append(query.astype(np.float64), 0.0)[None, :], d)[0]
        base = float(query @ query) + self.tops[d]
        most = np.inf if floor is None else far(base, floor)
        margin = 1e-3 + MARGIN * away + np.sqrt(1e-13 * base)  # differences of large squares lose more than norms do
        return np.flatnonzero((away - self.reach[d] - margin <= most) & (self.parts[d] > 0))


def _matrix(column) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _searched(visits: DataFrame, trees: DataFrame, scratch: Scratch, label: str, k: int, block_queries: int) -> DataFrame:
    """visits: dim, cell, part, id, v, floor. One row for each: query_id, computed and hits, an array of (id, score)."""
    key = ["dim", "cell", "part"]
    visits = scratch.stage(visits, f"{label}-visits")
    blocks = scratch.stage(visits.groupBy(*key).agg(F.ceil(F.count("*") / block_queries).alias("blocks")), f"{label}-blocks")
    dealt = visits.join(blocks, key).withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")))
    asked = dealt.groupBy(*key, "block").agg(F.collect_list(F.struct("id", "v", "floor")).alias("asked"))
    copies = trees.join(blocks, key).select(*key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "tree")
    n_tasks = int(blocks.agg(F.sum("blocks")).first()[0] or 1)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                tree = MTree.load(batch.column("tree")[i].as_py())
                out = []
                for q in batch.column("asked")[i].as_py():
                    tree.computed = 0
                    hits = tree.search(np.array(q["v"], dtype=np.int64), q["id"], k, q["floor"])
                    out.append((q["id"], tree.computed, [{"id": x, "score": s} for s, x in hits]))
                ids, computed, hits = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(computed, pa.int64()), pa.array(hits, pa.list_(pa.struct([("id", pa.int64()), ("score", pa.int64())])))], names=["query_id", "computed", "hits"])

    pairs = copies.join(asked, [*key, "block"]).repartition(min(n_tasks, 2000), *key, "block").select("tree", "asked")
    return scratch.stage(pairs.mapInArrow(run, "query_id long, computed long, hits array<struct<id:long,score:long>>"), f"{label}-found")


def top_k(
    vectors: DataFrame, queries, scratch: Scratch, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, part_rows: int = 4000, max_cells: int = 1000, block_queries: int = 500, stats: bool = False,
) -> DataFrame:
    """query_id, rank, id, score: the k highest integer inner products of each row whose id `queries` (a Column of it) admits.

    With stats, also `computed`, the distances and products that the query's searches took.
    """
    spark = vectors.sparkSession
    square = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    rows = scratch.stage(quantized(vectors, id_col, vector_col, scale).withColumn("dim", F.size("v")).where("dim > 0").withColumn("square", square), "rows")
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max("square").alias("top")).collect()
    schema = "query_id long, rank int, id long, score long" + (", computed long" if stats else "")
    if not sizes:
        return spark.createDataFrame([], schema)
    rate = F.lit(0.0)
    for r in sizes:
        if r["n"] > part_rows:
            rate = F.when(F.col("dim") == r["dim"], F.lit(min(max_cells, -(-r["n"] // part_rows)) / r["n"])).otherwise(rate)
    drawn: dict[int, list] = {}
    for r in rows.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 40)) < rate * (1 << 40)).select("dim", "v").collect():
        drawn.setdefault(r["dim"], []).append(r["v"])
    space = Space({r["dim"]: r["top"] for r in sizes}, {d: np.array(v, dtype=np.int64) for d, v in drawn.items()})
    pivots = spark.sparkContext.broadcast(space)

    @tidy
    def place(batches):
        for batch in batches:
            ids, dims = batch.column("id"), batch.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                at = pa.array(np.flatnonzero(dims == d))
                v = batch.column("v").take(at)
                cell, away = pivots.value.cell(_matrix(v))
                yield pa.RecordBatch.from_arrays([ids.take(at), v, pa.array(np.full(len(at), d, np.int32)), pa.array(cell.astype(np.int32)), pa.array(away)], names=["id", "v", "dim", "cell", "away"])

    placed = scratch.stage(rows.select("id", "v", "dim").mapInArrow(place, "id long, v array<long>, dim int, cell int, away double"), "placed")
    cells = placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("away").alias("reach")).collect()
    for c in cells:
        space.reach[c["dim"]][c["cell"]], space.parts[c["dim"]][c["cell"]] = c["reach"], -(-c["n"] // part_rows)
    known = spark.sparkContext.broadcast(space)
    parts = spark.createDataFrame([(c["dim"], c["cell"], -(-c["n"] // part_rows)) for c in cells], "dim int, cell int, parts long")
    dealt = placed.join(F.broadcast(parts), ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        d = t.column("dim")[0].as_py()
        tree = MTree(t.column("id").to_numpy(), _matrix(t.column("v")), top=known.value.tops[d])
        return pa.table({"dim": t.column("dim")[:1], "cell": t.column("cell")[:1], "part": t.column("part")[:1], "tree": pa.array([tree.dump()], pa.binary())})

    trees = scratch.stage(dealt.select("id", "v", "dim", "cell", "part").groupBy("dim", "cell", "part").applyInArrow(build, "dim int, cell int, part long, tree binary"), "trees")
    scratch.drop("placed")
    visit = "dim int, cell int, part long, id long, v array<long>, floor long"
    names = [x.split()[0] for x in visit.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64()]

    def home(space: Space, query: np.ndarray, own: int) -> tuple[int, int]:
        cell = space.first(query)
        return cell, own % int(space.parts[len(query)][cell])

    def visiting(of):
        """Visits (cell, part) of each row, some at a time."""

        def run(batches):
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    v = np.array(row["v"], dtype=np.int64)
                    for cell, part in of(known.value, v, row):
                        out.append((len(v), cell, part, row["id"], row["v"], row.get("floor")))
                        if len(out) == 2000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                            out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        return run

    def others(space: Space, v: np.ndarray, row: dict):
        done = home(space, v, row["id"])
        for cell in space.within(v, row["floor"]).tolist():
            for part in range(int(space.parts[len(v)][cell])):
                if (cell, part) != done:
                    yield cell, part

    asked = rows.where(queries(F.col("id"))).select("id", "v")
    near = _searched(asked.mapInArrow(visiting(lambda space, v, row: [home(space, v, row["id"])]), visit), trees, scratch, "near", k, block_queries)
    floors = near.select(F.col("query_id").alias("id"), F.when(F.size("hits") >= k, F.element_at("hits", -1)["score"]).alias("floor"))
    rest = _searched(asked.join(floors, "id", "left").mapInArrow(visiting(others), visit), trees, scratch, "rest", k, block_queries)
    scratch.drop("trees", "near-visits", "rest-visits", "near-blocks", "rest-blocks")
    found = near.union(rest)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = found.select("query_id", F.explode("hits").alias("h")).select("query_id", "h.*").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if not stats:
        return best.select("query_id", "rank", "id", "score")
    return best.join(found.groupBy("query_id").agg(F.sum("computed").alias("computed")), "query_id").select("query_id", "rank", "id", "score", "computed")
