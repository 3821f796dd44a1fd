"""Resharding by minimum-cost flow (operator 7).

Rows lie in old shards, each cut into blocks by a hash of the text, so equal texts share a block and the number of blocks
has a bound that does not follow the table. Only a text whose own copies exceed an even share of a new shard is cut, by a
hash of the id, and only into pieces of several rows each. Each block is a folder of files. From the old shards' sizes and
the new shards' capacities a minimum-cost flow (a byte that stays costs 0, one that moves costs 1) gives the bytes each pair
of shards exchanges; blocks are chosen to make up those flows. A last pass evens out what is left of the differences: first
it trades blocks that move anyway, and only if those cannot help it moves blocks that would stay. Then the files of moved
blocks alone are rewritten under their new shard; all others stay as they are.

Size: the text's bytes in UTF-8 plus 1; null texts have none. Repeated rows are stored as often as they come. Slots are
numbered from 0 in each shard, by block, then by a hash of the id, then by id. An empty table has no rows and moves none.
Texts as large as a shard make shards as unequal as they are.
"""

from __future__ import annotations

import bisect
import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliary.llm.common import Scratch


def min_cost_flow(supply: list[int], demand: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Successive shortest paths with potentials on the bipartite graph; the sums must be equal. Returns the flows."""
    n, m = len(supply), len(demand)
    flow = [[0] * m for _ in range(n)]
    left, want = supply[:], demand[:]
    high = [0] * (n + m)
    while any(left):
        dist: list[float] = [float("inf")] * (n + m)
        back = [-1] * (n + m)
        queue = [(0, i) for i in range(n) if left[i]]
        for _, i in queue:
            dist[i] = 0
        while queue:
            d, u = heapq.heappop(queue)
            if d > dist[u]:
                continue
            steps = ((n + j, cost[u][j]) for j in range(m)) if u < n else ((i, -cost[i][u - n]) for i in range(n) if flow[i][u - n])
            for v, c in steps:
                if (e := d + c + high[u] - high[v]) < dist[v]:
                    dist[v], back[v] = e, u
                    heapq.heappush(queue, (e, v))
        end = min((n + j for j in range(m) if want[j]), key=lambda v: dist[v] + high[v])
        for v in range(n + m):
            high[v] += min(dist[v], dist[end])
        path, v = [], end
        while back[v] >= 0:
            path.append((back[v], v))
            v = back[v]
        push = min([left[v], want[end - n], *(flow[b][a - n] for a, b in path if a >= n)])
        for a, b in path:
            if a < n:
                flow[a][b - n] += push
            else:
                flow[b][a - n] -= push
        left[v] -= push
        want[end - n] -= push
    return flow


def transfers(blocks: dict[tuple[int, int], int], n_new: int, rounds: int = 20_000, even: float = 0.001) -> dict[tuple[int, int], int]:
    """The new shard of each block (old shard, block); loads differ by at most `even` of their mean, if blocks allow it."""
    n_old = max((s for s, _ in blocks), default=-1) + 1
    supply = [0] * n_old
    for (s, _), size in blocks.items():
        supply[s] += size
    total = sum(supply)
    demand = [total // n_new + (j < total % n_new) for j in range(n_new)]
    flow = min_cost_flow(supply, demand, [[0 if i == j else 1 for j in range(n_new)] for i in range(n_old)])
    home = {}
    for i in range(n_old):
        mine = sorted((b for b in blocks if b[0] == i), key=lambda b: (-blocks[b], b))
        want = {j: f for j, f in enumerate(flow[i]) if f and j != i}
        leave = set(mine) if i >= n_new else _nearest_subset({b: blocks[b] for b in mine}, sum(want.values()))
        for b in mine:  # the largest blocks first, each to the outward flow with the most room
            home[b] = max(want, key=lambda j: (want[j], -j)) if b in leave else i
            if b in leave:
                want[home[b]] -= blocks[b]
    return _even_out(blocks, home, n_new, demand, rounds, even)


def _nearest_subset(sizes: dict[tuple[int, int], int], target: int) -> set[tuple[int, int]]:
    """Keys whose sizes add up to nearly the target: the largest that fit, then what adding, dropping or trading one improves."""
    inside, left = set(), target
    for b in sorted(sizes, key=lambda b: (-sizes[b], b)):
        if sizes[b] <= left:
            inside.add(b)
            left -= sizes[b]
    while left:
        best = (abs(left), None, None)
        outside = sorted([(0, None), *((sizes[b], b) for b in sizes if b not in inside)], key=lambda x: (x[0], x[1] or ()))
        for size, b in [(0, None), *((sizes[b], b) for b in sorted(inside))]:
            at = bisect.bisect_left(outside, left + size, key=lambda x: x[0])
            for more, c in outside[max(0, at - 1) : at + 1]:
                if abs(left + size - more) < best[0]:
                    best = (abs(left + size - more), b, c)
        if best[1] is None and best[2] is None:
            break
        inside -= {best[1]}
        inside |= {best[2]} - {None}
        left = target - sum(sizes[b] for b in inside)
    return inside


def _trade(blocks, of: list[set], hi: int, lo: int, gap: int, free: bool):
    """(rank, block of hi, block of lo or None) of the trade that brings two shards closer: the lower the rank, the better.

    A free one makes no more bytes move and takes a tenth of the gap at least; else the bytes that it moves count against it.
    """
    added = lambda b, here, there: blocks[b] * ((b[0] != there) - (b[0] != here))
    pools = [sorted((blocks[b], b) for b in of[lo] if b[0] not in (hi, lo))]
    if not free:
        pools.append(sorted((blocks[b], b) for b in of[lo]))
    best = None
    for b in sorted(of[hi]):
        give, more = blocks[b], added(b, hi, lo)
        if free and more > 0:
            continue
        options = [(0, None)]
        for there in pools:
            at = bisect.bisect_left(there, (give - gap / 2,))  # the trade that moves half of the gap most nearly
            options += [there[k] for k in (at - 1, at) if 0 <= k < len(there)]
        for back, c in options:
            after, cost = abs(gap - 2 * (give - back)), more + (added(c, lo, hi) if c is not None else 0)
            if after < gap and not (free and (cost > 0 or 10 * after > 9 * gap)):
                rank = (max(0, cost) + after / 2, cost)
                if best is None or rank < best[0]:
                    best = (rank, b, c)
    return best


def _even_out(blocks, home, n_new: int, demand: list[int], rounds: int, even: float) -> dict[tuple[int, int], int]:
    """Moves or trades blocks between a full and an empty shard while that brings the two closer.

    Free trades of the fullest or the emptiest shard with any other come first; only where there is none, the two trade
    blocks so that more bytes move.
    """
    load = [-d for d in demand]
    of: list[set] = [set() for _ in range(n_new)]
    for b, j in home.items():
        load[j] += blocks[b]
        of[j].add(b)
    for _ in range(rounds):
        by = sorted(range(n_new), key=lambda j: (load[j], j))
        hi, lo, enough = by[-1], by[0], even * sum(demand) / n_new
        if load[hi] - load[lo] <= enough:
            break
        pairs = [(hi, lo), *((hi, j) for j in by[1:-1]), *((j, lo) for j in by[-2:0:-1])]
        tries = [*((a, b, True) for a, b in pairs if load[a] - load[b] > enough / 2), (hi, lo, False)]
        found = next(((a, b, t) for a, b, free in tries if (t := _trade(blocks, of, a, b, load[a] - load[b], free))), None)
        if found is None:
            break
        hi, lo, (_, b, c) = found
        of[hi].remove(b)
        of[lo].add(b)
        home[b] = lo
        moved = blocks[b]
        if c is not None:
            of[lo].remove(c)
            of[hi].add(c)
            home[c] = hi
            moved -= blocks[c]
        load[hi] -= moved
        load[lo] += moved
    return home


def _size(text_col: str):
    return F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long") + 1


def lay_out(docs: DataFrame, scratch: Scratch, label: str, *, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 12, n_blocks: int = 64, n_new: int = 16, piece_rows: int = 8) -> DataFrame:
    """Writes docs in folders shard=s/block=b by the hash of the text; large blocks are written by several tasks.

    A text whose copies hold more than 1 / n_new of all bytes is cut into as many pieces as it holds such shares, if a piece
    then has piece_rows rows or more: fewer would not come out even. There are less than n_new such texts.
    """
    spark = docs.sparkSession
    h = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    shard, block = F.pmod(h, F.lit(n_shards)).cast("int"), F.pmod(F.shiftright(h, 20), F.lit(n_blocks)).cast("int")
    texts = scratch.stage(docs.groupBy(h.alias("h")).agg(F.sum(_size(text_col)).alias("size"), F.count("*").alias("rows")), f"{label}-texts")
    total = texts.agg(F.sum("size")).first()[0] or 0
    hot = texts.where((F.col("size") * n_new > total) & (F.col("rows") >= piece_rows * F.ceil(F.col("size") * n_new / total))).collect() if total else []
    scratch.drop(f"{label}-texts")
    cuts = F.lit(1)
    for r in hot:
        cuts = F.when(h == r["h"], F.lit(-(-r["size"] * n_new // total))).otherwise(cuts)
    piece = F.pmod(F.xxhash64(F.col(id_col)), cuts).cast("int")
    number = F.lit(0)  # the pieces of different texts of a block are different blocks
    for k, r in enumerate(hot):
        number = F.when(h == r["h"], 1 + k * n_new + piece).otherwise(number)
    placed = docs.withColumn("shard", shard).withColumn("block", (block + number * n_blocks).cast("int"))
    placed = placed.hint("rebalance", "shard", "block")
    placed.write.mode("overwrite").partitionBy("shard", "block").parquet(scratch.path(label))
    return spark.read.schema(placed.schema).parquet(scratch.path(label))


def reshard(old: DataFrame, scratch: Scratch, label: str, n_new: int, *, text_col: str = "text") -> DataFrame:
    """old: a table laid out by lay_out. Rewrites the moved blocks' files; the result's shard and old_shard say where rows lie."""
    spark = old.sparkSession
    sizes = {(r["shard"], r["block"]): r["size"] for r in old.groupBy("shard", "block").agg(F.sum(_size(text_col)).alias("size")).collect()}
    home = transfers(sizes, n_new)
    moved = {b: j for b, j in home.items() if j != b[0]}
    if not moved:
        return old.withColumn("old_shard", F.col("shard"))
    plan = F.create_map(*[F.lit(x) for (s, b), j in sorted(moved.items()) for x in (s * 1_000_000 + b, j)])
    to = plan[F.col("shard") * 1_000_000 + F.col("block")]
    rewritten = old.where(to.isNotNull()).withColumn("old_shard", F.col("shard")).withColumn("shard", to.cast("int"))
    rewritten.hint("rebalance", "shard", "block").write.mode("overwrite").partitionBy("shard", "block").parquet(scratch.path(label))
    stay = old.where(to.isNull()).withColumn("old_shard", F.col("shard"))
    return stay.unionByName(spark.read.schema(rewritten.schema).parquet(scratch.path(label)))


def numbered(rows: DataFrame, scratch: Scratch, label: str, *, id_col: str, unit_rows: int = 50_000) -> DataFrame:
    """rows (shard, block, ...) with a slot, gapless from 0 in each shard. Hot blocks are numbered in several units."""
    rows = scratch.stage(rows, label)
    key = ["shard", "block", "old_shard"]
    parts = rows.groupBy(*key).agg(F.ceil(F.count("*") / unit_rows).alias("units"))
    dealt = rows.join(F.broadcast(parts), key).withColumn("unit", F.pmod(F.xxhash64(F.col(id_col)), F.col("units")))
    unit = [*key, "unit"]
    counts = scratch.stage(dealt.groupBy(*unit).agg(F.count("*").alias("c")), f"{label}-units")
    before = Window.partitionBy("shard").orderBy("block", "old_shard", "unit").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("first", F.coalesce(F.sum("c").over(before), F.lit(0))).select(*unit, "first")
    within = Window.partitionBy(*unit).orderBy(F.col(id_col).asc_nulls_first())
    return dealt.join(first, unit).withColumn("slot", F.col("first") + F.row_number().over(within) - 1).drop("units", "unit", "first")
