"""N-gram Jaccard self-join by T-occurrence search (operator 2).

A document is the set of its distinct word shingles; two link when their Jaccard similarity reaches num / den.

1. Documents with equal sets are one class; its least id stands for it.
2. Sets that link have sizes in a common or adjacent size range, which bounds the number d of shingles in which they
   differ. From t = 8/9 on, a hash deals the shingles of a set to d + 1 parts, so two sets that link have equal parts; what a part
   holds is a signature with its range. Unrelated sets seldom agree in the eight or so shingles of a part, so signatures that are shared by
   chance do not grow with the square of the table. Two empty parts say nothing: a few more parts make up for them, and a set
   with more empty ones than that is dealt again by another hash. Under lower t parts would hold few shingles. There the
   shingles have one order, the frequent ones last, and sets that link share a shingle among the first n - ceil(t * n) + 1
   of each (the prefix filter, exact under any order); such a shingle with its range is a signature. The order needs the
   frequent shingles only: those met often within an input partition are counted over all of them, and the most frequent
   `ranked` of them are broadcast; all others come first, by hash.
3. Classes that share a signature form coarse components. Of a signature of few classes, pairs count only if the parity
   bitmaps of their sets differ in no more bits than their sizes let the sets differ (a bound that drops no link), so
   passages that few documents share do not chain them. Signatures of more classes are compared within a task, which passes on
   a spanning forest of what the bitmaps leave; of one of very many classes, all hang on its least. The latter are joined
   up first: what they hold together needs no comparison, so a large group of near copies is not paired with itself.
4. A coarse component is dealt to blocks of bounded size. A task indexes the shingles of its sets and runs DivideSkip for
   each of them: of the overlap T that a link needs, L = T / (mu * log2(longest list) + 1) longest lists are set aside. The
   others are merged by a heap for sets that occur T - L times, and lists skip over what cannot; the long lists are probed by
   binary search, and sets that reach the overlap their sizes need are linked. What earlier links already join is passed over, and so is,
   before any list is read, what the sets' parity bitmaps rule out. First each block meets itself and
   the first block. Then only sets outside the component's largest part so far can have links that are missing: these
   meet all blocks. So a group of near copies, which the first block joins up, costs tasks in proportion to its size.
5. Links of components of several blocks are joined up by connected components.

All copies are in their class and no link between different sets is lost; what leaves a task is a spanning forest.

Null and empty texts, and texts without words, have size 0 and link with nothing. Fewer words than the shingle is long
make one shingle. Repeated rows are members of the same class. Null ids take part, but never stand for a class that
has another id.
"""

from __future__ import annotations

import bisect
import heapq
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliary.llm.common import Scratch, bit_filter, tidy
from foliary.llm.components import components

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M1
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; A-Z are lower-cased, words are split at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = min(size, len(words))
    h = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        h = _mix(h * _M3 + hashes[k : len(words) - n + 1 + k])
    return np.unique(h)


class Ranges:
    """Size ranges, the parts of each, and the signatures of a set."""

    #: So often a set with many empty parts is dealt to parts; the last time, empty parts are signatures, too.
    ROUNDS = 6

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.by_parts = 8 * (den - num) <= num
        self.starts = [1]
        while self.starts[-1] < 1 << 40:
            b = self.starts[-1]
            self.starts.append(max(b + 1, b * den**3 // num**3))
        self.starts_at = np.array(self.starts)
        self.spare = [self._spare(k) for k in range(len(self.starts) - 1)]

    def differ(self, k: int) -> int:
        """The most shingles in which two linked sets may differ, the smaller of which has a size in range k."""
        small = self.starts[k + 1] - 1
        return (self.den - self.num) * (small + small * self.den // self.num) // (self.den + self.num)

    def of(self, n: int) -> list[int]:
        k = int(np.searchsorted(self.starts_at, n, side="right")) - 1
        return [k, k - 1] if k and self.num * n < self.den * self.starts[k] and -(-self.num * n // self.den) < self.starts[k] else [k]

    def _spare(self, k: int) -> int:
        """Parts beyond differ(k) + 1: about as many as stay empty in a set of the range."""
        empty = (self.differ(k) + 1) * math.exp(-self.starts[k] / (self.differ(k) + 1))
        return int(empty + 3 * math.sqrt(empty))

    def parts(self, h: np.ndarray, k: int) -> np.ndarray:
        """Signatures in range k; sets that link and differ in differ(k) shingles at most have one in common.

        Of the parts, spare + 1 at least are equal in both. If either set has no more empty ones than spare, an equal one is
        not empty; otherwise both are dealt again.
        """
        m, found = self.differ(k) + 1 + self.spare[k], []
        for again in range(self.ROUNDS):
            at = _mix(h + _mix(np.array([again], np.uint64) * _M3 + np.uint64(k))) % np.uint64(m)
            sums = np.zeros(m, np.uint64)
            np.add.at(sums, at, _mix(h + _M2))
            full = np.bincount(at.astype(np.int64), minlength=m) > 0
            sigs = _mix(sums + _mix(np.arange(m, dtype=np.uint64) + _mix(np.array([k * self.ROUNDS + again], np.uint64))))
            enough = m - int(full.sum()) <= self.spare[k]
            found.append(sigs[full] if enough or again < self.ROUNDS - 1 else sigs)
            if enough:
                break
        return np.concatenate(found)

    def signatures(self, h: np.ndarray, order: Order | None) -> np.ndarray:
        ks = [k for k in self.of(len(h)) if self.differ(k)] if len(h) else []
        if not ks:  # sets of these sizes link only if they are equal
            return np.zeros(0, np.int64)
        if self.by_parts:
            return np.concatenate([self.parts(h, k) for k in ks]).view(np.int64)
        first = order.first(h, len(h) + self.num * len(h) // -self.den + 1)
        return np.concatenate([_mix(first + _mix(np.array([k], np.uint64))) for k in ks]).view(np.int64)


class Order:
    """Shingles by frequency: `hashes` are the frequent ones, sorted, and `rank` their places, the most frequent last."""

    def __init__(self, hashes: np.ndarray, rank: np.ndarray) -> None:
        self.hashes, self.rank = hashes, rank

    def first(self, h: np.ndarray, n: int) -> np.ndarray:
        if not len(self.hashes):
            return h[:n]
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        place = np.where(self.hashes[at] == h, self.rank[at], 0)
        return h[np.argsort(place, kind="stable")[:n]]


def parity(h: np.ndarray, size: int | None = None) -> bytes:
    """Bit b is the parity of the shingles that fall on b; two sets differ in at least as many shingles as bits."""
    size = size or (1 << max(6, int(len(h) - 1).bit_length()) if len(h) else 64)
    bits = np.bincount((_mix(h + _M1) % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def may_link(n_a: int, a: bytes, n_b: int, b: bytes, num: int, den: int) -> bool:
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    if len(x) < len(y):  # sizes are powers of two, so the larger folds onto the smaller
        y = np.bitwise_xor.reduce(np.unpackbits(y).reshape(-1, len(x) * 8), axis=0)
        x = np.unpackbits(x)
    return int(np.bitwise_count(x ^ y).sum()) <= (den - num) * (n_a + n_b) // (den + num)


def _digest(h: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(h.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def frequent(docs: DataFrame, size: int, often: int, ranked: int) -> Order:
    """Counts shingles over distinct sets. At most `ranked` of them reach the driver."""
    schema = pa.schema([("h", pa.int64()), ("c", pa.int64())])

    @tidy
    def run(batches):
        seen, held, n = set(), [], 0

        def out():
            found, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            keep = counts >= often
            return pa.RecordBatch.from_arrays([pa.array(found[keep].view(np.int64)), pa.array(counts[keep])], schema=schema)

        for batch in batches:
            for text in batch.column(1):
                h = shingles(text.as_py(), size)
                digest = _digest(h)
                if digest in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(digest)
                held.append(h)
                n += len(h)
                if n > 3_000_000:
                    yield out()
                    held, n = [], 0
        yield out()

    total = docs.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "h").limit(ranked)
    rows = total.toPandas()
    hashes, rank = rows.h.to_numpy(dtype=np.int64).view(np.uint64), np.arange(len(rows), 0, -1)
    by = np.argsort(hashes)
    return Order(hashes[by], rank[by])


def describe(docs: DataFrame, size: int, ranges: Ranges, order: Order | None) -> DataFrame:
    """id, th, n, h1, h2 (the set's digest), sigs and parity bits; docs has id, t, th. A set's last two are given once for each input partition at least."""
    schema = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("sigs", pa.list_(pa.int64())), ("bits", pa.binary())])
    shared = docs.sparkSession.sparkContext.broadcast((ranges, order))

    @tidy
    def run(batches):
        (ranges, order), seen = shared.value, set()
        for batch in batches:
            rows = []
            for i, text, th in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                h = shingles(text.as_py(), size)
                digest = _digest(h)
                if len(seen) > 200_000:
                    seen.clear()
                again = digest in seen
                rows.append((i, th, len(h), *digest, None if again else ranges.signatures(h, order), None if again else parity(h)))
                seen.add(digest)
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return docs.mapInArrow(run, "id long, th long, n long, h1 long, h2 long, sigs array<long>, bits binary")


def merge_skip(lists: list[list[int]], least: int) -> list[tuple[int, int]]:
    """(value, number of lists) of the values that are in at least so many of the sorted lists.

    Where the heap's top is in too few, as many more heads as could not make up the number without the next are taken off,
    and their lists go on from the first value that is not less than the next top.
    """
    found, at = [], [0] * len(lists)
    heap = [(run[0], k) for k, run in enumerate(lists) if run]
    heapq.heapify(heap)
    while len(heap) >= least:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= least:
            found.append((top, len(popped)))
            upto = top + 1
        else:
            while heap and len(popped) < least - 1:
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                break
            upto = heap[0][0]
        for k in popped:
            at[k] = bisect.bisect_left(lists[k], upto, at[k])
            if at[k] < len(lists[k]):
                heapq.heappush(heap, (lists[k][at[k]], k))
    return found


def divide_skip(sets: list[np.ndarray], side: np.ndarray, label: np.ndarray, num: int, den: int, mu: float = 0.01) -> np.ndarray:
    """Least position in the component of each set. Equal labels are joined already; two sets of side 0 are not compared."""
    n_sets = len(sets)
    order = np.array(sorted(range(n_sets), key=lambda i: len(sets[i])), dtype=np.int64)
    sets = [sets[i] for i in order]
    side, label = side[order], label[order]
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(n_sets), sizes)
    by = np.argsort(tokens, kind="stable")
    vocab, starts, counts = np.unique(tokens[by], return_index=True, return_counts=True)
    postings = owner[by]
    keys = np.repeat(np.arange(len(vocab)), counts) * n_sets + postings
    _, first, same = np.unique(label, return_index=True, return_inverse=True)
    root = first[same]
    width = 1 << min(13, max(6, int(sizes[-1]).bit_length()))
    bits = np.stack([np.frombuffer(parity(s, width), np.uint64) for s in sets])
    for q in range(n_sets):
        n = int(sizes[q])
        if not n:
            continue
        least = -(-num * n // den)
        # sets that come before, reach the size, are not joined to this one yet and do not differ in too many bits
        may = np.flatnonzero((root[:q] != root[q]) & (sizes[:q] >= least) & ((side[q] > 0) | (side[:q] > 0)))
        may = may[np.bitwise_count(bits[may] ^ bits[q]).sum(axis=1, dtype=np.int64) <= (den - num) * (n + sizes[may]) // (den + num)]
        if not len(may):
            continue
        asked = np.zeros(n_sets, dtype=bool)
        asked[may] = True
        lists = np.searchsorted(vocab, sets[q])
        ranked = lists[np.argsort(counts[lists], kind="stable")]
        need = -(-num * (n + least) // (den + num))
        n_long = min(need - 1, int(need / (mu * np.log2(max(2, counts[ranked[-1]])) + 1)))
        short, long = ranked[: n - n_long], ranked[n - n_long :]
        # what the short lists hold of those
        length = counts[short]
        of = np.repeat(np.arange(len(short)), length)
        run = postings[np.arange(len(of)) - np.repeat(np.cumsum(length) - length, length) + starts[short][of]]
        of, run = of[asked[run]], run[asked[run]]
        if len(run) < need - n_long:
            continue
        for d, overlap in merge_skip([x.tolist() for x in np.split(run, np.flatnonzero(np.diff(of)) + 1)], need - n_long):
            if root[d] == root[q]:
                continue
            probe = long * n_sets + d
            at = np.minimum(np.searchsorted(keys, probe), len(keys) - 1)
            overlap += int((keys[at] == probe).sum())
            if den * overlap >= num * (n + int(sizes[d]) - overlap):
                a, b = sorted((int(root[d]), int(root[q])))
                root[root == b] = a
    place = np.empty(n_sets, dtype=np.int64)
    for r in np.unique(root):
        members = order[root == r]
        place[members] = members.min()
    return place


def _plausible(pairs: DataFrame, bitmaps: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose bitmaps do not rule out a link."""
    bitmaps = bit_filter(bitmaps, F.col("h1"), pairs.select("a").union(pairs.select("b")), "a").groupBy("h1", "n").agg(F.min("bits").alias("bits"))
    of = lambda x: bitmaps.select(F.col("h1").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))

    @tidy
    def run(batches):
        for batch in batches:
            a, b, *rest = (c.to_pylist() for c in batch.columns)
            keep = [may_link(*x, num, den) for x in zip(*rest, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, k in zip(c, keep, strict=True) if k], pa.int64()) for c in (a, b)], names=["a", "b"])

    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "n_a", "bits_a", "n_b", "bits_b")
    return both.mapInArrow(run, "a long, b long")


def _forest(h1: np.ndarray, home: np.ndarray, n: np.ndarray, bits: list[bytes], num: int, den: int) -> list[tuple[int, int]]:
    """Pairs of sets of different homes whose bitmaps, folded to the shortest one's length, do not rule out a link; no more than join them up."""
    width = min(map(len, bits))
    folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(b, np.uint8).reshape(-1, width), axis=0) for b in bits])
    folded = np.ascontiguousarray(folded).view(np.uint64)
    _, root = np.unique(home, return_inverse=True)
    found = []
    step = max(1, (1 << 20) // folded.size)
    for low in range(0, len(h1), step):
        i = np.arange(low, min(low + step, len(h1)))
        apart = np.bitwise_count(folded[i][:, None] ^ folded[None]).sum(axis=2, dtype=np.int64)
        near = (apart <= (den - num) * (n[i][:, None] + n[None]) // (den + num)) & (root[i][:, None] != root[None])
        for a, b in zip(*np.nonzero(near), strict=True):
            if root[i[a]] != root[b]:
                found.append((int(h1[i[a]]), int(h1[b])))
                root[root == root[b]] = root[i[a]]
    return found


def _compared(met: DataFrame, bitmaps: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (a, b) within signatures; met has sig, h1 and home. Rows of a signature follow each other in one task, which holds one signature at a time."""
    several = met.groupBy("sig").agg(F.min("home").alias("low"), F.max("home").alias("high")).where("low <> high").select("sig")
    met = met.join(several, "sig")
    bitmaps = bit_filter(bitmaps, F.col("h1"), met, "h1").groupBy("h1", "n").agg(F.min("bits").alias("bits"))
    rows = met.join(bitmaps, "h1").select("sig", "h1", "home", "n", "bits").repartition("sig").sortWithinPartitions("sig")

    @tidy
    def run(batches):
        sig, held = None, {}

        def out():
            edges = []
            if len(held) > 1:
                h1, home, n, bits = zip(*held.values(), strict=True)
                edges = _forest(np.array(h1), np.array(home), np.array(n), list(bits), num, den)
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for s, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != sig:
                    yield out()
                    sig, held = s, {}
                held[row[0], row[2]] = row
        yield out()

    return rows.mapInArrow(run, "a long, b long").distinct()


def _linked(source: DataFrame, dealt: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Runs the tasks (root, bi, bj) of dealt: r and the links (a, b), by h1, of a spanning forest of each task's sets."""
    schema = pa.schema([("r", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def task(t: pa.Table) -> pa.Table:
        found: dict[tuple[int, int], list] = {}
        for rep, h1, h2, side, label, text in zip(*(t.column(c).to_pylist() for c in ("rep", "h1", "h2", "side", "label", "t")), strict=True):
            if (h1, h2) in found:
                found[h1, h2][1] = max(found[h1, h2][1], side)
                continue
            h = shingles(text, size)
            if _digest(h) == (h1, h2):  # a row of the same id may hold another text
                found[h1, h2] = [rep, side, label, h]
        rows = sorted((x[0], h1, x) for (h1, _), x in found.items())
        if len(rows) < 2:
            return schema.empty_table()
        nodes, rows = [x[1] for x in rows], [x[2] for x in rows]
        place = divide_skip([x[3] for x in rows], np.array([x[1] for x in rows]), np.array([x[2] for x in rows]), num, den)
        pairs = [(nodes[p], nodes[i]) for i, p in enumerate(place.tolist()) if p != i]
        return pa.table([pa.array([t.column("r")[0].as_py()] * len(pairs), pa.int64()), pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], schema=schema)

    texts = bit_filter(source, F.col("id"), dealt, "rep").join(dealt, F.col("id") == F.col("rep")).select("rep", "h1", "h2", "root", "r", "bi", "bj", "side", "label", "t")
    # a task's rows are few bytes and much work, so the planner must not put many of them together
    spark = source.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, min(20_000, dealt.count() // 200))
    return texts.repartition(tasks, "root", "bi", "bj").groupBy("root", "bi", "bj").applyInArrow(task, "r long, a long, b long")


def link(
    docs: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text", size: int = 3, num: int = 90, den: int = 100, block_shingles: int = 1_500_000, block_docs: int = 500, often: int = 3, ranked: int = 200_000, few: int = 12, many: int = 1000,
) -> DataFrame:
    """One row per row of docs: id, th (a hash of the text), n (shingles), grp (which no other component has) and component (the least id that links reach, its own included)."""
    source, lit0 = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t")).withColumn("th", F.xxhash64("t")), F.lit(0).cast("long")
    ranges = Ranges(num, den)
    sets = scratch.stage(describe(source, size, ranges, None if ranges.by_parts else frequent(source, size, often, ranked)), "sets")
    classes = scratch.stage(sets.where("n > 0").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.max("n").alias("n")), "classes")
    signed = sets.where("sigs is not null").select("h1", F.explode("sigs").alias("sig"))
    shared = signed.groupBy("sig").agg(F.min("h1").alias("low"), F.max("h1").alias("high"), F.count("*").alias("c")).where("low <> high").select("sig", "low", "c")
    shared = scratch.stage(shared, "shared")
    hot, rare = shared.where(F.col("c") > many).select("sig", "low"), shared.where(F.col("c") <= many).select("sig", "c")
    hangs = bit_filter(signed, F.col("sig"), hot, "sig").join(hot, "sig").where("h1 <> low")
    hung = components(hangs.select(F.col("low").alias("a"), F.col("h1").alias("b")), scratch, "hung")
    homes = hung.select(F.col("node").alias("h1"), F.col("root").alias("home"))
    # homes are joined to sets and not to signatures, and what meets is read once
    homed = sets.where("sigs is not null").select("h1", "sigs").join(homes, "h1", "left").select("h1", F.coalesce("home", "h1").alias("home"), F.explode("sigs").alias("sig"))
    words = 1 << min(18, max(16, (rare.count() // 2).bit_length()))  # 32 bits for a signature, up to 2**24
    met = scratch.stage(bit_filter(homed, F.col("sig"), rare, "sig", words).join(rare, "sig").select("sig", "c", "h1", "home"), "met")
    groups = met.where(F.col("c") <= few).groupBy("sig").agg(F.array_sort(F.collect_set(F.struct("h1", "home"))).alias("m")).select("m").distinct()
    apart = lambda x: F.filter(F.slice("m", x + 2, F.size("m")), lambda y: y["home"] != F.col("m")[x]["home"])
    couples = F.flatten(F.transform("m", lambda x, i: F.transform(apart(i), lambda y: F.struct(x["h1"].alias("a"), y["h1"].alias("b")))))
    pairs = scratch.stage(groups.select(F.explode(couples).alias("p")).select("p.*").distinct(), "pairs")
    bitmaps = sets.where("bits is not null").select("h1", "n", "bits")
    near = _plausible(pairs, bitmaps, num, den).union(_compared(met.where(F.col("c") > few).select("sig", "h1", "home").distinct(), bitmaps, num, den))
    coarse = components(hung.select(F.col("node").alias("a"), F.col("root").alias("b")).union(near), scratch, "coarse")
    member = scratch.stage(classes.where("rep is not null").join(coarse, classes.h1 == coarse.node).select("rep", "n", "h1", "h2", "root"), "members")
    blocks = member.groupBy("root").agg(F.greatest(F.ceil(F.sum("n") / block_shingles), F.ceil(F.count("*") / block_docs)).alias("r"))
    placed = scratch.stage(member.join(blocks, "root").withColumn("blk", F.pmod(F.xxhash64("rep"), F.col("r"))), "placed")
    own = placed.select("rep", "h1", "h2", "root", "r", lit0.alias("bi"), F.col("blk").alias("bj"), F.lit(1).alias("side"), F.col("h1").alias("label"))
    pivots = placed.where("blk = 0 and r > 1").select("rep", "h1", "h2", "root", "r", lit0.alias("bi"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("r") - 1)).alias("bj"), F.lit(0).alias("side"), F.col("h1").alias("label"))
    links = scratch.stage(_linked(source, scratch.stage(own.union(pivots), "dealt"), size, num, den), "links")
    wide = placed.where("r > 1")
    parts = components(links.where("r > 1").select("a", "b"), scratch, "parts").select(F.col("node").alias("h1"), F.col("root").alias("part"))
    labelled = scratch.stage(wide.join(parts, "h1", "left").select(*wide.columns, F.coalesce("part", "h1").alias("label")), "labelled")
    largest = labelled.groupBy("root", "label").agg(F.count("*").alias("c")).groupBy("root").agg(F.max_by("label", F.struct("c", "label")).alias("main"))
    rest = labelled.join(largest, "root").where("label <> main")
    chunks = rest.groupBy("root").agg(F.greatest(F.ceil(F.sum("n") / block_shingles), F.ceil(F.count("*") / block_docs)).alias("chunks"))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    chunk = F.pmod(F.xxhash64("rep", F.lit(2)), F.col("chunks"))
    asking = rest.join(chunks, "root").select("rep", "h1", "h2", "root", "r", chunk.alias("bi"), upto("r").alias("bj"), F.lit(1).alias("side"), "label")
    asked = labelled.join(chunks, "root").select("rep", "h1", "h2", "root", "r", upto("chunks").alias("bi"), F.col("blk").alias("bj"), lit0.cast("int").alias("side"), "label")
    more = scratch.stage(_linked(source, scratch.stage(asking.union(asked), "dealt-rest"), size, num, den), "links-rest")
    whole = links.where("r = 1").select(F.col("b").alias("h1"), F.col("a").alias("lead"))
    split = components(links.where("r > 1").union(more).select("a", "b"), scratch, "split")
    lead = whole.union(split.select(F.col("node").alias("h1"), F.col("root").alias("lead")))
    grouped = scratch.stage(classes.join(lead, "h1", "left").select("h1", "h2", "rep", F.coalesce("lead", "h1").alias("grp")), "grouped")
    named = scratch.stage(grouped.join(grouped.groupBy("grp").agg(F.min("rep").alias("component")), "grp").select("h1", "h2", "grp", "component"), "named")
    scratch.drop("classes", "shared", "met", "pairs", "members", "placed", "dealt", "links", "labelled", "dealt-rest", "links-rest", "grouped")
    return sets.select("id", "th", "n", "h1", "h2").join(named, ["h1", "h2"], "left").select("id", "th", "n", "grp", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component"))


def keep_one(docs: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs without those that link to one before them, in the order of id, then of the text's hash.

    Of each group of links the first (id, text) stays, so rows of one id that hold unrelated texts all stay. Of rows that are
    equal in id and text, the first by their other columns stays. Rows without an id stay, and link nothing away.
    """
    found = scratch.stage(link(docs, scratch, id_col=id_col, text_col=text_col, **options).where("id is not null"), "found")
    lead = found.where("n > 0").groupBy("grp").agg(F.min(F.struct("id", "th")).alias("lead"))
    gone = found.where("n > 0").join(lead, "grp").where((F.col("id") != F.col("lead.id")) | (F.col("th") != F.col("lead.th"))).select("id", "th").distinct()
    gone = scratch.stage(gone, "gone")
    again = scratch.stage(found.groupBy("id", "th").count().where("count > 1").select("id", "th"), "again")
    scratch.drop("found", "sets", "named")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("th"))
    own = [F.col(f"d.`{c}`") for c in docs.columns]
    kept = rows.join(gone, ["id", "th"], "left_anti")
    if again.isEmpty():
        return kept.select(*own)
    once = kept.join(again, ["id", "th"], "left_anti").select("d")
    first = Window.partitionBy("id", "th").orderBy(F.to_json("d"))
    repeated = kept.join(again, ["id", "th"], "left_semi").withColumn("at", F.row_number().over(first)).where("at = 1").select("d")
    return once.union(repeated).select(*own)
