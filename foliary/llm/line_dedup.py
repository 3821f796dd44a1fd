"""Line deduplication by a segment-partition edit join (operator 6); DataFrame functions only.

Lines of at least `min_chars` characters are compared, in the order of (id, hash of the text, position). A line goes if an
equal line came earlier, or if one within `distance` edits first came before its own first occurrence. That relation is
direct: a chain of small edits does not join its ends.

1. Equal lines are counted up before anything is joined; later steps see each distinct line once.
2. Each distinct line is cut into distance + 1 segments, whose hashes with their place and the line's length form the index.
   It probes the index of its own and of up to `distance` lesser lengths with those substrings that the segment's place
   and the difference of lengths allow. By the pigeonhole principle similar lines share a segment that no edit touches.
3. A bucket of at most `few` lines gives its pairs. Lines of a larger one, as a group of near copies makes it, are cut again
   without the segment that they share: what remains of two similar lines is similar too, so the same index over the remains
   tells the bucket's lines apart. Remains shrink with each round, down to where all that is left is within the distance;
   there the first line of the bucket stands for the others. So pairs grow with the lines and not with their square.
4. Candidates lose their common prefix and suffix; between the rests a bit-parallel edit distance runs in a band of
   2 * distance + 1 diagonals, held in one integer, and stops counting beyond the distance.
5. Documents are put together again from the lines that stay.

With `per_chars`, two lines may differ by one edit in so many characters of the longer one, and by `distance` if that is more.
Then steps 2 to 4 are others: of a line that may differ by k edits the q * k + 1 least q-grams by hash are its prefix, which
holds k + 1 that do not overlap. One of those outlives the edits, so of two similar lines the one whose prefix ends first
shares such a gram with the other's prefix, at places no more than the edits apart (the pivotal prefix filter, exact under any
order). All lines that share such a gram are paired, so a large group of near copies costs its square there; no query uses it.
What is left of candidates between their common prefix and suffix goes to Spark's own banded distance.

Null texts stay null; empty texts, and lines shorter than min_chars, stay as they are. Rows that repeat in id and text are one
document that is stored twice and are treated alike. Null ids come before all others. An empty table stays empty. Columns of
the documents may have any names; one named as the result column is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.llm.common import Scratch, bit_filter


def segment(length: Column, i: int, distance: int) -> tuple[Column, Column]:
    """Start (from 0) and size of segment i of a line of that length; the last segments are the longer ones."""
    parts = distance + 1
    q = (length / parts).cast("int")
    longer = F.greatest(F.lit(0), F.lit(i - parts) + F.pmod(length, F.lit(parts)))
    return (q * i + longer).cast("int"), (q + F.when(F.pmod(length, F.lit(parts)) >= parts - i, 1).otherwise(0)).cast("int")


def probes(distance: int) -> list[tuple[int, int, int]]:
    """(less, i, off): a line looks for segment i of lines that are `less` shorter, `off` characters after its place there."""
    return [(less, i, off) for less in range(distance + 1) for i in range(distance + 1) for off in range(max(-i, less - (distance - i)), min(i, less + distance - i) + 1)]


def segment_key(line: Column, less, i: int, off: int, distance: int) -> tuple[Column, Column, Column]:
    """Hash of the substring with its place, what remains of the line without it, and its size."""
    n = F.length(line) - less
    start, size = segment(n, i, distance)
    key = F.xxhash64(F.lit(i), n, line.substr(start + off + 1, size))
    return key, F.concat(F.substr(line, F.lit(1), start + off), F.substr(line, start + off + size + 1)), size


def common_prefix(a: Column, b: Column, take) -> Column:
    """Length of the common prefix (or suffix, as `take` cuts), by binary search in powers of two."""
    most = F.least(F.length(a), F.length(b))
    steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda n, s: F.when((n + s <= most) & (take(a, n + s) == take(b, n + s)), n + s).otherwise(n))


def banded_distance(a: Column, b: Column, k: int) -> Column:
    """Edit distance of a and b, or some number over k if it is over k; a is at least as long as b, by at most k.

    The state is the vertical differences of one column within the band (up, down) and the distance on the diagonal that
    ends in the last cell. Bit t of column j stands for row j - k + t.
    """
    width = 2 * k + 1
    mask = (1 << width) - 1
    big = lambda x: F.lit(x).cast("long")
    chars = F.concat(F.array_repeat(F.lit(None).cast("string"), k), F.split(a, ""), F.array_repeat(F.lit(None).cast("string"), width))
    extra = F.length(a) - F.length(b)
    start = F.struct(big(mask & ~((1 << k) - 1)).alias("up"), big(0).alias("down"), extra.cast("int").alias("d"), F.lit(0).alias("j"))

    def step(s: Column, c: Column) -> Column:
        match = big(0)
        for t in range(width):
            match = match.bitwiseOR(F.when(F.get(chars, s["j"] + t) == c, big(1 << t)).otherwise(big(0)))
        # each line names one vector of the column, so that it is computed once
        v = F.transform(F.array(F.struct(s["up"].alias("up"), s["down"].alias("down"), match.alias("m"))), lambda x: F.struct(
            x["up"].alias("up"), x["down"].alias("down"), ((x["m"].bitwiseAND(x["up"]) + x["up"]).bitwiseXOR(x["up"])).bitwiseOR(x["m"]).bitwiseOR(x["down"]).bitwiseAND(big(mask)).alias("zero")))
        v = F.transform(v, lambda x: F.struct(
            x["zero"].alias("zero"), x["down"].bitwiseOR(F.bitwise_not(x["zero"].bitwiseOR(x["up"]))).bitwiseAND(big(mask)).alias("right"), x["zero"].bitwiseAND(x["up"]).alias("left")))
        v = F.transform(v, lambda x: F.struct(
            x["left"].bitwiseOR(F.bitwise_not(F.shiftright(x["zero"], 1).bitwiseOR(x["right"]))).bitwiseAND(big(mask)).alias("up"),
            F.shiftright(x["zero"], 1).bitwiseAND(x["right"]).alias("down"),
            (s["d"] + F.when(x["zero"].bitwiseAND(F.call_function("shiftleft", big(1), (extra + k).cast("int"))) != 0, 0).otherwise(1)).cast("int").alias("d"),
            (s["j"] + 1).alias("j")))
        return F.when(s["d"] > k, s).otherwise(v[0])

    return F.aggregate(F.when(F.length(b) > 0, F.split(b, "")).otherwise(F.array().cast("array<string>")), start, step, lambda s: s["d"])


def allowed(length: Column, distance: int, per_chars: int) -> Column:
    """Edits that a line of that length and one that is no longer may differ by."""
    return F.greatest(F.lit(distance), F.floor(length / per_chars).cast("int"))


def gram_keys(line: Column, length: Column, distance: int, per_chars: int, q: int) -> Column:
    """Array of (key, own, pos): the prefix of q-grams; own marks those that do not overlap, from the left."""
    most = F.greatest(F.lit(distance), F.floor(length / (per_chars - 1)).cast("int"))  # with a longer line, too
    grams = F.transform(F.sequence(F.lit(0), length - q), lambda p: F.xxhash64(F.substr(line, p + 1, F.lit(q))))
    bound = F.transform(F.array(grams), lambda g: F.struct(g.alias("g"), F.get(F.sort_array(g), most * q).alias("last")))[0]
    start = F.struct(F.lit(-q).alias("end"), F.array().cast("array<struct<key:bigint,own:boolean,pos:int>>").alias("keys"))

    def prefix(s: Column) -> Column:
        return F.filter(F.transform(s["g"], lambda h, i: F.struct(h.alias("key"), i.alias("pos"))), lambda x: x["key"] <= s["last"])

    def pick(s: Column, x: Column) -> Column:
        free = x["pos"] - s["end"] >= q
        return F.struct(F.when(free, x["pos"]).otherwise(s["end"]).alias("end"), F.concat(s["keys"], F.array(F.struct(x["key"].alias("key"), free.alias("own"), x["pos"].alias("pos")))).alias("keys"))

    return F.transform(F.array(bound), lambda s: F.aggregate(prefix(s), start, pick, lambda a: a["keys"]))[0]


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc, th, no, line of each line that is compared; docs has doc, th, t."""
    return docs.select("doc", "th", F.posexplode(F.split("t", "\n")).alias("no", "line")).where(F.length("line") >= min_chars)


def _id(line: str) -> tuple[Column, Column]:
    return F.xxhash64(F.col(line)).alias("id"), F.xxhash64(F.lit(7), F.col(line)).alias("id2")


def _shared(rows: DataFrame) -> DataFrame:
    """rows (key, own, ...) whose key several rows have, one of them its own; with their number c."""
    shared = rows.groupBy("key").agg(F.count("*").alias("c"), F.max("own").alias("owned")).where("c > 1 and owned").select("key", "c")
    return rows.join(shared, "key")


def _ordered(x: Column, y: Column) -> Column:
    swap = F.struct(x["id"], x["id2"]) > F.struct(y["id"], y["id2"])
    lo, hi = (lambda f: F.when(swap, y[f]).otherwise(x[f])), (lambda f: F.when(swap, x[f]).otherwise(y[f]))
    return F.struct(lo("id").alias("a"), lo("id2").alias("a2"), hi("id").alias("b"), hi("id2").alias("b2"))


def _bucket_pairs(met: DataFrame, few: int) -> DataFrame:
    """Pairs (a, a2, b, b2) of the buckets of at most `few` rows."""
    buckets = met.where(F.col("c") <= few).groupBy("key").agg(F.collect_list(F.struct("id", "id2", "own")).alias("m")).select("m")
    differ = lambda x, y: (x["id"] != y["id"]) | (x["id2"] != y["id2"])
    once = lambda x, y: ~y["own"] | (F.struct(x["id"], x["id2"]) < F.struct(y["id"], y["id2"]))
    couples = F.flatten(F.transform(F.filter("m", lambda x: x["own"]), lambda x: F.transform(F.filter("m", lambda y: differ(x, y) & once(x, y)), lambda y: _ordered(x, y))))
    return buckets.select(F.explode(couples).alias("p")).select("p.*")


def _leader_pairs(rows: DataFrame, distance: int) -> DataFrame:
    """Pairs of the rows (key, own, less, rest, ...) that are within the distance whatever remains of them: each with the bucket's first."""
    fit = rows.where(F.length("rest") <= distance)
    who = F.struct("first", "id", "id2")
    lead = fit.groupBy("key").agg(F.min(F.when(F.col("own"), who)).alias("o"), F.min(F.when(~F.col("own"), who)).alias("p"))
    both = fit.join(lead, "key").select(F.struct("id", "id2").alias("x"), F.explode(F.array(F.col("o"), F.when(F.col("own"), F.col("p")))).alias("y"))
    return both.where("y is not null and (x.id <> y.id or x.id2 <> y.id2)").select(_ordered(F.col("x"), F.col("y")).alias("p")).select("p.*")


def _cut_again(rows: DataFrame, distance: int) -> DataFrame:
    """The remains of rows (key, own, less, rest, ...), cut into segments once more; no empty ones, so that they shrink."""
    kids = []
    for less, i, off in probes(distance):
        key, rest, size = segment_key(F.col("rest"), less, i, off, distance)
        own = F.col("own") if less == off == 0 else F.lit(False)
        open_ = (F.col("less") == less) & (size > 0) & (own | (F.length("rest") > distance))
        kids.append(F.when(open_, F.struct(F.xxhash64("key", key).alias("key"), own.alias("own"), rest.alias("rest"))))
    return rows.select("id", "id2", "first", "less", F.explode(F.array_compact(F.array(*kids))).alias("k")).select("k.key", "k.own", "less", "id", "id2", "first", "k.rest")


def _texts(docs: DataFrame, sides: DataFrame, min_chars: int) -> DataFrame:
    """id, id2, first, line for sides (id, id2, first), from the documents that hold a line's first occurrence."""
    near = bit_filter(docs, F.col("doc"), sides.select(F.col("first.doc").alias("doc")), "doc")
    at = sides.select("id", "id2", "first", F.col("first.th").alias("th"), F.col("first.no").alias("no"))
    texts = occurrences(near, min_chars).select("doc", "th", "no", "line").join(at, ["th", "no"])
    return texts.where(F.col("doc").eqNullSafe(F.col("first.doc"))).select("id", "id2", "first", "line").dropDuplicates(["id", "id2"])


def _segment_pairs(docs: DataFrame, distinct: DataFrame, scratch: Scratch, distance: int, min_chars: int, few: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs of distinct (id, id2, first, key_0, ...), and the texts of their lines."""
    ways = probes(distance)
    entries = F.array(*[F.struct(F.col(f"key_{k}").alias("key"), F.lit(less == off == 0).alias("own"), F.lit(k).alias("way")) for k, (less, _, off) in enumerate(ways)])
    met = scratch.stage(_shared(distinct.select("id", "id2", "first", F.explode(entries).alias("k")).select("k.*", "id", "id2", "first")), "met")
    texts = scratch.stage(_texts(docs, met.select("id", "id2", "first").distinct(), min_chars), "texts")
    # each round's pairs are written at once, so that no plan holds all rounds
    keep = lambda found: found.write.mode("append").parquet(scratch.path("candidates"))
    keep(_bucket_pairs(met, few))
    less, rest = F.lit(0), F.lit("")
    for k, (d, i, off) in enumerate(ways):
        less = F.when(F.col("way") == k, d).otherwise(less)
        rest = F.when(F.col("way") == k, segment_key(F.col("line"), d, i, off, distance)[1]).otherwise(rest)
    crowded = met.where(F.col("c") > few).select("key", "own", "way", "id", "id2").join(texts, ["id", "id2"])
    rows = scratch.stage(crowded.select("key", "own", less.alias("less"), "id", "id2", "first", rest.alias("rest")), "crowded-0")
    level = 0
    while not rows.isEmpty():
        keep(_leader_pairs(rows, distance))
        kids = scratch.stage(_cut_again(rows, distance), f"kids-{level}")
        met = scratch.stage(_shared(kids), f"met-{level}")
        scratch.drop(f"kids-{level}")
        keep(_bucket_pairs(met, few))
        level += 1
        rows = scratch.stage(met.where(F.col("c") > few).drop("c"), f"crowded-{level}")
    found = scratch.stage(scratch.spark.read.schema("a bigint, a2 bigint, b bigint, b2 bigint").parquet(scratch.path("candidates")).distinct(), "pairs")
    scratch.drop("met", "candidates", *(f"{x}-{n}" for n in range(level + 1) for x in ("met", "crowded")))
    return found, texts


def _gram_pairs(docs: DataFrame, distinct: DataFrame, scratch: Scratch, distance: int, min_chars: int, per_chars: int) -> tuple[DataFrame, DataFrame]:
    """The same by shared grams of distinct (id, id2, first, len, keys)."""
    keyed = distinct.select("id", "id2", "len", F.explode("keys").alias("k")).select("id", "id2", "len", "k.key", "k.own", "k.pos")
    x = keyed.where("own").select("key", F.col("id").alias("a"), F.col("id2").alias("a2"), F.col("len").alias("len_a"), F.col("pos").alias("pos_a"))
    y = keyed.select("key", "own", F.col("id").alias("b"), F.col("id2").alias("b2"), "len", "pos")
    k = allowed(F.greatest("len", "len_a"), distance, per_chars)
    differ = (F.col("a") != F.col("b")) | (F.col("a2") != F.col("b2"))
    swap = F.struct("a", "a2") > F.struct("b", "b2")  # a pair that meets from both sides counts once
    met = x.join(y, "key").where(differ & (~F.col("own") | ~swap) & (F.abs(F.col("len") - F.col("len_a")) <= k) & (F.abs(F.col("pos") - F.col("pos_a")) <= k))
    met = met.select(*[F.when(swap, F.col(v)).otherwise(F.col(u)).alias(u) for u, v in (("a", "b"), ("a2", "b2"), ("b", "a"), ("b2", "a2"))])
    pairs = scratch.stage(met.distinct(), "pairs")
    sides = pairs.select(F.col("a").alias("id"), F.col("a2").alias("id2")).union(pairs.select("b", "b2")).distinct().join(distinct.select("id", "id2", "first"), ["id", "id2"])
    return pairs, scratch.stage(_texts(docs, scratch.stage(sides, "sides"), min_chars), "texts")


def dropped_lines(docs: DataFrame, scratch: Scratch, *, distance: int = 1, min_chars: int = 16, per_chars: int | None = None, few: int = 8) -> DataFrame:
    """doc, th and `drops`, the positions of the lines that go; for documents that lose any. docs has doc, th, t."""
    lines = occurrences(docs, min_chars)
    if per_chars:
        q = min(8, min_chars // (distance + 1), (per_chars - 1) // 2)
        if q < 1:
            raise ValueError(f"lines of {min_chars} characters and an edit in {per_chars} leave no grams for {distance} edits")
        keys = [F.length("line").alias("len"), gram_keys(F.col("line"), F.length("line"), distance, per_chars, q).alias("keys")]
        names = ["len", "keys"]
    else:
        keys = [segment_key(F.col("line"), *way, distance)[0].alias(f"key_{k}") for k, way in enumerate(probes(distance))]
        names = [f"key_{k}" for k in range(len(keys))]
    seen = lines.select(*_id("line"), F.struct("doc", "th", "no").alias("at"), *keys)
    distinct = scratch.stage(seen.groupBy("id", "id2").agg(F.min("at").alias("first"), F.count("*").alias("c"), *[F.max(n).alias(n) for n in names]), "distinct")
    pairs, texts = _gram_pairs(docs, distinct, scratch, distance, min_chars, per_chars) if per_chars else _segment_pairs(docs, distinct, scratch, distance, min_chars, few)
    of = lambda s: texts.select(F.col("id").alias(s), F.col("id2").alias(f"{s}2"), F.col("first").alias(f"first_{s}"), F.col("line").alias(f"line_{s}"))
    both = pairs.join(of("a"), ["a", "a2"]).join(of("b"), ["b", "b2"])
    similar = both.where(within(F.col("line_a"), F.col("line_b"), distance, per_chars))
    later = similar.select(F.when(F.col("first_a") < F.col("first_b"), F.struct(F.col("b").alias("id"), F.col("b2").alias("id2"))).otherwise(F.struct(F.col("a").alias("id"), F.col("a2").alias("id2"))).alias("x")).select("x.*").distinct()
    removed = scratch.stage(later.withColumn("similar", F.lit(True)), "removed")
    notable = distinct.select("id", "id2", "first", "c").join(removed, ["id", "id2"], "left").where("c > 1 or similar").select("id", "id2", "first", "c", F.coalesce("similar", F.lit(False)).alias("similar"))
    notable = scratch.stage(notable, "notable")
    # lines that make up a ten-thousandth of all or more are at most ten thousand: these are broadcast, so that no join has a hot key
    total = distinct.agg(F.sum("c")).first()[0] or 0
    common = notable.where(F.col("c") * 10_000 >= total)
    common = F.broadcast(common.select(F.col("id").alias("cid"), F.col("id2").alias("cid2"), F.col("similar").alias("csimilar"), F.col("first").alias("cfirst")))
    rare = notable.where(F.col("c") * 10_000 < total).select(F.col("id").alias("rid"), F.col("id2").alias("rid2"), F.col("similar").alias("rsimilar"), F.col("first").alias("rfirst"))
    marked = lines.select(*_id("line"), "doc", "th", "no").join(common, (F.col("id") == F.col("cid")) & (F.col("id2") == F.col("cid2")), "left")
    spread = F.when(F.col("cid").isNotNull(), F.xxhash64("doc", "th", "no")).otherwise(F.col("id2"))  # a common line needs no partner any more
    met = marked.join(rare, (F.col("id") == F.col("rid")) & (spread == F.col("rid2")), "left").where("cid is not null or rid is not null")
    similar, first = F.coalesce("csimilar", "rsimilar"), F.coalesce("cfirst", "rfirst")
    places = met.where(similar | ~F.struct("doc", "th", "no").eqNullSafe(first))
    return places.groupBy("doc", "th").agg(F.collect_set("no").alias("drops"))


def within(a: Column, b: Column, distance: int, per_chars: int | None = None) -> Column:
    """Whether a and b are within so many edits, by what is left between their common prefix and suffix."""
    longer, shorter = F.when(F.length(a) >= F.length(b), a).otherwise(b), F.when(F.length(a) >= F.length(b), b).otherwise(a)
    cut = F.transform(F.array(F.struct(longer.alias("x"), shorter.alias("y"))), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"), common_prefix(s["x"], s["y"], lambda c, n: F.left(c, n)).alias("p")))
    cut = F.transform(cut, lambda s: F.struct(F.substring(s["x"], s["p"] + 1, F.length(s["x"])).alias("x"), F.substring(s["y"], s["p"] + 1, F.length(s["y"])).alias("y")))
    cut = F.transform(cut, lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"), common_prefix(s["x"], s["y"], lambda c, n: F.right(c, n)).alias("q")))
    cut = F.transform(cut, lambda s: F.struct(F.left(s["x"], F.length(s["x"]) - s["q"]).alias("x"), F.left(s["y"], F.length(s["y"]) - s["q"]).alias("y")))
    if per_chars:
        k = allowed(F.length(longer), distance, per_chars)
        return F.transform(cut, lambda s: F.call_function("levenshtein", s["x"], s["y"], k) >= 0)[0]
    return F.transform(cut, lambda s: (F.length(s["x"]) - F.length(s["y"]) <= distance) & (banded_distance(s["x"], s["y"], distance) <= distance))[0]


def dedup(docs: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text", out: str = "_lines", distance: int = 1, min_chars: int = 16, per_chars: int | None = None) -> DataFrame:
    """The rows of docs with their texts less the lines that go, and a struct column `out` of n_lines and n_removed."""
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.col(f"`{id_col}`").alias("doc"), F.xxhash64(text).alias("th"), text.alias("t"))
    drops = scratch.stage(dropped_lines(rows.select("doc", "th", "t"), scratch, distance=distance, min_chars=min_chars, per_chars=per_chars), "drops")
    scratch.drop("distinct", "pairs", "sides", "texts", "removed", "notable")
    drops = drops.withColumnsRenamed({"doc": "of", "th": "of_th"})
    joined = rows.join(drops, (F.col("th") == F.col("of_th")) & F.col("doc").eqNullSafe(F.col("of")), "left")
    parts = F.split("t", "\n")
    kept = F.when(F.col("drops").isNull(), F.col("t")).otherwise(F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("drops", i)), "\n"))
    own = [F.col(f"d.`{c}`") if c != text_col else kept.alias(c) for c in docs.columns if c != out]
    return joined.select(*own, F.struct(F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_removed")).alias(out))
