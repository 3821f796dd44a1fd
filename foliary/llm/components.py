"""Connected components of an edge table, by contraction: hook to the least neighbour, jump pointers, merge, repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """edges: columns a, b of one orderable type. Result: node, root (the least node of its component), one row per node.

    Every round at least halves the nodes left, and every round's tables are staged, so lineage stays short. An edge
    from a node to itself makes it a node and no more; repeated edges and rows with nulls change nothing.
    """
    edges = edges.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = scratch.stage(edges, f"{label}-e0")
    maps: list[DataFrame] = []
    spent: list[str] = []
    while not left.isEmpty():
        k = len(maps)
        both = left.select(F.col("a").alias("node"), F.col("b").alias("p")).union(left.select("b", "a"))
        hooked = scratch.stage(both.groupBy("node").agg(F.min("p").alias("p")).select("node", F.least("node", "p").alias("p")), f"{label}-p{k}")
        jump = 0
        while True:
            up = hooked.select(F.col("node").alias("q"), F.col("p").alias("r"))
            jumped = scratch.stage(hooked.join(up, F.col("p") == F.col("q")).select("node", F.col("r").alias("p"), (F.col("r") != F.col("p")).alias("moved")), f"{label}-j{k}-{jump}")
            spent.append(f"{label}-p{k}" if not jump else f"{label}-j{k}-{jump - 1}")
            jump += 1
            moved = not jumped.where("moved").isEmpty()
            hooked = jumped.select("node", "p")
            if not moved:
                break
        maps.append(hooked)
        of = lambda side: hooked.select(F.col("node").alias(side), F.col("p").alias(f"r{side}"))
        merged = left.join(of("a"), "a").join(of("b"), "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        left = scratch.stage(merged, f"{label}-e{k + 1}")
        scratch.drop(f"{label}-e{k}", *spent)
        spent.clear()
    if not maps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = maps[0].select("node", F.col("p").alias("root"))
    for nxt in maps[1:]:
        found = found.join(nxt.select(F.col("node").alias("q"), F.col("p")), F.col("root") == F.col("q"), "left").select("node", F.coalesce("p", "root").alias("root"))
    return scratch.stage(found, f"{label}-roots")
