"""Connected components of a graph held in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut, discard

#: Each round at least halves, in expectation, the nodes that still have links.
MAX_ROUNDS = 200


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row (node, root) for each node of ``links``; nodes are linked iff roots are equal.

    Rounds of contraction: each node hooks onto the least node among itself and
    its neighbours, in an order by hash that changes every round (sorted chains
    take no longer than others), and the links are rewritten between the hooked
    nodes.  Aggregates are combined before the shuffle and the joins have an
    exchange on both sides, so a hub's rows can be split.  Links with a null end
    are no links; empty links give no nodes.  Round results are written tables.
    """
    edges = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    edges = cut(edges.where("a is not null and b is not null and a <> b").distinct())
    moves: list[DataFrame] = []
    for turn in range(MAX_ROUNDS):
        if not edges.take(1):
            break
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), c.alias("node"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("m"))
        hook = cut(hook.select(F.col("a").alias("node"), F.least(F.col("m"), rank(F.col("a")))["node"].alias("to")))
        moves.append(hook)
        left = hook.select(F.col("node").alias("a"), F.col("to").alias("a2"))
        right = hook.select(F.col("node").alias("b"), F.col("to").alias("b2"))
        live, edges = edges, edges.join(left, "a").select("b", "a2").join(right, "b").select(F.col("a2").alias("a"), F.col("b2").alias("b"))
        before, edges = live, cut(edges.where("a <> b").distinct())
        discard(before)
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    labels = moves[0].select("node", F.col("to").alias("root"))
    for hook in moves[1:]:
        labels = labels.join(hook.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    labels = cut(labels)
    discard(edges, *moves)
    return labels
