"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import BROADCAST_PAIRS, broadcast_if_small, materialise, release


def components(edges: DataFrame) -> DataFrame:
    """(a, b) to (node, root): one root for all nodes of a component, for every node that has an edge.

    In each round every node goes to the neighbour (or itself) that a fresh random order puts first, and the edges are
    drawn anew between those. A round leaves a fraction of the nodes, so the rounds grow with the logarithm of the input.
    Everything is a join or a minimum: no list of neighbours is ever gathered. A round's tables are written to the shared
    folder, so its lineage is cut and a lost executor costs no more than the current round.
    """
    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    edges = materialise(edges.where("a <> b").select(*pair(F.col("a"), F.col("b"))).distinct())
    moves: list[DataFrame] = []
    most = 0  # nodes of the first round, and so of any
    while edges.take(1):
        seed = F.lit(len(moves))
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c, seed=seed: F.struct(F.xxhash64(c, seed).alias("o"), c.alias("n"))
        first = ends.groupBy("a").agg(F.min(order(F.col("b"))).alias("m"))
        moves.append(materialise(first.select(F.col("a").alias("node"), F.least("m", order(F.col("a")))["n"].alias("to"))))
        most = most or moves[-1].count()
        near = broadcast_if_small(moves[-1], most, BROADCAST_PAIRS)
        to_a = near.select(F.col("node").alias("a"), F.col("to").alias("x"))
        to_b = near.select(F.col("node").alias("b"), F.col("to").alias("y"))
        left = materialise(edges.join(to_a, "a").join(to_b, "b").where("x <> y").select(*pair(F.col("x"), F.col("y"))).distinct())
        release(edges)
        edges = left
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = moves.pop().withColumnRenamed("to", "root")
    for move in reversed(moves):
        above = broadcast_if_small(roots.withColumnRenamed("node", "to"), most, BROADCAST_PAIRS)
        roots = move.join(above, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return roots
