"""Connected components by alternating large and small stars, on edges that never leave the executors.

Before each round, nodes whose only neighbour is smaller leave with a pointer to it; what has become a star is then
done, and later rounds work on the rest alone. The pointers are followed back at the end, the last round's first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


PER_FILE = 50_000


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("u").alias("n"), F.col("v").alias("o")).unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("o")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours are tied to the smallest of them and the node.

    Large: the neighbours above the node. Small: the neighbours below it, and the node itself. The smallest is
    found by a pre-aggregated minimum, so a node with very many neighbours costs a task no more than the rest.
    """
    around = _both_ways(edges) if large else edges.select(F.col("u").alias("n"), F.col("v").alias("o"))
    least = around.groupBy("n").agg(F.min("o").alias("m")).select("n", F.least("m", "n").alias("m"))
    if large:
        tied = around.where("o > n").join(least, "n").select(F.col("o").alias("u"), F.col("m").alias("v"))
    else:
        tied = around.join(least, "n").select(F.col("o").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
    return tied.where("u > v").distinct()


def _leaves(edges: DataFrame) -> DataFrame:
    """(node, root): nodes whose only neighbour is smaller, and that neighbour, which is no such node itself."""
    return _both_ways(edges).groupBy("n").agg(F.count(F.lit(1)).alias("k"), F.min("o").alias("o")).where("k = 1 and o < n").select(F.col("n").alias("node"), F.col("o").alias("root"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge and isn't its component's smallest, from edges (u, v) of longs.

    Self loops and repeated edges don't matter; without edges the result is empty. Each round is checkpointed, in files
    of some PER_FILE edges, since each file costs its own time to make.
    """
    now = durable(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    files = 1 + now.count() // PER_FILE
    kept = lambda df: durable(df.coalesce(files))
    rounds = []
    while True:
        rounds.append(kept(_leaves(now)))
        rest = kept(now.join(rounds[-1].select(F.col("node").alias("u")), "u", "left_anti"))
        if not rest.limit(1).count():
            break
        now = kept(_star(_star(rest, True), False))
    found = rounds.pop()
    for left in reversed(rounds):
        later = found.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        found = kept(found.unionByName(left.join(later, left["root"] == later["_n"], "left").select("node", F.coalesce("_r", "root").alias("root"))))
    return found
