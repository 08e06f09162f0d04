"""Edges laid out for expansion: stored once, bucketed by the node they leave, so a hop shuffles its frontier alone.

A node of very many edges (a hub) has them dealt over several buckets by a second key; a frontier that holds hubs asks
each of their parts. Hubs are known from a count when the edges are stored, and there are never more of them than edges
divided by HUB.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import durable, shared_dir

#: Edges of a node above which they are dealt over parts, each of so many.
HUB = 200_000


@dataclass(frozen=True)
class Adjacency:
    """edges (src_id, part, dst_id), bucketed by src_id, or by src_id and part if there are hubs (src_id, parts)."""

    edges: DataFrame
    hubs: DataFrame | None

    def expand(self, frontier: DataFrame, node: str, to: str, when: Column | None = None, how: str = "inner") -> DataFrame:
        """The frontier's rows, each with every node that an edge from its node leads to; with how ``left`` also those without one. when: which rows expand, of a left join."""
        steps = self.edges.select(F.col("src_id").alias("_src"), F.col("part").alias("_part"), F.col("dst_id").alias(to))
        met = F.col(node) == F.col("_src")
        if self.hubs is not None:
            parts = self.hubs.select(F.col("src_id").alias("_hub"), "parts")
            frontier = frontier.join(parts, F.col(node) == F.col("_hub"), "left").withColumn("_of", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("_hub", "parts")
            met = met & (F.col("_of") == F.col("_part"))
        out = frontier.join(steps, met if when is None else met & when, how).drop("_src", "_part")
        return out.drop("_of") if self.hubs is not None else out


def lay_out(calls: DataFrame, reverse: bool = False) -> Adjacency:
    """Stores edges (src_id, dst_id), turned round if reverse, in the shared folder."""
    spark = calls.sparkSession
    e = calls.select("src_id", "dst_id") if not reverse else calls.select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"))
    hubs = durable(e.groupBy("src_id").count().where(F.col("count") > HUB).select("src_id", F.ceil(F.col("count") / HUB).cast("int").alias("parts")))
    many = bool(hubs.limit(1).count())
    part = F.coalesce(F.pmod(F.xxhash64("dst_id"), F.col("parts")).cast("int"), F.lit(0)) if many else F.lit(0)
    rows = (e.join(hubs, "src_id", "left") if many else e).select("src_id", part.alias("part"), "dst_id")
    n, keys = int(spark.conf.get("spark.sql.shuffle.partitions")), ["src_id", "part"] if many else ["src_id"]
    name = f"adjacency_{uuid.uuid4().hex}"
    rows.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return Adjacency(spark.table(name), hubs if many else None)
