"""Bounded and unbounded traversal.

A bounded expansion is one plan: each level joins the frontier of the level before with the stored edges and keeps the
smallest depth of each node. A level refers to the one before once, so the plan grows linearly with the depth; the edges
are laid out by the node they leave, hubs in parts, and are not shuffled again. Many requests share one frontier, whose
rows carry their request. Unbounded search runs level by level over checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import durable
from ..schema import PropertyGraph, priority
from . import lookup
from .adjacency import Adjacency

MAX_DEPTH = 10


def clamp(depth: int) -> int:
    return max(1, min(MAX_DEPTH, depth))


def reach(adjacency: Adjacency, start: DataFrame, depth: int) -> DataFrame:
    """(node_id, depth) of what is reached from start (node_id) in ``depth`` hops at most; start has depth 0."""
    seen = start.select("node_id", F.lit(0).alias("depth")).distinct()
    for level in range(depth):
        met = adjacency.expand(seen, "node_id", "_dst", F.col("depth") == level, "left")
        both = F.array(F.struct("node_id", "depth"), F.struct(F.col("_dst").alias("node_id"), F.lit(level + 1).alias("depth")))
        seen = met.select(F.explode(both).alias("x")).select("x.*").where("node_id is not null").groupBy("node_id").agg(F.min("depth").alias("depth"))
    return seen


def reach_many(adjacency: Adjacency, starts: DataFrame, deepest: int) -> DataFrame:
    """(request, node_id, depth) for many requests at once, from starts (request, node_id, hops), each up to its own number of hops.

    A level's new nodes are all that is expanded: they meet the stored edges, and what an earlier level has reached for
    the same request is left out. So the number of jobs goes by the depth, whatever the number of requests.
    """
    now = durable(starts.select("request", "node_id", "hops", F.lit(0).alias("depth")).distinct())
    seen = now
    for level in range(deepest):
        step = adjacency.expand(now.where(F.col("hops") > level), "node_id", "_dst").select("request", F.col("_dst").alias("node_id"), "hops").distinct()
        now = durable(step.join(seen.select("request", "node_id"), ["request", "node_id"], "left_anti").withColumn("depth", F.lit(level + 1)))
        if not now.limit(1).count():
            break
        seen = seen.unionByName(now)
    return seen.select("request", "node_id", "depth")


def edges_within(g: PropertyGraph, reached: DataFrame) -> DataFrame:
    """(request, src_id, dst_id): the calls between the nodes that each request has reached."""
    ids = durable(reached.select("request", "node_id").distinct())
    met = g.adjacency().expand(ids, "node_id", "dst_id").withColumnRenamed("node_id", "src_id")
    return met.join(ids.withColumnRenamed("node_id", "dst_id"), ["request", "dst_id"], "left_semi").select("request", "src_id", "dst_id")


def resolve_many(g: PropertyGraph, requests: DataFrame) -> DataFrame:
    """(request, name, file) of (request, symbol, file): the name of the node that each symbol means, as lookup.resolve finds it. Requests without a node give no row."""
    owner = F.regexp_extract("symbol", r"(?s)^(.*)\.[^.]*$", 1)
    asked = requests.select("request", "symbol", "file", F.substring_index("symbol", ".", -1).alias("_last"), F.when(F.contains("symbol", F.lit(".")), owner).alias("_owner"))
    n = g.nodes.select("node_id", "name", F.col("file").alias("_file"), F.col("parent").alias("_parent"), priority(F.col("label")).alias("_p"), "line")
    inside = F.col("file").isNull() | F.contains(F.col("_file"), F.col("file"))
    own = asked.join(n, (F.col("symbol") == F.col("name")) & inside).withColumn("_way", F.lit(0))
    dotted = asked.where("_owner is not null").join(n, (F.col("_last") == F.col("name")) & F.contains(F.col("_parent"), F.col("_owner")) & inside).withColumn("_way", F.lit(1))
    best = F.min(F.struct("_way", "_p", "_file", "line", "node_id", "name", "file")).alias("b")
    return own.unionByName(dotted).groupBy("request").agg(best).select("request", "b.name", "b.file")


def start_of_many(g: PropertyGraph, named: DataFrame) -> DataFrame:
    """(request, node_id) of (request, name, file): the one node each traversal by name starts at."""
    n = g.nodes.select("node_id", F.col("name").alias("_name"), F.col("file").alias("_file"), priority(F.col("label")).alias("_p"), "line")
    found = named.join(n, (F.col("name") == F.col("_name")) & (F.col("file").isNull() | F.contains(F.col("_file"), F.col("file"))))
    return found.groupBy("request").agg(F.min(F.struct("_p", "_file", "line", "node_id")).alias("b")).select("request", "b.node_id")


def start_of(g: PropertyGraph, name: str, file: str | None = None) -> DataFrame:
    """The one node a traversal by name starts at."""
    found = g.nodes.where(F.col("name") == name)
    if file:
        found = found.where(F.contains("file", F.lit(file)))
    return found.orderBy(priority(F.col("label")), "file", "line", "node_id").limit(1).select("node_id")


def neighbors(g: PropertyGraph, node_id: str, depth: int = 1, limit: int = 500) -> DataFrame:
    """Distinct callees within ``depth`` hops, the node itself if it is on a cycle; at most ``limit``, as asked for."""
    start = g.nodes.where(F.col("node_id") == node_id).select("node_id")
    near = reach(g.adjacency(), start, clamp(depth) - 1)
    ids = g.adjacency().expand(near.select("node_id"), "node_id", "_to").select(F.col("_to").alias("node_id")).distinct()
    return g.nodes.join(ids, "node_id", "left_semi").select(*lookup.BRIEF).orderBy("node_id").limit(limit)


def subgraph_nodes(g: PropertyGraph, start: DataFrame, depth: int, reverse: bool = False) -> DataFrame:
    """Nodes within ``depth`` calls of start (against the calls if reverse), with depth and is_root."""
    near = reach(g.adjacency(reverse), start, clamp(depth))
    return g.nodes.join(near, "node_id").select(*lookup.BRIEF, "docstring", "depth", (F.col("depth") == 0).alias("is_root"))


def induced_edges(g: PropertyGraph, nodes: DataFrame) -> DataFrame:
    """Calls between the given nodes."""
    return edges_within(g, nodes.select(F.lit(0).alias("request"), "node_id")).select("src_id", "dst_id")


def by_name(g: PropertyGraph, edges: DataFrame) -> DataFrame:
    """Edges as distinct pairs of names."""
    s, d = g.nodes.select(F.col("node_id").alias("src_id"), F.col("name").alias("src")), g.nodes.select(F.col("node_id").alias("dst_id"), F.col("name").alias("dst"))
    return edges.join(s, "src_id").join(d, "dst_id").select("src", "dst").distinct()


def impact_by_depth(g: PropertyGraph, name: str, depth: int = 3) -> DataFrame:
    """Callers of a name, direct and indirect, with the fewest hops; nodes of the root's own name are left out."""
    return subgraph_nodes(g, start_of(g, name), depth, reverse=True).where((F.col("depth") > 0) & (F.col("name") != name)).select("node_id", "name", "file", "depth")


def token_estimate(nodes: DataFrame) -> DataFrame:
    """Tokens that listing the nodes takes, roughly."""
    size = F.length("name") + F.length("file") + 30
    return nodes.agg(F.floor(F.coalesce(F.sum(size), F.lit(0)) / 4).cast("long").alias("tokens"))


def shortest_path(g: PropertyGraph, source: str, target: str) -> DataFrame:
    """(hop, node_id, name, file) of a shortest directed path between two names; empty if there is none.

    Two searches meet: from the source along the calls and from the target against them, and each time the one with the
    smaller frontier goes a level further. Of equally short paths one is taken, by the smallest ids at the meeting and
    from there outwards. Ends when they meet, or when one has nothing new.
    """
    spark = g.nodes.sparkSession
    level0 = lambda name: durable(g.nodes.where(F.col("name") == name).select("node_id", F.lit(None).cast("string").alias("via")))
    levels = {False: [level0(source)], True: [level0(target)]}
    sizes = {way: levels[way][0].count() for way in levels}
    seen = {way: levels[way][0].select("node_id") for way in levels}
    met = levels[False][0].join(levels[True][0].select("node_id"), "node_id", "left_semi").agg(F.min("node_id")).first()[0]
    while met is None and all(sizes.values()):
        way = sizes[True] < sizes[False]
        step = g.adjacency(way).expand(levels[way][-1].select("node_id"), "node_id", "_to").groupBy(F.col("_to").alias("node_id")).agg(F.min("node_id").alias("via"))
        now = durable(step.join(seen[way], "node_id", "left_anti"))
        levels[way].append(now)
        seen[way] = seen[way].unionByName(now.select("node_id"))
        # the other search's last level is all that can be met first
        sizes[way], met = now.count(), now.join(levels[not way][-1].select("node_id"), "node_id", "left_semi").agg(F.min("node_id")).first()[0]
    path = [] if met is None else [met]
    for way in (False, True):
        at = met
        for level in reversed(levels[way][1:] if met is not None else []):  # a row a level
            at = level.where(F.col("node_id") == at).select("via").first()["via"]
            path = [*path, at] if way else [at, *path]
    rows = spark.createDataFrame(list(enumerate(path)), "hop int, node_id string")
    return rows.join(g.nodes.select("node_id", "name", "file"), "node_id").select("hop", "node_id", "name", "file")


def path_diagnosis(g: PropertyGraph, source: str, target: str) -> str:
    """Why there is no path: an endpoint is missing, or none exists."""
    found = {r["name"] for r in g.nodes.where(F.col("name").isin(source, target)).select("name").distinct().collect()}
    missing = [n for n in (source, target) if n not in found]
    return f"not in the graph: {', '.join(missing)}" if missing else f"no path from {source} to {target}"
