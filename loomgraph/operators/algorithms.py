"""Cycles as strongly connected components, and compression of bridges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import settled


#: Rows of a table up to which joins may send it to all tasks by way of the driver. Files of names shrink so much that their size says little.
FEW = 100_000


def _large(df: DataFrame) -> DataFrame:
    """A table to join with, which is shuffled if it has more than a few rows."""
    return df.hint("merge") if df.count() > FEW else df


def _trim(e: DataFrame) -> DataFrame:
    """Drops edges of nodes without a predecessor or successor, a layer of them: they are on no cycle.

    Edges are counted by their ends and left where they are; only the nodes to drop, few as a rule, are joined with them.
    """
    outs, ins = (e.groupBy(F.col(c).alias("n")).agg(F.lit(1).alias(c)) for c in "uv")
    ends = settled(outs.join(ins, "n", "full").where("u is null or v is null").select("n"))
    return settled(_without(e, _large(ends))) if ends.limit(1).count() else e


def chains(e: DataFrame, keep: DataFrame | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """(links, rings) of a graph with distinct edges (u, v): nodes with one predecessor and one successor, but for those of keep (n).

    links (n, u, v): of each chain's nodes, what comes before the chain and what after it. rings (n, l): nodes of rings
    that have nothing else, and the ring's smallest. Each node looks twice as far in every round, so the rounds go by
    the logarithm of the longest chain.
    """
    ins = e.groupBy(F.col("v").alias("n")).agg(F.count(F.lit(1)).alias("i"), F.min("u").alias("before")).where("i = 1").drop("i")
    outs = e.groupBy(F.col("u").alias("n")).agg(F.count(F.lit(1)).alias("o"), F.min("v").alias("after")).where("o = 1").drop("o")
    own = ins.join(outs, "n").where("before <> n")
    own = settled(own if keep is None else own.join(keep.select("n"), "n", "left_anti"))
    size = own.count()
    if not size:
        return None, None
    ids = own.select(F.col("n").alias("x"))
    first = own.join(ids.withColumnRenamed("x", "before"), "before", "left_anti").select(F.col("n").alias("f"), "before")
    ends = own.join(ids.withColumnRenamed("x", "after"), "after", "left_anti").select("n")
    # to: how far a node sees; last: the chain's last node, once it is seen; l: the smallest on the way
    seen = own.join(ends.withColumn("done", F.lit(True)), "n", "left").select("n", F.col("after").alias("to"), F.coalesce("done", F.lit(False)).alias("done"), F.when(F.col("done"), F.col("n")).alias("last"), F.least("n", "after").alias("l"))
    far, seen = 1, settled(seen)
    while far <= size and seen.where("not done").limit(1).count():
        next_ = seen.select(F.col("n").alias("to"), F.col("to").alias("_to"), F.col("done").alias("_done"), F.col("last").alias("_last"), F.col("l").alias("_l"))
        moved = seen.where("not done").join(next_, "to").select("n", F.col("_to").alias("to"), F.col("_done").alias("done"), F.col("_last").alias("last"), F.least("l", "_l").alias("l"))
        seen, far = settled(seen.where("done").unionByName(moved)), 2 * far
    whole = seen.where("done")
    begins = whole.join(first, whole["n"] == first["f"]).select("last", F.col("before").alias("u"))
    links = settled(whole.join(begins, "last").select("n", "u", F.col("to").alias("v")))
    return links, seen.where("not done").select("n", "l")


def _without(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges that don't touch the nodes (n)."""
    return e.join(nodes.select(F.col("n").alias("u")), "u", "left_anti").join(nodes.select(F.col("n").alias("v")), "v", "left_anti").select("u", "v")


def contracted(e: DataFrame, links: DataFrame) -> DataFrame:
    """The edges with each chain as one edge; a chain that comes back to where it began leaves none."""
    return settled(_without(e, links).unionByName(links.select("u", "v").where("u <> v")).distinct())


def _reached(e: DataFrame, labels: DataFrame) -> DataFrame:
    """(n, l): the smallest label that reaches each node along the edges (u, v); labels (n, l) of the nodes to start from.

    Nodes whose label fell hand it on in the next round, and no others do.
    """
    new = labels = settled(labels.select("n", "l"))
    while new.limit(1).count():
        sent = e.join(_large(new).select(F.col("n").alias("u"), "l"), "u").groupBy(F.col("v").alias("n")).agg(F.min("l").alias("m"))
        new = settled(sent.join(_large(labels), "n", "left").where("l is null or m < l").select("n", F.col("m").alias("l")))
        labels = settled(labels.join(_large(new).select("n"), "n", "left_anti").unionByName(new))
    return labels


def _first(e: DataFrame) -> DataFrame:
    """(n, l): the nodes without a smaller predecessor, labelled by themselves. What another one reaches, a smaller one reaches as well."""
    return e.groupBy(F.col("u").alias("n")).agg(F.lit(1)).select("n").join(e.where("u < v").select(F.col("v").alias("n")).distinct(), "n", "left_anti").select("n", F.col("n").alias("l"))


def scc(edges: DataFrame) -> DataFrame:
    """(node_id, component): nodes on cycles of two or more, component is the smallest member. Self loops are no cycles.

    The graph shrinks first: ends are trimmed, and chains become single edges, in rounds that go by the logarithm of
    their length. Of what remains the smallest id that reaches a node is its colour, and what reaches a colour's root back
    within the colour is a component. Found components leave, and the rest shrinks again. At last the chains are
    unwound: a chain's nodes are on a cycle if what is before it and after it are in one component, or are the same node.
    """
    e = settled(edges.select(F.col("src_id").alias("u"), F.col("dst_id").alias("v")).where("u <> v").distinct())
    found, held = None, []  # (n, k): k is any node that stands for the component
    add = lambda new: new if found is None else found.unionByName(new)
    while True:
        n = e.count()
        while n:
            e = _trim(e)
            links, rings = chains(e)
            if links is not None:
                found = add(rings.select("n", F.col("l").alias("k")))
                held.append(links)
                e = contracted(_without(e, rings), links)
            if (m := e.count()) == n:
                break
            n = m
        if not n:
            break
        colour = _large(_reached(e, _first(e)))  # all nodes have successors, since ends are trimmed
        a, b = colour.select(F.col("n").alias("u"), F.col("l").alias("lu")), colour.select(F.col("n").alias("v"), F.col("l").alias("lv"))
        inside = settled(e.join(a, "u").join(b, "v").where("lu = lv").select("u", "v"))
        # Roots keep their own label. What reaches a root within its colour is on a cycle with it.
        own = _reached(inside.select(F.col("v").alias("u"), F.col("u").alias("v")), colour.where("n = l")).select("n", F.col("l").alias("k"))
        found = add(own)
        e = settled(_without(e, _large(own)))
    if found is None:
        return edges.limit(0).select(F.col("src_id").alias("node_id"), F.col("src_id").alias("component"))
    sizes = found.groupBy("k").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    found = found.join(sizes, "k", "left_semi").select("n", "k")
    for links in reversed(held):
        # a node that a chain comes back to is on a cycle, whether or not on another one
        back = links.where("u = v").select(F.col("u").alias("n")).distinct().join(found, "n", "left_anti").select("n", F.col("n").alias("k"))
        found = settled(found.unionByName(back))
        a, b = found.select(F.col("n").alias("u"), F.col("k").alias("ku")), found.select(F.col("n").alias("v"), F.col("k").alias("kv"))
        found = settled(found.unionByName(links.join(a, "u").join(b, "v").where("ku = kv").select("n", F.col("ku").alias("k"))))
    least = found.groupBy("k").agg(F.min("n").alias("component"))
    return found.join(least, "k").select(F.col("n").alias("node_id"), "component")


def cycle_groups(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(representative, members, size): members sorted; edges to unknown nodes don't count."""
    ids = _large(nodes.select("node_id"))
    known = edges.join(ids, edges.src_id == ids.node_id, "left_semi").join(ids, edges.dst_id == ids.node_id, "left_semi")
    return scc(known).groupBy(F.col("component").alias("representative")).agg(F.array_sort(F.collect_list("node_id")).alias("members"), F.count(F.lit(1)).alias("size"))


def valid_group(members: list[str], representative: str) -> None:
    if not members:
        raise ValueError("a cycle group needs members")
    if representative not in members:
        raise ValueError(f"{representative} is not a member")


def compress(root: str, nodes: list[str], edges: list[tuple[str, str]], cyclic: set[str] = frozenset()) -> tuple[list[str], list[tuple[str, str]], list[str], list[str]]:
    """(nodes, edges, bridges, paths) of a subgraph without its bridges.

    In the nodes' order, again and again until nothing changes: a node other than the root, on no cycle, with one
    predecessor and one successor is taken out, and they are joined.
    """
    alive = list(dict.fromkeys(nodes))
    out: dict[str, dict[str, None]] = {n: {} for n in alive}
    into: dict[str, dict[str, None]] = {n: {} for n in alive}
    for a, b in edges:
        if a in out and b in out:
            out[a][b] = into[b][a] = None
    bridges, paths, moved = [], [], True
    while moved:
        moved = False
        for n in list(alive):
            if n == root or n in cyclic or len(out[n]) != 1 or len(into[n]) != 1:
                continue
            (a,), (b,) = into.pop(n), out.pop(n)
            if n in (a, b):
                into[n], out[n] = {a: None}, {b: None}
                continue
            del out[a][n], into[b][n]
            out[a][b] = into[b][a] = None
            alive.remove(n)
            bridges.append(n)
            paths.append(f"{a} -> {n} -> {b}")
            moved = True
    return alive, [(a, b) for a in alive for b in out[a]], sorted(bridges), paths


def compress_subgraphs(rows: DataFrame) -> DataFrame:
    """compress() of many subgraphs at once, from (graph, root, kind, a, b): kind is node, edge or cyclic. Returns (graph, kind, a, b): node, edge and bridge rows.

    Chains between nodes that stay are contracted, parallel edges fall together, and so on until there is no chain. A
    node that may go may still go when another has gone, so the order makes no difference to what stays. Nodes on cycles
    must be named as cyclic; those of a cycle that aren't named stay too. Edges to unknown nodes don't count.
    """
    key = lambda c: F.struct(F.col("graph").alias("g"), F.col(c).alias("x"))
    nodes = settled(rows.where("kind = 'node'").select(key("a").alias("n"), (F.col("a") == F.col("root")).alias("root")).groupBy("n").agg(F.max("root").alias("root")))
    ids = nodes.select("n")
    e = rows.where("kind = 'edge'").select(key("a").alias("u"), key("b").alias("v")).distinct()
    e = settled(e.join(ids.withColumnRenamed("n", "u"), "u", "left_semi").join(ids.withColumnRenamed("n", "v"), "v", "left_semi"))
    keep = settled(nodes.where("root").select("n").unionByName(rows.where("kind = 'cyclic'").select(key("a").alias("n"))).distinct())
    bridges = None
    while True:
        links, rings = chains(e, keep)
        if links is None:
            break
        gone = links.where("u <> v").select("n")
        if not gone.limit(1).count():
            break
        e = contracted(e, links.where("u <> v"))
        bridges = gone if bridges is None else bridges.unionByName(gone)
    bridges = nodes.select("n").limit(0) if bridges is None else bridges
    out = lambda df, kind, a, b: df.select(F.col(f"{a}.g").alias("graph"), F.lit(kind).alias("kind"), F.col(f"{a}.x").alias("a"), (F.col(f"{b}.x") if b else F.lit(None).cast("string")).alias("b"))
    left = ids.join(bridges, "n", "left_anti")
    return out(left, "node", "n", None).unionByName(out(e, "edge", "u", "v")).unionByName(out(bridges, "bridge", "n", None))


def compression_stats(before_nodes: int, before_edges: int, after_nodes: int, after_edges: int, bridges: int) -> str:
    share = lambda a, b: 0 if not a else round(100 * (a - b) / a)
    return f"{before_nodes} -> {after_nodes} nodes (-{share(before_nodes, after_nodes)}%), {before_edges} -> {after_edges} edges (-{share(before_edges, after_edges)}%), {bridges} bridges removed"
