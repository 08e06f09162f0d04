"""Aggregates over the graph: each is a few equi joins and pre-aggregated groupings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import PropertyGraph

#: Labels that stand for files, imports and history rather than code.
NOT_CODE = ("Commit", "File", "Module")


def _ends(g: PropertyGraph) -> DataFrame:
    """Call edges with both ends' names, files and labels."""
    pick = lambda p: g.nodes.select(*[F.col(c).alias(f"{p}_{c}") for c in ("node_id", "name", "file", "label")])
    s, d = pick("s"), pick("d")
    e = g.edges.where(F.col("type") == "CALLS").select("src_id", "dst_id").distinct()
    return e.join(s, e.src_id == s.s_node_id).join(d, e.dst_id == d.d_node_id)


def hot_callees(g: PropertyGraph, limit: int = 20) -> DataFrame:
    """Most called: distinct callers of each (name, file, label)."""
    return (
        _ends(g).groupBy(F.col("d_name").alias("name"), F.col("d_file").alias("file"), F.col("d_label").alias("label"))
        .agg(F.count_distinct("src_id").alias("callers")).orderBy(F.desc("callers"), "name", "file", "label").limit(limit)
    )


def module_coupling(g: PropertyGraph) -> DataFrame:
    """Symbols of each file, and cross-file calls that touch it at either end."""
    cross = _ends(g).where("s_file <> d_file").select(F.explode(F.array("s_file", "d_file")).alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("coupling"))
    files = g.nodes.where("file is not null").groupBy("file").agg(F.count(F.lit(1)).alias("symbols"))
    return files.join(cross, "file", "left").select("file", "symbols", F.coalesce("coupling", F.lit(0)).alias("coupling"))


def complexity_rank(g: PropertyGraph, limit: int = 20) -> DataFrame:
    """Fan-in times fan-out of code nodes that have either; distinct neighbours."""
    e = g.calls()
    fan_in = e.groupBy(F.col("dst_id").alias("node_id")).agg(F.count(F.lit(1)).alias("fan_in"))
    fan_out = e.groupBy(F.col("src_id").alias("node_id")).agg(F.count(F.lit(1)).alias("fan_out"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    both = fan_in.join(fan_out, "node_id", "full").select("node_id", zero("fan_in").alias("fan_in"), zero("fan_out").alias("fan_out"))
    code = g.nodes.where(~F.col("label").isin(*NOT_CODE)).select("node_id", "name", "file", "label")
    return code.join(both, "node_id").withColumn("score", F.col("fan_in") * F.col("fan_out")).orderBy(F.desc("score"), F.desc("fan_in"), "node_id").limit(limit)


def bottleneck_rank(g: PropertyGraph, limit: int = 10) -> DataFrame:
    """Distinct other files that call a node, times distinct other files it calls; both above zero."""
    e = _ends(g).where("s_file <> d_file")
    into = e.groupBy(F.col("dst_id").alias("node_id")).agg(F.count_distinct("s_file").alias("caller_files"), F.min("s_file").alias("caller_sample"))
    out = e.groupBy(F.col("src_id").alias("node_id")).agg(F.count_distinct("d_file").alias("callee_files"), F.min("d_file").alias("callee_sample"))
    named = g.nodes.select("node_id", "name", "file")
    return into.join(out, "node_id").join(named, "node_id").withColumn("score", F.col("caller_files") * F.col("callee_files")).orderBy(F.desc("score"), "name", "file", "node_id").limit(limit)


def unused(g: PropertyGraph, include_dunders: bool = False) -> DataFrame:
    """Code nodes that nothing calls."""
    called = g.edges.where(F.col("type") == "CALLS").select(F.col("dst_id").alias("node_id")).distinct()
    code = g.nodes.where(~F.col("label").isin(*NOT_CODE))
    code = code if include_dunders else code.where(~F.col("name").startswith("__"))
    return code.join(called, "node_id", "left_anti").select("node_id", "name", "label", "file", "line")


def changed_symbols(g: PropertyGraph, changes: DataFrame, hunks: DataFrame) -> DataFrame:
    """Symbols of changed files with their callers; direct if the file was added or deleted, or a hunk holds the start line.

    changes (file, status), hunks (file, lo, hi).
    """
    inside = g.nodes.alias("n").join(changes.select("file", "status"), "file")
    callers = g.calls().groupBy(F.col("dst_id").alias("node_id")).agg(F.count(F.lit(1)).alias("callers"))
    spans = hunks.select(F.col("file").alias("h_file"), "lo", "hi")
    touched = inside.join(spans, (F.col("file") == F.col("h_file")) & F.col("line").between(F.col("lo"), F.col("hi")), "left_semi").select("node_id", F.lit(True).alias("hit"))
    return (
        inside.join(touched, "node_id", "left").join(callers, "node_id", "left")
        .select("node_id", "name", "file", "line", (F.col("status").isin("A", "D") | F.coalesce("hit", F.lit(False))).alias("direct"), F.coalesce("callers", F.lit(0)).alias("callers"))
    )


def _layer(c: Column, layers: list[tuple[str, list[str]]]) -> Column:
    """The number of the first layer of which a path part occurs in the file, or null."""
    out = F.lit(None).cast("int")
    for i, (_, paths) in reversed(list(enumerate(layers))):
        hit = F.lit(False)
        for p in paths:
            hit = hit | F.contains(c, F.lit(p))
        out = F.when(hit, i).otherwise(out)
    return out


def layer_violations(g: PropertyGraph, layers: list[tuple[str, list[str]]], allow: list[tuple[str, str]] = (), allowed: bool = False) -> DataFrame:
    """Cross-file calls from a lower layer up to a higher one; allowed: those that ``allow`` excuses, in place of the others."""
    names = F.array(*[F.lit(n) for n, _ in layers])
    e = _ends(g).where("s_file <> d_file").select("s_name", "s_file", "d_name", "d_file", _layer(F.col("s_file"), layers).alias("a"), _layer(F.col("d_file"), layers).alias("b"))
    bad = e.where(F.col("a") > F.col("b")).withColumn("from_layer", F.element_at(names, F.col("a") + 1)).withColumn("to_layer", F.element_at(names, F.col("b") + 1))
    excused = F.lit(False)
    for x, y in allow:
        excused = excused | ((F.col("from_layer") == x) & (F.col("to_layer") == y))
    return bad.where(excused if allowed else ~excused).groupBy("s_name", "s_file", "d_name", "d_file", "from_layer", "to_layer").agg(F.count(F.lit(1)).alias("calls"))


def unclassified_files(g: PropertyGraph, layers: list[tuple[str, list[str]]]) -> DataFrame:
    """(file, calls): files of cross-file calls that are in no layer, with the calls at either end of them."""
    ends = _ends(g).where("s_file <> d_file").select(F.explode(F.array("s_file", "d_file")).alias("file"))
    return ends.where(_layer(F.col("file"), layers).isNull()).groupBy("file").agg(F.count(F.lit(1)).alias("calls"))


def scope_symbols(g: PropertyGraph, file: str) -> DataFrame:
    return g.nodes.where((F.col("file") == file) & ~F.col("label").isin("File", "Commit")).select("node_id", "name", "label", "line")


def scope_exports(g: PropertyGraph, file: str) -> DataFrame:
    """Symbols of the file that other files call: distinct callers, and the first three of their files."""
    e = _ends(g).where((F.col("d_file") == file) & (F.col("s_file") != file))
    return e.groupBy(F.col("d_name").alias("name"), F.col("d_label").alias("label")).agg(F.count_distinct("src_id").alias("callers"), F.array_join(F.slice(F.array_sort(F.collect_set("s_file")), 1, 3), ",").alias("sample_files"))


def scope_imports(g: PropertyGraph, file: str) -> DataFrame:
    """Symbols of other files that this file calls, by distinct users."""
    e = _ends(g).where((F.col("s_file") == file) & (F.col("d_file") != file))
    return e.groupBy(F.col("d_name").alias("name"), F.col("d_file").alias("file")).agg(F.count_distinct("src_id").alias("users"))


def scope_internal(g: PropertyGraph, file: str) -> DataFrame:
    """Symbols of the file whose names are in neither list."""
    named = scope_exports(g, file).select("name").union(scope_imports(g, file).select("name"))
    return scope_symbols(g, file).join(named, "name", "left_anti").select("node_id", "name", "label", "line")


#: Extensions that a file name is tried with, in this order.
RETRY_EXTENSIONS = (".py", ".ts", ".tsx", ".js", ".jsx", ".go", ".rs")


def resolve_file(g: PropertyGraph, text: str, dir_filter: str | None = None, limit: int = 10) -> DataFrame:
    """Files that a partial path may mean: those that contain it, else it with an extension, else its stem; (stage, file)."""
    files = g.nodes.where("file is not null").select("file").distinct()
    if dir_filter:
        files = files.where(F.contains("file", F.lit(dir_filter)))
    stem = text.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    tail = "." + text.rsplit(".", 1)[1] if "." in text.rsplit("/", 1)[-1] else ""
    stage = F.when(F.contains("file", F.lit(text)), 0)
    for k, ext in enumerate(RETRY_EXTENSIONS, 1):
        stage = stage.when(F.contains("file", F.lit(text + ext)), k)
    stage = stage.when(F.contains("file", F.lit(stem)) & F.col("file").endswith(tail), len(RETRY_EXTENSIONS) + 1)
    found = files.select("file", stage.alias("stage")).where("stage is not null")
    first = found.agg(F.min("stage").alias("first"))
    return found.crossJoin(F.broadcast(first)).where("stage = first").select("stage", "file").orderBy("file").limit(limit)  # first is one row


def graph_stats(g: PropertyGraph) -> DataFrame:
    """Totals; an edge counts if both its ends do."""
    ids = g.nodes.select("node_id")
    e = g.edges.join(ids, g.edges.src_id == ids.node_id, "left_semi")
    e = e.join(ids, e.dst_id == ids.node_id, "left_semi")
    return g.nodes.select(F.lit("nodes").alias("what")).unionAll(e.select(F.lit("edges"))).groupBy("what").agg(F.count(F.lit(1)).alias("total"))


def label_histogram(g: PropertyGraph) -> DataFrame:
    return g.nodes.groupBy("label").agg(F.count(F.lit(1)).alias("total"))


def inconsistencies(g: PropertyGraph) -> DataFrame:
    """Nodes without a name or file, and (file, name) pairs that occur more than once."""
    missing = g.nodes.where("name is null or file is null").agg(F.count(F.lit(1)).alias("total")).select(F.lit("missing").alias("what"), "total")
    twice = g.nodes.groupBy("file", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("total")).select(F.lit("duplicates").alias("what"), "total")
    return missing.unionAll(twice)


def last_commit(commits: DataFrame, modified_by: DataFrame | None = None) -> DataFrame:
    """The newest commit; if links are given, of those that some symbol links to."""
    own = commits if modified_by is None else commits.join(modified_by.select(F.col("dst_id").alias("commit_hash")).distinct(), "commit_hash", "left_semi")
    return own.orderBy(F.desc("ts"), "commit_hash").limit(1)


def freshness(head: str, graph_head: str | None, commits_behind: int, stale_files: list[str]) -> dict:
    """Verdict on the store against the repository; -1 commits behind means unknown."""
    if graph_head is None or commits_behind < 0:
        verdict = "unknown"
    elif head == graph_head:
        verdict = "fresh"
    elif commits_behind:
        verdict = f"{commits_behind} commit{'s' * (commits_behind > 1)} behind"
    else:
        verdict = "out of sync"
    shown = ", ".join(stale_files[:5]) + (f" and {len(stale_files) - 5} more" if len(stale_files) > 5 else "")
    return {"verdict": verdict, "is_fresh": verdict == "fresh", "stale": shown}
