"""Snapshot deltas, their application, and the upsert of nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_of_each(symbols: DataFrame) -> DataFrame:
    """One row per file and qualified name: the last."""
    last = Window.partitionBy("file", "qualified_name").orderBy(F.desc("ord"))
    return symbols.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file, qualified_name, op, line, type): added, deleted, or modified where the line or type differs."""
    key = ["file", "qualified_name"]
    b = last_of_each(before).select(*key, F.col("line").alias("b_line"), F.col("type").alias("b_type"), F.lit(True).alias("was"))
    a = last_of_each(after).select(*key, F.col("line").alias("a_line"), F.col("type").alias("a_type"), F.lit(True).alias("is"))
    op = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "deleted").when(~F.col("a_line").eqNullSafe(F.col("b_line")) | ~F.col("a_type").eqNullSafe(F.col("b_type")), "modified")
    return b.join(a, key, "full").select(*key, op.alias("op"), F.coalesce("a_line", "b_line").alias("line"), F.coalesce("a_type", "b_type").alias("type")).where("op is not null")


def is_empty(changes: DataFrame) -> bool:
    return not changes.limit(1).count()


def apply_delta(symbols: DataFrame, changes: DataFrame, after: DataFrame) -> DataFrame:
    """The symbols with a delta applied. An added name that its file already has is a conflict and raises; a deleted one that is missing is not."""
    key = ["file", "qualified_name"]
    clash = changes.where("op = 'added'").join(symbols, key, "left_semi").limit(1).collect()
    if clash:
        raise ValueError(f"{clash[0]['qualified_name']} is already in {clash[0]['file']}")
    kept = symbols.join(changes.where("op <> 'added'").select(*key), key, "left_anti")
    new = after.join(changes.where("op <> 'deleted'").select(*key), key, "left_semi")
    return kept.unionByName(new)


def structural_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file, structural): whether a file's set of names differs; a file without a snapshot before counts as changed."""
    names = lambda df, c: df.groupBy("file").agg(F.array_sort(F.collect_set("name")).alias(c))
    return names(before, "b").join(names(after, "a"), "file", "full").select("file", (~F.col("a").eqNullSafe(F.col("b"))).alias("structural"))


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """New values over old ones by (label, node_id); what is null in the new keeps its old value."""
    key = ["label", "node_id"]
    cols = [c for c in old.columns if c not in key]
    n = new.dropDuplicates(key).select(*key, *[F.col(c).alias(f"_{c}") for c in cols if c in new.columns])
    joined = old.join(n, key, "full")

    def value(c):
        if c not in new.columns:
            return F.col(c)
        if c == "props":
            empty = F.create_map().cast("map<string,string>")
            mine, theirs = F.coalesce(F.col("_props"), empty), F.coalesce(F.col("props"), empty)
            return F.map_concat(F.map_filter(theirs, lambda k, v: ~F.array_contains(F.map_keys(mine), k)), mine).alias(c)
        return F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c)

    return joined.select(*[c if c in key else value(c) for c in old.columns])


def valid_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends exist with the labels the edge names, distinct; the others are dropped."""
    s, d = nodes.select(F.col("node_id").alias("src_id"), F.col("label").alias("src_label")), nodes.select(F.col("node_id").alias("dst_id"), F.col("label").alias("dst_label"))
    return edges.join(s, ["src_id", "src_label"], "left_semi").join(d, ["dst_id", "dst_label"], "left_semi").dropDuplicates(["src_id", "dst_id", "type"])


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes of gone (node_id) and all their edges."""
    ids = gone.select("node_id").distinct()
    left = edges.join(ids.withColumnRenamed("node_id", "src_id"), "src_id", "left_anti").join(ids.withColumnRenamed("node_id", "dst_id"), "dst_id", "left_anti")
    return nodes.join(ids, "node_id", "left_anti"), left


#: Touched nodes among which a task looks for equal ones.
TOUCHED_A_TASK = 1_000_000


def modified_by(nodes: DataFrame, commits: DataFrame, touched: DataFrame) -> DataFrame:
    """MODIFIED_BY edges from touched (commit_hash, node_ids): both ends must exist. A commit may have several rows, with some of its nodes each."""
    size = touched.agg(F.sum(F.size("node_ids"))).first()[0] or 0
    rows = touched.select("commit_hash", F.explode("node_ids").alias("src_id"))
    rows = rows.repartition(max(touched.sparkSession.sparkContext.defaultParallelism, -(-size // TOUCHED_A_TASK)), "commit_hash", "src_id").distinct()
    n = nodes.select(F.col("node_id").alias("src_id"), F.col("label").alias("src_label"), "project_id")
    return rows.join(commits.select("commit_hash"), "commit_hash", "left_semi").join(n, "src_id").select(
        "project_id", "src_id", F.concat(F.lit("Commit:"), "commit_hash").alias("dst_id"), F.lit("MODIFIED_BY").alias("type"), "src_label", F.lit("Commit").alias("dst_label"), F.lit(None).cast("map<string,string>").alias("props")
    )
