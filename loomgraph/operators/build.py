"""Graph construction: nodes by projection, edges by joins with the first symbol of a name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import PropertyGraph, label_of, node_id
from .incremental import valid_edges


def nodes_of(symbols: DataFrame) -> DataFrame:
    """A File node for each file, and a node for each symbol; of the same id the first."""
    none = lambda kind: F.lit(None).cast(kind)
    files = symbols.groupBy("project_id", "file").agg(F.lit(1).alias("one")).select(
        "project_id", node_id(F.lit("File"), F.col("file"), F.lit(1), F.col("file")).alias("node_id"), F.lit("File").alias("label"), F.col("file").alias("name"), "file",
        F.lit(1).alias("line"), F.lit(1).alias("column"), none("int").alias("end_line"), none("string").alias("docstring"), none("string").alias("parent"), none("map<string,string>").alias("props"),
    )
    own = symbols.groupBy("node_id").agg(F.min_by(F.struct("project_id", "type", "name", "file", "line", "column", "end_line", "docstring", "parent"), "ord").alias("s")).select("node_id", "s.*")
    own = own.select("project_id", "node_id", label_of(F.col("type")).alias("label"), "name", "file", "line", "column", "end_line", "docstring", "parent", none("map<string,string>").alias("props"))
    return files.unionByName(own)


def first_of_name(symbols: DataFrame) -> DataFrame:
    """(target, target_id, target_type): the first symbol of each name."""
    return symbols.groupBy(F.col("name").alias("target")).agg(F.min_by(F.struct("node_id", "type"), "ord").alias("s")).select("target", F.col("s.node_id").alias("target_id"), F.col("s.type").alias("target_type"))


def resolve_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(project_id, caller_id, callee_id, callee_type) of calls (caller_id, caller_file, call_text).

    A plain name means the first symbol of that name in the caller's file, else the first anywhere; a dotted one the
    first anywhere of its last part. Others are dropped.
    """
    text = F.trim("call_text")
    is_dotted = F.contains(text, F.lit("."))
    c = calls.select("project_id", "caller_id", "caller_file", is_dotted.alias("is_dotted"), F.substring_index(text, ".", -1).alias("target")).distinct()
    near = symbols.groupBy(F.col("name").alias("target"), F.col("file").alias("caller_file")).agg(F.min_by(F.struct("node_id", "type"), "ord").alias("n"))
    met = c.join(near, ["target", "caller_file"], "left").join(first_of_name(symbols), "target", "left")
    own = ~F.col("is_dotted") & F.col("n").isNotNull()
    return met.select("project_id", "caller_id", F.when(own, F.col("n.node_id")).otherwise(F.col("target_id")).alias("callee_id"), F.when(own, F.col("n.type")).otherwise(F.col("target_type")).alias("callee_type")).where("callee_id is not null")


def edges_of(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """DEFINES, INHERITS (of a nested class from the class around it), IMPORTS and CALLS edges."""
    file_id = node_id(F.lit("File"), F.col("file"), F.lit(1), F.col("file"))
    first = first_of_name(symbols)

    def edge(df, src, dst, type_, src_label, dst_label):
        return df.select("project_id", src.alias("src_id"), dst.alias("dst_id"), F.lit(type_).alias("type"), src_label.alias("src_label"), dst_label.alias("dst_label"), F.lit(None).cast("map<string,string>").alias("props"))

    own = label_of(F.col("type"))
    defines = edge(symbols, file_id, F.col("node_id"), "DEFINES", F.lit("File"), own)
    nested = symbols.where("type = 'class' and length(parent) > 0").join(first, F.col("parent") == F.col("target"))
    inherits = edge(nested, F.col("node_id"), F.col("target_id"), "INHERITS", own, label_of(F.col("target_type")))
    imports = edge(symbols.where("type = 'import'").join(first, F.col("name") == F.col("target")), file_id, F.col("target_id"), "IMPORTS", F.lit("File"), label_of(F.col("target_type")))
    called = resolve_calls(calls, symbols)
    calls_ = edge(called, F.col("caller_id"), F.col("callee_id"), "CALLS", F.lit("Function"), F.lit("Function"))
    return defines.unionByName(inherits).unionByName(imports).unionByName(calls_)


def build(symbols: DataFrame, calls: DataFrame) -> PropertyGraph:
    """The graph; edges whose ends are missing, or have other labels than the edge says, are dropped."""
    nodes = nodes_of(symbols)
    return PropertyGraph(nodes, valid_edges(nodes, edges_of(symbols, calls)))
