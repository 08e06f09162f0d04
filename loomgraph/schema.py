"""Schemas and enumerations of the property graph, the symbol tables and the session logs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels of nodes and types of edges.
NODE_LABELS = ("File", "Module", "Function", "Class", "Variable", "Type", "Interface", "Commit")
EDGE_TYPES = ("IMPORTS", "CALLS", "DEFINES", "INHERITS", "DEPENDS_ON", "TYPE_OF", "IMPLEMENTS", "MODIFIED_BY")
LABEL_OF_TYPE = {"function": "Function", "class": "Class", "variable": "Variable", "import": "Module", "type": "Type", "interface": "Interface"}
DEFAULT_LABEL = "Variable"

SYMBOLS = "project_id string, ord long, node_id string, type string, name string, qualified_name string, file string, line int, column int, end_line int, docstring string, parent string, language string"
CALLS = "project_id string, caller_id string, caller_file string, call_text string"
NODES = "project_id string, node_id string, label string, name string, file string, line int, column int, end_line int, docstring string, parent string, props map<string,string>"
EDGES = "project_id string, src_id string, dst_id string, type string, src_label string, dst_label string, props map<string,string>"
COMMITS = "commit_hash string, short_hash string, message string, author string, ts timestamp, ts_raw string, branch string, files_changed int"


@dataclass(frozen=True)
class PropertyGraph:
    """nodes (node_id, label, name, file, line, ...) and edges (src_id, dst_id, type, ...)."""

    nodes: DataFrame
    edges: DataFrame

    def calls(self) -> DataFrame:
        """Call edges between nodes of the graph, as (src_id, dst_id), distinct."""
        e = self.edges.where(F.col("type") == "CALLS").select("src_id", "dst_id").distinct()
        ids = self.nodes.select("node_id")
        return e.join(ids, e.src_id == ids.node_id, "left_semi").join(ids, e.dst_id == ids.node_id, "left_semi")

    def adjacency(self, reverse: bool = False):
        """The calls laid out for expansion, along or against them: stored once for this graph."""
        from .operators.adjacency import lay_out

        key = "_against" if reverse else "_along"
        if key not in self.__dict__:
            object.__setattr__(self, key, lay_out(self.calls(), reverse))
        return self.__dict__[key]

    def kept_calls(self) -> DataFrame:
        """The calls (src_id, dst_id) from the stored layout."""
        return self.adjacency().edges.select("src_id", "dst_id")


def node_id(type_: Column, file: Column, line: Column, name: Column) -> Column:
    return F.concat_ws(":", type_, file, line.cast("string"), name)


def qualified_name(parent: Column, name: Column) -> Column:
    return F.when(F.length(parent) > 0, F.concat_ws(".", parent, name)).otherwise(name)


def project_id(path: Column) -> Column:
    """Twelve hex digits of the path's SHA-256; every read and write is scoped by it."""
    return F.substring(F.sha2(path, 256), 1, 12)


def label_of(type_: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LABEL_OF_TYPE.items() for x in kv])
    return F.coalesce(F.element_at(table, type_), F.lit(DEFAULT_LABEL))


def priority(label: Column) -> Column:
    """Functions before classes before all others."""
    return F.when(label == "Function", 0).when(label == "Class", 1).otherwise(2)
