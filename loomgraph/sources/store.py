"""The graph on disk: versions of node, edge, commit and vector tables under one folder.

A write makes a new version in full and then moves a pointer, so readers see the old graph or the new one, never
half of either. Nodes and edges have a folder for each project, so a write touches its own project alone; edges are
partitioned by type, so scans read what they need.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.incremental import delete_nodes, modified_by, upsert_nodes, valid_edges
from ..schema import COMMITS, EDGES, NODES, PropertyGraph

PARTITIONS = {"nodes": ["project_id"], "edges": ["project_id", "type"], "commits": [], "vectors": [], "vector_words": []}
SCHEMAS = {"nodes": NODES, "edges": EDGES, "commits": COMMITS, "vectors": "node_id string, embedding array<float>", "vector_words": "w string, weight double"}


UPDATES = "update_id string, project_id string, commits string, at timestamp, success boolean, files long, added long, deleted long, modified long, duration_ms double, error string"
UPDATE_ROWS = "update_id string, file string, qualified_name string, op string, line int, type string"
#: Tables with a folder for each project.
OWNED = ("nodes", "edges")


class GraphStore:
    def __init__(self, spark: SparkSession, root: str, project: str = ""):
        self.spark, self.root, self.project = spark, root.rstrip("/"), project

    def _path(self, name: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return jvm, p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> dict[str, str]:
        """Table -> folder of the current version."""
        _, p, fs = self._path("current.json")
        if not fs.exists(p):
            return {}
        return json.loads("".join(r["value"] for r in self.spark.read.text(f"{self.root}/current.json").collect()))

    def _publish(self, manifest: dict[str, str]) -> None:
        jvm, tmp, fs = self._path(f".current-{uuid.uuid4().hex}")
        out = fs.create(tmp)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        now = self._path("current.json")[1]
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(tmp, now, options)

    def restore(self, manifest: dict[str, str]) -> None:
        """Makes earlier versions current again; their files are never changed."""
        if manifest != self.manifest():
            self._publish(manifest)

    def read(self, table: str, everything: bool = False) -> DataFrame:
        """A table: of the project, or of all projects if asked for or if the store has none."""
        held = [f for k, f in self.manifest().items() if k == table or k == f"{table}@{self.project}" or k.startswith(f"{table}@") and (everything or not self.project)]
        out = None
        for folder in held:  # one for each project
            df = self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.root}/{folder}")
            out = df if out is None else out.unionByName(df)
        return self.spark.createDataFrame([], SCHEMAS[table]) if out is None else out

    def _folder(self, name: str, df: DataFrame) -> str:
        folder = f"{name}-{uuid.uuid4().hex}"
        cols = [c.strip().split()[0] for c in SCHEMAS[name].replace("map<string,string>", "map").split(",")]
        df.select(*cols).write.partitionBy(*PARTITIONS[name]).parquet(f"{self.root}/{folder}")
        return folder

    def write(self, notes: dict[str, str] | None = None, **tables: DataFrame) -> None:
        """New versions of what read() gives of the tables, published together with notes on them; nodes and edges of other projects stay as they are."""
        manifest = self.manifest() | (notes or {})
        for name, df in tables.items():
            folder = self._folder(name, df)
            if name in OWNED:
                manifest = {k: f for k, f in manifest.items() if self.project or not k.startswith(f"{name}@")}
                manifest[f"{name}@{self.project}"] = folder
            else:
                manifest[name] = folder
        self._publish(manifest)

    def graph(self) -> PropertyGraph:
        return PropertyGraph(self.read("nodes"), self.read("edges"))

    def replace(self, g: PropertyGraph) -> None:
        """The project's nodes and edges anew; other projects keep theirs, unread and unwritten."""
        manifest = self.manifest()
        self._publish(manifest | {f"nodes@{self.project}": self._folder("nodes", g.nodes), f"edges@{self.project}": self._folder("edges", g.edges)})

    def clear(self) -> None:
        if not self.project:
            raise ValueError("clearing needs a project")
        self._publish({k: f for k, f in self.manifest().items() if k not in [f"{t}@{self.project}" for t in OWNED]})

    def upsert(self, nodes: DataFrame, edges: DataFrame | None = None) -> None:
        """Nodes by (label, node_id), and edges whose ends are there by then."""
        now = upsert_nodes(self.read("nodes"), nodes)
        tables = {"nodes": now}
        if edges is not None:
            tables["edges"] = valid_edges(now, self.read("edges").unionByName(edges))
        self.write(**tables)

    def delete(self, gone: DataFrame) -> None:
        n, e = delete_nodes(self.read("nodes"), self.read("edges"), gone)
        self.write(nodes=n, edges=e)

    def record_commit(self, commit: DataFrame, touched: DataFrame | None = None) -> None:
        """A commit, and MODIFIED_BY links from touched (commit_hash, node_ids)."""
        commits = self.read("commits").join(commit, "commit_hash", "left_anti").unionByName(commit)
        tables = {"commits": commits}
        if touched is not None:
            links = modified_by(self.read("nodes"), commits, touched)
            tables["edges"] = self.read("edges").unionByName(links).dropDuplicates(["src_id", "dst_id", "type"])
        self.write(**tables)

    # What updates did: appended, never rewritten, and kept apart from the versions.
    def record_update(self, result: DataFrame, delta: DataFrame | None) -> None:
        """Appends the result of an update (UPDATES), after the rows of its delta: a result without rows changed nothing."""
        if delta is not None:
            rows = delta.join(result.select("update_id"))  # one row
            rows.select("update_id", "file", "qualified_name", "op", F.col("line").cast("int"), "type").write.mode("append").parquet(f"{self.root}/update_rows")
        result.write.mode("append").parquet(f"{self.root}/updates")

    def updates(self) -> DataFrame:
        """The project's updates, or all if the store has none: results with their times, see UPDATES."""
        found = self._appended("updates", UPDATES)
        return found.where(F.col("project_id") == self.project) if self.project else found

    def update_rows(self) -> DataFrame:
        """(update_id, file, qualified_name, op, line, type) of the updates that ended."""
        return self._appended("update_rows", UPDATE_ROWS).join(self.updates().select("update_id"), "update_id", "left_semi")

    def _appended(self, name: str, schema: str) -> DataFrame:
        _, p, fs = self._path(name)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}") if fs.exists(p) else self.spark.createDataFrame([], schema)
