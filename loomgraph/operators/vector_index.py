"""Vectors of a graph's nodes, kept in the graph store with the commit they were built at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import durable
from ..sources.store import GraphStore
from .vectors import WIDTH, embed, embedding_text, nearest, word_weights


class VectorIndex:
    """The weights of words are frozen when the index is built: refreshed vectors and queries use them, too."""

    HEAD = "vectors_head"

    def __init__(self, store: GraphStore):
        self.store = store

    def _texts(self) -> DataFrame:
        n = self.store.read("nodes").where(~F.col("label").isin("File", "Commit"))
        return n.select("node_id", n["name"], F.col("label").alias("type"), "docstring", "parent")

    def build(self, head: str | None = None) -> None:
        """Vectors of all nodes but files and commits, anew."""
        rows = self._texts()
        weights = durable(word_weights(rows, embedding_text()))
        self.store.write({self.HEAD: head or ""}, vectors=embed(rows, embedding_text(), weights=weights), vector_words=weights)

    def exists(self) -> bool:
        return "vectors" in self.store.manifest()

    def load(self, head: str | None = None) -> DataFrame | None:
        """The vectors, or None if there are none, or if they were built at another commit; an unknown commit passes."""
        built = self.store.manifest().get(self.HEAD)
        if not self.exists() or (built and head and built != head):
            return None
        return self.store.read("vectors")

    def refresh(self, changed: DataFrame, head: str | None = None) -> None:
        """Vectors of the changed nodes (node_id) anew, and none of nodes that are gone."""
        rows = self._texts()
        ids = durable(changed.select("node_id").distinct())
        fresh = embed(rows.join(ids, "node_id", "left_semi"), embedding_text(), weights=self.store.read("vector_words"))
        kept = self.store.read("vectors").join(ids, "node_id", "left_anti").join(rows.select("node_id"), "node_id", "left_semi")
        self.store.write({self.HEAD: head or ""}, vectors=kept.unionByName(fresh))

    def search(self, query: str, k: int = 5, head: str | None = None) -> DataFrame | None:
        """(node_id, name, file, line, docstring, distance, score) of the k nearest, or None without a fresh index."""
        vectors = self.load(head)
        if vectors is None:
            return None
        asked = self.store.spark.createDataFrame([("q", query)], "node_id string, text string")
        row = embed(asked, F.col("text"), weights=self.store.read("vector_words")).first()
        near = nearest(vectors, row["embedding"] if row else [0.0] * WIDTH, k)  # k rows
        nodes = self.store.read("nodes").select("node_id", "name", "file", "line", "docstring")
        return F.broadcast(near).join(nodes, "node_id").orderBy("distance", "node_id")

    def stats(self) -> dict:
        m = self.store.manifest()
        return {"vectors": self.store.read("vectors").count(), "words": self.store.read("vector_words").count(), "width": WIDTH, "head": m.get(self.HEAD) or None}
