"""Vectors of symbols: text to embed, a hashed embedding, exact nearest neighbours, lexical search."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

WIDTH = 384
#: Queries that a task holds at once; rows of a block.
BLOCK, ROWS = 10_000, 1000


def embedding_text() -> Column:
    """Name, type, docstring and parent; what is empty is left out."""
    some = lambda c, prefix="": F.when(F.length(c) > 0, F.concat(F.lit(prefix), F.col(c)))
    return F.concat_ws(" ", some("name"), some("type", "type: "), some("docstring"), some("parent", "parent: "))


def _bag(rows: DataFrame, text: Column, id: str) -> DataFrame:
    words = F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != ""))
    return rows.select(F.col(id).alias("id"), F.explode(words).alias("w"))


def word_weights(rows: DataFrame, text: Column, id: str = "node_id") -> DataFrame:
    """(w, weight): the rarer a word is over all rows, the more it weighs."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    rare = _bag(rows, text, id).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    return rare.crossJoin(F.broadcast(total)).select("w", (F.log((F.col("total") + 1.0) / (F.col("df") + 1.0)) + 1).alias("weight"))  # total is one row


def embed(rows: DataFrame, text: Column, id: str = "node_id", width: int = WIDTH, weights: DataFrame | None = None) -> DataFrame:
    """(id, embedding array<float>): a hashed bag of words of unit length. A stand-in where no model is installed.

    Words weigh by their rarity over all rows, or as ``weights`` says; a word that it lacks weighs as much as its rarest.
    """
    rare = word_weights(rows, text, id) if weights is None else weights
    most = rare.agg(F.coalesce(F.max("weight"), F.lit(1.0)).alias("most"))
    bag = _bag(rows, text, id).join(rare, "w", "left").crossJoin(F.broadcast(most)).withColumn("weight", F.coalesce("weight", "most"))  # one row
    slots = bag.groupBy("id", F.pmod(F.xxhash64("w"), F.lit(width)).cast("int").alias("slot")).agg(F.sum("weight").alias("x"))
    norm = slots.groupBy("id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.map_from_entries(F.collect_list(F.struct("slot", "x"))).alias("at"))  # width entries at most
    vector = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: (F.coalesce(F.element_at("at", k), F.lit(0.0)) / F.col("norm")).cast("float"))
    return norm.select(F.col("id").alias(id), vector.alias("embedding"))


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, query: list[float], k: int = 5, id: str = "node_id", vector: str = "embedding") -> DataFrame:
    """(id, distance, score): the k nearest by squared distance, ties to the smaller id; score is 1 / (1 + distance)."""
    d = squared_l2(F.col(vector), F.array(*[F.lit(float(x)) for x in query]))
    return vectors.select(F.col(id), d.alias("distance")).orderBy("distance", id).limit(k).withColumn("score", 1 / (1 + F.col("distance")))


def _packed(rows: DataFrame, kind: str, width: int) -> DataFrame:
    """(block, ids, data): rows (id, vec) of vectors of this width in blocks of ROWS, by rising id, as matrices of doubles."""
    arrow = pa.schema([("block", pa.string()), ("ids", pa.list_(to_arrow_schema(StructType.fromDDL(f"id {kind}")).field("id").type)), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_pylist()
            m = batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
            order = sorted(range(len(ids)), key=ids.__getitem__)
            for at in range(0, len(order), ROWS):
                part = order[at : at + ROWS]
                yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([[ids[i] for i in part]], arrow.field("ids").type), pa.array([m[part].tobytes()], pa.binary())], schema=arrow)

    return rows.mapInArrow(run, f"block string, ids array<{kind}>, data binary")


def _closest(met: DataFrame, k: int, width: int, kinds: tuple[str, str]) -> DataFrame:
    """(query_id, node, distance): of block pairs (q_block, q_ids, q, v_ids, v) the k nearest of each query that a task has seen.

    A product of matrices bounds the distances; those that may be among the k nearest so far are then computed as
    squared_l2 does, term after term.
    """
    schema = f"query_id {kinds[0]}, node {kinds[1]}, distance double"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def told(held: list) -> pa.RecordBatch:
        rows = [(q, n, d) for ids, best, _ in held for q, found in zip(ids, best, strict=True) for d, n in found]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}  # by block of queries, in the order of their first pair; as many queries as BLOCK
        for row in (batch.slice(i, 1).to_pylist()[0] for batch in batches for i in range(batch.num_rows)):
            key = row["q_block"]
            if key not in held:
                while held and (len(held) + 1) * ROWS > BLOCK:
                    yield told([held.pop(next(iter(held)))])
                held[key] = (row["q_ids"], [[] for _ in row["q_ids"]], np.full(len(row["q_ids"]), np.inf))
            _, best, far = held[key]
            q, v = (np.frombuffer(row[c], np.float64).reshape(-1, width) for c in ("q", "v"))
            qn, vn = (q * q).sum(1)[:, None], (v * v).sum(1)
            near = qn + vn - 2 * (q @ v.T)
            slack = 8 * (width + 4) * np.finfo(np.float64).eps * (qn + vn.max(initial=0))
            if len(v) > k:
                far_here = np.minimum(far, np.partition(near, k - 1, axis=1)[:, k - 1] + slack[:, 0]) if not np.isfinite(far).all() else far
            else:
                far_here = far
            some = near <= far_here[:, None] + slack
            for i in np.flatnonzero(some.any(1)).tolist():
                at = np.flatnonzero(some[i])
                diff = v[at] - q[i]
                d = np.cumsum(diff * diff, axis=1)[:, -1] if width else np.zeros(len(at))
                order = np.argsort(d, kind="stable")[:k]  # ids rise within a block
                best[i] = sorted(best[i] + [(float(d[j]), row["v_ids"][at[j]]) for j in order.tolist()])[:k]
                if len(best[i]) == k:
                    far[i] = best[i][-1][0]
        if held:
            yield told(list(held.values()))

    return met.mapInArrow(run, schema)


def nearest_of_each(vectors: DataFrame, queries: DataFrame, k: int = 5, id: str = "node_id", vector: str = "embedding") -> DataFrame:
    """The k nearest of each query (query_id, query), in pairs of blocks that are multiplied as matrices; each task keeps k rows a query.

    Pairs with a vector that is null, not finite or of another width than most are compared one by one; their distance may be null, and comes first.
    """
    v, q = vectors.select(F.col(id).alias("id"), F.col(vector).alias("vec")), queries.select(F.col("query_id").alias("id"), F.col("query").alias("vec"))
    fine = F.coalesce(F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < 1e100)) & F.col("id").isNotNull(), F.lit(False))
    widths = v.where(fine).groupBy(F.size("vec").alias("w")).count().orderBy(F.desc("count"), "w").first()
    width = widths["w"] if widths else 0
    plain = F.coalesce(fine & (F.size("vec") == width), F.lit(False))
    kinds = dict(q.dtypes)["id"], dict(v.dtypes)["id"]
    blocks = [_packed(x.where(plain), kind, width).withColumnsRenamed({"block": f"{c}_block", "ids": f"{c}_ids", "data": c}) for c, x, kind in (("q", q, kinds[0]), ("v", v, kinds[1]))]
    # Blocks of vectors go to as many tasks as there are cores, whatever files they come from.
    met = blocks[0].crossJoin(blocks[1].repartition(vectors.sparkSession.sparkContext.defaultParallelism))
    rows = _closest(met, k, width, kinds)
    odd = lambda x, on: x.where(~plain if on else plain)
    for a, b in ((odd(q, True), v), (odd(q, False), odd(v, True))):
        if a.limit(1).count() and b.limit(1).count():
            a, b = a.select(F.col("id").alias("query_id"), F.col("vec").alias("_q")), b.select(F.col("id").alias("node"), F.col("vec").alias("_v"))
            rows = rows.unionByName(b.crossJoin(a).select("query_id", "node", squared_l2(F.col("_v"), F.col("_q")).alias("distance")))
    best = Window.partitionBy("query_id").orderBy("distance", "node")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("node").alias(id), "distance", (1 / (1 + F.col("distance"))).alias("score"))


def lexical(symbols: DataFrame, query: str, k: int = 5) -> DataFrame:
    """Search without vectors: 1 for the exact name, 0.8 for a part of it, 0.5 for a part of the docstring; ties by ord."""
    if not query:
        return symbols.limit(0).withColumn("score", F.lit(0.0))
    q = query.lower()
    name = F.lower("name")
    score = F.when(name == q, 1.0).when(F.contains(name, F.lit(q)), 0.8).when(F.contains(F.lower(F.coalesce("docstring", F.lit(""))), F.lit(q)), 0.5)
    return symbols.withColumn("score", score).where("score is not null").orderBy(F.desc("score"), "ord").limit(k)
