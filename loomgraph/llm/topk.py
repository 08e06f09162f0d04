"""Exact top-k by inner product, with a table of distances to pivots.

Vectors are lifted by one coordinate so that they all have the same length; ranking by inner product is then
ranking by Euclidean distance, and the triangle inequality holds. Each vector's distances to the pivots are
computed once and kept with it; for a query, the largest difference over the pivots bounds its distance to a
candidate from below, so its score from above. Candidates are scored in the order of their bounds until no bound
can reach the k-th best score. Vectors too long for exact floating-point products are left out of the table, not of
the search: they are scored by whole numbers of any size.

Queries and candidates meet in blocks of bounded size: a stated query set against all rows. A block pair returns
k rows a query, and a window over those few picks the k best of all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _arrow_schema, bounded_batches, durable, table

PIVOTS = 64
CANDIDATE_BLOCK = 16384
QUERY_BLOCK = 512
#: Slack of the bounds for rounding, relative to the squared length of the lifted vectors.
SLACK = 1e-9
#: Squared length below which products are exact in 64-bit floating point.
NARROW = 2.0**52
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def _floor(c: Column) -> Column:
    """floor as a double: beyond 2 ** 52 all doubles are whole."""
    return F.when(F.abs(c) < 2.0**52, F.floor(c).cast("double")).otherwise(c)


def usable(vectors: DataFrame, id: str, vector: str, scale: int) -> DataFrame:
    """(id, v array<double>, norm): floor(scale * x) of rows with an id and a vector whose components are all finite numbers; norm is the squared length."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    good = F.col(vector).isNotNull() & F.col(id).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    most = F.lit(1.7976931348623157e308)  # what leaves the range of doubles when scaled stays at its end
    v = F.transform(x, lambda c: _floor(F.greatest(-most, F.least(most, c * scale))))
    return vectors.where(good).select(F.col(id).cast("long").alias("id"), v.alias("v")).withColumn("norm", F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))


def pivot_distances(v: np.ndarray, lift: np.ndarray, pivots: np.ndarray, pivot_lift: np.ndarray) -> np.ndarray:
    square = (v * v).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * v @ pivots.T
    return np.sqrt(np.maximum(square + (lift[:, None] - pivot_lift[None, :]) ** 2, 0))


def search_block(q_ids, q, table_q, c_ids, c, table_c, top, k, scored: list[int] | None = None) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of each query's k best in this block; ties go to the smaller id. Rows come with their distances to the pivots; scored gets the number of candidates that were not eliminated."""
    q_square = (q * q).sum(1)
    reach = np.abs(table_c).max(initial=0)
    out = []
    for i in range(len(q)):
        # float32 rounds each stored distance by less than 1e-7 of it; the slack covers both roundings.
        low = np.zeros(len(c), np.float32)
        for p in range(table_c.shape[1]):
            np.maximum(low, np.abs(table_c[:, p] - table_q[i, p]), out=low)
        low = np.maximum(low.astype(float) - 4e-7 * (float(reach) + float(np.abs(table_q[i]).max(initial=0))), 0)
        # a query has no lift of its own: its distance to a lifted candidate gives the score
        bound = (q_square[i] + top - low * low) / 2 + SLACK * (top + q_square[i]) + 1e-6
        ids, scores, step = np.empty(0, np.int64), np.empty(0, np.int64), 256
        left = np.arange(len(c))
        while len(left):
            take = min(step, len(left))
            part = np.argpartition(-bound[left], take - 1)[:take] if take < len(left) else np.arange(len(left))
            now = left[part]
            if scored is not None:
                scored.append(take)
            got = (c[now] @ q[i]).astype(np.int64)
            own = c_ids[now] != q_ids[i]
            ids, scores = np.concatenate([ids, c_ids[now][own]]), np.concatenate([scores, got[own]])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            left = np.delete(left, part)
            if len(ids) == k:
                left = left[bound[left] >= scores[-1]]
            step *= 4
        out += zip([int(q_ids[i])] * len(ids), ids.tolist(), scores.tolist(), strict=True)
    return out


def search_wide(q_ids, q, c_ids, c, k) -> list[tuple[int, int, int]]:
    """The same by whole numbers of any size, all candidates scored; a score beyond 64 bits counts as the nearest that fits."""
    whole = lambda x: np.array([[int(y) for y in r] for r in x.tolist()], object).reshape(x.shape)
    out, wide = [], whole(c)
    for i, row in zip(q_ids.tolist(), whole(q), strict=True):
        scores = [max(LEAST, min(MOST, int(s))) for s in (wide @ row if c.shape[1] else [0] * len(c))]
        best = sorted((-s, j) for s, j in zip(scores, c_ids.tolist(), strict=True) if j != i)[:k]
        out += [(i, j, -s) for s, j in best]
    return out


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products, ties to the smaller id.

    - Queries are rows whose id is divisible by ``every``; candidates all rows but those with the query's own id.
    - Ids are whole numbers. Scores are whole and exact; one beyond 64 bits counts as the nearest 64-bit number, also when
      it is ranked, and components beyond the doubles' range when scaled as its end.
    - Rows with a null id, a null vector or a component that is null or not finite take no part; vectors meet only
      others of their own length, and empty ones score 0.
    - Rows that repeat an id are candidates of their own, and a repeated query is asked once. An empty table gives an empty result.
    - Pivots are a fixed number of vectors of each length, in the order of a hash of their id: they affect speed only, and
      how much they eliminate depends on how the vectors cluster. Very long vectors and columns of any name make no difference.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    base = durable(usable(vectors, id, vector, scale).withColumn("dim", F.size("v")).withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1 << 40))))
    narrow = F.col("norm") < NARROW
    shape = base.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(narrow, F.col("norm"))).alias("top"), F.count_if(F.col("id") % every == 0).alias("q")).collect()  # a row per length
    schema = "query_id long, vec_id long, score long"
    parts = None
    for s in shape:
        if not s["q"]:
            continue
        own = base.where(F.col("dim") == s["dim"])
        # A fixed number of rows, so a closure of bounded size.
        rows = own.where(narrow).orderBy("h", "id").limit(pivots).collect()
        chosen = np.array([r["v"] for r in rows], float).reshape(len(rows), s["dim"])
        top = float(s["top"] or 0)
        blocks, asked = -(-s["n"] // CANDIDATE_BLOCK), -(-s["q"] // QUERY_BLOCK)
        deal = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("long")
        query = own.where(F.col("id") % every == 0).dropDuplicates(["id"]).select("id", "v", "norm", deal(asked, 1).alias("qb"))
        query = _with_distances(query, chosen, top, False).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
        # A repeated id, however frequent, is dealt over all blocks by the row's place in the table.
        cand = own.select("id", "v", "norm", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(blocks)).cast("long").alias("cb"))
        cand = _with_distances(cand, chosen, top, True).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(asked - 1)).cast("array<long>")))

        met = query.groupBy("cb", "qb").cogroup(cand.groupBy("cb", "qb")).applyInArrow(_meet(top, k, s["dim"], len(chosen)), schema)
        parts = met if parts is None else parts.unionByName(met)
    if parts is None:
        parts = spark.createDataFrame([], schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return parts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _with_distances(rows: DataFrame, pivots: np.ndarray, top: float, lifted: bool) -> DataFrame:
    """The rows with their distances to the pivots in ``t array<float>``, computed once for each; zeros for vectors that the bounds leave out."""
    lift = np.sqrt(np.maximum(top - (pivots * pivots).sum(1), 0))
    schema = ", ".join(f"{n} {k}" for n, k in rows.dtypes) + ", t array<float>"
    arrow = _arrow_schema(rows.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("v"), pivots.shape[1])
            norm = batch.column("norm").to_numpy()
            v = np.where((norm < NARROW)[:, None], v, 0.0)
            own = np.sqrt(np.maximum(top - (v * v).sum(1), 0)) if lifted else np.zeros(len(v))
            t = pivot_distances(v, own, pivots, lift).astype(np.float32)
            made = pa.ListArray.from_arrays(pa.array(np.arange(len(t) + 1) * t.shape[1], pa.int32()), pa.array(t.ravel()))
            yield pa.RecordBatch.from_arrays([*[c.cast(f.type) for c, f in zip(batch.columns, arrow, strict=False)], made.cast(arrow.field("t").type)], schema=arrow)

    return rows.mapInArrow(run, schema)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _meet(top: float, k: int, dim: int, width: int):
    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        if left.num_rows and right.num_rows:
            (qi, q, qn, tq), (ci, c, cn, tc) = (
                (x.column("id").to_numpy(), matrix(x.column("v").combine_chunks(), dim), x.column("norm").to_numpy() < NARROW, matrix(x.column("t").combine_chunks(), width)) for x in (left, right)
            )
            found = search_block(qi[qn], q[qn], tq[qn], ci[cn], c[cn], tc[cn], top, k)
            if not cn.all():
                found += search_wide(qi[qn], q[qn], ci[~cn], c[~cn], k)
            if not qn.all():
                found += search_wide(qi[~qn], q[~qn], ci, c, k)
        columns = list(zip(*found, strict=True)) if found else [(), (), ()]
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), columns, strict=True)})

    return meet


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, coalesce(score, 0)::BIGINT AS score FROM r WHERE rank <= 5
"""
