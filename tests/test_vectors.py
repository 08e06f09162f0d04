"""Nearest neighbours of more queries than a block holds."""

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import vectors


@pytest.mark.parametrize("block", [10_000, 1000])
def test_nearest_of_many_queries(spark, block, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", block, raising=False)
    rows = spark.createDataFrame([(i, [float(i * i), 1.0]) for i in range(6)], "node_id long, embedding array<float>")
    queries = spark.range(10_500).select(F.col("id").alias("query_id"), F.array((F.col("id") % 31).cast("float"), F.lit(1.0).cast("float")).alias("query"))
    got = {}
    for r in vectors.nearest_of_each(rows, queries, 2).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.node_id, r.distance)
    assert len(got) == 10_500
    for q, found in got.items():
        want = sorted(((i * i - q % 31) ** 2, i) for i in range(6))[:2]
        assert found == {k: (i, float(d)) for k, (d, i) in enumerate(want, 1)}


def test_pairs_of_blocks_are_not_sorted(spark):
    """Copies, ties to the smaller id, and vectors that are null, broken or of another width; no row a pair in the plan."""
    import random

    rng = random.Random(7)
    kept = [[float(rng.randrange(4)) / 3 for _ in range(8)] for _ in range(40)]
    data = [(i, kept[i % 40]) for i in range(1300)]
    df = spark.createDataFrame(data, "node_id long, embedding array<float>")
    queries = df.where("node_id % 20 = 0").selectExpr("node_id AS query_id", "embedding AS query")
    out = vectors.nearest_of_each(df, queries, 5)
    got = {(r.query_id, r["rank"]): (r.node_id, r.distance) for r in out.collect()}
    f = {r.node_id: r.embedding for r in df.collect()}
    for q in range(0, 1300, 20):
        want = sorted((sum((x - y) * (x - y) for x, y in zip(f[i], f[q], strict=True)), i) for i in f)[:5]
        assert [got[q, k] for k in range(1, 6)] == [(i, d) for d, i in want]
    assert "zip_with" not in out._jdf.queryExecution().optimizedPlan().toString()
    odd = spark.createDataFrame([(5000, None), (5001, [1.0]), (5002, [float("nan")] * 8)], "node_id long, embedding array<float>")
    more = vectors.nearest_of_each(df.unionByName(odd), queries.where("query_id = 0"), 5).orderBy("rank").collect()
    assert [r.node_id for r in more] == [5000, 5001, 0, 40, 80] and [r.distance for r in more[:2]] == [None, None]
