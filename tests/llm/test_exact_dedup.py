"""Repeated ids with different texts."""

from loomgraph.llm.exact_dedup import keep_first


def test_losing_copy_of_a_kept_id(spark):
    rows = [(1, "b"), (3, "b"), (3, "a"), (None, "b"), (None, "c  d"), (4, "c d")]
    got = keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(1, "b"), (3, "a"), (4, "c d")]
