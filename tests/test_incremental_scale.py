"""MODIFIED_BY edges without lists of a commit's nodes."""

from loomgraph.operators import incremental
from loomgraph.plans import building, derived


def test_touched_nodes_are_dealt_over_tasks(spark, monkeypatch):
    """A commit's nodes may come in several rows, and repeat; tasks have so many of them at most."""
    monkeypatch.setattr(incremental, "TOUCHED_A_TASK", 2, raising=False)
    nodes = spark.createDataFrame([("p", "a", "Function"), ("p", "b", "Class")], "project_id string, node_id string, label string")
    commits = spark.createDataFrame([("1",), ("2",)], "commit_hash string")
    rows = [("1", ["a", "b"])] + [("1", [x]) for x in "abz"] + [("2", ["b"]), ("2", ["b", None]), ("2", []), ("3", ["a"])] + [("2", ["a"])] * 200
    df = incremental.modified_by(nodes, commits, spark.createDataFrame(rows, "commit_hash string, node_ids array<string>"))
    assert sorted((r.src_id, r.dst_id, r.src_label) for r in df.collect()) == [("a", "Commit:1", "Function"), ("a", "Commit:2", "Function"), ("b", "Commit:1", "Class"), ("b", "Commit:2", "Class")]
    size = sum(len(x) for _, x in rows)
    assert f", {-(-size // 2)}" in next(x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RepartitionByExpression" in x)


def test_query_makes_no_lists(spark, sf_dir):
    assert "collect_" not in building.modified_by(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
