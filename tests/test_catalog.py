"""Every registered query of the reference's kind against its SQL."""

import pytest
from oracle import compare

from loomgraph.plans import catalog

@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_agrees_with_sql(spark, sf_dir, name):
    compare(spark, sf_dir, catalog.QUERIES[name], catalog.ORACLES[name])


def test_bridges_around_several_nodes(spark, sf_dir):
    from loomgraph.operators import algorithms, traverse
    from loomgraph.plans import derived

    rows = catalog.QUERIES["bridge_compression"](spark, sf_dir).collect()
    assert {r.graph for r in rows} == {"red bolt", "hot gear", "blue gizmo"}
    g = derived.graph(spark, sf_dir)
    root = traverse.start_of(g, "red bolt")
    nodes = traverse.subgraph_nodes(g, root, 2)
    edges = [(r.src_id, r.dst_id) for r in traverse.induced_edges(g, nodes).orderBy("src_id", "dst_id").collect()]
    order = [r.node_id for r in nodes.orderBy("depth", "node_id").collect()]
    kept, joined, bridges, _ = algorithms.compress(root.first().node_id, order, edges)
    mine = [r for r in rows if r.graph == "red bolt"]
    assert sorted(r.a for r in mine if r.kind == "node") == sorted(kept) and sorted(r.a for r in mine if r.kind == "bridge") == bridges
    assert sorted((r.a, r.b) for r in mine if r.kind == "edge") == sorted(joined)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
