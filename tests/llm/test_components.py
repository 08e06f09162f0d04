"""Components against union-find."""

import random

import pytest

from loomgraph.llm.components import components


@pytest.mark.parametrize("kind", ["random", "path", "star", "ring", "empty"])
def test_components(spark, kind):
    r = random.Random(2)
    edges = {
        "random": [(r.randrange(80), r.randrange(80)) for _ in range(60)], "path": [(k, k + 1) for k in range(30)], "star": [(50, k) for k in range(40)] + [(50, 50)] * 2,
        "ring": [(k, (k + 1) % 12) for k in range(12)] + [(100, 101), (101, 100)], "empty": [],
    }[kind]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in up if find(x) != x}
