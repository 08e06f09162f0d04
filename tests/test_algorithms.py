"""Graph algorithms on small literals."""

import random

import pytest

from loomgraph.engine import GraphEngine, all_callers, callers_at, error_reason, explain, from_json, hits_from, online, references, strong_components, to_json, top, with_reason
from loomgraph.operators import algorithms, conflicts, lookup, traverse
from loomgraph.schema import PropertyGraph


def graph(spark, edges, extra=()):
    names = sorted({x for e in edges for x in e} | set(extra))
    nodes = spark.createDataFrame([("", n, "Function", n, "f.py", k, "doc " + n, None) for k, n in enumerate(names)], "project_id string, node_id string, label string, name string, file string, line int, docstring string, parent string")
    return PropertyGraph(nodes, spark.createDataFrame([(a, b, "CALLS") for a, b in edges] or [], "src_id string, dst_id string, type string"))


@pytest.mark.parametrize("edges, want", [
    ([("a", "b"), ("b", "c")], []), ([("a", "b"), ("b", "a")], [["a", "b"]]), ([("a", "a")], []), ([], []),
    ([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", "x"), ("c", "x"), ("y", "z")], [["a", "b", "c"], ["x", "y"]]),
    ([("d", "b"), ("b", "a"), ("a", "d"), ("a", "c"), ("c", "e"), ("e", "c"), ("e", "f")], [["a", "b", "d"], ["c", "e"]]),
])
def test_cycles(spark, edges, want):
    g = graph(spark, edges, ["q"])
    got = algorithms.cycle_groups(g.nodes, g.calls()).collect()
    assert sorted(r.members for r in got) == want and all(r.representative == r.members[0] and r["size"] == len(r.members) for r in got)
    assert sorted(strong_components(sorted({x for e in edges for x in e}), edges)) == want


def test_cycles_of_random_graphs(spark):
    r = random.Random(11)
    edges = [(f"n{r.randrange(14):02d}", f"n{r.randrange(14):02d}") for _ in range(20)]
    g = graph(spark, edges)
    got = algorithms.cycle_groups(g.nodes, g.calls()).collect()
    assert sorted(x.members for x in got) == sorted(strong_components(sorted({x for e in edges for x in e}), edges))


def test_edges_to_unknown_nodes_are_ignored(spark):
    g = graph(spark, [("a", "b")])
    e = g.edges.unionByName(spark.createDataFrame([("b", "zz", "CALLS"), ("zz", "a", "CALLS")], g.edges.schema))
    assert algorithms.cycle_groups(g.nodes, e.select("src_id", "dst_id")).count() == 0


def test_invalid_groups():
    with pytest.raises(ValueError):
        algorithms.valid_group([], "a")
    with pytest.raises(ValueError):
        algorithms.valid_group(["a"], "b")


def test_compression():
    nodes, edges, bridges, paths = algorithms.compress("a", ["a", "b", "c"], [("a", "b"), ("b", "c")])
    assert (nodes, edges, bridges, paths) == (["a", "c"], [("a", "c")], ["b"], ["a -> b -> c"])
    assert algorithms.compress("a", ["a", "b", "c"], [("a", "b"), ("b", "c")], {"b"})[2] == []
    assert algorithms.compress("s", list("sabt"), [("s", "a"), ("a", "b"), ("b", "t"), ("s", "t")])[1] == [("s", "t")]
    assert "3 bridges removed" in algorithms.compression_stats(7, 5, 4, 3, 3)


@pytest.mark.parametrize("edges, want", [
    ([("b", "a")], {"a": 0, "b": 1}), ([("b", "a"), ("c", "b"), ("d", "c")], {"a": 0, "b": 1, "c": 2, "d": 3}), ([("b", "a"), ("c", "a"), ("d", "b"), ("d", "c")], {"a": 0, "b": 1, "c": 1, "d": 2}),
    ([("b", "a"), ("x", "y")], {"a": 0, "b": 1}), ([("a", "b"), ("b", "a")], {"a": 0, "b": 1}),
])
def test_depths_of_callers(spark, edges, want):
    g = graph(spark, edges)
    got = traverse.subgraph_nodes(g, traverse.start_of(g, "a"), 10, reverse=True).collect()
    assert {r.node_id: r.depth for r in got} == want


def test_paths(spark):
    g = graph(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("a", "x"), ("x", "d"), ("d", "a")], ["lone"])
    assert [r.node_id for r in traverse.shortest_path(g, "a", "d").orderBy("hop").collect()] == ["a", "x", "d"]
    assert traverse.shortest_path(g, "a", "lone").count() == 0 and traverse.shortest_path(g, "nope", "a").count() == 0
    assert traverse.path_diagnosis(g, "a", "nope") == "not in the graph: nope" and "no path" in traverse.path_diagnosis(g, "a", "lone")
    assert {r.node_id for r in traverse.neighbors(g, "a", 3).collect()} == {"a", "b", "c", "d", "x"}


def test_engine(spark):
    g = graph(spark, [("a", "b"), ("b", "c"), ("c", "b"), ("z", "a"), ("y", "z")])
    engine = GraphEngine(g, head=("h", "h", 0, []))
    d = engine.definition("a")
    assert d["found"] and [c["name"] for c in d["callees"]] == ["b"] and engine.definition("a") is d
    assert engine.definition("none") == {"found": False, "symbol": "none", "error": "not_found"}
    c = engine.context("a", 3)
    assert [x["members"] for x in c["cycles"]] == [["b", "c"]] and c["depth_reached"] == 2 and len(c["edges"]) == 3 and "cycle: b, c" in explain(c)
    assert engine.context("y", 2, True)["bridges_removed"] == 1
    i = engine.impact("a")
    assert [x["name"] for x in callers_at(i, 1)] == ["z"] and [x["name"] for x in all_callers(i)] == ["z", "y"] and from_json(to_json(i)) == i
    assert engine.status()["is_fresh"] and engine.status()["edges"] == 5
    got = engine.batch([("definition", "a"), ("impact", "a"), ("definition", "a")])
    assert got[0] is got[2] and got[1]["total_callers"] == 2
    with pytest.raises(ValueError):
        engine.batch([("drop", "a")])
    assert error_reason("Symbol not found") == "not_found" and error_reason("Unable to connect to it") == "store_offline" and error_reason("odd") == "parse_error"
    assert online(engine.status()) and not online(GraphEngine(g).status()) and [r["name"] for r in references(c)] == ["a", "b", "c"] and references(d)[0]["file"] == "f.py"
    assert top(hits_from([])) is None and top(hits_from([{"name": "x"}, {"name": "y"}], "q")) == {"name": "x"}
    assert with_reason(engine.impact("none"))["error_reason"] == "not_found" and with_reason({"error": "Connection refused"})["error_reason"] == "store_offline" and with_reason(i) is i


def test_engine_views(spark):
    g = graph(spark, [("a", "b"), ("b", "c"), ("c", "b"), ("z", "a"), ("y", "z"), ("user_of_lone", "z")], ["lone"])
    from pyspark.sql import functions as F

    nodes = g.nodes.withColumn("parent", F.when(F.col("name") == "b", "Owner")).withColumn("docstring", F.when(F.col("name") == "z", "uses lone").otherwise("")).withColumn("end_line", F.lit(None).cast("int"))
    engine = GraphEngine(PropertyGraph(nodes, g.edges))
    c = engine.context("a", 2)
    assert c["total_callers"] == 1 and c["callers"] == [{"name": "z", "file": "f.py"}]
    assert engine.context("Owner.b", 1)["found"] and engine.impact("Owner.b", 1)["total_callers"] == 2 and not engine.context("No.b")["found"]
    i = engine.impact("b", 5)
    assert [x["members"] for x in i["cycles"]] == [["b", "c"]] and i["total_callers"] == 5
    assert engine.impact("a", 5, True)["bridges_removed"] == 0 and engine.impact("z", 3)["callers_by_depth"] == {1: [{"name": "user_of_lone", "file": "f.py"}, {"name": "y", "file": "f.py"}]}
    o = engine.orient("Where does user_of_lone go, and lone")
    assert {h["name"] for h in o["hits"]} == {"user_of_lone"} and o["follow"]["user_of_lone"]["edges"]
    lines = spark.createDataFrame([("f.py", k, t) for k, t in enumerate(["", "def a():", "    pass", "def b():", "    return 1"], 1)], "file string, line_no long, text string")
    assert [r.text for r in lookup.view(engine.graph, lines, "Owner.b").orderBy("line_no").collect()] == ["def b():", "    return 1"]
    assert lookup.view(engine.graph, lines, "nothing").count() == 0


def test_schedule(spark):
    rows = [("t1", ["core"], []), ("t2", ["a"], ["core"]), ("t3", ["b"], ["core"]), ("t4", ["c"], ["core"]), ("t5", ["d"], ["a", "b", "c"]), ("t6", ["e"], ["d"])]
    df = spark.createDataFrame(rows, "id string, target_symbols array<string>, dependency_symbols array<string>")
    assert {r.id: r.phase for r in conflicts.phases(df).collect()} == {"t1": 1, "t2": 2, "t3": 2, "t4": 2, "t5": 3, "t6": 4}
    same = spark.createDataFrame([("a", ["x"], []), ("b", ["x"], []), ("c", ["y"], ["z"]), ("d", ["z"], ["y"])], df.schema)
    assert {r.id: r.phase for r in conflicts.phases(same).collect()} == {"a": 1, "b": 2, "c": None, "d": None}


def test_outcome_of_a_plan(spark):
    plan = spark.createDataFrame([("t0", 1), ("t1", 1), ("t2", 2), ("t3", 2), ("t4", None)], "id string, phase int")
    results = lambda *ok: spark.createDataFrame([(f"t{k}", x) for k, x in enumerate(ok)], "id string, success boolean")
    of = lambda *ok, **more: tuple(conflicts.outcome(plan, results(*ok), **more).first())
    assert of(False, True, False, True) == ("PARTIAL", 5, 2, 2, 1)
    assert of(False, True, False, True, True, stop_at_failure=True) == ("PARTIAL", 5, 1, 1, 3)
    assert of(True, True, True, True, True, stop_at_failure=True) == ("PARTIAL", 5, 4, 0, 1)
    assert tuple(conflicts.outcome(plan.where("phase is not null"), results(True, True, True, True)).first()) == ("SUCCESS", 4, 4, 0, 0)
    assert of(False, False) == ("FAILED", 5, 0, 2, 3) and tuple(conflicts.outcome(plan.limit(0), results(True)).first()) == ("SUCCESS", 0, 0, 0, 0)


def test_conflicts(spark):
    symbols = spark.createDataFrame([(1, "f", "f", "function", "a.py"), (2, "g", "g", "function", "b.py"), (3, "g", "g", "import", "a.py"), (4, "h", "h", "function", "c.py")], "ord long, name string, qualified_name string, type string, file string")
    tasks = spark.createDataFrame([("t1", ["f"]), ("t2", ["g"]), ("t3", ["h", "f"])], "id string, target_symbols array<string>")
    got = {r.kind: r.conflicts for r in conflicts.report(tasks, symbols).collect()}
    assert got["direct"] == 1 and got["dependency"] >= 2 and got["feasible"] == 0
    pairs = conflicts.direct_conflicts(tasks).select("task_a", "task_b")
    assert conflicts.recommendation(tasks, pairs, 0).startswith("All tasks can") and "t2" in conflicts.recommendation(tasks, pairs, 3)


def test_task_terms():
    assert lookup.task_terms("Where does HttpClient handle retry_count for the request") == ["HttpClient", "retry_count", "request"]


def test_hops_do_not_shuffle_edges(spark):
    import random

    r = random.Random(3)
    edges = sorted({(f"n{r.randrange(60)}", f"n{r.randrange(60)}") for _ in range(200)})
    g = graph(spark, edges)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = traverse.reach(g.adjacency(), g.nodes.where("node_id = 'n1'").select("node_id"), 4)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    scans = [k for k, line in enumerate(plan.splitlines()) if "adjacency_" in line and "Scan" in line or "FileScan" in line]
    lines = plan.splitlines()
    assert len(scans) >= 4
    for k in scans:  # what stands above a scan, up to its join
        up, depth = [], len(lines[k]) - len(lines[k].lstrip(" :+-*|"))
        for line in reversed(lines[:k]):
            d = len(line) - len(line.lstrip(" :+-*|"))
            if d < depth:
                up.append(line)
                depth = d
            if "Join" in up[-1] if up else False:
                break
        assert not any("Exchange" in x for x in up), up


def slow_reach(edges, start, hops):
    depth, now = {start: 0}, [start]
    for level in range(hops):
        now = sorted({b for a, b in edges if a in now} - set(depth))
        depth |= dict.fromkeys(now, level + 1)
    return depth


@pytest.mark.parametrize("hub", [10**6, 5])
def test_reach_of_many_requests(spark, monkeypatch, hub):
    """Also with hubs in parts."""
    import random

    from loomgraph.operators import adjacency

    monkeypatch.setattr(adjacency, "HUB", hub)
    r = random.Random(hub)
    edges = sorted({(f"n{r.randrange(40)}", f"n{r.randrange(40)}") for _ in range(70)} | {("n0", f"n{k}") for k in range(1, 30)} | {("n39", "n39")})
    g = graph(spark, edges)
    assert (g.adjacency().hubs is not None) == (hub == 5)
    starts = [(k, f"n{r.randrange(40)}", r.randrange(5)) for k in range(25)] + [(99, "n0", 3), (99, "n5", 3)]
    got = traverse.reach_many(g.adjacency(), spark.createDataFrame(starts, "request int, node_id string, hops int"), 5)
    found = {}
    for x in got.collect():
        assert (x.request, x.node_id) not in found
        found[x.request, x.node_id] = x.depth
    want = {}
    for k, start, hops in starts:
        for n, d in slow_reach(edges, start, hops).items():
            want[k, n] = min(d, want.get((k, n), 99))
    assert found == want
    back = [(b, a) for a, b in edges]
    one = traverse.reach(g.adjacency(True), g.nodes.where("node_id = 'n3'").select("node_id"), 3)
    assert {x.node_id: x.depth for x in one.collect()} == slow_reach(back, "n3", 3)
    inner = {(x.request, x.src_id, x.dst_id) for x in traverse.edges_within(g, got).collect()}
    assert inner == {(k, a, b) for k in {s[0] for s in starts} for a, b in edges if (k, a) in want and (k, b) in want}


def test_shortest_paths_from_both_ends(spark):
    import random

    r = random.Random(8)
    edges = sorted({(f"n{r.randrange(30)}", f"n{r.randrange(30)}") for _ in range(45)} | {("n0", f"m{k}") for k in range(40)})
    g = graph(spark, edges)
    for source, target in (("n0", "n7"), ("n0", "m3"), ("m3", "n0"), ("n4", "n4"), ("n9", "n21"), ("n2", "n11")):
        want = slow_reach(edges, source, 50).get(target)
        path = [x.node_id for x in traverse.shortest_path(g, source, target).orderBy("hop").collect()]
        assert (len(path) - 1 if path else None) == want, (source, target)
        assert all(e in set(edges) for e in zip(path, path[1:])) and (not path or (path[0], path[-1]) == (source, target))


def test_batches_answer_together(spark):
    """What a batch answers in common jobs is what each query answers alone."""
    import random

    from pyspark.sql import functions as F

    r = random.Random(11)
    edges = sorted({(f"n{r.randrange(25)}", f"n{r.randrange(25)}") for _ in range(45)})
    g = graph(spark, edges, ["lone"])
    nodes = g.nodes.withColumn("parent", F.when(F.col("name") == "n3", "pkg.Owner")).withColumn("docstring", F.col("name"))
    twin = nodes.where("name = 'n4'").withColumns({"node_id": F.lit("n4b"), "file": F.lit("other.py"), "label": F.lit("Class")})
    g = PropertyGraph(nodes.unionByName(twin), g.edges)
    queries = [
        ("definition", "n1"), ("definition", ("n4",), {"file_filter": "other"}), ("definition", "none"), ("context", ("n2",), {"depth": 3, "compress": True}), ("context", "n3", 2), ("context", "Owner.n3", 1), ("context", ("nope",), {}),
        ("context", ("lone",), {}), ("impact", ("n5",), {"depth": 4}), ("impact", "n6", 2, True), ("impact", "none"), ("context", "n4", 2, False, "other"), ("status", (), {}), ("impact", ("n5",), {"depth": 4}),
    ]
    many = GraphEngine(g)
    calls = []
    whole = many._ask_many
    many._ask_many = lambda keys: calls.append(len(keys)) or whole(keys)
    got = many.batch([*queries, ("context",), ("impact", ("n1",), {"wrong": 1}), ("search", ("n1",), {"follow": "odd"})])
    assert calls == [12] and got[8] is got[13]
    assert [type(x) for x in got[-3:]] == [TypeError, TypeError, ValueError]
    alone = GraphEngine(g, ttl=0)
    for q, x in zip(queries, got, strict=False):
        args, kwargs = (q[1], q[2]) if len(q) == 3 and isinstance(q[2], dict) else (q[1:], {})
        assert x == getattr(alone, q[0])(*args, **kwargs), q
    assert many.batch([("definition", "n1"), ("impact", "n6", 2, True)]) == [got[0], got[9]] and calls == [12]  # from the cache


def slow_components(edges):
    from loomgraph.engine import strong_components

    return {n: c[0] for c in strong_components(sorted({x for e in edges for x in e}), edges) for n in c}


def test_components_of_shrinking_graphs(spark):
    """Rings, rings on rings, ladders, chains that come back to their node, and random sparse graphs, in one graph."""
    import random

    r = random.Random(21)
    edges = [(f"p{k}", f"p{k + 1}") for k in range(30)]  # a path
    edges += [(f"r{k}", f"r{(k + 1) % 17}") for k in range(17)]  # a ring
    edges += [("h", "h1"), ("h1", "h2"), ("h2", "h"), ("h", "i1"), ("i1", "h"), ("p30", "h"), ("h", "z1"), ("z1", "z2")]  # chains back to one node
    edges += [(f"a{k}", f"a{(k + 1) % 9}") for k in range(9)] + [("a3", "b1"), ("b1", "b2"), ("b2", "a7"), ("a5", "c1"), ("c1", "q0")] + [(f"q{k}", f"q{(k + 1) % 6}") for k in range(6)] + [("q2", "a_"), ("a_", "x"), ("x", "x")]
    edges += [(f"s{r.randrange(60)}", f"s{r.randrange(60)}") for _ in range(75)] + [(f"t{r.randrange(40)}", f"t{r.randrange(40)}") for _ in range(44)]
    got = {x.node_id: x.component for x in algorithms.scc(spark.createDataFrame(edges, "src_id string, dst_id string")).collect()}
    assert got == slow_components([e for e in edges if e[0] != e[1]])


def test_a_long_ring_takes_few_rounds(spark, monkeypatch):
    rounds = []
    keep = algorithms.settled
    monkeypatch.setattr(algorithms, "settled", lambda df: rounds.append(1) or keep(df))
    n = 10_000
    ring = spark.range(n).selectExpr("format_string('%05d', id) AS src_id", f"format_string('%05d', (id + 1) % {n}) AS dst_id")
    path = spark.range(n).selectExpr("format_string('x%05d', id) AS src_id", "format_string('x%05d', id + 1) AS dst_id")
    shortcut = spark.createDataFrame([("00077", "05000"), ("x00005", "x09000")], "src_id string, dst_id string")
    got = algorithms.scc(ring.unionAll(path).unionAll(shortcut))
    assert got.count() == n and got.select("component").distinct().collect()[0].component == "00000"
    assert len(rounds) < 60, len(rounds)


def test_subgraphs_are_compressed_as_one_by_one(spark):
    import random

    r = random.Random(4)
    rows, want = [], set()
    for k in range(25):
        n = r.randrange(3, 14)
        nodes = [f"n{i:02d}" for i in range(n)]
        edges = sorted({(nodes[a], nodes[b]) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(r.randrange(2, 18))) if a < b or k % 3 == 0 and a != b})
        cyclic = set(slow_components(edges)) if edges else set()
        kept, left, bridges, _ = algorithms.compress(nodes[0], nodes, edges, cyclic)
        want |= {(f"g{k}", "node", x, None) for x in kept} | {(f"g{k}", "edge", *e) for e in left} | {(f"g{k}", "bridge", x, None) for x in bridges}
        rows += [(f"g{k}", nodes[0], "node", x, None) for x in nodes] + [(f"g{k}", nodes[0], "edge", *e) for e in edges] + [(f"g{k}", nodes[0], "cyclic", x, None) for x in cyclic] + [(f"g{k}", nodes[0], "edge", nodes[0], "nowhere")]
    got = algorithms.compress_subgraphs(spark.createDataFrame(rows, "graph string, root string, kind string, a string, b string"))
    assert {tuple(x) for x in got.collect()} == want
    assert algorithms.compress_subgraphs(spark.createDataFrame([], "graph string, root string, kind string, a string, b string")).count() == 0


def slow_phases(tasks):
    """By the same rules: layers of dependencies, an order in each target, the longest way."""
    def longest(edges):
        level, left = {}, {t for t, *_ in tasks}
        while left:
            now = {t for t in left if not any(b == t and a in left for a, b in edges)}
            if not now:
                return level
            for t in now:
                level[t] = max([level[a] + 1 for a, b in edges if b == t], default=0)
            left -= now
        return level

    after = {(a, b) for a, ta, _ in tasks for b, _, db in tasks if a != b and set(ta) & set(db)}
    layer = longest(after)
    same = set()
    for s in {x for _, ts, _ in tasks for x in ts}:
        own = sorted((layer[t], t) for t, ts, _ in tasks if s in ts and t in layer)
        same |= {(a, b) for (_, a), (_, b) in zip(own, own[1:])}
    final = longest(after | same)
    return {t: final[t] + 1 if t in final else None for t, *_ in tasks}


def test_schedules_by_longest_ways(spark, monkeypatch):
    import random

    monkeypatch.setattr(conflicts, "LAYERS", 0)

    r = random.Random(17)
    tasks = [(f"t{k:02d}", sorted({r.choice("abcdefghij") for _ in range(r.randrange(3))}), sorted({r.choice("abcdefghijzz") for _ in range(r.randrange(2))})) for k in range(14)]
    tasks += [("u1", ["m"], ["m"]), ("u2", ["m"], []), ("v1", ["n"], ["n"]), ("v2", ["n"], ["n"]), ("w1", ["o"], ["n"]), ("w2", ["p"], ["o"])]
    df = spark.createDataFrame(tasks, "id string, target_symbols array<string>, dependency_symbols array<string>")
    assert {x.id: x.phase for x in conflicts.phases(df).collect()} == slow_phases(tasks)
    got = {x.symbol: (x.tasks, x.pairs) for x in conflicts.conflict_classes(df).collect()}
    assert got["m"] == (2, 1) and got["n"] == (2, 1) and all(p == n * (n - 1) // 2 for n, p in got.values())


def test_many_tasks_on_one_target(spark, monkeypatch):
    rounds = []
    keep = conflicts.settled
    monkeypatch.setattr(conflicts, "settled", lambda df: rounds.append(1) or keep(df))
    n = 20_000
    df = spark.range(n).selectExpr("id", "array('shared') AS target_symbols", "CAST(array() AS array<string>) AS dependency_symbols")
    got = conflicts.phases(df)
    assert got.where("phase <> id + 1").count() == 0 and got.count() == n
    assert len(rounds) < 100, len(rounds)


def test_fronts_alone_hand_on_labels(spark, monkeypatch):
    """Each node starts from a smaller predecessor's label if it has one, and only nodes whose label fell are joined with the edges."""
    starts, n = [], 60
    keep = algorithms._reached
    monkeypatch.setattr(algorithms, "_reached", lambda e, labels: starts.append(labels.count()) or keep(e, labels), raising=False)
    edges = [(f"{i:03d}", f"{(i + d) % n:03d}") for i in range(n) for d in (1, 2, 7, 19)]
    got = algorithms.scc(spark.createDataFrame(edges, "src_id string, dst_id string")).collect()
    assert {r.component for r in got} == {"000"} and len(got) == n
    assert starts == [1, 1]


def test_large_tables_are_not_sent_by_way_of_the_driver(spark, monkeypatch):
    monkeypatch.setattr(algorithms, "FEW", 10, raising=False)
    nodes = spark.range(50).selectExpr("CAST(id AS string) AS node_id")
    edges = spark.range(50).selectExpr("CAST(id AS string) AS src_id", "CAST((id + 1) % 50 AS string) AS dst_id")
    seen = []
    keep = algorithms.scc
    monkeypatch.setattr(algorithms, "scc", lambda known: seen.append(known) or keep(known))
    got = algorithms.cycle_groups(nodes, edges).collect()
    assert [(r.representative, r.size) for r in got] == [("0", 50)]
    assert "Broadcast" not in seen[0]._jdf.queryExecution().executedPlan().toString()
