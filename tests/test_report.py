"""Text views of literal results."""

from loomgraph.report import context_text, definition_text, impact_text, session_text

NODE = {"node_id": "1", "name": "f", "label": "Function", "file": "a.py", "line": 3, "depth": 0}


def test_views():
    missing = {"found": False, "symbol": "x"}
    assert {definition_text(missing), context_text(missing), impact_text(missing)} == {"x: not found"}
    d = {"found": True, "symbol": "f", "node": NODE, "callees": [{"name": "g", "file": "b.py"}]}
    assert definition_text(d, "brief") == "f a.py:3" and definition_text(d, "compact") == "Function f a.py:3 calls: g" and "calls g (b.py)" in definition_text(d)
    c = {"found": True, "symbol": "f", "nodes": [NODE, NODE | {"node_id": "2", "name": "g", "depth": 1}], "edges": [("1", "2"), ("2", "1")], "cycles": [{"members": ["1", "2"]}], "bridges_removed": 0, "depth_reached": 1, "token_estimate": 18}
    assert "f -> g; g -> f" in context_text(c, "compact") and "cycle: f, g" in context_text(c) and context_text(c, "brief").startswith("2 nodes, 2 edges")
    i = {"found": True, "symbol": "f", "callers_by_depth": {1: [{"name": "h", "file": "c.py"}]}, "total_callers": 1}
    assert impact_text(i, "brief") == "1 callers of f" and "  1: h (c.py)" in impact_text(i)
    facts = {"session": "s", "outcome": None, "turns": 2, "cost": 0.5, "total_calls": 3, "total_errors": 1, "tool_ok": 1, "tool_err": 0, "fallback": 2, "abandoned_turn": 1, "P01_x": 2, "P02_y": 0}
    text = session_text(facts, {"P01_x": ["a", "b", "c"]})
    assert "P01_x: 2 (a; b)" in text and "P02" not in text and "given up after turn 1" in text


def test_freshness_below_a_context():
    from loomgraph import report
    from loomgraph.operators.metrics import freshness

    node = {"node_id": "a", "name": "a", "file": "f.py", "line": 1, "depth": 0, "label": "Function"}
    found = {"found": True, "symbol": "a", "nodes": [node], "edges": [], "cycles": [], "bridges_removed": 0, "depth_reached": 0, "token_estimate": 9, "callers": [], "total_callers": 0}
    behind = freshness("h2", "h1", 2, [f"f{k}.py" for k in range(7)])
    for style in report.STYLES:
        assert report.context_text(found, style, behind).split("\n")[1:3] == ["graph: 2 commits behind", "changed since: f0.py, f1.py, f2.py, f3.py, f4.py and 2 more"] or style == "full"
        assert "graph:" not in report.context_text(found, style)
        assert report.context_text(found, style, freshness("h", "h", 0, [])).rstrip("\n").count("graph: fresh") == 1
    assert report.context_text(found, "full", behind).endswith("changed since: f0.py, f1.py, f2.py, f3.py, f4.py and 2 more")
