"""Text views of results: brief, compact or full."""

from __future__ import annotations

STYLES = ("brief", "compact", "full")


def _place(node: dict) -> str:
    return f"{node['name']} {node['file']}:{node['line']}" if node.get("line") is not None else f"{node['name']} {node['file']}"


def definition_text(result: dict, style: str = "full") -> str:
    if not result["found"]:
        return f"{result['symbol']}: not found"
    node, callees = result["node"], [c["name"] for c in result["callees"]]
    if style == "brief":
        return _place(node)
    if style == "compact":
        return f"{node['label']} {_place(node)}" + (f" calls: {', '.join(callees)}" if callees else "")
    return "\n".join([f"{node['label']} {node['name']}", f"  at {node['file']}:{node['line']}", *(f"  calls {c['name']} ({c['file']})" for c in result["callees"])])


def freshness_text(status: dict | None) -> list[str]:
    """How the graph stands to the repository, and which files have changed since; nothing without a status."""
    if not status:
        return []
    return [f"graph: {status['verdict']}"] + ([f"changed since: {status['stale']}"] if status.get("stale") else [])


def context_text(result: dict, style: str = "full", status: dict | None = None) -> str:
    """status: the engine's, whose freshness stands below the numbers."""
    if not result["found"]:
        return f"{result['symbol']}: not found"
    names = {n["node_id"]: n["name"] for n in result["nodes"]}
    cycles = [", ".join(names.get(m, m) for m in c["members"][:3]) for c in result["cycles"]]
    stats = f"{len(result['nodes'])} nodes, {len(result['edges'])} edges, depth {result['depth_reached']}, about {result['token_estimate']} tokens" + (f", {result['bridges_removed']} bridges removed" if result["bridges_removed"] else "")
    fresh = freshness_text(status)
    if style == "brief":
        return "\n".join([stats, *fresh])
    edges = [f"{names.get(a, a)} -> {names.get(b, b)}" for a, b in result["edges"]]
    if style == "compact":
        return "\n".join([stats, *fresh, "; ".join(edges), *(f"cycle: {c}" for c in cycles)])
    callers = [f"{result['total_callers']} callers: " + ", ".join(c["name"] for c in result["callers"])] if result.get("callers") else []
    return "\n".join([*(f"{'  ' * n['depth']}{_place(n)}" for n in result["nodes"]), *edges, *(f"cycle: {c}" for c in cycles), *callers, stats, *fresh])


def impact_text(result: dict, style: str = "full") -> str:
    if not result["found"]:
        return f"{result['symbol']}: not found"
    head = f"{result['total_callers']} callers of {result['symbol']}"
    if style == "brief":
        return head
    rows = [f"  {d}: " + ", ".join(c["name"] if style == "compact" else f"{c['name']} ({c['file']})" for c in callers) for d, callers in sorted(result["callers_by_depth"].items())]
    cycles = [f"cycle of {len(c['members'])} around {c['representative']}" for c in result.get("cycles", [])]
    removed = [f"{result['bridges_removed']} bridges removed"] if result.get("bridges_removed") else []
    return "\n".join([head, *rows, *cycles, *removed])


def session_text(facts: dict, patterns: dict[str, list[str]]) -> str:
    """One session's row of facts and the examples of its patterns."""
    lines = [f"{facts['session']}: {facts['outcome'] or 'no result'}, {facts['turns'] or 0} turns, ${facts['cost'] or 0:.3f}"]
    lines.append(f"calls {facts['total_calls']}, errors {facts['total_errors']}; tool ok {facts['tool_ok']}, failed {facts['tool_err']}, other {facts['fallback']}")
    if facts.get("abandoned_turn"):
        lines.append(f"tool given up after turn {facts['abandoned_turn']}")
    lines += [f"{p}: {facts[p]} ({'; '.join(patterns.get(p, [])[:2])})" for p in sorted(k for k in facts if k[:1] == "P" and k[1:3].isdigit()) if facts[p]]
    return "\n".join(lines)
