"""The programmatic engine: named queries with typed results, a time-limited cache, and batches."""

from __future__ import annotations

import inspect
import json
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .operators import algorithms, lookup, metrics, traverse, vectors
from .operators.vector_index import VectorIndex
from .runtime import durable
from .schema import PropertyGraph

#: Methods whose queries a batch answers together.
TOGETHER = ("definition", "context", "impact")
METHODS = ("definition", "context", "impact", "search", "orient", "status")
#: Direct callers that a context names.
CALLERS = 20


# What messages of a store that cannot be reached hold.
OFFLINE = ("ServiceUnavailable", "Unable to connect", "Connection refused")


def error_reason(message: str) -> str:
    """store_offline, not_found or parse_error, from a message."""
    if any(w in message for w in OFFLINE):
        return "store_offline"
    return "not_found" if "not found" in message.lower() else "parse_error"


class GraphEngine:
    """Answers over a graph. Results are dicts, ready for JSON; they hold one symbol's surroundings, which depth and limits bound."""

    def __init__(self, graph: PropertyGraph, symbols: DataFrame | None = None, ttl: float = 60, head: tuple[str, str | None, int, list[str]] | None = None, index: Callable[[], VectorIndex] | None = None):
        """index: makes the vector index when a search first needs it."""
        self._make_index, self._index = index, None
        self.graph, self.symbols, self.ttl, self.head = graph, symbols, ttl, head
        self._cache: dict[tuple, tuple[float, dict]] = {}

    def _cached(self, key: tuple, make, ttl: float | None = None) -> dict:
        ttl = self.ttl if ttl is None else min(ttl, self.ttl)
        hit = self._cache.get(key)
        if ttl and hit and time.monotonic() - hit[0] < ttl:
            return hit[1]
        out = make()
        if ttl:
            self._cache[key] = (time.monotonic(), out)
        return out

    def cache_clear(self) -> None:
        self._cache.clear()

    @staticmethod
    def _missing(symbol: str) -> dict:
        return {"found": False, "symbol": symbol, "error": "not_found"}

    def definition(self, symbol: str, file_filter: str | None = None) -> dict:
        def make():
            rows = [r.asDict() for r in lookup.definition(self.graph, symbol, file_filter).collect()]
            return self._definition(symbol, rows[0] if rows else None, [(r["callee"], r["callee_file"]) for r in rows if r["callee"] is not None])

        return self._cached(("definition", symbol, file_filter), make)

    def _definition(self, symbol: str, node: dict | None, callees: list[tuple]) -> dict:
        if node is None:
            return self._missing(symbol)
        found = [{"name": name, "file": file} for name, file in callees]
        return {"found": True, "symbol": symbol, "node": {k: node[k] for k in lookup.BRIEF}, "callees": sorted(found, key=lambda c: (c["name"], c["file"] or ""))}

    def _name(self, symbol: str, file_filter: str | None = None) -> str | None:
        """The node's name that a symbol means: its own, or the last part of a dotted one."""
        row = lookup.resolve(self.graph, symbol, file_filter).first()
        return row["name"] if row else None

    def context(self, symbol: str, depth: int = 2, compress: bool = False, file_filter: str | None = None) -> dict:
        """What a symbol calls within ``depth``, with cycles, and its direct callers: their number and the first CALLERS."""

        def make():
            name = self._name(symbol, file_filter)
            if name is None:
                return self._missing(symbol)
            start = traverse.start_of(self.graph, name, file_filter)
            nodes_df = traverse.subgraph_nodes(self.graph, start, depth)
            by = lookup.callers(self.graph, name)
            callers = [{"name": r["name"], "file": r["file"]} for r in by.orderBy("file", "name", "node_id").limit(CALLERS).collect()]
            return self._context(symbol, compress, [r.asDict() for r in nodes_df.collect()], pairs(traverse.induced_edges(self.graph, nodes_df)), callers, by.count())

        return self._cached(("context", symbol, depth, compress, file_filter), make)

    def _context(self, symbol: str, compress: bool, nodes: list[dict], edges: list[tuple], callers: list[dict], total: int) -> dict:
        nodes, edges = sorted(nodes, key=lambda n: (n["depth"], n["file"] or "", n["line"] or 0, n["node_id"])), sorted(edges)
        cycles = strong_components([n["node_id"] for n in nodes], edges)
        bridges: list[str] = []
        if compress:
            kept, edges, bridges, _ = algorithms.compress(nodes[0]["node_id"], [n["node_id"] for n in nodes], edges, {m for c in cycles for m in c})
            nodes = [n for n in nodes if n["node_id"] in set(kept)]
        tokens = sum(len(n["name"]) + len(n["file"] or "") + 30 for n in nodes) // 4
        found = {"found": True, "symbol": symbol, "nodes": nodes, "edges": edges, "cycles": [{"members": c, "representative": c[0]} for c in cycles], "bridges_removed": len(bridges), "depth_reached": max(n["depth"] for n in nodes), "token_estimate": tokens}
        return found | {"callers": callers, "total_callers": total}

    def impact(self, symbol: str, depth: int = 3, compress: bool = False) -> dict:
        """Callers of a symbol by their fewest hops, with the cycles among them; compress takes bridges between callers out."""

        def make():
            name = self._name(symbol)
            if name is None:
                return self._missing(symbol)
            nodes_df = traverse.subgraph_nodes(self.graph, traverse.start_of(self.graph, name), depth, reverse=True)
            return self._impact(symbol, name, compress, [r.asDict() for r in nodes_df.collect()], pairs(traverse.induced_edges(self.graph, nodes_df)))

        return self._cached(("impact", symbol, depth, compress), make)

    def _impact(self, symbol: str, name: str, compress: bool, nodes: list[dict], edges: list[tuple]) -> dict:
        nodes, edges = sorted(nodes, key=lambda n: (n["depth"], n["file"] or "", n["name"], n["node_id"])), sorted(edges)
        cycles = strong_components([n["node_id"] for n in nodes], edges)
        bridges = 0
        if compress:
            kept, _, gone, _ = algorithms.compress(nodes[0]["node_id"], [n["node_id"] for n in nodes], edges, {m for c in cycles for m in c})
            nodes, bridges = [n for n in nodes if n["node_id"] in set(kept)], len(gone)
        by_depth: dict[int, list[dict]] = {}
        for n in nodes:
            if n["depth"] and n["name"] != name:
                by_depth.setdefault(n["depth"], []).append({"name": n["name"], "file": n["file"]})
        tokens = sum(len(n["name"]) + len(n["file"] or "") + 30 for n in nodes) // 4
        found = {"found": True, "symbol": symbol, "callers_by_depth": by_depth, "total_callers": sum(map(len, by_depth.values()))}
        return found | {"cycles": [{"members": c, "representative": c[0]} for c in cycles], "bridges_removed": bridges, "token_estimate": tokens}

    def orient(self, task: str, top: int = 6, depth: int = 5) -> dict:
        """Nodes that a task's words name, and for the first of each word its context, else its impact, else that of up to three nodes that mention it."""

        def make():
            hits = [r.asDict() for r in lookup.orient(self.graph, task, top).orderBy("term", "file", "line", "node_id").collect()]  # top rows a term
            found: dict[str, dict] = {}
            for name in dict.fromkeys({h["term"]: h["name"] for h in reversed(hits)}.values()):
                answer = self.context(name, depth, True)
                if not answer["edges"]:
                    answer = self.impact(name, depth, True)
                if answer.get("edges") or answer.get("total_callers"):
                    found[name] = answer
                    continue
                users = [r["name"] for r in lookup.grep(self.graph, name, top=10).collect() if r["label"] in ("Function", "Class") and r["name"] != name]
                for user in list(dict.fromkeys(users))[:3]:
                    if (answer := self.impact(user, depth, True)).get("total_callers"):
                        found[user] = answer
            return {"task": task, "hits": hits, "follow": found}

        return self._cached(("orient", task, top, depth), make)

    @property
    def index(self) -> VectorIndex | None:
        if self._index is None and self._make_index:
            self._index = self._make_index()
        return self._index

    def search(self, query: str, top_k: int = 5, follow: str | None = None) -> dict:
        """The nearest nodes by vectors, or by text where there is no fresh index; follow adds the best hit's context or impact."""
        if follow not in (None, "context", "impact"):
            raise ValueError(f"unknown follow {follow}")

        def make():
            near = self.index.search(query, top_k, self.head[0] if self.head else None) if self.index else None
            if near is not None:
                how, hits = "vectors", near.collect()
            else:
                how, hits = "text", [] if self.symbols is None else vectors.lexical(self.symbols, query, top_k).collect()
            out = {"query": query, "how": how, "hits": [{"name": r["name"], "file": r["file"], "score": r["score"]} for r in hits]}
            if follow and hits:
                best = hits[0]["name"]
                out[follow] = self.context(best, 2) if follow == "context" else self.impact(best, 3)
            return out

        return self._cached(("search", query, top_k, follow), make)

    def status(self) -> dict:
        def make():
            totals = {r["what"]: r["total"] for r in metrics.graph_stats(self.graph).collect()}
            verdict = metrics.freshness(*self.head) if self.head else {"verdict": "unknown", "is_fresh": False, "stale": ""}
            return {"nodes": totals.get("nodes", 0), "edges": totals.get("edges", 0), "head": self.head[0] if self.head else "unknown", **verdict}

        return self._cached(("status",), make, 10)

    def batch(self, queries: list[tuple], max_workers: int = 8) -> list:
        """Results in order of (method, args...) or (method, (args), {keyword arguments}); equal queries run once, and an exception is that query's result.

        Definitions, contexts and impacts that the cache lacks are answered together, in a number of jobs that goes by
        the deepest of them; the other methods run side by side.
        """
        asked: list[tuple | Exception] = []
        for q in queries:
            if q[0] not in METHODS:
                raise ValueError(f"unknown method {q[0]}")
            plain = len(q) == 3 and isinstance(q[1], (tuple, list)) and isinstance(q[2], dict)
            try:
                bound = inspect.signature(getattr(self, q[0])).bind(*(q[1] if plain else q[1:]), **(q[2] if plain else {}))
                bound.apply_defaults()
                asked.append((q[0], *bound.arguments.values()))
            except TypeError as e:
                asked.append(e)
        once = list(dict.fromkeys(x for x in asked if isinstance(x, tuple)))
        got: dict[tuple, object] = {}
        together = [x for x in once if x[0] in TOGETHER and not self._held(x)]
        if len(together) > 1:
            try:
                for key, answer in self._ask_many(together).items():
                    got[key] = self._cached(key, lambda answer=answer: answer)
            except Exception:  # each then has its own result, or its own exception
                got = {}

        def ask(x):
            try:
                return getattr(self, x[0])(*x[1:])
            except Exception as e:  # the caller gets it in the query's place
                return e

        rest = [x for x in once if x not in got]
        with ThreadPoolExecutor(max(1, min(max_workers, 8, len(rest)))) as pool:
            got |= dict(zip(rest, pool.map(ask, rest), strict=True))
        return [got[x] if isinstance(x, tuple) else x for x in asked]

    def _held(self, key: tuple) -> bool:
        hit = self._cache.get(key)
        return bool(self.ttl and hit and time.monotonic() - hit[0] < self.ttl)

    def _ask_many(self, keys: list[tuple]) -> dict[tuple, dict]:
        """Answers to several definitions, contexts and impacts. What comes to the driver is what the answers hold."""
        g, spark = self.graph, self.graph.nodes.sparkSession
        rows = [(k, x[0], x[1], x[2] if x[0] == "definition" else x[4] if x[0] == "context" else None, 0 if x[0] == "definition" else traverse.clamp(x[2])) for k, x in enumerate(keys)]
        requests = spark.createDataFrame(rows, "request int, method string, symbol string, file string, hops int")
        walks = requests.where("method <> 'definition'")
        named = durable(traverse.resolve_many(g, walks).unionByName(requests.where("method = 'definition'").select("request", F.col("symbol").alias("name"), "file")))
        starts = durable(traverse.start_of_many(g, named).join(requests.select("request", "method", "hops"), "request"))
        deepest = max(r[4] for r in rows)
        reached = None
        for method, reverse in (("context", False), ("impact", True)):
            if any(r[1] == method for r in rows):
                own = traverse.reach_many(g.adjacency(reverse), starts.where(F.col("method") == method).select("request", "node_id", "hops"), deepest)
                reached = own if reached is None else reached.unionByName(own)
        own = starts.where("method = 'definition'").select("request", "node_id", F.lit(0).alias("depth"))
        reached = durable(own if reached is None else reached.unionByName(own))
        nodes: dict[int, list[dict]] = {}
        for r in reached.join(g.nodes, "node_id").select("request", *lookup.BRIEF, "docstring", "depth", (F.col("depth") == 0).alias("is_root")).collect():
            nodes.setdefault(r["request"], []).append({c: r[c] for c in (*lookup.BRIEF, "docstring", "depth", "is_root")})
        edges: dict[int, list[tuple]] = {}
        for r in traverse.edges_within(g, reached.join(walks.select("request"), "request", "left_semi")).collect():
            edges.setdefault(r["request"], []).append((r["src_id"], r["dst_id"]))
        names = {r["request"]: r["name"] for r in named.collect()}
        callees: dict[int, set] = {}
        called = g.adjacency().expand(own.select("request", "node_id"), "node_id", "_to").select("request", F.col("_to").alias("node_id"))
        for r in called.join(g.nodes.where("name is not null").select("node_id", "name", "file"), "node_id").collect():
            callees.setdefault(r["request"], set()).add((r["node_id"], r["name"], r["file"]))
        callers, totals = self._callers_of_many(named.join(requests.where("method = 'context'").select("request"), "request", "left_semi"))
        out = {}
        for k, key in enumerate(keys):
            found = nodes.get(k)
            if key[0] == "definition":
                out[key] = self._definition(key[1], found[0] if found else None, [c[1:] for c in callees.get(k, ())])
            elif not found:
                out[key] = self._missing(key[1])
            elif key[0] == "context":
                out[key] = self._context(key[1], key[3], found, edges.get(k, []), callers.get(k, []), totals.get(k, 0))
            else:
                out[key] = self._impact(key[1], names[k], key[3], found, edges.get(k, []))
        return out

    def _callers_of_many(self, named: DataFrame) -> tuple[dict[int, list[dict]], dict[int, int]]:
        """The first CALLERS callers of each request's name, and how many there are."""
        g = self.graph
        ids = named.select("request", "name").join(g.nodes.select("node_id", "name"), "name").select("request", "node_id")
        pairs_ = g.adjacency(True).expand(ids, "node_id", "_by").select("request", F.col("_by").alias("node_id")).distinct()
        by = durable(pairs_.join(g.nodes.select("node_id", "name", "file"), "node_id"))
        totals = {r["request"]: r["count"] for r in by.groupBy("request").count().collect()}
        first = Window.partitionBy("request").orderBy("file", "name", "node_id")
        callers: dict[int, list[dict]] = {}
        for r in by.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= CALLERS).orderBy("request", "_n").collect():
            callers.setdefault(r["request"], []).append({"name": r["name"], "file": r["file"]})
        return callers, totals

    def close(self) -> None:
        self.cache_clear()


def pairs(edges: DataFrame) -> list[tuple[str, str]]:
    return [(r["src_id"], r["dst_id"]) for r in edges.collect()]


def reference(node: dict) -> dict:
    """What points to a symbol: its name, file, line and label, those that are known."""
    return {k: node[k] for k in ("name", "file", "line", "label") if node.get(k) is not None}


def references(result: dict) -> list[dict]:
    """The symbols of a result: all nodes of a context, the node of a definition, the hits of a search."""
    nodes = result.get("nodes") or result.get("hits") or ([result["node"]] if result.get("node") else [])
    return [reference(n) for n in nodes]


def top(search: dict) -> dict | None:
    """The best hit, or None."""
    return search["hits"][0] if search.get("hits") else None


def hits_from(rows: list[dict], query: str | None = None) -> dict:
    """A search result made of bare hits, in their order."""
    return {"query": query, "hits": list(rows)}


def online(status: dict) -> bool:
    """Whether a status was told by a store: it counts nodes, and knows the repository's head."""
    return status.get("nodes", -1) >= 0 and status.get("head", "unknown") != "unknown"


def with_reason(result: dict) -> dict:
    """A result whose error has its reason beside it."""
    error = result.get("error")
    return result if not error or result.get("error_reason") else result | {"error_reason": "not_found" if error == "not_found" else error_reason(str(error))}


def callers_at(impact: dict, depth: int) -> list[dict]:
    return impact.get("callers_by_depth", {}).get(depth, [])


def all_callers(impact: dict) -> list[dict]:
    return [c for d in sorted(impact.get("callers_by_depth", {})) for c in impact["callers_by_depth"][d]]


def to_json(result: dict) -> str:
    return json.dumps(result, indent=2, sort_keys=True, default=str)


def from_json(text: str) -> dict:
    """A result read back: depths become numbers again."""
    out = json.loads(text)
    if "callers_by_depth" in out:
        out["callers_by_depth"] = {int(k): v for k, v in out["callers_by_depth"].items()}
    return out


def explain(context: dict) -> str:
    """A context as text for a reader who doesn't know the code."""
    if not context["found"]:
        return f"{context['symbol']} is not in the graph."
    root, names = context["nodes"][0], {n["node_id"]: n["name"] for n in context["nodes"]}
    lines = [f"{root['label']} {root['name']} ({root['file']}:{root['line']})"] + ([root["docstring"]] if root.get("docstring") else [])
    lines += [f"- {n['name']} ({n['file']}:{n['line']}), {n['depth']} calls away" for n in context["nodes"][1:]]
    lines += [f"  {names[a]} -> {names[b]}" for a, b in context["edges"] if a in names and b in names]
    lines += [f"cycle: {', '.join(names.get(m, m) for m in c['members'][:3])}" for c in context["cycles"]]
    return "\n".join(lines)


def strong_components(nodes: list[str], edges: list[tuple[str, str]]) -> list[list[str]]:
    """Cycles of a small subgraph: sorted members of each strongly connected component of two or more."""
    out: dict[str, list[str]] = {n: [] for n in nodes}
    back: dict[str, list[str]] = {n: [] for n in nodes}
    for a, b in edges:
        if a in out and b in out:
            out[a].append(b)
            back[b].append(a)
    order, seen = [], set()
    for n in out:
        stack = [(n, iter(out[n]))] if n not in seen else []
        seen.add(n)
        while stack:
            at, rest = stack[-1]
            new = next((m for m in rest if m not in seen), None)
            if new is None:
                order.append(at)
                stack.pop()
            else:
                seen.add(new)
                stack.append((new, iter(out[new])))
    groups, done = [], set()
    for n in reversed(order):
        if n in done:
            continue
        group, todo = [], [n]
        done.add(n)
        while todo:
            at = todo.pop()
            group.append(at)
            fresh = [m for m in back[at] if m not in done]
            done.update(fresh)
            todo += fresh
        if len(group) > 1:
            groups.append(sorted(group))
    return sorted(groups, key=lambda c: (-len(c), c))
