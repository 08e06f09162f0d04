"""The registered queries over derived tables, each next to its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from ..functions import diffs, imports
from ..operators import algorithms, conflicts, incremental, lookup, metrics, sessions, traverse, vectors
from ..operators.index import SymbolIndex
from ..schema import priority, project_id
from . import building, derived  # noqa: F401  building registers its own queries
from .derived import SYMBOLS_SQL, TASKS_SQL, TIMELINE_SQL, UNIQUE_SQL, table
from .registry import ORACLES, QUERIES, query  # noqa: F401

LAYERS = [("top", ["#1"]), ("mid", ["#2", "#3"]), ("low", ["#4", "#5"]), ("base", ["#"])]
PATTERNS = ["P01_symbol_not_found", "P02_view_depth_flag", "P03_grep_wrong_flag", "P04_unsupported_file", "P08_windows_cmd_tools", "P20_list_empty"]


def on_graph(name: str, f: Callable, sql: str | None = None) -> None:
    query(name, sql, True)(lambda spark, d: f(derived.graph(spark, d)))


# Aggregates.
on_graph("hot_callees", metrics.hot_callees, """
SELECT d_name AS name, d_file AS file, d_label AS label, count(DISTINCT src_id) AS callers FROM ends GROUP BY ALL ORDER BY callers DESC, 1, 2, 3 LIMIT 20""")
on_graph("module_coupling", metrics.module_coupling, """
, x AS (SELECT unnest([s_file, d_file]) AS file FROM ends WHERE s_file <> d_file)
SELECT n.file, n.symbols, coalesce(c.coupling, 0) AS coupling FROM (SELECT file, count(*) AS symbols FROM nodes GROUP BY file) n
LEFT JOIN (SELECT file, count(*) AS coupling FROM x GROUP BY file) c ON n.file = c.file""")
on_graph("complexity_rank", metrics.complexity_rank, """
, i AS (SELECT dst_id, count(*) AS n FROM calls GROUP BY 1), o AS (SELECT src_id, count(*) AS n FROM calls GROUP BY 1)
SELECT node_id, name, file, label, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out, coalesce(i.n, 0) * coalesce(o.n, 0) AS score
FROM nodes LEFT JOIN i ON node_id = dst_id LEFT JOIN o ON node_id = src_id WHERE label <> 'Module' AND (i.n > 0 OR o.n > 0) ORDER BY score DESC, fan_in DESC, node_id LIMIT 20""")
on_graph("bottleneck_rank", metrics.bottleneck_rank, """
, i AS (SELECT dst_id, count(DISTINCT s_file) AS caller_files, min(s_file) AS caller_sample FROM ends WHERE s_file <> d_file GROUP BY 1),
o AS (SELECT src_id, count(DISTINCT d_file) AS callee_files, min(d_file) AS callee_sample FROM ends WHERE s_file <> d_file GROUP BY 1)
SELECT node_id, name, file, caller_files, caller_sample, callee_files, callee_sample, caller_files * callee_files AS score
FROM nodes JOIN i ON node_id = dst_id JOIN o ON node_id = src_id ORDER BY score DESC, name, file, node_id LIMIT 10""")
on_graph("unused_nodes", metrics.unused, """
SELECT node_id, name, label, file, line FROM nodes n WHERE label <> 'Module' AND NOT starts_with(name, '__') AND NOT EXISTS (SELECT 1 FROM calls WHERE dst_id = node_id)""")
on_graph("layer_violations", lambda g: metrics.layer_violations(g, LAYERS, [("low", "mid")]), """
, l AS (SELECT *, CASE WHEN contains(s_file, '#1') THEN 0 WHEN contains(s_file, '#2') OR contains(s_file, '#3') THEN 1 WHEN contains(s_file, '#4') OR contains(s_file, '#5') THEN 2 WHEN contains(s_file, '#') THEN 3 END AS a,
  CASE WHEN contains(d_file, '#1') THEN 0 WHEN contains(d_file, '#2') OR contains(d_file, '#3') THEN 1 WHEN contains(d_file, '#4') OR contains(d_file, '#5') THEN 2 WHEN contains(d_file, '#') THEN 3 END AS b FROM ends)
SELECT s_name, s_file, d_name, d_file, ['top', 'mid', 'low', 'base'][a + 1] AS from_layer, ['top', 'mid', 'low', 'base'][b + 1] AS to_layer, count(*) AS calls
FROM l WHERE s_file <> d_file AND a > b AND NOT (a = 2 AND b = 1) GROUP BY ALL""")
on_graph("unclassified_files", lambda g: metrics.unclassified_files(g, [("one", ["#1"]), ("two", ["#2"])]), """
, x AS (SELECT unnest([s_file, d_file]) AS file FROM ends WHERE s_file <> d_file) SELECT file, count(*) AS calls FROM x WHERE NOT contains(file, '#1') AND NOT contains(file, '#2') GROUP BY file""")
FILE = "Brand#7"
on_graph("scope_exports", lambda g: metrics.scope_exports(g, FILE), f"""
SELECT d_name AS name, d_label AS label, count(DISTINCT src_id) AS callers, array_to_string(list_sort(list(DISTINCT s_file))[1:3], ',') AS sample_files FROM ends WHERE d_file = '{FILE}' AND s_file <> '{FILE}' GROUP BY 1, 2""")
on_graph("scope_imports", lambda g: metrics.scope_imports(g, FILE), f"""
SELECT d_name AS name, d_file AS file, count(DISTINCT src_id) AS users FROM ends WHERE s_file = '{FILE}' AND d_file <> '{FILE}' GROUP BY 1, 2""")
on_graph("scope_internal", lambda g: metrics.scope_internal(g, FILE), f"""
SELECT node_id, name, label, line FROM nodes WHERE file = '{FILE}' AND name NOT IN (SELECT d_name FROM ends WHERE (d_file = '{FILE}') <> (s_file = '{FILE}'))""")
on_graph("scope_resolve", lambda g: metrics.resolve_file(g, "Brand#2"), """
SELECT 0 AS stage, file FROM (SELECT DISTINCT file FROM nodes WHERE contains(file, 'Brand#2')) ORDER BY file LIMIT 10""")
on_graph("graph_stats", metrics.graph_stats, """
SELECT 'nodes' AS what, count(*) AS total FROM nodes UNION ALL SELECT 'edges', count(*) FROM ends""")
on_graph("label_histogram", metrics.label_histogram, "SELECT label, count(*) AS total FROM nodes GROUP BY label")
on_graph("consistency", metrics.inconsistencies, """
SELECT 'missing' AS what, count(*) AS total FROM nodes WHERE name IS NULL OR file IS NULL
UNION ALL SELECT 'duplicates', count(*) FROM (SELECT 1 FROM nodes GROUP BY file, name HAVING count(*) > 1)""")


@query("changed_symbols", """
, c AS (SELECT file, CASE WHEN file = 'Brand#4' THEN 'A' ELSE 'M' END AS status FROM (SELECT DISTINCT file FROM nodes) WHERE file IN ('Brand#4', 'Brand#9', 'Brand#11'))
SELECT node_id, name, n.file, line, status = 'A' OR (n.file = 'Brand#9' AND (line BETWEEN 3 AND 9 OR line BETWEEN 20 AND 31)) AS direct,
  (SELECT count(*) FROM calls WHERE dst_id = node_id) AS callers FROM nodes n JOIN c ON n.file = c.file""", True)
def changed_symbols(spark, d):
    changes = spark.createDataFrame([("Brand#4", "A"), ("Brand#9", "M"), ("Brand#11", "M")], "file string, status string")
    hunks = spark.createDataFrame([("Brand#9", 3, 9), ("Brand#9", 20, 31)], "file string, lo int, hi int")
    return metrics.changed_symbols(derived.graph(spark, d), changes, hunks)


@query("last_commit", """
SELECT o_orderkey::VARCHAR AS commit_hash, o_orderdate AS ts FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) ORDER BY ts DESC, 1 LIMIT 1""")
def last_commit(spark, d):
    commits = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("commit_hash"), F.col("o_orderdate").alias("ts"))
    links = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("dst_id"))
    return metrics.last_commit(commits, links)


# Lookups.
RANK = "CASE label WHEN 'Function' THEN 0 WHEN 'Class' THEN 1 ELSE 2 END"
on_graph("node_by_id", lambda g: lookup.node_by_id(g, "42").select(*lookup.BRIEF), "SELECT node_id, name, label, file, line FROM nodes WHERE node_id = '42'")
on_graph("definition", lambda g: lookup.definition(g, "red bolt", "Brand#1"), f"""
, b AS (SELECT * FROM nodes WHERE name = 'red bolt' AND contains(file, 'Brand#1') ORDER BY {RANK}, file, line, node_id LIMIT 1)
SELECT b.node_id, b.name, b.label, b.file, b.line, e.dst_id AS callee_id, e.d_name AS callee, e.d_file AS callee_file FROM b LEFT JOIN ends e ON e.src_id = b.node_id""")
on_graph("definition_homonyms", lambda g: lookup.homonyms(g, "red bolt"), "SELECT node_id, name, label, file, line FROM nodes WHERE name = 'red bolt' AND (SELECT count(*) FROM nodes WHERE name = 'red bolt') > 1")
on_graph("definition_by_name", lambda g: lookup.definition_by_name(g, "red bolt"), "SELECT DISTINCT d_name AS callee, d_file AS callee_file FROM ends WHERE s_name = 'red bolt'")
on_graph("definition_fallback", lambda g: lookup.definition_fallback(g, "red.red bolt"), "SELECT 1 AS stage, name, file, label, line FROM nodes WHERE name = 'red bolt' AND parent = 'red'")
on_graph("definition_suggest", lambda g: lookup.definition_fallback(g, "Cls.olt"), """
SELECT 3 AS stage, name, file, label, NULL::INTEGER AS line FROM (SELECT DISTINCT name, file, label FROM nodes WHERE contains(lower(name), 'olt') ORDER BY length(name), name, file, label LIMIT 5)""")
LOOKUP = """, b AS (SELECT *, {how} AS via FROM nodes WHERE {cond} ORDER BY {order}{rank}, file, line, node_id LIMIT 1)
SELECT node_id, name, label, file, line, via, (SELECT count(*) FROM calls WHERE dst_id = node_id) AS callers,
  coalesce((SELECT array_to_string(list_sort(list(DISTINCT d_name))[1:5], ',') FROM ends WHERE src_id = node_id), '') AS callees FROM b"""
on_graph("lookup_exact", lambda g: lookup.lookup(g, "hot gear"), LOOKUP.format(how="'exact'", cond="name = 'hot gear'", order="", rank=RANK))
on_graph("lookup_partial", lambda g: lookup.lookup(g, "Gear"), LOOKUP.format(how="'partial'", cond="contains(lower(name), 'gear')", order="length(name), ", rank=RANK))
on_graph("lookup_dotted", lambda g: lookup.lookup(g, "hot.hot gear"), LOOKUP.format(how="'dotted'", cond="name = 'hot gear' AND parent = 'hot'", order="", rank=RANK))
SNIPPET = """CASE WHEN position(lower(term) IN lower(docstring)) > 0 THEN docstring ELSE '' END"""
on_graph("grep_symbols", lambda g: lookup.grep(g, "def BOLT", label="function", top=25), f"""
, h AS (SELECT *, CASE WHEN contains(lower(name), 'bolt') THEN 0 ELSE 1 END AS rank, 'BOLT' AS term FROM nodes WHERE label = 'Function' AND (contains(lower(name), 'bolt') OR contains(lower(docstring), 'bolt')) ORDER BY rank, file, line, node_id LIMIT 25)
SELECT node_id, name, label, file, line, rank, {SNIPPET} AS snippet FROM h QUALIFY row_number() OVER (PARTITION BY file, name, line ORDER BY rank, node_id) = 1""")
on_graph("grep_alternation", lambda g: lookup.grep(g, "gizmo|promo", top=15), f"""
, a(alt, term) AS (VALUES (0, 'gizmo'), (1, 'promo')),
h AS (SELECT n.*, alt, term, CASE WHEN contains(lower(name), term) THEN 0 ELSE 1 END AS rank FROM nodes n, a WHERE contains(lower(name), term) OR contains(lower(docstring), term)),
t AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY alt ORDER BY rank, file, line, node_id) <= 15)
SELECT node_id, name, label, file, line, rank, {SNIPPET} AS snippet FROM t QUALIFY row_number() OVER (PARTITION BY file, name, line ORDER BY alt, rank, node_id) = 1""")


@query("grep_snippet", r"""
SELECT doc_id, CASE WHEN p = 0 THEN '' ELSE CASE WHEN p > 41 THEN '...' ELSE '' END || replace(substr(text, greatest(1, p - 40)::INT, (least(length(text), p + 43) - greatest(1, p - 40) + 1)::INT), chr(10), ' ')
  || CASE WHEN p + 43 < length(text) THEN '...' ELSE '' END END AS snippet FROM (SELECT doc_id, text, position('tion' IN lower(text)) AS p FROM documents)""")
def grep_snippet(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", lookup.snippet(F.col("text"), F.lit("tion")).alias("snippet"))


on_graph("list_by_file", lambda g: lookup.list_symbols(g, "Brand#1", "class"), """
SELECT node_id, name, label, file, line, count(*) OVER (PARTITION BY file) AS in_file FROM nodes WHERE contains(file, 'Brand#1') AND label = 'Class'""")


@query("view_window", r"""
, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE doc_id = 17)
SELECT line_no, text FROM l WHERE line_no BETWEEN 3 - 1 AND 3 + 29 + 1""".replace(", l AS", "WITH l AS", 1))
def view_window(spark, d):
    lines = table(spark, d, "documents").where("doc_id = 17").select(F.posexplode(F.split("text", "\n")).alias("p", "text")).select((F.col("p") + 1).cast("long").alias("line_no"), "text")
    return lookup.view_window(lines, "nosuchname", 3, context=1)


@query("view_symbol", """
, b AS (SELECT file, line FROM nodes WHERE name = 'red bolt' AND contains(file, 'Brand#1') ORDER BY CASE label WHEN 'Function' THEN 0 WHEN 'Class' THEN 1 ELSE 2 END, file, line, node_id LIMIT 1)
SELECT b.file, g.n AS line_no, b.file || ':' || g.n AS text FROM b, (SELECT unnest(generate_series(1, 60)) AS n) g WHERE g.n BETWEEN b.line - 2 AND b.line + 31""", True)
def view_symbol(spark, d):
    g = derived.graph(spark, d)
    lines = g.nodes.select("file").distinct().select("file", F.explode(F.sequence(F.lit(1), F.lit(60))).alias("line_no"))
    lines = lines.select("file", F.col("line_no").cast("long").alias("line_no"), F.concat_ws(":", "file", "line_no").alias("text"))
    return lookup.view(g, lines, "red bolt", "Brand#1", context=2)


on_graph("orient_terms", lambda g: lookup.orient(g, "Where does the Bolt handle widget and ring_gear and gizmo for Gear"), """
, t(term) AS (VALUES ('Bolt'), ('Gear'), ('widget'), ('ring_gear'), ('gizmo')),
h AS (SELECT term, n.* FROM nodes n, t WHERE label NOT IN ('File', 'Module') AND contains(lower(name), lower(term)))
SELECT term, node_id, name, label, file, line FROM h QUALIFY row_number() OVER (PARTITION BY term ORDER BY CASE WHEN lower(name) = lower(term) THEN 0 ELSE 1 END, file, line, node_id) <= 6""")
on_graph("callers", lambda g: lookup.callers(g, "red bolt"), "SELECT node_id, name, label, file, line FROM nodes WHERE node_id IN (SELECT src_id FROM ends WHERE d_name = 'red bolt')")

# Traversal.
START = f"s AS (SELECT node_id FROM nodes WHERE name = '{{name}}' ORDER BY {RANK}, file, line, node_id LIMIT 1)"
WALK = ", " + START + """, r(node_id, depth) AS (SELECT node_id, 0 FROM s UNION SELECT {to}, depth + 1 FROM r JOIN calls ON {frm} = r.node_id WHERE depth < {k}),
m AS (SELECT node_id, min(depth) AS depth FROM r GROUP BY node_id)"""
IMPACT = "old gear"
DOWN, UP = ("dst_id", "src_id"), ("src_id", "dst_id")


def walk(k: int, way: tuple[str, str] = DOWN, name: str = "red bolt") -> str:
    return WALK.format(k=k, to=way[0], frm=way[1], name=name)


on_graph("neighbors_2", lambda g: traverse.neighbors(g, "42", 2, 100_000), """
, r(node_id, depth) AS (SELECT '42', 0 UNION SELECT dst_id, depth + 1 FROM r JOIN calls ON src_id = r.node_id WHERE depth < 2)
SELECT node_id, name, label, file, line FROM nodes WHERE node_id IN (SELECT node_id FROM r WHERE depth > 0)""")
on_graph("bounded_subgraph_nodes", lambda g: traverse.subgraph_nodes(g, traverse.start_of(g, "red bolt"), 6), walk(6) + "SELECT node_id, name, label, file, line, docstring, depth, depth = 0 AS is_root FROM m JOIN nodes USING (node_id)")
on_graph("bounded_subgraph_edges", lambda g: traverse.induced_edges(g, traverse.subgraph_nodes(g, traverse.start_of(g, "red bolt"), 5)), walk(5) + "SELECT src_id, dst_id FROM calls WHERE src_id IN (SELECT node_id FROM m) AND dst_id IN (SELECT node_id FROM m)")
on_graph("subgraph_edges_by_name", lambda g: traverse.by_name(g, traverse.induced_edges(g, traverse.subgraph_nodes(g, traverse.start_of(g, "red bolt"), 3))), walk(3) + "SELECT DISTINCT s_name AS src, d_name AS dst FROM ends WHERE src_id IN (SELECT node_id FROM m) AND dst_id IN (SELECT node_id FROM m)")
on_graph("impact_by_depth", lambda g: traverse.impact_by_depth(g, IMPACT, 5), walk(5, UP, IMPACT) + f"SELECT node_id, name, file, depth FROM m JOIN nodes USING (node_id) WHERE depth > 0 AND name <> '{IMPACT}'")
on_graph("token_estimate", lambda g: traverse.token_estimate(traverse.subgraph_nodes(g, traverse.start_of(g, "red bolt"), 5)), walk(5) + "SELECT (sum(length(name) + length(file) + 30) // 4)::BIGINT AS tokens FROM m JOIN nodes USING (node_id)")


# Many requests at once: of each file the first function, and what it reaches, or is reached from, in as many hops as its name has words.
MANY_SQL = f"""
, s AS (SELECT file AS request, node_id, len(string_split(name, ' ')) AS hops FROM nodes QUALIFY row_number() OVER (PARTITION BY file ORDER BY {RANK}, file, line, node_id) = 1),
r(request, node_id, hops, depth) AS (SELECT request, node_id, hops, 0 FROM s UNION SELECT request, {{to}}, hops, depth + 1 FROM r JOIN calls ON {{frm}} = r.node_id WHERE depth < hops)
SELECT request, node_id, min(depth) AS depth FROM r GROUP BY request, node_id"""


def _many(g, reverse: bool):
    best = F.min(F.struct(priority(F.col("label")).alias("p"), "line", "node_id", "name")).alias("b")
    starts = g.nodes.groupBy(F.col("file").alias("request")).agg(best).select("request", "b.node_id", F.size(F.split("b.name", " ")).alias("hops"))
    return traverse.reach_many(g.adjacency(reverse), starts, traverse.MAX_DEPTH)


on_graph("reach_of_many", lambda g: _many(g, False), MANY_SQL.format(to="dst_id", frm="src_id"))
on_graph("impact_of_many", lambda g: _many(g, True), MANY_SQL.format(to="src_id", frm="dst_id"))


@query("shortest_path_hops", """
, r(node_id, depth) AS (SELECT node_id, 0 FROM nodes WHERE name = 'red bolt' UNION SELECT dst_id, depth + 1 FROM r JOIN calls ON src_id = r.node_id WHERE depth < 12)
SELECT min(depth) AS hops FROM r JOIN nodes USING (node_id) WHERE name = 'blue gizmo'""", True)
def shortest_path_hops(spark, d):
    return traverse.shortest_path(derived.graph(spark, d), "red bolt", "blue gizmo").agg(F.max("hop").alias("hops"))


# Algorithms.
@query("scc_groups", """
, t(a, b) AS (SELECT src_id, dst_id FROM calls UNION SELECT a, dst_id FROM t JOIN calls ON src_id = b),
p AS (SELECT x.a, x.b FROM t x JOIN t y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b)
SELECT a AS node_id, least(a, min(b)) AS component FROM p GROUP BY a""", True)
def scc_groups(spark, d):
    return algorithms.scc(derived.graph(spark, d).calls())


@query("cycle_report", """
, t(a, b) AS (SELECT src_id, dst_id FROM calls UNION SELECT a, dst_id FROM t JOIN calls ON src_id = b),
p AS (SELECT x.a, x.b FROM t x JOIN t y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b),
g AS (SELECT a, least(a, min(b)) AS representative FROM p GROUP BY a)
SELECT representative, array_to_string(list_sort(list(a)), ',') AS members, count(*) AS size FROM g GROUP BY representative""", True)
def cycle_report(spark, d):
    g = derived.graph(spark, d)
    return algorithms.cycle_groups(g.nodes, g.calls()).select("representative", F.array_join("members", ",").alias("members"), "size")


@query("bridge_compression")
def bridge_compression(spark, d):
    """Bridges of the subgraphs around several nodes, all at once."""
    g = derived.graph(spark, d)
    out = None
    for name in ("red bolt", "hot gear", "blue gizmo"):
        root = traverse.start_of(g, name)
        nodes = traverse.subgraph_nodes(g, root, 2)
        root_id = F.lit(root.first()["node_id"] if root.first() else "")
        n = nodes.select(F.lit(name).alias("graph"), root_id.alias("root"), F.lit("node").alias("kind"), F.col("node_id").alias("a"), F.lit(None).cast("string").alias("b"), (F.col("depth") * 1_000_000).cast("long").alias("ord"))
        e = traverse.induced_edges(g, nodes).select(F.lit(name), root_id, F.lit("edge"), "src_id", "dst_id", F.lit(0).cast("long"))
        rows = n.unionAll(e)
        out = rows if out is None else out.unionAll(rows)
    return algorithms.compress_subgraphs(out)


# Deltas.
@query("snapshot_delta", f"""
WITH {SYMBOLS_SQL}, b AS (SELECT * FROM symbols WHERE ord % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY file, qualified_name ORDER BY ord DESC) = 1),
a AS (SELECT ord, name, qualified_name, CASE WHEN ord % 13 = 0 THEN 'class' ELSE type END AS type, file, CASE WHEN ord % 11 = 0 THEN line + 1 ELSE line END AS line FROM symbols WHERE ord % 5 <> 0
  QUALIFY row_number() OVER (PARTITION BY file, qualified_name ORDER BY ord DESC) = 1)
SELECT coalesce(a.file, b.file) AS file, coalesce(a.qualified_name, b.qualified_name) AS qualified_name, CASE WHEN b.ord IS NULL THEN 'added' WHEN a.ord IS NULL THEN 'deleted' ELSE 'modified' END AS op,
  coalesce(a.line, b.line) AS line, coalesce(a.type, b.type) AS type FROM a FULL JOIN b ON a.file = b.file AND a.qualified_name = b.qualified_name
WHERE b.ord IS NULL OR a.ord IS NULL OR a.line <> b.line OR a.type <> b.type""")
def snapshot_delta(spark, d):
    s = derived.symbols(spark, d)
    after = s.where("ord % 5 <> 0").withColumn("type", F.when(F.col("ord") % 13 == 0, "class").otherwise(F.col("type"))).withColumn("line", F.when(F.col("ord") % 11 == 0, F.col("line") + 1).otherwise(F.col("line")))
    return incremental.delta(s.where("ord % 7 <> 0"), after)


@query("structural_change", f"""
WITH {SYMBOLS_SQL}, b AS (SELECT file, list_sort(list(DISTINCT name)) AS n FROM symbols WHERE ord % 7 <> 0 GROUP BY file), a AS (SELECT file, list_sort(list(DISTINCT name)) AS n FROM symbols WHERE ord % 5 <> 0 GROUP BY file)
SELECT coalesce(a.file, b.file) AS file, a.n IS DISTINCT FROM b.n AS structural FROM a FULL JOIN b ON a.file = b.file""")
def structural_change(spark, d):
    s = derived.symbols(spark, d)
    return incremental.structural_change(s.where("ord % 7 <> 0"), s.where("ord % 5 <> 0"))


@query("edge_upsert", """
, e AS (SELECT src_id, dst_id, s_label, 'Function' AS d_label FROM ends UNION SELECT src_id, 'none', s_label, 'Function' FROM ends)
SELECT DISTINCT e.src_id, e.dst_id FROM e JOIN nodes d ON d.node_id = e.dst_id AND d.label = e.d_label""", True)
def edge_upsert(spark, d):
    g = derived.graph(spark, d)
    e = g.edges.join(g.nodes.select(F.col("node_id").alias("src_id"), F.col("label").alias("src_label")), "src_id").withColumn("dst_label", F.lit("Function"))
    return incremental.valid_edges(g.nodes, e.unionByName(e.withColumn("dst_id", F.lit("none")))).select("src_id", "dst_id")


# Conflicts.
@query("conflicts_direct", f"""
WITH {TASKS_SQL} SELECT a.task AS task_a, b.task AS task_b, array_to_string(list_sort(list(a.symbol)), ',') AS symbols FROM targets a JOIN targets b ON a.symbol = b.symbol AND a.task < b.task GROUP BY 1, 2""")
def conflicts_direct(spark, d):
    return conflicts.direct_conflicts(derived.targets(spark, d)).withColumn("symbols", F.array_join("symbols", ","))


CLOSURE_SQL = f"""WITH RECURSIVE {TASKS_SQL}, {UNIQUE_SQL},
f AS (SELECT name, coalesce((SELECT arg_max(file, ord) FROM symbols q WHERE q.qualified_name = n.name), (SELECT arg_min(file, ord) FROM symbols q WHERE q.name = n.name)) AS file FROM (SELECT name FROM symbols UNION SELECT qualified_name FROM symbols) n),
step AS (SELECT DISTINCT f.name, s.name AS dep FROM f JOIN symbols s ON s.file = f.file AND s.type = 'import'),
c(name, dep) AS (SELECT step.name, dep FROM step JOIN (SELECT DISTINCT symbol FROM targets) w ON w.symbol = step.name UNION SELECT c.name, step.dep FROM c JOIN step ON step.name = c.dep)"""


def _closure(spark, d):
    return derived.targets(spark, d), *conflicts.file_closure(derived.unique_symbols(spark, d), derived.wanted(spark, d))


@query("dependency_closure", CLOSURE_SQL + " SELECT name, dep FROM c")
def dependency_closure(spark, d):
    return conflicts.dependency_closure(derived.unique_symbols(spark, d), derived.wanted(spark, d))


@query("conflicts_dependency", CLOSURE_SQL + """
SELECT a.task AS task_a, b.task AS task_b, array_to_string(list_sort(list(DISTINCT c.dep)), ',') AS symbols FROM targets a JOIN c ON c.name = a.symbol JOIN targets b ON b.symbol = c.dep WHERE a.task <> b.task GROUP BY 1, 2""")
def conflicts_dependency(spark, d):
    return conflicts.dependency_conflicts(*_closure(spark, d), separator=",")


@query("conflict_report", CLOSURE_SQL + """
, k AS (SELECT 'direct' AS kind, count(*) AS conflicts FROM (SELECT DISTINCT a.task, b.task FROM targets a JOIN targets b ON a.symbol = b.symbol AND a.task < b.task)
  UNION ALL SELECT 'dependency', count(*) FROM (SELECT DISTINCT a.task, b.task FROM targets a JOIN c ON c.name = a.symbol JOIN targets b ON b.symbol = c.dep WHERE a.task <> b.task)
  UNION ALL SELECT 'circular', count(*) FROM (SELECT DISTINCT a.task FROM targets a JOIN c ON c.name = a.symbol JOIN targets b ON b.symbol = c.dep AND b.task = a.task))
SELECT kind, conflicts FROM k UNION ALL SELECT 'feasible', (sum(conflicts) = 0)::BIGINT FROM k""")
def conflict_report(spark, d):
    return conflicts.report(derived.targets(spark, d), derived.unique_symbols(spark, d))


@query("conflicts_circular", CLOSURE_SQL + """
SELECT a.task, array_to_string(list_sort(list(DISTINCT a.symbol)), ',') AS symbols FROM targets a JOIN c ON c.name = a.symbol JOIN targets b ON b.symbol = c.dep AND b.task = a.task GROUP BY 1""")
def conflicts_circular(spark, d):
    return conflicts.circular(*_closure(spark, d)).withColumn("symbols", F.array_join("symbols", ","))


# The symbol index.
@query("index_find", f"WITH {SYMBOLS_SQL} SELECT ord, name, file FROM symbols WHERE name = 'red bolt' ORDER BY file <> 'Brand#7/3', ord LIMIT 1")
def index_find(spark, d):
    return SymbolIndex(derived.symbols(spark, d)).find("red bolt", "Brand#7/3").select("ord", "name", "file")


@query("index_by_qualified_name", f"WITH {SYMBOLS_SQL} SELECT ord, name, file FROM symbols WHERE qualified_name = 'red.red bolt' ORDER BY ord DESC LIMIT 1")
def index_by_qualified_name(spark, d):
    return SymbolIndex(derived.symbols(spark, d)).get_by_qualified_name("red.red bolt").select("ord", "name", "file")


@query("index_by_name", f"WITH {SYMBOLS_SQL} SELECT ord, name, file FROM symbols WHERE name = 'hot gear'")
def index_by_name(spark, d):
    return SymbolIndex(derived.symbols(spark, d)).get_by_name("hot gear").select("ord", "name", "file")


@query("index_by_file", f"WITH {SYMBOLS_SQL} SELECT ord, name, file FROM symbols WHERE file = 'Brand#7/3'")
def index_by_file(spark, d):
    return SymbolIndex(derived.symbols(spark, d)).get_by_file("Brand#7/3").select("ord", "name", "file")


@query("index_of_type", f"WITH {SYMBOLS_SQL} SELECT ord, name, file FROM symbols WHERE type = 'import'")
def index_of_type(spark, d):
    return SymbolIndex(derived.symbols(spark, d)).of_type("import").select("ord", "name", "file")


@query("index_add_and_remove", f"""
WITH {SYMBOLS_SQL}, two AS (SELECT *, ord AS o FROM symbols UNION ALL SELECT *, ord + (SELECT max(ord) FROM symbols) + 1 FROM symbols WHERE type = 'class'), i AS (SELECT *, concat_ws(':', type, file, line, name) AS node_id FROM two)
SELECT o AS ord, node_id FROM i WHERE node_id <> (SELECT node_id FROM i WHERE o = 3)""")
def index_add_and_remove(spark, d):
    s = derived.symbols(spark, d)
    index = SymbolIndex(s).add_all(s.where("type = 'class'"))
    return index.remove(index.symbols.where("ord = 3").first()["node_id"])[0].symbols.select("ord", "node_id")


@query("index_duplicates", f"WITH {SYMBOLS_SQL} SELECT name, count(*) AS n, arg_min(concat_ws(':', type, file, line, name), ord) AS first_id FROM symbols GROUP BY name HAVING count(*) > 1")
def index_duplicates(spark, d):
    return SymbolIndex(derived.symbols(spark, d)).duplicates()


@query("index_methods", f"WITH {SYMBOLS_SQL} SELECT ord, name FROM symbols WHERE type = 'function' AND parent = 'hot'")
def index_methods(spark, d):
    return SymbolIndex(derived.symbols(spark, d)).methods_of("hot").select("ord", "name")


@query("index_prefix", f"WITH {SYMBOLS_SQL} SELECT ord, name FROM symbols WHERE starts_with(name, 'blue')")
def index_prefix(spark, d):
    return SymbolIndex(derived.symbols(spark, d)).search_by_prefix("blue").select("ord", "name")


@query("index_summary", f"WITH {SYMBOLS_SQL} SELECT count(*) AS symbols, count(DISTINCT file) AS files, count(DISTINCT name) AS names FROM symbols")
def index_summary(spark, d):
    return SymbolIndex(derived.symbols(spark, d)).summary()


# Vectors.
@query("knn_l2", """
, q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7)
SELECT vec_id, round(d, 6) AS distance, round(1 / (1 + d), 6) AS score FROM (SELECT vec_id, list_sum(list_transform(list_zip(embedding, e), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))) AS d FROM embeddings, q) ORDER BY d, vec_id LIMIT 5""".replace(", q AS", "WITH q AS", 1))
def knn_l2(spark, d):
    v = table(spark, d, "embeddings")
    near = vectors.nearest(v, v.where("vec_id = 7").first()["embedding"], 5, "vec_id")
    return near.select("vec_id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


@query("knn_batch", """
WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id, list_sum(list_transform(list_zip(embedding, e), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))) AS d FROM embeddings, q)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, round(d, 6) AS distance, round(1 / (1 + d), 6) AS score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY d, vec_id) QUALIFY row_number() OVER w <= 5""")
def knn_batch(spark, d):
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vectors.nearest_of_each(v, q, 5, "vec_id").select("query_id", "rank", "vec_id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


@query("embedding_text", f"""
WITH {SYMBOLS_SQL} SELECT ord, concat_ws(' ', name, 'type: ' || type, docstring, 'parent: ' || parent) AS text FROM symbols""")
def embedding_text(spark, d):
    return derived.symbols(spark, d).select("ord", vectors.embedding_text().alias("text"))


@query("lexical_search", f"""
WITH {SYMBOLS_SQL} SELECT ord, name, CASE WHEN lower(name) = 'red bolt' THEN 1.0 WHEN contains(lower(name), 'red bolt') THEN 0.8 ELSE 0.5 END::DOUBLE AS score FROM symbols
WHERE contains(lower(name), 'red bolt') OR contains(lower(docstring), 'red bolt') ORDER BY score DESC, ord LIMIT 30""")
def lexical_search(spark, d):
    return vectors.lexical(derived.symbols(spark, d), "Red Bolt", 30).select("ord", "name", "score")


# Sessions.
def on_timeline(name: str, f: Callable, sql: str) -> None:
    query(name, f"WITH {TIMELINE_SQL} {sql}")(lambda spark, d: f(derived.timeline(spark, d)))


on_timeline("tool_totals", sessions.tool_totals, "SELECT session, name, count(*) AS calls, count(*) FILTER (is_error) AS errors FROM tl GROUP BY 1, 2")
on_timeline("tool_usage", lambda tl: sessions.tool_usage(tl, "tool"), """, b AS (SELECT *, starts_with(command, 'tool') AS own FROM tl WHERE name = 'Bash')
SELECT session, count(*) FILTER (own AND NOT is_error) AS tool_ok, count(*) FILTER (own AND is_error) AS tool_err, count(*) FILTER (NOT own) AS fallback, min(turn) FILTER (NOT own)::INTEGER AS first_fallback_turn,
  (CASE WHEN max(turn) FILTER (own) IS NULL THEN 1 WHEN max(turn) > max(turn) FILTER (own) + 4 THEN max(turn) FILTER (own) END)::INTEGER AS abandoned_turn FROM b GROUP BY session""")
on_timeline("subcommands", lambda tl: sessions.subcommands(tl, "tool"), "SELECT session, split_part(command, ' ', 2) AS subcommand, count(*) AS calls FROM tl WHERE name = 'Bash' AND starts_with(command, 'tool ') GROUP BY 1, 2")
on_timeline("failed_commands", lambda tl: sessions.failed_commands(tl, "tool", "view", 9).withColumn("turn", F.col("turn").cast("long")), "SELECT session, turn, command, result[1:9] AS result FROM tl WHERE name = 'Bash' AND is_error AND starts_with(command, 'tool view')")
on_timeline("pattern_hits", lambda tl: sessions.pattern_hits(tl, "tool").drop("severity"), "SELECT session, pattern, count(*) AS hits FROM hits GROUP BY 1, 2")
on_timeline("pattern_matrix", lambda tl: sessions.pattern_matrix(sessions.pattern_hits(tl, "tool"), PATTERNS), "SELECT session, " + ", ".join(f"count(*) FILTER (pattern = '{p}') AS {p}" for p in PATTERNS) + " FROM hits GROUP BY session")
on_timeline("pattern_scan", lambda tl: sessions.pattern_scan(tl, "tool").select("pattern", "hits", "sessions", F.array_join("examples", "|").alias("examples")), """, e AS (SELECT pattern, h.session, h.turn, t.command FROM hits h JOIN tl t ON t.session = h.session AND t.turn = h.turn WHERE pattern NOT IN ('P04_unsupported_file', 'P20_list_empty') AND is_error),
r AS (SELECT pattern, string_agg(command, '|' ORDER BY session, turn) AS examples FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY pattern ORDER BY session, turn) <= 5) GROUP BY pattern)
SELECT pattern, count(*) AS hits, count(DISTINCT session) AS sessions, any_value(examples) AS examples FROM e JOIN r USING (pattern) GROUP BY pattern""")
on_timeline("call_classes", sessions.call_classes, """SELECT session, name, CASE WHEN name IN ('Read', 'Grep') AND is_error THEN 'blocked' WHEN is_error THEN 'failed' ELSE 'ok' END AS class, count(*) AS calls FROM tl WHERE name <> 'Bash' GROUP BY 1, 2, 3""")


def _facts(spark, d):
    tl = derived.timeline(spark, d).withColumn("day", F.date_trunc("day", "ts"))
    return tl.groupBy("session", "day").agg(F.min("ts").alias("ts"), F.count(F.lit(1)).alias("total_calls"), F.count_if("is_error").alias("total_errors"), F.count_if(F.col("name") == "Bash").alias("bash"), (F.count_if(F.col("name") == "Edit") / 8).alias("cost")).withColumn("instance", F.col("session"))


FACTS_SQL = f"""WITH {TIMELINE_SQL}, facts AS (SELECT session, date_trunc('day', ts) AS day, min(ts) AS ts, count(*) AS total_calls, count(*) FILTER (is_error) AS total_errors, count(*) FILTER (name = 'Bash') AS bash,
  count(*) FILTER (name = 'Edit') / 8 AS cost FROM tl GROUP BY 1, 2)"""


@query("first_last_verdict", FACTS_SQL + """
SELECT instance, first_cost, last_cost, CASE WHEN last_cost - first_cost < -0.005 THEN 'better' WHEN last_cost - first_cost > 0.005 THEN 'worse' ELSE 'same' END AS verdict
FROM (SELECT session AS instance, arg_min(cost, ts) AS first_cost, arg_max(cost, ts) AS last_cost FROM facts GROUP BY session HAVING count(*) > 1)""")
def first_last_verdict(spark, d):
    return sessions.first_last_verdict(_facts(spark, d))


@query("pattern_deltas", FACTS_SQL + """
, h AS (SELECT session, date_trunc('day', tl.ts) AS day, pattern, count(*) AS n FROM hits JOIN tl USING (session, turn) GROUP BY 1, 2, 3),
f AS (SELECT f.session, f.ts, cost, p.pattern, coalesce(n, 0) AS n FROM facts f CROSS JOIN (SELECT unnest(""" + str(PATTERNS) + """) AS pattern) p LEFT JOIN h ON h.session = f.session AND h.day = f.day AND h.pattern = p.pattern)
SELECT session AS instance, pattern, arg_min(n, ts) AS first_hits, arg_max(n, ts) AS last_hits FROM f GROUP BY 1, 2
HAVING count(*) > 1 AND arg_max(cost, ts) - arg_min(cost, ts) > 0.005 AND arg_max(n, ts) > arg_min(n, ts)""")
def pattern_deltas(spark, d):
    daily = F.concat_ws("@", "session", F.date_trunc("day", "ts").cast("string"))
    hits = sessions.pattern_matrix(sessions.pattern_hits(derived.timeline(spark, d).withColumn("session", daily), "tool"), PATTERNS)
    facts = _facts(spark, d).withColumn("session", F.concat_ws("@", "session", F.col("day").cast("string")))
    return sessions.pattern_deltas(facts.join(hits, "session", "left"), PATTERNS)


@query("batch_trend", FACTS_SQL + """
, l AS (SELECT strftime(ts, '%m-%dT%H') AS batch, ts, unnest([struct_pack(metric := 'total_calls', x := total_calls::DOUBLE), struct_pack(metric := 'total_errors', x := total_errors::DOUBLE), struct_pack(metric := 'bash', x := bash::DOUBLE)]) AS m FROM facts),
s AS (SELECT m.metric AS metric, batch, min(ts) AS b, sum(m.x) AS total, avg(m.x) AS av FROM l GROUP BY 1, 2),
e AS (SELECT metric, arg_min(total, b) AS t1, arg_min(av, b) AS a1, arg_max(total, b) AS t2, arg_max(av, b) AS a2 FROM s GROUP BY metric HAVING count(*) > 1)
SELECT metric, t1 AS first_total, a1 AS first_avg, t2 AS last_total, a2 AS last_avg,
  CASE WHEN abs(t2 - t1) < 0.001 THEN '=' WHEN t2 > t1 THEN CASE WHEN t1 < 0.001 THEN '+' || t2::BIGINT || ' NEW' ELSE '+' || round(100 * abs(t2 - t1) / t1)::BIGINT || '%' END WHEN t1 < 0.001 THEN '=' ELSE '-' || round(100 * abs(t2 - t1) / t1)::BIGINT || '%' END AS trend,
  CASE WHEN abs(t2 - t1) < 0.001 THEN 'same' WHEN t2 > t1 THEN CASE WHEN metric IN ('total_calls', 'bash') THEN 'neutral' ELSE 'regression' END ELSE 'improvement' END AS verdict FROM e""")
def batch_trend(spark, d):
    return sessions.batch_trend(_facts(spark, d), ["total_calls", "total_errors", "bash"])


# Every metric: a session a user and day, whose turns are the day's, and whose cost goes by its edits.
REPORT_SQL = f"""WITH {TIMELINE_SQL.replace("FROM events)", "FROM (SELECT *, user_id || '@' || date_trunc('day', ts)::DATE AS u FROM events))").replace("'s' || user_id AS session", "'s' || u AS session").replace("PARTITION BY user_id", "PARTITION BY u")},
p AS (SELECT session, pattern, count(*) AS n FROM hits GROUP BY ALL),
f AS (SELECT session, min(ts) AS ts, count(*) FILTER (name = 'Edit') / 8 AS cost, max(turn) AS turns, count(*) AS total_calls, count(*) FILTER (is_error) AS total_errors, count(*) FILTER (name = 'Bash') AS bash, count(*) FILTER (name = 'Read') AS read, 0 AS skill,
  count(*) FILTER (name = 'Edit') AS edit, count(*) FILTER (name = 'Grep') AS grep, count(*) FILTER (name = 'Bash' AND starts_with(command, 'tool ') AND NOT is_error) AS tool_ok, count(*) FILTER (name = 'Bash' AND starts_with(command, 'tool ') AND is_error) AS tool_err,
  count(*) FILTER (name = 'Bash' AND NOT starts_with(command, 'tool ')) AS fallback FROM tl GROUP BY session),
l AS (SELECT strftime(ts, '%m-%dT%H') AS batch, ts, unnest([{", ".join(f"struct_pack(metric := '{m}', x := {m}::DOUBLE)" for m in sessions.METRICS)}]) AS m FROM f),
q AS (SELECT strftime(ts, '%m-%dT%H') AS batch, ts, struct_pack(metric := k.pattern, x := coalesce(n, 0)::DOUBLE) AS m FROM f CROSS JOIN (SELECT unnest({list(sessions.MEANINGS)}) AS pattern) k LEFT JOIN p ON p.session = f.session AND p.pattern = k.pattern),
s AS (SELECT m.metric AS metric, batch, min(ts) AS b, sum(m.x) AS total, avg(m.x) AS av FROM (SELECT * FROM l UNION ALL SELECT * FROM q) GROUP BY 1, 2),
e AS (SELECT metric, arg_min(total, b) AS t1, arg_min(av, b) AS a1, arg_max(total, b) AS t2, arg_max(av, b) AS a2 FROM s GROUP BY metric HAVING count(*) > 1)
SELECT metric, t1 AS first_total, a1 AS first_avg, t2 AS last_total, a2 AS last_avg,
  CASE WHEN abs(t2 - t1) < 0.001 THEN '=' WHEN t2 > t1 THEN CASE WHEN t1 < 0.001 THEN '+' || t2::BIGINT || ' NEW' ELSE '+' || round(100 * abs(t2 - t1) / t1)::BIGINT || '%' END WHEN t1 < 0.001 THEN '=' ELSE '-' || round(100 * abs(t2 - t1) / t1)::BIGINT || '%' END AS trend,
  CASE WHEN abs(t2 - t1) < 0.001 THEN 'same' WHEN t2 > t1 THEN CASE WHEN metric IN ('total_calls', 'bash', 'read', 'tool_ok', 'edit') THEN 'neutral' ELSE 'regression' END WHEN metric = 'tool_ok' THEN 'regression' ELSE 'improvement' END AS verdict FROM e"""


@query("batch_report", REPORT_SQL)
def batch_report(spark, d):
    from pyspark.sql import Window

    session = F.concat_ws("@", "session", F.to_date("ts").cast("string"))
    tl = derived.timeline(spark, d).withColumn("session", session)
    tl = tl.withColumn("turn", F.row_number().over(Window.partitionBy("session").orderBy("turn")))
    head = tl.groupBy("session").agg(F.min("ts").alias("ts"), F.max("turn").alias("turns"), (F.count_if(F.col("name") == "Edit") / 8).alias("cost"))
    return sessions.batch_report(head.join(sessions.session_counts(tl, "tool"), "session"), "tool")


@query("batch_gap_commits", """
WITH b AS (SELECT strftime(ts, '%m-%d') AS batch, min(ts) AS begin FROM events GROUP BY 1), g AS (SELECT batch, begin AS lo, lead(begin) OVER (ORDER BY begin) AS hi, lead(batch) OVER (ORDER BY begin) AS next_batch FROM b),
c AS (SELECT event_id::VARCHAR AS commit_hash, ts, event_type AS message FROM events)
SELECT batch, next_batch, commit_hash, ts, CASE WHEN contains(message, 'err') THEN 'P01' WHEN contains(message, 'c') THEN 'P02' END AS pattern FROM c JOIN g ON ts > lo AND ts <= hi""")
def batch_gap_commits(spark, d):
    e = table(spark, d, "events")
    batches = e.groupBy(F.date_format("ts", "MM-dd").alias("batch")).agg(F.min("ts").alias("begin"))
    commits = e.select(F.col("event_id").cast("string").alias("commit_hash"), "ts", F.col("event_type").alias("message"))
    return sessions.batch_gap_commits(batches, commits, {"err": "P01", "c": "P02"})


@query("timeline_turns", """
SELECT conv_id, turn, role, sum((role = 'assistant')::INT) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS so_far FROM conversations""")
def timeline_turns(spark, d):
    from pyspark.sql import Window

    by = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.sum((F.col("role") == "assistant").cast("int")).over(by).alias("so_far"))


@query("prompt_line_difference", r"""
WITH s AS (SELECT conv_id, arg_min(text, turn) AS a, arg_max(text, turn) AS b FROM conversations GROUP BY conv_id)
SELECT conv_id, array_to_string(list_sort(list_distinct(list_filter(string_split(a, chr(10)), lambda x: NOT list_contains(string_split(b, chr(10)), x)))), chr(10)) AS gone FROM s""")
def prompt_line_difference(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("a"), F.max_by("text", "turn").alias("b"))
    return c.select("conv_id", F.array_join(sessions.line_difference(F.col("a"), F.col("b")), "\n").alias("gone"))


# Plans of tasks: suppliers in chains of four.
@query("conflict_classes", f"WITH {TASKS_SQL} SELECT symbol, count(*) AS tasks, count(*) * (count(*) - 1) // 2 AS pairs FROM targets GROUP BY symbol HAVING count(*) > 1")
def conflict_classes(spark, d):
    return conflicts.conflict_classes(derived.targets(spark, d))


def _turns(spark, d):
    """Suppliers are tasks, the nations their targets: those of a nation take turns."""
    nation = F.col("s_nationkey").cast("string")
    return conflicts.phases(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.array(nation).alias("target_symbols"), F.array().cast("array<string>").alias("dependency_symbols")))


query("task_turns", "SELECT s_suppkey AS id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)::INTEGER AS phase FROM supplier")(_turns)


def _plan(spark, d):
    k, text = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    none = F.array().cast("array<string>")
    return conflicts.phases(table(spark, d, "supplier").select(k.alias("id"), F.array(text).alias("target_symbols"), F.when(k % 4 == 0, none).otherwise(F.array((k - 1).cast("string"))).alias("dependency_symbols")))


FIRST_SQL = "SELECT s_suppkey AS id, (CASE WHEN s_suppkey < 4 THEN s_suppkey - min(s_suppkey) OVER () ELSE s_suppkey % 4 END + 1)::INTEGER AS phase FROM supplier"


@query("task_phases", FIRST_SQL)
def task_phases(spark, d):
    return _plan(spark, d)


@query("task_outcome", f"""
WITH p AS ({FIRST_SQL}), f AS (SELECT min(phase) AS stop FROM p WHERE id % 5 <> 0 AND id % 7 = 3), r AS (SELECT *, CASE WHEN id % 5 <> 0 AND phase <= stop THEN id % 7 <> 3 END AS ok FROM p, f)
SELECT CASE WHEN count(*) FILTER (ok) = count(*) THEN 'SUCCESS' WHEN count(*) FILTER (ok) = 0 THEN 'FAILED' ELSE 'PARTIAL' END AS status, count(*) AS total, count(*) FILTER (ok) AS completed, count(*) FILTER (NOT ok) AS failed,
  count(*) FILTER (ok IS NULL) AS skipped FROM r""")
def task_outcome(spark, d):
    results = table(spark, d, "supplier").where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 7 != 3).alias("success"))
    return conflicts.outcome(_plan(spark, d), results, stop_at_failure=True)


# Scalar operators.
@query("import_resolve_python", """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'pkg.sub.' || p_name WHEN 1 THEN 'pkg.' || p_name ELSE p_name END AS module FROM part""")
def import_resolve_python(spark, d):
    dots = F.element_at(F.array(F.lit("."), F.lit(".."), F.lit("")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", imports.resolve_python(F.concat(dots, F.col("p_name")), F.lit("pkg/sub/mod.py")).alias("module"))


@query("import_resolve_typescript", """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'src/app/' || p_name WHEN 1 THEN 'src/' || p_name ELSE '@scope/' || p_name || '.ts' END AS module FROM part""")
def import_resolve_typescript(spark, d):
    head = F.element_at(F.array(F.lit("./"), F.lit("../"), F.lit("@scope/")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", imports.resolve_typescript(F.concat(head, F.col("p_name"), F.lit(".ts")), F.lit("src/app/main.ts")).alias("module"))


@query("import_names", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand || '|z' ELSE '*' END AS names FROM part")
def import_names(spark, d):
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("from a.b import (x as "), F.col("p_brand"), F.lit(", z)"))).otherwise("from m import *")
    return table(spark, d, "part").select("p_partkey", F.array_join(imports.import_names(text), "|").alias("names"))


@query("stdlib_flag", "SELECT p_partkey, p_partkey % 3 < 2 AS stdlib FROM part")
def stdlib_flag(spark, d):
    module = F.element_at(F.array(F.lit("os.path"), F.lit("json"), F.lit("numpy.linalg")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", imports.is_stdlib(module).alias("stdlib"))


@query("project_id_hash", "SELECT DISTINCT source, sha256(source)[1:12] AS project FROM documents")
def project_id_hash(spark, d):
    return table(spark, d, "documents").select("source", project_id(F.col("source")).alias("project")).distinct()


@query("diff_summary", """
SELECT p_partkey AS diff_id, 2::BIGINT AS files, (p_size + 1)::BIGINT AS added, 1::BIGINT AS deleted FROM part""")
def diff_summary(spark, d):
    body = F.concat(
        F.lit("diff --git a/x.py b/x.py\nindex 1..2 100644\n--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,3 @@\n-old\n"), F.repeat(F.lit("+new\n"), F.col("p_size")),
        F.lit("diff --git a/y.py b/y.py\nnew file mode 100644\n--- /dev/null\n+++ b/y.py\n@@ -0,0 +1 @@\n+one\n"),
    )
    return diffs.diff_summary(diffs.parse_diff(table(spark, d, "part").select(F.col("p_partkey").alias("diff_id"), body.alias("diff_text"))))
