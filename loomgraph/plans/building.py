"""Queries that read sources, build and update graphs, compare contracts, and read session logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import contracts, diffs, tables
from ..operators import build, incremental, sessions
from ..schema import node_id
from ..sources import files
from . import derived
from .derived import SYMBOLS_SQL, UNIQUE_SQL, table
from .registry import query

# Building: parts are symbols, and each line of an order is a call from its part to the part with the supplier's number.
S_SQL = f"WITH {SYMBOLS_SQL}, s AS (SELECT *, concat_ws(':', type, file, line, name) AS node_id FROM symbols)"
CALLS_SQL = """, c AS (SELECT DISTINCT s.node_id AS caller_id, s.type AS caller_type, s.file AS caller_file, l_linenumber % 2 = 0 AS dotted, q.name AS target FROM lineitem JOIN s ON s.ord = l_partkey JOIN s q ON q.ord = l_suppkey),
near AS (SELECT name, file, arg_min(node_id, ord) AS id, arg_min(type, ord) AS t FROM s GROUP BY 1, 2), far AS (SELECT name, arg_min(node_id, ord) AS id, arg_min(type, ord) AS t FROM s GROUP BY 1),
r AS (SELECT caller_id, caller_type, CASE WHEN NOT dotted AND near.id IS NOT NULL THEN near.id ELSE far.id END AS callee_id, CASE WHEN NOT dotted AND near.id IS NOT NULL THEN near.t ELSE far.t END AS callee_type
  FROM c JOIN far ON target = far.name LEFT JOIN near ON target = near.name AND caller_file = near.file)"""


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    s = derived.symbols(spark, d).withColumn("node_id", node_id(F.col("type"), F.col("file"), F.col("line"), F.col("name")))
    return s.withColumns({"project_id": F.lit("p"), "column": F.lit(0), "end_line": F.lit(None).cast("int")})


def _calls(spark: SparkSession, d: str) -> DataFrame:
    s = _symbols(spark, d)
    lines = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber")
    called = s.select(F.col("ord").alias("l_suppkey"), F.col("name").alias("called"))
    text = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(" obj.inner."), F.col("called"))).otherwise(F.col("called"))
    met = lines.join(s.select(F.col("ord").alias("l_partkey"), "node_id", "file"), "l_partkey").join(called, "l_suppkey")
    return met.select(F.lit("p").alias("project_id"), F.col("node_id").alias("caller_id"), F.col("file").alias("caller_file"), text.alias("call_text"))


@query("build_nodes", S_SQL + """
SELECT 'File:' || file || ':1:' || file AS node_id, 'File' AS label, file AS name, file, 1 AS line, NULL::VARCHAR AS parent FROM (SELECT DISTINCT file FROM s)
UNION ALL (SELECT node_id, CASE type WHEN 'function' THEN 'Function' WHEN 'class' THEN 'Class' ELSE 'Module' END, name, file, line, parent FROM s QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY ord) = 1)""")
def build_nodes(spark, d):
    return build.nodes_of(_symbols(spark, d)).select("node_id", "label", "name", "file", "line", "parent")


@query("resolve_calls", S_SQL + CALLS_SQL + " SELECT caller_id, callee_id, callee_type FROM r")
def resolve_calls(spark, d):
    return build.resolve_calls(_calls(spark, d), _symbols(spark, d)).select("caller_id", "callee_id", "callee_type")


@query("build_edges", S_SQL + CALLS_SQL + """
SELECT 'File:' || file || ':1:' || file AS src_id, node_id AS dst_id, 'DEFINES' AS type FROM s UNION SELECT 'File:' || s.file || ':1:' || s.file, far.id, 'IMPORTS' FROM s JOIN far ON far.name = s.name WHERE s.type = 'import'
UNION SELECT caller_id, callee_id, 'CALLS' FROM r WHERE caller_type = 'function' AND callee_type = 'function'""")
def build_edges(spark, d):
    return build.build(_symbols(spark, d), _calls(spark, d)).edges.select("src_id", "dst_id", "type")


# Updates.
@query("upsert_nodes", f"""
WITH {UNIQUE_SQL}, o AS (SELECT * FROM symbols WHERE ord % 3 <> 0), n AS (SELECT * FROM symbols WHERE ord % 2 = 0)
SELECT coalesce(o.type, n.type) AS label, coalesce(o.name, n.name) AS node_id, coalesce(n.line + 1, o.line) AS line, o.docstring FROM o FULL JOIN n ON o.ord = n.ord""")
def upsert_nodes(spark, d):
    s = derived.unique_symbols(spark, d).select(F.col("type").alias("label"), F.col("name").alias("node_id"), "line", "docstring", "ord")
    new = s.where("ord % 2 = 0").withColumn("line", F.col("line") + 1).withColumn("docstring", F.lit(None).cast("string")).drop("ord")
    return incremental.upsert_nodes(s.where("ord % 3 <> 0").drop("ord"), new)


@query("delete_nodes", """, gone AS (SELECT node_id FROM nodes WHERE line > 40)
SELECT src_id, dst_id FROM calls WHERE src_id NOT IN (SELECT node_id FROM gone) AND dst_id NOT IN (SELECT node_id FROM gone)""", True)
def delete_nodes(spark, d):
    g = derived.graph(spark, d)
    return incremental.delete_nodes(g.nodes, g.edges, g.nodes.where("line > 40"))[1].select("src_id", "dst_id")


@query("modified_by", """
SELECT DISTINCT node_id AS src_id, 'Commit:' || l_orderkey AS dst_id, label AS src_label FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN nodes ON node_id = l_partkey::VARCHAR""", True)
def modified_by(spark, d):
    touched = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("commit_hash"), F.array(F.col("l_partkey").cast("string")).alias("node_ids"))  # a row for each of a commit's lines
    commits = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("commit_hash"))
    return incremental.modified_by(derived.graph(spark, d).nodes, commits, touched).select("src_id", "dst_id", "src_label")


@query("delta_applied", f"""
WITH {UNIQUE_SQL} SELECT file, qualified_name, CASE WHEN ord % 11 = 0 THEN line + 1 ELSE line END AS line, type FROM symbols WHERE ord % 5 <> 0""")
def delta_applied(spark, d):
    s = derived.unique_symbols(spark, d)
    before, after = s.where("ord % 7 <> 0"), s.where("ord % 5 <> 0").withColumn("line", F.when(F.col("ord") % 11 == 0, F.col("line") + 1).otherwise(F.col("line")))
    return incremental.apply_delta(before, incremental.delta(before, after), after).select("file", "qualified_name", "line", "type")


# Changes.
@query("name_status", """
SELECT p_brand || '.py' AS file, CASE p_partkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'A' ELSE 'D' END AS status FROM part WHERE p_partkey % 4 <> 0
UNION ALL SELECT 'old' || p_partkey, 'D' FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT 'new' || p_partkey, 'A' FROM part WHERE p_partkey % 4 = 0""")
def name_status(spark, d):
    k = F.col("p_partkey").cast("string")
    plain = F.concat(F.element_at(F.array(F.lit("M"), F.lit("A"), F.lit("D")), (F.col("p_partkey") % 3 + 1).cast("int")), F.lit("\t"), F.col("p_brand"), F.lit(".py"))
    line = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("R096\told"), k, F.lit("\tnew"), k)).otherwise(plain)
    return diffs.as_changes(diffs.name_status(table(spark, d, "part").select(line.alias("line"))))


@query("changed_files", """
SELECT DISTINCT p_brand || CASE p_partkey % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.TSX' ELSE '.md' END AS path FROM part WHERE p_type <> 'SMALL' AND p_partkey % 3 < 2""")
def changed_files(spark, d):
    end = F.element_at(F.array(F.lit(".py"), F.lit(".TSX"), F.lit(".md")), (F.col("p_partkey") % 3 + 1).cast("int"))
    rows = table(spark, d, "part").select(F.concat("p_brand", end).alias("path"), F.when(F.col("p_type") == "SMALL", "deleted").otherwise("modified").alias("status"))
    return diffs.changed_files(rows)


@query("ignored_paths", r"""
SELECT p_partkey, p_size % 5 = 0 OR p_type = 'LARGE' OR (p_brand = 'Brand#1' AND p_size % 7 = 0) AS ignored FROM part""")
def ignored_paths(spark, d):
    rules = files.ignore_rules("# rules\nbuild/\n\n*.tmp\nBrand#1/docs\n")
    size = F.col("p_size")
    path = F.concat("p_brand", F.when(size % 7 == 0, "/docs/").otherwise("/src/"), F.when(size % 5 == 0, "build/").otherwise(""), F.lit("a"), F.when(F.col("p_type") == "LARGE", ".tmp").otherwise(".py"))
    return table(spark, d, "part").select("p_partkey", files.is_ignored(path, rules).alias("ignored"))


#: Files that a task reads.
FILES_A_TASK = 20_000


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    """Rows of n files over tasks of bounded work: reading a file costs far more than sending it."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // FILES_A_TASK)))


# Sources: a file for each part, of three pieces; which of its three forms a piece has goes by the part's size, key and type, and its names hold the part's key, name and type.
def _sources(spark: SparkSession, d: str) -> DataFrame:
    """(project_id, file, language, content) of all languages, a file for each part and language."""
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_size")
    part = _dealt(part, part.count() * len(PIECES))  # the texts are made by the tasks that read them
    key, name, kind = F.col("p_partkey").cast("string"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lower("p_type")
    chosen = [F.col("p_size") % 3, F.col("p_partkey") % 3, F.length("p_type") % 3]

    def text(language: str):
        forms = [F.element_at(F.array(*[F.lit(text) for text, _, _ in piece]), (c + 1).cast("int")) for c, piece in zip(chosen, PIECES[language], strict=True)]
        return F.replace(F.replace(F.replace(F.concat(*forms), F.lit("§"), key), F.lit("¤"), name), F.lit("¥"), kind)

    each = F.explode(F.array(*[F.struct(F.lit(x).alias("language"), text(x).alias("text")) for x in PIECES])).alias("s")
    rows = part.select(key.alias("k"), each)
    return rows.select(F.lit("p").alias("project_id"), F.concat(F.lit("d/"), "k", F.lit("."), F.element_at(F.create_map(*[F.lit(x) for kv in ENDS.items() for x in kv]), F.col("s.language"))).alias("file"), F.col("s.language").alias("language"), F.col("s.text").cast("binary").alias("content"))


def _value(x: str | None) -> str:
    if x is None:
        return "NULL"
    out = x.replace("'", "''")
    for mark, column in (("§", "p_partkey"), ("¤", "replace(p_name, ' ', '_')"), ("¥", "lower(p_type)")):
        out = out.replace(mark, f"' || {column} || '")
    return f"'{out}'"


#: Extensions of the made files.
ENDS = {"python": "py", "typescript": "tsx", "go": "go", "rust": "rs", "java": "java", "csharp": "cs"}
CHOSEN = ("p_size % 3", "p_partkey % 3", "length(p_type) % 3")


def _expected(language: str, calls: bool) -> str:
    """SQL of the rows that the pieces' forms stand for, each under its own condition."""
    rows, line = [], 0
    for chosen, piece in zip(CHOSEN, PIECES[language], strict=True):
        sizes = {text.count("\n") for text, _, _ in piece}
        assert len(sizes) == 1, (language, sizes)
        for k, (_, symbols, called) in enumerate(piece):
            if calls:
                at = {name: line + own for _, name, own, _, _ in symbols}
                rows += [f"SELECT 'function:d/' || p_partkey || '.{ENDS[language]}:{at[caller]}:' || {_value(caller)} AS caller_id, {_value(name)} AS call_text FROM part WHERE {chosen} = {k}" for caller, name in called]
            else:
                rows += [
                    f"SELECT 'd/' || p_partkey || '.{ENDS[language]}' AS file, '{kind}' AS type, {_value(name)} AS name, {line + own} AS line, {_value(parent)} AS parent, {_value(doc)} AS docstring FROM part WHERE {chosen} = {k}"
                    for kind, name, own, parent, doc in symbols
                ]
        line += sizes.pop()
    return " UNION ALL ".join(rows)


#: Of each language three pieces of three forms: text, symbols (type, name, line of the piece, parent, docstring) and calls (caller, called). The forms of a piece have equally many lines.
PIECES = {
    "python": [
        [
            ("import os\nfrom .¥ import a as b, c\nX = 1\n", [("import", "os", 1, None, None), ("import", "d.¥.b", 2, None, None), ("import", "d.¥.c", 2, None, None)], []),
            ("try:\n    import ¤ as q\nexcept ImportError: pass\n", [("import", "q", 2, None, None)], []),
            ("'''import no'''\nfrom ¥.x import *\n# def no(): pass\n", [("import", "¥.x.*", 2, None, None)], []),
        ],
        [
            ("class C§(B):\n    \"Doc ¤.\"\n    @p(z())\n    def m§(self): return self.f(g§(1))\n    x = lambda: no()\n", [("class", "C§", 1, None, "Doc ¤."), ("function", "m§", 4, "C§", None)], [("m§", "self.f"), ("m§", "g§")]),
            ("async def f§(a, *b):\n    def inner(): return deep()\n    class L: pass\n    return f\"{t§(a)}\"\n\n", [("function", "f§", 1, None, None), ("function", "inner", 2, None, None), ("class", "L", 3, None, None)], [("f§", "deep"), ("f§", "t§"), ("inner", "deep")]),
            ("class C§:\n    if X:\n        def ¤(self):\n            'does'\n            [h(i) for i in k()]\n", [("class", "C§", 1, None, None), ("function", "¤", 3, "C§", "does")], [("¤", "h"), ("¤", "k")]),
        ],
        [
            ("def last():\n    return '''def no(): x()'''\n", [("function", "last", 1, None, None)], []),
            ("with open(p) as f:\n    def last(): f.read().strip()\n", [("function", "last", 2, None, None)], [("last", "f.read"), ("last", "f.read().strip")]),
            ("for i in r():\n    class Last§: y = 1\n", [("class", "Last§", 2, None, None)], []),
        ],
    ],
    "typescript": [
        [
            ("import D, { a as b } from './¥';\nconst s = `function no() { ${x(`}`)} class N {`;\ndeclare const z: any;\n", [("import", "d/¥.D", 1, None, None), ("import", "d/¥.b", 1, None, None)], []),
            ("import * as n from '¤';\nimport type {\n  T } from \"../¥.ts\";\n", [("import", "¤.n", 1, None, None), ("import", "¥.T", 2, None, None)], []),
            ("const r = /[/'{]+\\/class X {/g; import './side';\n/** Type. */\nexport type U§ = { a: string } | `k${string}`;\n", [("import", "d/side", 1, None, None), ("type", "U§", 3, None, "* Type.")], []),
        ],
        [
            ("@Comp({ f() {} })\nexport class C§<T extends { a: string }> extends B<T> {\n  private x = () => { no(); };\n  m§<U>(a: U): { k: number } { return this.go<U>(a); }\n}\n", [("class", "C§", 2, None, None), ("function", "m§", 4, "C§", None)], [("m§", "this.go")]),
            ("interface I§<T> { f(): void; }\nnamespace N { export async function ¤(x): x is T {\n  return h(`${j§(x)}`);\n} }\nfunction over(a): void;\n", [("interface", "I§", 1, None, None), ("function", "¤", 2, None, None)], [("¤", "h"), ("¤", "j§")]),
            ("abstract class A§ {\n  abstract q(): void; n(): void;\n  static async *gen() { yield* z§(); new W(v()); }\n  get ¥() { return super.p(); }\n}\n", [("class", "A§", 1, None, None), ("function", "gen", 3, "A§", None), ("function", "¥", 4, "A§", None)], [("gen", "z§"), ("gen", "v"), ("¥", "super.p")]),
        ],
        [
            ("export function V§() { return <div title='{'>Don't {list.map(i => <Row a={f(i)} />)}</div>; }\n", [("function", "V§", 1, None, None)], [("V§", "list.map"), ("V§", "f")]),
            ("function o§() { function inner() { deep(); } return a / b / inner(); }\n", [("function", "o§", 1, None, None), ("function", "inner", 1, None, None)], [("o§", "deep"), ("o§", "inner"), ("inner", "deep")]),
            ("const e = function named() { no(); }, g = <T,>(x: T) => x;\n", [], []),
        ],
    ],
    "go": [
        [
            ("package p\nimport \"fmt\"\nvar s = `func no() {`\n", [("import", "fmt", 2, None, None)], []),
            ("package p\nimport (n \"net/¥\"\n\t_ \"a/b/¤/\")\n", [("import", "¥", 2, None, None), ("import", "¤", 3, None, None)], []),
            ("package p\n// T§ is one.\ntype T§[K any] struct { f func() struct{ b int } }\n", [("class", "T§", 3, None, "T§ is one.")], []),
        ],
        [
            ("type (\n\tA§ struct{ x int }\n\tB interface{ M() }\n\tC func(a struct{}) int\n)\n", [("class", "A§", 2, None, None), ("interface", "B", 3, None, None), ("type", "C", 4, None, None)], []),
            ("func (s *S§[K, V]) M(a K) (err error) {\n\tgo s.run(a)\n\tdefer mu.Unlock()\n\treturn g§[K](func() { z() })\n}\n", [("function", "M", 1, "S§", None)], [("M", "s.run"), ("M", "mu.Unlock"), ("M", "g§"), ("M", "z")]),
            ("/* ¤ */\nfunc f§(\n\ta int,\n) map[string]func() int { b := []byte(s); return h(b, '{', \"}\") }\n\n", [("function", "f§", 2, None, "/* ¤ */")], [("f§", "h")]),
        ],
        [
            ("func asm(x int) int\n", [("function", "asm", 1, None, None)], []),
            ("func last() interface{ M() } { return k() }\n", [("function", "last", 1, None, None)], [("last", "k")]),
            ("var f = func() { no() }; type ¤ [5]int\n", [("type", "¤", 1, None, None)], []),
        ],
    ],
    "rust": [
        [
            ("use a::{B, c::D as ¤, f::*};\n#![allow(x)]\n/* fn no() /* {} */ */\n", [("import", "B", 1, None, None), ("import", "¤", 1, None, None), ("import", "f", 1, None, None)], []),
            ("/// One\n#[derive(Debug)]\npub struct P§<T> where T: X { a: fn(i32) -> T }\n", [("class", "P§", 3, None, "One")], []),
            ("macro_rules! m { () => { fn no() {} } }\npub(crate) type A§<'a> = &'a str;\nconst C: fn() = || { no(); };\n", [("type", "A§", 2, None, None)], []),
        ],
        [
            ("impl<T: Fn() -> i32> fmt::Display for S§<T> where T: Clone {\n    const K: char = '{';\n    /// ¥\n    pub async fn m<'a>(&'a self) -> R<(), E> { self.go()?; Self::st(f(1)) }\n}\n", [("function", "m", 4, "S§<T>", "¥")], [("m", "self.go"), ("m", "Self.st"), ("m", "f")]),
            ("mod ¤ {\n    use super::X;\n    #[test]\n    fn t§() { assert_eq!(no(1), 2); check::<u8>(b'x', r#\"fn \"no\"() {\"#); }\n}\n", [("import", "X", 2, None, None), ("function", "t§", 4, "¤", None)], [("t§", "check")]),
            ("trait T§: A { fn req(&self); fn def(&self) { no(); } }\nfn f§() {\n    if let Some(x) = g() { x.h() }\n    match k() { Ok(v) => l(v), Err(e) => {} }\n}\n", [("interface", "T§", 1, None, None), ("function", "f§", 2, None, None)], [("f§", "g"), ("f§", "x.h"), ("f§", "k"), ("f§", "l")]),
        ],
        [
            ("fn last() { fn nested() { a() } nested() }\n", [("function", "last", 1, None, None)], [("last", "a"), ("last", "nested")]),
            ("enum E§ { A { x: i32 }, B(i32) } extern \"C\" { fn no(); }\n", [("class", "E§", 1, None, None)], []),
            ("pub extern \"C\" fn ¤() -> impl Iterator<Item = u8> + '_ { q() }\n", [("function", "¤", 1, None, None)], [("¤", "q")]),
        ],
    ],
    "java": [
        [
            ("package p;\nimport static org.¥.Y.z;\nimport java.io.*;\n", [("import", "z", 2, None, None), ("import", "io", 3, None, None)], []),
            ("import java.util.¤;\n/** An\n * interface. */ interface I§<T> { double area(); default int n() { return k().trim(); } }\n", [("import", "¤", 1, None, None), ("interface", "I§", 3, None, "An interface."), ("function", "area", 3, "I§", None), ("function", "n", 3, "I§", None)], [("n", "k"), ("n", "trim")]),
            ("enum E§ { RED(1) { int no() { return no(); } }, BLUE;\n  E§(int x) { set(x); }\n}\n", [("class", "E§", 1, None, None), ("function", "E§", 2, "E§", None)], [("E§", "set")]),
        ],
        [
            ("/** Doc ¤. */\n@Entity(name = \"t{\")\npublic class C§<T extends B & D> extends F<T> {\n  @Override <R> List<R> m§(Function<T, R> f, int... n) throws X { return f.apply(new Q(w()), \"}\"); }\n}\n", [("class", "C§", 2, None, "Doc ¤."), ("function", "m§", 4, "C§", None)], [("m§", "apply"), ("m§", "w")]),
            ("class C§ {\n  Map<String, List<int[]>> v = new HashMap<>() {{ put(no()); }};\n  static { no(); }\n  String ¥() { return \"\"\"\n    class No { \"\"\" + go(); } }\n", [("class", "C§", 1, None, None), ("function", "¥", 4, "C§", None)], [("¥", "go")]),
            ("class O§ {\n  // void no() {}\n  class In { In() { a§(); } static class Deep {\n    void d() { O§.this.b(); } } }\n}\n", [("class", "O§", 1, None, None), ("class", "In", 3, "O§", None), ("function", "In", 3, "In", None), ("class", "Deep", 3, "In", None), ("function", "d", 4, "Deep", None)], [("In", "a§"), ("d", "b")]),
        ],
        [
            ("record R§(int x) { static R§ of() { return make(); } }\n", [("class", "R§", 1, None, None), ("function", "of", 1, "R§", None)], [("of", "make")]),
            ("@interface No { String value() default \"x\"; } class Z§ {}\n", [("class", "Z§", 1, None, None)], []),
            ("abstract class Z§ { Runnable r = () -> { no(); }; abstract <T> T get(Class<T> c); char c = '{'; }\n", [("class", "Z§", 1, None, None), ("function", "get", 1, "Z§", None)], []),
        ],
    ],
    "csharp": [
        [
            ("using System;\nusing static A.¥;\nusing J = N.¤;\n", [("import", "System", 1, None, None), ("import", "¥", 2, None, None), ("import", "¤", 3, None, None)], []),
            ("/// <summary>The <c>¤</c>.</summary>\n/// More.\npublic record struct R§(int A) { public int Sum() => Add(A); }\n", [("class", "R§", 3, None, "The ¤. More."), ("function", "Sum", 3, "R§", None)], [("Sum", "Add")]),
            ("#if DEBUG {\nenum E§ : byte { A = 1 }\n#endif }\n", [("class", "E§", 2, None, None)], []),
        ],
        [
            ("namespace N.¥ {\n  [Attr(\"}\")] public sealed class C§<T> : B<T> where T : class, new() {\n    public C§(int x) : base(no(x)) { Init(); }\n    public int P { get; set; } = no(); event Action E;\n    async Task<(int, T)> M<U>(U u) where U : struct { await L§(u); } } }\n", [("class", "C§", 2, None, None), ("function", "C§", 3, "C§", None), ("function", "M", 5, "C§", None)], [("C§", "Init"), ("M", "L§")]),
            ("class C§ {\n  string v = @\"C:\\ \"\"class No { }\"\" \";\n  char c = '\"';\n  void ¤() { var s = $\"a{G($\"b{H§()}\")} {{no()}}\"; }\n}\n", [("class", "C§", 1, None, None), ("function", "¤", 4, "C§", None)], [("¤", "G"), ("¤", "H§")]),
            ("interface I§<in T> {\n  void M(T t);\n  static int D() { int Local() => q(); return new X(z()).Y<int>(); }\n  int this[int i] { get; }\n}\n", [("interface", "I§", 1, None, None), ("function", "M", 2, "I§", None), ("function", "D", 3, "I§", None)], [("D", "q"), ("D", "z"), ("D", "Y")]),
        ],
        [
            ("struct S§ { public static S§ operator +(S§ a, S§ b) => no(a); ~S§() { no(); } }\n", [("class", "S§", 1, None, None)], []),
            ("class Z§ { (int a, int b) Pair() => (One(), 2); void I.Ex() { a?.B(); } }\n", [("class", "Z§", 1, None, None), ("function", "Pair", 1, "Z§", None), ("function", "Ex", 1, "Z§", None)], [("Pair", "One"), ("Ex", "a.B")]),
            ("delegate void No(int x); class Z§ { Func<int, int> g = x => { return no(x); }; }\n", [("class", "Z§", 1, None, None)], []),
        ],
    ],
}


def _extracted(spark: SparkSession, d: str, language: str) -> DataFrame:
    return files.extract(_sources(spark, d).where(F.col("language") == language))


def _extraction(language: str) -> None:
    query(f"symbols_of_{language}", _expected(language, False))(lambda spark, d: files.symbols_of(_extracted(spark, d, language)).select("file", "type", "name", "line", "parent", "docstring"))
    query(f"calls_of_{language}", _expected(language, True))(lambda spark, d: files.calls_of(_extracted(spark, d, language)).select("caller_id", "call_text"))


for _language in PIECES:
    _extraction(_language)


# The same from SQL: table functions in LATERAL joins, and over a table whole.
ALL_SYMBOLS = " UNION ALL ".join(_expected(x, False) for x in PIECES)


def _sql(spark: SparkSession, d: str, text: str) -> DataFrame:
    tables.register(spark)
    return spark.sql(text, sources=_sources(spark, d))


@query("sql_symbols", ALL_SYMBOLS)
def sql_symbols(spark, d):
    return _sql(spark, d, "SELECT s.file, x.type, x.name, x.line, x.parent, x.docstring FROM {sources} s, LATERAL extract_symbols(s.file, s.content) x")


@query("sql_symbols_of_table", f"SELECT file, type, count(*) AS n, sum(line)::BIGINT AS lines, count(parent) AS members FROM ({ALL_SYMBOLS}) GROUP BY ALL")
def sql_symbols_of_table(spark, d):
    return _sql(spark, d, "SELECT file, type, count(*) AS n, sum(line) AS lines, count(parent) AS members FROM symbols_of_files(TABLE(SELECT file, content FROM {sources})) WHERE error IS NULL GROUP BY ALL")


@query("sql_calls", " UNION ALL ".join(_expected(x, True) for x in PIECES))
def sql_calls(spark, d):
    return _sql(spark, d, "SELECT concat_ws(':', x.caller_type, s.file, x.caller_line, x.caller_name) AS caller_id, x.call_text FROM {sources} s, LATERAL extract_calls(s.file, s.content) x")


# Contracts.
CONTRACT_SOURCE = '''class C:
    def m(self, a: int, b: str = 'x') -> Optional[@]:
        """Does it.

        Args:
            a: must be above @

        Returns:
            what @ is

        Raises:
            ValueError: if not
        """
        return b


def f@(x, *, y: int):
    pass
'''


@query("contracts_of_sources", """
SELECT p_partkey::VARCHAR AS file, 'C.m' AS qualified_name, 'self,a,b' AS names, 'b' AS optional, 'Optional[' || p_type || ']' AS return_type, 'ValueError' AS raises, 'a: must be above ' || p_type AS preconditions, 'what ' || p_type || ' is' AS postconditions FROM part
UNION ALL SELECT p_partkey::VARCHAR, 'f' || p_type, 'x,y', 'y', NULL, '', '', '' FROM part""")
def contracts_of_sources(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("file"), F.regexp_replace(F.lit(CONTRACT_SOURCE), "@", F.col("p_type")).alias("source"))
    names = lambda ps: F.array_join(F.transform(ps, lambda p: p["name"]), ",")
    return contracts.extract_contracts(rows).select(
        "file", "qualified_name", names(F.col("parameters")).alias("names"), names(F.filter("parameters", lambda p: p["is_optional"])).alias("optional"), "return_type",
        *[F.array_join(c, ",").alias(c) for c in ("raises", "preconditions", "postconditions")],
    )


@query("sql_contracts", """
SELECT p_partkey::VARCHAR AS file, 'C.m' AS qualified_name, 3::BIGINT AS n_parameters, 'b=\'\'x\'\'' AS defaults, 'Optional[' || p_type || ']' AS return_type, ['ValueError'] AS raises FROM part
UNION ALL SELECT p_partkey::VARCHAR, 'f' || p_type, 2::BIGINT, '', NULL, []::VARCHAR[] FROM part""".replace("\\'", "'"))
def sql_contracts(spark, d):
    tables.register(spark)
    part = table(spark, d, "part")
    part = _dealt(part.select("p_partkey", "p_type"), part.count())  # a small table may be one partition
    rows = part.select(F.col("p_partkey").cast("string").alias("file"), F.regexp_replace(F.lit(CONTRACT_SOURCE), "@", F.col("p_type")).alias("source"))
    return spark.sql("""
        SELECT s.file, x.qualified_name, cast(size(x.parameters) AS bigint) AS n_parameters, array_join(transform(filter(x.parameters, p -> p.default_value IS NOT NULL), p -> p.name || '=' || p.default_value), ',') AS defaults, x.return_type, x.raises
        FROM {rows} s, LATERAL extract_contracts(s.source) x""", rows=rows)


@query("contract_changes", """
, b AS (SELECT p_partkey AS k, list_filter([CASE WHEN p_partkey % 5 = 0 THEN 'PARAMETER_REMOVED:HIGH:b' END, CASE WHEN p_partkey % 3 = 0 THEN 'PARAMETER_REQUIRED_NOW:HIGH:c' END, CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 7 = 0 THEN 'PARAMETER_TYPE_CHANGED:HIGH:b' END,
  CASE WHEN p_partkey % 8 = 0 THEN 'RETURN_TYPE_NARROWED:MEDIUM:return' END, CASE WHEN p_partkey % 4 = 0 THEN 'EXCEPTION_ADDED:LOW:E2' END, CASE WHEN p_partkey % 9 = 0 THEN 'PRECONDITION_ADDED:MEDIUM:preconditions' END], lambda x: x IS NOT NULL) AS x FROM part)
SELECT k AS qualified_name, array_to_string(x, ';') AS breaking, concat_ws(';', CASE WHEN k % 4 <> 0 AND k % 6 = 1 THEN 'Removed exceptions: E1' END, CASE WHEN k % 11 = 0 AND k % 3 <> 0 THEN 'Added optional parameters: d' END) AS notes,
  len(x) = 0 AS is_compatible, round(greatest(0.0, 1 - 0.3 * len(x)), 6)::DOUBLE AS score FROM b""".replace(", b AS", "WITH b AS", 1))
def contract_changes(spark, d):
    k = F.col("p_partkey")
    parameter = lambda name, hint, optional=False: F.struct(F.lit(name).alias("name"), F.lit(hint).alias("type_hint"), F.lit(optional).alias("is_optional"), F.lit(None).cast("string").alias("default_value"))
    a, b, b2, c, e = parameter("a", "int"), parameter("b", "Union[int, str]", True), parameter("b", "int", True), parameter("c", "int"), parameter("d", "str", True)
    texts = lambda *xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    rows = table(spark, d, "part").select(k.alias("qualified_name"))
    k = F.col("qualified_name")
    some = lambda cond, x: F.when(cond, F.array(x)).otherwise(F.slice(F.array(x), 1, 0))
    old = rows.select("qualified_name", F.array(a, b).alias("parameters"), F.lit("Any").alias("return_type"), texts("E1").alias("raises"), texts("x must").alias("preconditions"))
    new = rows.select(
        "qualified_name", F.concat(F.array(a), some(k % 5 != 0, F.when(k % 7 == 0, b2).otherwise(b)), some(k % 3 == 0, c), some(k % 11 == 0, e)).alias("parameters"),
        F.when(k % 8 == 0, "int").otherwise("Any").alias("return_type"), F.when(k % 4 == 0, texts("E1", "E2")).when(k % 6 == 1, texts()).otherwise(texts("E1")).alias("raises"),
        F.when(k % 9 == 0, texts("x must", "y must")).otherwise(texts("x must")).alias("preconditions"),
    )
    line = lambda x: F.concat_ws(":", x["type"], x["severity"], F.array_join(x["elements"], ","))
    return contracts.compare(old, new).select("qualified_name", F.array_join(F.transform("breaking", line), ";").alias("breaking"), F.array_join("notes", ";").alias("notes"), "is_compatible", F.round("score", 6).alias("score"))


# Session logs: conversations, where each assistant turn uses a tool and each user turn has the result of the use before.
def _logs(spark: SparkSession, d: str) -> DataFrame:
    turn, role = F.col("turn"), F.col("role")
    text = lambda x: F.lit(x).cast("string")
    block = lambda **f: F.struct(*[f.get(n, F.lit(None)).cast(t).alias(n) for n, t in (("type", "string"), ("id", "string"), ("name", "string"), ("input", "map<string,string>"), ("tool_use_id", "string"), ("content", "string"), ("is_error", "boolean"), ("text", "string"))])
    key = lambda t: F.concat(F.lit("t"), t.cast("string"))
    use = block(type=text("tool_use"), id=key(turn), name=F.when(turn % 3 == 0, "Read").otherwise("Bash"), input=F.create_map(F.lit("command"), F.lit("tool list")))
    result = block(type=text("tool_result"), tool_use_id=key(turn - 1), content=F.when(turn % 4 == 0, "Exit code 2").when(turn % 5 == 0, "Exit code 0").otherwise("fine"))
    said = block(type=text("text"), text=F.concat(F.lit("**Task:**  go to "), key(turn), F.lit(" ")))
    content = F.when(role == "assistant", F.array(use)).otherwise(F.array(said, result))
    return table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("session"), turn.alias("seq"), role.alias("type"), content.alias("content"))


@query("session_timeline", """
WITH t AS (SELECT *, sum((role = 'assistant')::INT) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS n FROM conversations), r AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE role <> 'assistant' AND role = 'user')
SELECT t.conv_id::VARCHAR AS session, n AS turn, t.turn AS seq, CASE WHEN t.turn % 3 = 0 THEN 'Read' ELSE 'Bash' END AS name,
  CASE WHEN r.turn IS NULL THEN '(no result)' WHEN r.turn % 4 = 0 THEN 'Exit code 2' WHEN r.turn % 5 = 0 THEN 'Exit code 0' ELSE 'fine' END AS result, r.turn IS NOT NULL AND r.turn % 4 = 0 AS is_error
FROM t LEFT JOIN r ON r.conv_id = t.conv_id AND r.turn = t.turn + 1 WHERE role = 'assistant'""")
def session_timeline(spark, d):
    return sessions.timeline(_logs(spark, d)).select("session", F.col("turn").cast("long").alias("turn"), "seq", "name", "result", "is_error")


@query("session_tasks", """
SELECT conv_id::VARCHAR AS session, coalesce('go to t' || min(turn) FILTER (role = 'user'), '?') AS task FROM conversations GROUP BY conv_id""")
def session_tasks(spark, d):
    return sessions.task_text(_logs(spark, d))


@query("session_prompts", """
SELECT conv_id::VARCHAR AS session, '**Task:**  go to t' || min(turn) || ' ' AS prompt FROM conversations WHERE role <> 'assistant' GROUP BY conv_id""")
def session_prompts(spark, d):
    return sessions.prompt_with(_logs(spark, d), "**Task:**")
