"""Extraction, graph building, the store, the watcher, contracts, diffs, imports and session logs."""

import json
import time

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import contracts, diffs, imports
from loomgraph.operators import build, incremental, metrics, sessions
from loomgraph.operators.index import SymbolIndex
from loomgraph.sources import files
from loomgraph.sources.files import extract_source
from loomgraph.schema import PropertyGraph
from loomgraph.sources.store import GraphStore
from loomgraph.streaming import watch


def names(language, source, file="a/b/m.x"):
    return [(s["type"], s["name"], s["parent"]) for s in extract_source(language, file, source.encode())[0]]


def test_python():
    source = '"""m"""\nimport os, json as j\nfrom ..a import b as c\nfrom x import *\n\n@d\nasync def f():\n    """Doc."""\n    def inner(): pass\n    return g(a.b(1))\n\nclass K(B):\n    "kd"\n    @property\n    def m(self): return self.z()\n    if True:\n        def n(self): pass\n'
    symbols, calls = extract_source("python", "p/q/m.py", source.encode())
    assert [(s["type"], s["name"], s["parent"]) for s in symbols] == [
        ("import", "os", None), ("import", "j", None), ("import", "p.a.c", None), ("import", "x.*", None), ("function", "f", None), ("function", "inner", None), ("class", "K", None), ("function", "m", "K"), ("function", "n", "K"),
    ]
    assert [s["docstring"] for s in symbols if s["name"] in "fK"] == ["Doc.", "kd"]
    assert {(c["caller_name"], c["call_text"]) for c in calls} == {("f", "g"), ("f", "a.b"), ("m", "self.z")}
    assert names("python", "") == [] and names("python", "def é(): pass") == [("function", "é", None)]


@pytest.mark.parametrize("language, source, want", [
    ("typescript", "import R, { a as b } from './u';\n/** Doc */\nexport async function f(x: number) { return g(x); }\nexport class C { constructor(p: string) {} run(): void { this.go(); } }\ninterface I { x: number }\ntype T = string;\n",
     [("import", "a/b/u.R", None), ("import", "a/b/u.b", None), ("function", "f", None), ("class", "C", None), ("function", "constructor", "C"), ("function", "run", "C"), ("interface", "I", None), ("type", "T", None)]),
    ("go", 'package m\nimport (\n  "fmt"\n  s "net/http"\n)\ntype P struct { X int }\ntype S interface { A() }\ntype N int\nfunc F() { fmt.Println("}") }\nfunc (p *P) M() {}\n',
     [("import", "fmt", None), ("import", "http", None), ("class", "P", None), ("interface", "S", None), ("type", "N", None), ("function", "F", None), ("function", "M", "P")]),
    ("rust", "use a::{B, c::D as E};\npub struct P { x: i32 }\nenum C { R }\ntrait T { fn a(&self); }\nimpl P { pub fn new() -> Self { P { x: 1 } } }\nfn main() { fn inner() {} inner() }\n",
     [("import", "B", None), ("import", "E", None), ("class", "P", None), ("class", "C", None), ("interface", "T", None), ("function", "new", "P"), ("function", "main", None)]),
    ("java", "import java.util.List;\npublic class A {\n  private int n = f(1);\n  public A() { }\n  @Override\n  public <T> List<T> get(int a, String b) throws E { if (a > 1) { x(); } return y.z(a); }\n  interface I { void q(); }\n}\n",
     [("import", "List", None), ("class", "A", None), ("function", "A", "A"), ("function", "get", "A"), ("interface", "I", "A"), ("function", "q", "I")]),
    ("csharp", "using System.Text;\nnamespace N {\n  public class A : B {\n    public A(int x) : base(x) { Init(); }\n    public async Task<int> Go(int a) { return await S.Run(a); }\n    public int P { get; set; }\n  }\n  public enum E { X }\n  public record R(int X);\n}\n",
     [("import", "Text", None), ("class", "A", None), ("function", "A", "A"), ("function", "Go", "A"), ("class", "E", None), ("class", "R", None)]),
])
def test_languages_with_braces(language, source, want):
    assert names(language, source) == want


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    (root / "pkg").mkdir()
    (root / "node_modules").mkdir()
    (root / "pkg/util.py").write_text("def helper(x):\n    return x\n\ndef other():\n    return helper(1)\n")
    (root / "pkg/main.py").write_text("from pkg.util import helper\n\nclass App:\n    def run(self):\n        return helper(2) + missing()\n\n    def stop(self):\n        return self.run()\n")
    (root / "pkg/bad.py").write_text("def broken(:\n")
    (root / "node_modules/x.js").write_text("function skip() {}")
    (root / "pkg/gen_a.ts").write_text("function gen() {}")
    return root


def test_build_and_store(spark, repo, tmp_path):
    found = files.discover(spark, f"file://{repo}", "# comment\ngen_*\n", "proj")
    assert sorted(r.file for r in found.select("file").collect()) == ["pkg/bad.py", "pkg/main.py", "pkg/util.py"]
    rows = files.extract(found).cache()
    assert [r.file for r in rows.where("kind = 'error'").collect()] == ["pkg/bad.py"]
    symbols, calls = files.symbols_of(rows), files.calls_of(rows)
    g = build.build(symbols, calls)
    edges = {(r.src_id.split(":")[-1], r.dst_id.split(":")[-1], r.type) for r in g.edges.collect()}
    assert ("run", "helper", "CALLS") in edges and ("other", "helper", "CALLS") in edges and ("stop", "run", "CALLS") in edges
    assert ("pkg/util.py", "helper", "DEFINES") in edges and not any(t == "missing" for _, t, _ in edges)
    assert {r["name"] for r in metrics.hot_callees(g).collect()} == {"helper", "run"}
    store = GraphStore(spark, f"file://{tmp_path}/store", "proj")
    store.replace(g)
    assert store.graph().nodes.count() == g.nodes.count() and store.graph().edges.count() == g.edges.count()
    other = GraphStore(spark, store.root, "else")
    assert other.graph().nodes.count() == 0
    other.replace(PropertyGraph(g.nodes.withColumn("project_id", F.lit("else")), g.edges.withColumn("project_id", F.lit("else"))))
    before = store.manifest()["nodes@proj"]
    other.delete(other.read("nodes").where("label = 'File'").select("node_id"))
    assert store.manifest()["nodes@proj"] == before and store.read("nodes").count() == g.nodes.count() and GraphStore(spark, store.root).read("nodes").count() > g.nodes.count()
    helper = store.read("nodes").where("name = 'helper'").where("label = 'Function'")
    store.upsert(helper.withColumn("docstring", F.lit("new")).withColumn("props", F.create_map(F.lit("k"), F.lit("v"))))
    now = store.read("nodes").where("name = 'helper' and label = 'Function'").collect()
    assert len(now) == 1 and now[0].docstring == "new" and now[0].props == {"k": "v"}
    commit = spark.createDataFrame([("abc", "a", "m", "me", None, "2024-01-01", "main", 1)], "commit_hash string, short_hash string, message string, author string, ts timestamp, ts_raw string, branch string, files_changed int")
    store.record_commit(commit, spark.createDataFrame([("abc", [now[0].node_id, "none"])], "commit_hash string, node_ids array<string>"))
    assert store.read("edges").where("type = 'MODIFIED_BY'").count() == 1
    store.delete(helper.select("node_id"))
    assert store.read("nodes").where("name = 'helper' and label = 'Function'").count() == 0
    assert store.read("edges").where(F.col("dst_id") == now[0].node_id).count() == 0
    store.clear()
    assert store.read("nodes").count() == 0 and other.read("nodes").count() > 0
    with pytest.raises(ValueError):
        GraphStore(spark, store.root).clear()


def test_watch(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("def a(): pass\ndef b(): pass\n")
    seen = []
    query = watch.watch(spark, f"file://{tmp_path}/src", f"file://{tmp_path}/cp", lambda s, f, n: seen.append((sorted(r["name"] for r in s.collect()), f)), every=None)
    query.awaitTermination(60)
    assert seen == [(["a", "b"], ["a.py"])]


def test_changes_wait_for_a_quiet_tree(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "a.py").write_text("def a(): pass\n")
    (tmp_path / "b.py").write_text("def b(): pass\n")
    now, seen = [0.0], []
    tree = watch.Debounced(spark, f"file://{tmp_path}", lambda s, f, n: seen.append((sorted((r["file"], r["name"]) for r in s.collect()), f, n)), debounce=2, clock=lambda: now[0])
    assert tree.tick() == [] and not seen
    (tmp_path / "a.py").write_text("def a(): pass\ndef more(): pass\n")
    (tmp_path / "node_modules" / "x.py").write_text("def x(): pass\n")
    assert tree.tick() == []
    now[0] = 1.5
    (tmp_path / "c.py").write_text("def c(): pass\n")
    (tmp_path / "b.py").unlink()
    assert tree.tick() == []
    now[0] = 3
    assert tree.tick() == []  # 3 s after the first change, 1.5 after the last
    now[0] = 4
    assert tree.tick() == ["a.py", "b.py", "c.py"]
    assert seen == [([("a.py", "a"), ("a.py", "more"), ("c.py", "c")], ["a.py", "b.py", "c.py"], 0)]
    now[0] = 9
    assert tree.tick() == [] and len(seen) == 1


def test_watching_changes(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("def a(): pass\n")
    seen = []
    query = watch.watch_changes(spark, f"file://{tmp_path}/src", f"file://{tmp_path}/cp", lambda s, f, n: seen.append((sorted(r["name"] for r in s.collect()), f)), debounce=0.5)
    try:
        (tmp_path / "src/a.py").write_text("def a(): pass\ndef b(): pass\n")
        until = time.monotonic() + 60
        while not seen and time.monotonic() < until:
            time.sleep(0.2)
    finally:
        query.stop()
    assert seen == [(["a", "b"], ["a.py"])]


def test_windows_of_events(spark, sf_dir):
    rows = watch.windowed_totals(spark.read.parquet(f"{sf_dir}/events.parquet")).agg(F.sum("n")).first()[0]
    assert rows == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_index(spark):
    rows = [(0, "add", "function", "t.py", 5, "Calc"), (1, "sub", "function", "t.py", 9, "Calc"), (2, "Calc", "class", "t.py", 1, None), (3, "add", "function", "u.py", 1, None), (4, "os", "import", "t.py", 1, None)]
    index = SymbolIndex(spark.createDataFrame(rows, "ord long, name string, type string, file string, line int, parent string"))
    assert [r.file for r in index.get_by_name("add").collect()] == ["t.py", "u.py"]
    assert index.find("add", "u.py").first().file == "u.py" and index.find("add", "nope").first().file == "t.py"
    assert index.get_by_qualified_name("Calc.sub").first().ord == 1
    assert [r["name"] for r in index.methods_of("Calc").collect()] == ["add", "sub"]
    assert index.summary().first().asDict() == {"symbols": 5, "files": 2, "names": 4}
    less, there = index.remove("function:t.py:5:add")
    assert there and less.summary().first().symbols == 4 and index.remove("x")[1] is False
    assert less.add_all(spark.createDataFrame([(0, "new", "function", "n.py", 1, None)], "ord long, name string, type string, file string, line int, parent string")).summary().first().symbols == 5


def test_delta(spark):
    schema = "ord long, name string, qualified_name string, type string, file string, line int"
    before = spark.createDataFrame([(0, "a", "a", "function", "f", 1), (1, "b", "b", "function", "f", 2), (2, "c", "c", "function", "f", 3)], schema)
    after = spark.createDataFrame([(0, "a", "a", "function", "f", 1), (1, "b", "b", "function", "f", 9), (2, "d", "d", "class", "f", 3)], schema)
    d = incremental.delta(before, after)
    assert {(r.qualified_name, r.op) for r in d.collect()} == {("b", "modified"), ("c", "deleted"), ("d", "added")}
    now = incremental.apply_delta(before, d, after)
    assert sorted((r["name"], r.line) for r in now.collect()) == [("a", 1), ("b", 9), ("d", 3)]
    with pytest.raises(ValueError):
        incremental.apply_delta(after, d.where("op = 'added'"), after)
    assert incremental.is_empty(incremental.delta(before, before))


def test_contracts(spark):
    old = 'def f(a, b: Any, c=1) -> Optional[int]:\n    """D.\n\n    Args:\n        a: must be positive\n\n    Returns:\n        a number\n\n    Raises:\n        ValueError: if bad\n    """\nclass K:\n    def m(self, x: Union[int, str]): pass\nasync def skipped(): pass\n'
    new = 'def f(b: int, c, d=2, *, e) -> int:\n    """D.\n\n    Args:\n        b: must be\n        c: requires more\n\n    Raises:\n        KeyError: if gone\n    """\nclass K:\n    def m(self, x: int): pass\n'
    read = lambda s: contracts.extract_contracts(spark.createDataFrame([("f.py", s), ("g.py", "def broken(:"), ("h.py", None)], "file string, source string"))
    one = {r.qualified_name: r for r in read(old).collect()}
    assert set(one) == {"f", "K.m"} and one["f"].raises == ["ValueError"] and one["f"].preconditions == ["a: must be positive"] and one["f"].postconditions == ["a number"]
    assert [(p.name, p.type_hint, p.is_optional, p.default_value) for p in one["f"].parameters] == [("a", None, False, None), ("b", "Any", False, None), ("c", None, True, "1")]
    got = {r.qualified_name: r for r in contracts.compare(read(old), read(new)).collect()}
    assert [(c.type, c.elements) for c in got["f"].breaking] == [
        ("PARAMETER_REMOVED", ["a"]), ("PARAMETER_REQUIRED_NOW", ["c"]), ("PARAMETER_TYPE_CHANGED", ["b"]), ("RETURN_TYPE_NARROWED", ["return"]), ("EXCEPTION_ADDED", ["KeyError"]), ("PRECONDITION_ADDED", ["preconditions"]),
    ]
    assert got["f"].score == 0 and got["f"].notes == ["Removed exceptions: ValueError", "Added optional parameters: d, e"]
    assert got["K.m"].score == pytest.approx(0.7) and not got["K.m"].is_compatible


DIFF = """diff --git a/x.py b/x.py
index 1..2 100644
--- a/x.py
+++ b/x.py
@@ -1 +1,2 @@
-old
+new
+more
diff --git a/gone.py b/gone.py
deleted file mode 100644
--- a/gone.py
+++ /dev/null
@@ -1 +0,0 @@
-x
diff --git a/new.txt b/new.txt
new file mode 100644
--- /dev/null
+++ b/new.txt
@@ -0,0 +3,2 @@
+a
+b
"""


def test_diffs(spark):
    rows = diffs.parse_diff(spark.createDataFrame([(1, DIFF)], "diff_id int, diff_text string"))
    assert [(r.path, r.status, r.added, r.deleted) for r in rows.orderBy("path").collect()] == [("gone.py", "deleted", 0, 1), ("new.txt", "added", 2, 0), ("x.py", "modified", 2, 1)]
    assert [r.path for r in diffs.changed_files(rows).collect()] == ["x.py"]
    lines = spark.createDataFrame(list(enumerate(DIFF.splitlines())), "seq int, line string")
    assert {(r.file, r.lo, r.hi) for r in diffs.hunks(lines).collect()} == {("x.py", 1, 2), ("new.txt", 3, 4)}
    listed = diffs.name_status(spark.createDataFrame([("M\ta.py",), ("R100\told.py\tnew.py",), ("",)], "line string"))
    assert {(r.file, r.status) for r in diffs.as_changes(listed).collect()} == {("a.py", "M"), ("old.py", "D"), ("new.py", "A")}


def test_imports(spark):
    one = lambda e: spark.range(1).select(e.alias("x")).first().x
    lit = F.lit
    assert one(imports.resolve_python(lit(".utils"), lit("src/pkg/m.py"))) == "src.pkg.utils"
    assert one(imports.resolve_python(lit("..utils"), lit("src/pkg/m.py"))) == "src.utils"
    assert one(imports.resolve_python(lit("os.path"), lit("src/pkg/m.py"))) == "os.path"
    assert one(imports.resolve_typescript(lit("../lib/x.ts"), lit("src/app/m.ts"))) == "src/lib/x"
    assert one(imports.resolve_typescript(lit("@a/b"), lit("src/app/m.ts"))) == "@a/b"
    assert one(imports.import_names(lit("from a import (b, c as d)"))) == ["b", "d"] and one(imports.import_names(lit("import os, json as j"))) == ["os", "j"] and one(imports.import_names(lit("from a import *"))) == ["*"]
    assert one(imports.is_stdlib(lit("os.path"))) and not one(imports.is_stdlib(lit("numpy")))


def test_session_logs(spark, tmp_path):
    def use(i, name, **args):
        return {"type": "assistant", "message": {"content": [{"type": "tool_use", "id": i, "name": name, "input": args}]}}

    def result(i, text, **more):
        return {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": i, "content": text, **more}]}}

    log = [
        {"type": "user", "message": {"content": [{"type": "text", "text": "x **Task:** fix it"}]}},
        use("1", "Bash", command="tool view Foo --depth 2"), result("1", "Exit code 1: Foo not found in graph"), use("2", "Read", file_path="/a/b.py"), result("2", "Full-file read blocked", is_error=True),
        use("3", "Bash", command="ls"), result("3", "Exit code 0"), use("4", "Grep", pattern="zz"), {"type": "result", "subtype": "success", "num_turns": 4, "total_cost_usd": 0.5, "usage": {"output_tokens": 7, "cache_read_input_tokens": 9}},
    ]
    (tmp_path / "inst__tool__2026-05-07T15-52-18.jsonl").write_text("\n".join(map(json.dumps, log)))
    (tmp_path / "inst__tool__2026-05-08T16-00-00.jsonl").write_text("\n".join(map(json.dumps, [*log[:3], log[-1] | {"total_cost_usd": 0.1}])))
    logs = sessions.read_logs(spark, str(tmp_path)).cache()
    tl = sessions.timeline(logs).where("session like '%15-52-18'").orderBy("seq").collect()
    assert [(r.turn, r.name, r.is_error) for r in tl] == [(1, "Bash", True), (2, "Read", True), (3, "Bash", False), (4, "Grep", False)] and tl[3].result == "(no result)"
    facts = {r.session[-8:]: r for r in sessions.session_facts(logs, "tool").collect()}
    f = facts["15-52-18"]
    assert (f.instance, f.outcome, f.turns, f.cost, f.total_calls, f.total_errors, f.tool_err, f.fallback, f.P01_symbol_not_found, f.P02_view_depth_flag, f.P17_read_blocked) == ("inst", "success", 4, 0.5, 4, 2, 1, 1, 1, 1, 1)
    assert sessions.first_last_verdict(sessions.session_facts(logs, "tool")).first().verdict == "better"
    trend = {r.metric: r for r in sessions.batch_trend(sessions.session_facts(logs, "tool"), ["cost", "total_calls", "total_errors"]).collect()}
    assert trend["cost"].trend == "-80%" and trend["total_errors"].verdict == "improvement"
    assert {r.task for r in sessions.task_text(logs).collect()} == {"fix it"}
    worse = sessions.session_facts(logs, "tool").withColumn("ts", F.expr("timestamp '2027-01-01' - (ts - timestamp '2026-01-01')"))
    assert sessions.first_last_verdict(worse).first().verdict == "worse"
    assert {(r.pattern, r.first_hits, r.last_hits) for r in sessions.pattern_deltas(worse, list(sessions.detectors("tool"))).collect()} == {("P17_read_blocked", 0, 1)}
    free = worse.withColumn("cost", F.lit(None).cast("double"))
    assert sessions.first_last_verdict(free).first().verdict == "same" and not sessions.pattern_deltas(free, ["P17_read_blocked"]).count()


def test_tasks_of_sessions(spark):
    block = "struct<type:string,name:string,input:map<string,string>,text:string>"
    said = lambda t: ("text", None, None, t)
    skill = lambda **a: ("tool_use", "Skill", a, None)
    rows = [
        ("a", 0, "user", [said("**Task:**"), said("x **Task:** one\ntwo")]), ("a", 1, "user", [said("**Task:** three")]),
        ("b", 0, "assistant", [skill(skill="other", args="no"), skill(skill="code-analysis", args="")]), ("b", 1, "assistant", [skill(skill="code-analysis", args="y" * 300)]),
        ("c", 0, "assistant", [said("**Task:** not by the user")]), ("d", 0, "user", None),
    ]
    logs = spark.createDataFrame(rows, f"session string, seq long, type string, content array<{block}>")
    assert {r.session: r.task for r in sessions.task_text(logs).collect()} == {"a": "one", "b": "y" * 200, "c": "?", "d": "?"}


def test_scan_differs_from_reports(spark):
    bash = lambda c, err=True, result="": ("s", 1, 1, 0, "Bash", {"command": c}, result, err)
    rows = [bash("tool grep x --compact", False), bash("tool lookup x --file f"), bash("tool grep x --output_mode y"), bash("cat C:\\\\a"), bash("xfindstr a"), bash("tool list", False, "No symbols found")]
    tl = spark.createDataFrame(rows, "session string, turn int, seq int, pos int, name string, input map<string,string>, result string, is_error boolean")
    assert {r.pattern: r.hits for r in sessions.pattern_hits(tl, "tool").collect()} == {"P03_grep_wrong_flag": 1, "P04_unsupported_file": 1, "P07_backslash_path": 1, "P20_list_empty": 1}
    assert {r.pattern: r.hits for r in sessions.pattern_scan(tl, "tool").collect()} == {"P07_backslash_path": 1, "P08_windows_cmd_tools": 1, "P14b_grep_output_mode": 1}
    meta = {r.pattern: r for r in sessions.pattern_meta(spark, "tool").collect()}
    assert len(meta) == 20 and meta["P10_dotenv_errors"].severity == "CRIT" and all(r.description for r in meta.values())
