"""Table functions: broken, unknown and missing sources, and the DataFrame path beside them."""

from loomgraph.functions import contracts, tables
from loomgraph.sources import files

SOURCES = [
    ("a.py", b"def f(x: int, y=1):\n    g()\nclass C:\n    def m(self): return self.n()\n"), ("b.go", b"func M() { k() }"), ("c.py", b"def broken(:"), ("d.txt", b"x"), ("e.tsx", b"function V() { return <p>it's {f()}</p>; }"), (None, None), ("f.rs", None), ("", b""), ("A.PY", b"def up(): pass"),
]


def test_rows_of_joins_and_of_tables_agree(spark):
    tables.register(spark)
    df = spark.createDataFrame(SOURCES, "file string, content binary")
    ran = lambda q: spark.sql(q, s=df).collect()
    joined = ran("SELECT s.file, x.type, x.name, x.qualified_name, x.line, x.`column`, x.end_line, x.language FROM {s} s, LATERAL extract_symbols(s.file, s.content) x")
    whole = ran("SELECT file, type, name, qualified_name, line, `column`, end_line, language FROM symbols_of_files(TABLE({s})) WHERE error IS NULL")
    assert sorted(map(tuple, joined)) == sorted(map(tuple, whole)) and {r.qualified_name for r in joined} == {"f", "C", "C.m", "M", "V", "up"}
    rows = files.extract(df.selectExpr("'p' AS project_id", "file", "CASE WHEN lower(file) LIKE '%.py' THEN 'python' WHEN file LIKE '%.go' THEN 'go' WHEN file LIKE '%.tsx' THEN 'typescript' ELSE 'rust' END AS language", "content").where("file IS NOT NULL AND file NOT IN ('', 'd.txt')"))
    assert sorted((r.file, r.qualified_name, r.line) for r in files.symbols_of(rows).collect()) == sorted((r.file, r.qualified_name, r.line) for r in joined)
    broken = ran("SELECT file, error FROM symbols_of_files(TABLE({s})) WHERE error IS NOT NULL")
    assert [(r.file, r.error.split(":")[0]) for r in broken] == [("c.py", "SyntaxError")]
    calls = ran("SELECT s.file, x.caller_name, x.call_text FROM {s} s, LATERAL extract_calls(s.file, s.content) x")
    assert sorted(map(tuple, calls)) == [("a.py", "f", "g"), ("a.py", "m", "self.n"), ("b.go", "M", "k"), ("e.tsx", "V", "f")]
    assert sorted(map(tuple, ran("SELECT file, caller_name, call_text FROM calls_of_files(TABLE({s})) WHERE error IS NULL"))) == sorted(map(tuple, calls))
    assert ran("SELECT * FROM symbols_of_files(TABLE(SELECT * FROM {s} WHERE false))") == []


def test_contracts(spark):
    tables.register(spark)
    df = spark.createDataFrame([(f, (c or b"").decode()) for f, c in SOURCES if f in ("a.py", "c.py")], "file string, source string")
    got = spark.sql("SELECT s.file, x.qualified_name, x.parameters, x.return_type, x.raises FROM {s} s, LATERAL extract_contracts(s.source) x", s=df)
    want = contracts.extract_contracts(df).select("file", "qualified_name", "parameters", "return_type", "raises")
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 2
    whole = spark.sql("SELECT file, qualified_name FROM contracts_of_files(TABLE(SELECT file, cast(source AS binary) AS content FROM {s}))", s=df)
    assert sorted(map(tuple, whole.collect())) == [("a.py", "C.m"), ("a.py", "f")]


def test_work_is_dealt_over_tasks(spark, sf_dir, monkeypatch):
    """Tasks read a bounded number of files, and a small table is not read by one task."""
    from loomgraph.plans import building

    assert building.sql_contracts(spark, sf_dir).rdd.getNumPartitions() >= 4
    monkeypatch.setattr(building, "FILES_A_TASK", 100, raising=False)
    files_ = building._sources(spark, sf_dir)
    assert files_.rdd.getNumPartitions() >= files_.count() / 100 > 4
    assert building.sql_contracts(spark, sf_dir).rdd.getNumPartitions() >= 2


def test_joins_make_no_table_a_row():
    from pyspark.util import PythonEvalType

    for f in (tables._rowwise(tables._symbols, tables.SYMBOL), tables._rowwise(tables._calls, tables.CALL), tables._contract_rows()):
        assert f.evalType == PythonEvalType.SQL_TABLE_UDF


def test_texts_are_made_after_the_deal(spark, sf_dir):
    """One task may read a small table whole; it makes no texts of files."""
    from loomgraph.plans import building

    plan = building._sources(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("Generate explode") < plan.index("Repartition")
