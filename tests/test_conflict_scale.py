"""Conflicts and closures whose pairs are made at the end, and neither shuffled in between nor stored."""

import itertools

import pytest

from loomgraph.operators import conflicts

NAMES, IMPORTS = 120, 40


def brute(tasks, symbols):
    """Closure, dependency, circular and direct conflicts by loops."""
    file = {s[1]: s[4] for s in symbols}
    imports = {}
    for _, name, _, kind, f in symbols:
        if kind == "import":
            imports.setdefault(f, set()).add(name)
    deps = {}
    for name in {x for _, xs in tasks for x in xs} & set(file):
        seen, now = set(), imports.get(file[name], set())
        while now - seen:
            seen |= now
            now = set().union(*[imports.get(file[x], set()) for x in now])
        deps[name] = seen
    after = {t: set().union(*[deps.get(x, set()) for x in xs]) for t, xs in tasks}
    closure = {(n, d) for n, ds in deps.items() for d in ds}
    dependency = {(a, b): sorted(after[a] & set(xs)) for a, _ in tasks for b, xs in tasks if a != b and after[a] & set(xs)}
    circular = {t: got for t, xs in tasks if (got := sorted(x for x in set(xs) if deps.get(x, set()) & set(xs)))}
    direct = {(a, b): sorted(set(x) & set(y)) for (a, x), (b, y) in itertools.combinations(sorted(tasks), 2) if set(x) & set(y)}
    return closure, dependency, circular, direct


@pytest.fixture
def given(spark, monkeypatch):
    """Tasks and symbols of three files, the first of which imports from the second and that from the third; and the rows of each stored table."""
    symbols = [(i, f"n{i}", f"q.n{i}", "function", f"f{i % 2}") for i in range(NAMES)]
    symbols += [(NAMES + i, f"i{i}", f"q.i{i}", "import", f"f{i % 2}") for i in range(IMPORTS)]
    symbols += [(900, "x", "x", "import", "f0"), (901, "x", "x", "function", "f1"), (902, "lone", "lone", "function", "f3")]
    tasks = [(t, [f"n{t}", f"n{t + 1}", f"i{t % 7}", "lone" if t % 5 else f"n{t}"]) for t in range(60)]
    held = []
    for name in ("durable", "settled"):
        keep = getattr(conflicts, name)
        monkeypatch.setattr(conflicts, name, lambda df, keep=keep: held.append(keep(df)) or held[-1])
    t = spark.createDataFrame(tasks, "id long, target_symbols array<string>")
    s = spark.createDataFrame(symbols, "ord long, name string, qualified_name string, type string, file string")
    return t, s, brute(tasks, symbols), held


def most(held):
    return max(x.count() for x in held)


def test_closure_stores_no_pairs(given):
    tasks, symbols, (closure, *_), held = given
    got = conflicts.dependency_closure(symbols, conflicts.targets(tasks).selectExpr("symbol AS name")).collect()
    assert {tuple(r) for r in got} == closure and len(got) == len(closure) > 2000
    assert most(held) < 400


def test_circular_stores_no_pairs(given):
    tasks, symbols, (_, _, circular, _), held = given
    names, deps = conflicts.file_closure(symbols, conflicts.targets(tasks).selectExpr("symbol AS name"))
    assert {r.task: r.symbols for r in conflicts.circular(tasks, names, deps).collect()} == circular
    assert circular and most(held) < 400


def test_report_stores_no_pairs(given):
    tasks, symbols, (_, dependency, circular, direct), held = given
    got = {r.kind: r.conflicts for r in conflicts.report(tasks, symbols).collect()}
    assert got == {"direct": len(direct), "dependency": len(dependency), "circular": len(circular), "feasible": 0}
    assert most(held) < 400


def test_dependency_conflicts_store_no_pairs(given):
    tasks, symbols, (_, dependency, _, _), held = given
    names, deps = conflicts.file_closure(symbols, conflicts.targets(tasks).selectExpr("symbol AS name"))
    got = conflicts.dependency_conflicts(tasks, names, deps).collect()
    assert {(r.task_a, r.task_b): r.symbols for r in got} == dependency and len(got) == len(dependency) > 2000
    assert most(held) < 400


@pytest.mark.parametrize(("most_listed", "heavy"), [(512, 100_000), (3, 2)])
def test_direct_conflicts_shuffle_lists(spark, given, monkeypatch, most_listed, heavy):
    """Crowded targets in several lists, tasks of many targets in several deals."""
    tasks, _, (*_, direct), _ = given
    monkeypatch.setattr(conflicts, "LIST", most_listed, raising=False)
    monkeypatch.setattr(conflicts, "HEAVY", heavy, raising=False)
    df = conflicts.direct_conflicts(tasks)
    assert {(r.task_a, r.task_b): r.symbols for r in df.collect()} == direct
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(others") < plan.index("RepartitionByExpression")  # lists are shuffled, pairs made after


@pytest.mark.parametrize("heavy", [100_000, 2])
def test_direct_conflicts_shuffle_no_pairs(given, monkeypatch, heavy):
    """What is grouped by the pair is where the lists went."""
    monkeypatch.setattr(conflicts, "HEAVY", heavy)
    monkeypatch.setattr(conflicts, "PAIRS", 100)  # several tasks
    plan = conflicts.direct_conflicts(given[0])._jdf.queryExecution().executedPlan().toString()
    assert "task_b" in plan and not [x for x in plan.splitlines() if "Exchange" in x and "task_b" in x]


def test_targets_may_be_rows(spark, given):
    """Tasks given by distinct (task, symbol) have the same conflicts, and no lists are made of them."""
    tasks, symbols, (_, dependency, circular, direct), _ = given
    rows = conflicts.targets(tasks)
    assert conflicts.targets(rows).columns == ["task", "symbol"]
    assert {(r.task_a, r.task_b): r.symbols for r in conflicts.direct_conflicts(rows).collect()} == direct
    got = {r.kind: r.conflicts for r in conflicts.report(rows, symbols).collect()}
    assert got == {"direct": len(direct), "dependency": len(dependency), "circular": len(circular), "feasible": 0}


def test_derived_targets_make_no_lists(spark, sf_dir):
    from loomgraph.plans import derived

    df = derived.targets(spark, sf_dir)
    assert "collect_" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == df.distinct().count() > 0


def test_derived_targets_are_dealt_over_tasks(spark, sf_dir, monkeypatch):
    from loomgraph.plans import derived

    monkeypatch.setattr(derived, "LINES_A_TASK", 100, raising=False)
    plan = derived.targets(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    lines = derived.table(spark, sf_dir, "lineitem").count()
    assert "RepartitionByExpression [task" in plan and f", {-(-lines // 100)}" in plan


def test_names_of_targets_need_no_tasks(spark, sf_dir, monkeypatch):
    """What is wanted comes from the lines' keys; tasks are paired with targets once."""
    from loomgraph.plans import catalog, derived

    asked, keep = [], derived.targets
    monkeypatch.setattr(derived, "targets", lambda *a: asked.append(a) or keep(*a))
    catalog.QUERIES["conflicts_circular"](spark, sf_dir)
    assert len(asked) == 1
    names = derived.wanted(spark, sf_dir)
    assert "l_suppkey" not in names._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.name for r in names.collect()) == sorted(r.symbol for r in keep(spark, sf_dir).select("symbol").distinct().collect())


def test_circular_knows_the_size_of_tasks_files(given):
    tasks, symbols, (_, _, circular, _), held = given
    names, deps = conflicts.file_closure(symbols, conflicts.targets(tasks).selectExpr("symbol AS name"))
    assert {r.task: r.symbols for r in conflicts.circular(tasks, names, deps).collect()} == circular
    assert ["task", "file"] in [x.columns for x in held]


@pytest.mark.parametrize("bits", [63, 1])
def test_dependency_conflicts_meet_by_bits(given, monkeypatch, bits):
    """Names are not gathered for each class that meets a task, but for tasks of more files than bits."""
    tasks, symbols, (_, dependency, *_), _ = given
    monkeypatch.setattr(conflicts, "BITS", bits, raising=False)
    names, deps = conflicts.file_closure(symbols, conflicts.targets(tasks).selectExpr("symbol AS name"))
    df = conflicts.dependency_conflicts(tasks, names, deps)
    assert {(r.task_a, r.task_b): r.symbols for r in df.collect()} == dependency
    assert ("collect_set" in df._jdf.queryExecution().executedPlan().toString()) == (bits == 1)
    joined = conflicts.dependency_conflicts(tasks, names, deps, separator=",").collect()
    assert {(r.task_a, r.task_b): r.symbols for r in joined} == {k: ",".join(v) for k, v in dependency.items()}


@pytest.mark.parametrize(("at_once", "dealt", "together"), [(250_000, 25_600, 512), (10, 3, 2)])
def test_classes_and_tasks_are_not_shuffled(spark, given, monkeypatch, at_once, dealt, together):
    """What is made of a class and a task stays where it is, also where Spark would broadcast nothing; classes come in blocks."""
    tasks, symbols, (_, dependency, circular, direct), _ = given
    for k, v in {"AT_ONCE": at_once, "DEALT": dealt, "TOGETHER": together}.items():
        monkeypatch.setattr(conflicts, k, v, raising=False)
    monkeypatch.setattr(conflicts, "PAIRS", 100)  # several parts
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        names, deps = conflicts.file_closure(symbols, conflicts.targets(tasks).selectExpr("symbol AS name"))
        df = conflicts.dependency_conflicts(tasks, names, deps)
        got = df.collect()
        counts = {r.kind: r.conflicts for r in conflicts.report(tasks, symbols).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {(r.task_a, r.task_b): r.symbols for r in got} == dependency and len(got) == len(dependency)
    assert counts == {"direct": len(direct), "dependency": len(dependency), "circular": len(circular), "feasible": 0}
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = plan[: plan.find("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
    assert not [x for x in plan.splitlines() if " Exchange " in f" {x.lstrip(' :+-')}" and "class" in x and "task_b" in x]
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning(class" in x or "Exchange hashpartitioning(file" in x] or at_once == 10
    assert "SortMergeJoin" not in plan or at_once == 10


def test_pairs_follow_lists(given, monkeypatch):
    """In a part the same task_a follow each other for one task_b after another: their column repeats, and files stay small."""
    tasks, symbols, *_ = given
    monkeypatch.setattr(conflicts, "TOGETHER", 4, raising=False)
    names, deps = conflicts.file_closure(symbols, conflicts.targets(tasks).selectExpr("symbol AS name"))
    rows = [(r.task_a, r.task_b) for r in conflicts.dependency_conflicts(tasks, names, deps).collect()]
    ends = sum(abs(i - k) > 12 for i, k in itertools.pairwise(at for a in range(5, 55) for at, r in enumerate(rows) if r[0] == a))
    assert ends < len(rows) / 8
