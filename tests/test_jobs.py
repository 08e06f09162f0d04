"""Build, sync and contract comparison over a small repository."""

import subprocess

import pytest

from loomgraph import jobs
from loomgraph.sources import git
from loomgraph.sources.store import GraphStore


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("git")
    run = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *a], cwd=root, check=True, capture_output=True)
    run("init", "-q")
    (root / "a.py").write_text("def f(x, y=1):\n    return g(x)\n\ndef g(x):\n    return x\n")
    (root / "b.py").write_text("def h():\n    return f(1)\n")
    run("add", ".")
    run("commit", "-qm", "one")
    yield root, run


def edges(store):
    return {(r.src_id.split(":")[-1], r.dst_id.split(":")[-1]) for r in store.read("edges").where("type = 'CALLS'").collect()}


def test_build_then_sync(spark, repo, tmp_path):
    root, run = repo
    store = GraphStore(spark, f"file://{tmp_path}/s", "p")
    assert jobs.build(spark, f"file://{root}", store, repo=str(root)).count() == 0
    assert edges(store) == {("f", "g"), ("h", "f")}
    assert store.read("commits").count() == 1 and git.commit_count(str(root)) == 1
    (root / "a.py").write_text("def f(x):\n    return k(x)\n\n\ndef k(x):\n    return x\n")
    run("mv", "b.py", "c.py")
    run("add", ".")
    run("commit", "-qm", "two")
    delta = jobs.sync(spark, f"file://{root}", str(root), "HEAD~1..HEAD", store)
    assert {(r.file, r.qualified_name, r.op) for r in delta.collect()} == {("a.py", "g", "deleted"), ("a.py", "k", "added"), ("b.py", "h", "deleted"), ("c.py", "h", "added")}
    assert edges(store) == {("f", "k"), ("h", "f")}
    assert {r.file for r in store.read("nodes").collect()} == {"a.py", "c.py"}
    assert store.read("commits").count() == 2 and store.read("edges").where("type = 'MODIFIED_BY'").count() == 2
    assert git.commits_behind(str(root), "HEAD~1")[0] == 1 and git.commits_behind(str(root), "nope") == (-1, [])
    assert {(r.file, r.lo) for r in git.changed_hunks(spark, str(root), "HEAD~1..HEAD").collect()} >= {("a.py", 1)}
    got = {r.qualified_name: r for r in jobs.breaking_changes(spark, str(root), "a.py", "HEAD~1", "HEAD").collect()}
    assert [b.type for b in got["f"].breaking] == ["PARAMETER_REMOVED"]
    with pytest.raises(git.GitError):
        git.run_git(["show", "nope"], str(root))
    assert git.log_between(spark, str(root), "2000-01-01", "2090-01-01").count() == 2


def test_vectors_follow_the_graph(spark, repo, tmp_path):
    from loomgraph.engine import GraphEngine
    from loomgraph.operators.vector_index import VectorIndex

    root, run = repo
    head = lambda: git.run_git(["rev-parse", "HEAD"], str(root)).strip()
    store = GraphStore(spark, f"file://{tmp_path}/v", "p")
    index = VectorIndex(store)
    assert index.load() is None and index.search("f") is None and not index.exists()
    (root / "d.py").write_text("def open_file(path):\n    \"\"\"Reads bytes from disk.\"\"\"\n    return close(path)\n\n\ndef close(path):\n    return path\n")
    run("add", ".")
    run("commit", "-qm", "three")
    jobs.build(spark, f"file://{root}", store, repo=str(root), embeddings=True)
    assert index.stats()["head"] == head() and index.stats()["vectors"] == store.read("nodes").where("label <> 'File' and label <> 'Commit'").count()
    engine = GraphEngine(store.graph(), head=(head(), head(), 0, []), index=lambda: index)
    got = engine.search("reads bytes disk", 2, follow="context")
    assert got["how"] == "vectors" and got["hits"][0]["name"] == "open_file" and got["context"]["found"]
    assert engine.search("close", 1, "impact")["impact"]["total_callers"] == 1
    (root / "d.py").write_text("def shut(path):\n    \"\"\"Reads bytes from disk.\"\"\"\n    return path\n")
    run("commit", "-qam", "four")
    assert index.load(head()) is None and GraphEngine(store.graph(), head=(head(), None, 1, []), index=lambda: index).search("x")["how"] == "text"
    jobs.sync(spark, f"file://{root}", str(root), "HEAD~1..HEAD", store)
    assert index.load(head()) is not None and [r.name for r in index.search("reads bytes disk", 1, head()).collect()] == ["shut"]
    with pytest.raises(ValueError):
        engine.search("x", follow="other")


def test_sync_of_a_single_commit(spark, tmp_path):
    root = tmp_path / "one"
    root.mkdir()
    (root / "a.py").write_text("def f():\n    pass\n")
    for a in (["init", "-q"], ["add", "."], ["commit", "-qm", "one"]):
        subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *a], cwd=root, check=True, capture_output=True)
    store = GraphStore(spark, f"file://{tmp_path}/s1", "p")
    assert jobs.sync(spark, f"file://{root}", str(root), "HEAD~1..HEAD", store).count() == 0 and store.read("commits").count() == 1


def test_environment_files(tmp_path):
    (tmp_path / ".env").write_text("# c\n\nA=1\n B = 'x=y' \nnothing\n")
    assert jobs.read_env(str(tmp_path / ".env")) == {"A": "1", "B": "x=y"} and jobs.read_env(str(tmp_path / "no")) == {}


def test_preferences(tmp_path):
    own, user = str(tmp_path / "own.json"), str(tmp_path / "user.json")
    assert jobs.preferences(own, user) == jobs.PREFERENCES
    jobs.set_preference(user, "default_depth", 3)
    jobs.set_preference(user, "brief", True)
    jobs.set_preference(own, "default_depth", 11)
    assert jobs.preferences(own, user) == jobs.PREFERENCES | {"default_depth": 3, "brief": True}
    jobs.set_preference(own, "default_depth", 7)
    assert jobs.preferences(own, user)["default_depth"] == 7 and jobs.preferences(own)["brief"] is False
    (tmp_path / "own.json").write_text("not json")
    assert jobs.preferences(own, user)["default_depth"] == 3
    with pytest.raises(ValueError):
        jobs.set_preference(user, "colour", 1)


def test_layer_config(tmp_path):
    layers, allow = jobs.layer_config(str(tmp_path / "l.json"))
    assert layers[0][0] == "cli" and allow == [] and jobs.layer_config(str(tmp_path / "l.json")) == (layers, allow)


def test_updates_are_recorded(spark, tmp_path, monkeypatch):
    root = tmp_path / "r"
    root.mkdir()
    run = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *a], cwd=root, check=True, capture_output=True)
    run("init", "-q")
    (root / "a.py").write_text("def f():\n    return g()\n\ndef g(): pass\n")
    run("add", ".")
    run("commit", "-qm", "one")
    store = GraphStore(spark, f"file://{tmp_path}/s", "p")
    assert store.updates().count() == 0 and store.update_rows().count() == 0
    jobs.build(spark, f"file://{root}", store, repo=str(root))
    (root / "a.py").write_text("def f():\n    return h()\n\n\ndef h(): pass\n")
    run("add", ".")
    run("commit", "-qm", "two")
    r = jobs.update(spark, f"file://{root}", str(root), "HEAD~1..HEAD", store).first()
    assert (r.success, r.files, r.added, r.deleted, r.modified, r.error, r.commits) == (True, 1, 1, 1, 0, None, "HEAD~1..HEAD") and r.duration_ms > 0
    held = edges(store)
    assert held == {("f", "h")}
    monkeypatch.setattr(GraphStore, "record_commit", lambda *a: 1 / 0)  # after the graph was published
    (root / "a.py").write_text("def f(): pass\n")
    run("add", ".")
    run("commit", "-qm", "three")
    bad = jobs.update(spark, f"file://{root}", str(root), "HEAD~1..HEAD", store).first()
    assert (bad.success, bad.files, bad.error) == (False, 0, "ZeroDivisionError: division by zero")
    assert edges(store) == held  # as before
    assert [x.success for x in store.updates().orderBy("at").collect()] == [True, False]
    assert {(x.update_id, x.qualified_name, x.op) for x in store.update_rows().collect()} == {(r.update_id, "g", "deleted"), (r.update_id, "h", "added")}
    assert GraphStore(spark, store.root, "other").updates().count() == 0
