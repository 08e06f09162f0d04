"""History as a source, against git itself."""

import subprocess

import pytest
from pyspark.sql import functions as F

from loomgraph.sources import files, git
from loomgraph.sources.git_source import GitReader, history


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("history")

    def run(*a, date=None):
        env = {"GIT_AUTHOR_DATE": date, "GIT_COMMITTER_DATE": date} if date else {}
        import os

        return subprocess.run(["git", "-c", "user.name=t é", "-c", "user.email=t@t", *a], cwd=root, check=True, capture_output=True, env=os.environ | env).stdout.decode()

    run("init", "-q", "-b", "main")
    (root / "pkg").mkdir()
    (root / "pkg/a.py").write_text("def f():\n    pass\n" + "".join(f"x{i} = {i}\n" for i in range(20)))
    (root / "b é.py").write_text("def g(): pass\n")
    (root / "data.bin").write_bytes(bytes(range(256)))
    run("add", ".")
    run("commit", "-qm", "one\n\nbody", date="2024-01-01T00:00:00+02:00")
    run("checkout", "-qb", "side")
    (root / "side.go").write_text("package p\nfunc S() {}\n")
    run("add", ".")
    run("commit", "-qm", "side: with \t tab", date="2024-01-02T00:00:00Z")
    run("checkout", "-q", "main")
    run("mv", "pkg/a.py", "pkg/renamed.py")
    (root / "pkg/renamed.py").write_text((root / "pkg/a.py").read_text() if (root / "pkg/a.py").exists() else "def f():\n    return 1\n" + "".join(f"x{i} = {i}\n" for i in range(20)) + "++ b/odd\n")
    run("rm", "-q", "data.bin")
    run("add", ".")
    run("commit", "-qm", "two", date="2024-01-03T12:00:00Z")
    run("merge", "-q", "--no-ff", "-m", "merge", "side", date="2024-01-04T00:00:00Z")
    return str(root), run


def test_commits(spark, repo):
    root, run = repo
    got = history(spark, root, "commits").collect()
    assert {r.commit_hash for r in got} == set(run("rev-list", "HEAD").split()) and {r.message for r in got} == {"one", "two", "merge", "side: with \t tab"}
    by = {r.message: r for r in got}
    assert (by["one"].parents, by["one"].author, by["one"].ts_raw, by["one"].files_changed) == ([], "t é", "2024-01-01T00:00:00+02:00", 3)
    assert str(by["one"].ts) == "2023-12-31 22:00:00" and len(by["merge"].parents) == 2 and by["merge"].files_changed == 1 and by["two"].files_changed == 2
    assert history(spark, root, "commits", ref="HEAD", limit="1").first().message == "merge"
    assert {r.message for r in git.log_between(spark, root, "2024-01-02", "2024-01-03 12:00:00").collect()} == {"two", "side: with \t tab"}
    cut = history(spark, root, "commits", range="HEAD~1..HEAD", slice="1")
    assert cut.count() == 2 and cut.rdd.getNumPartitions() == 2


def test_changes_and_diffs(spark, repo):
    root, run = repo
    rows = {(r.status, r.file, r.old_file) for r in history(spark, root, "changes").collect()}
    assert rows == {("A", "pkg/a.py", None), ("A", "b é.py", None), ("A", "data.bin", None), ("A", "side.go", None), ("R", "pkg/renamed.py", "pkg/a.py"), ("D", "data.bin", None)}
    diff = history(spark, root, "diff", range="HEAD~2..HEAD")
    assert {(r.status, r.file, r.old_file) for r in diff.collect()} == {("A", "side.go", None), ("R", "pkg/renamed.py", "pkg/a.py"), ("D", "data.bin", None)}
    assert [r.status for r in diff.where("file = 'pkg/renamed.py'").collect()] == ["R"]  # a filter doesn't hide the old name from git
    hunks = history(spark, root, "hunks", range="HEAD~2..HEAD")
    assert sorted(map(tuple, hunks.collect())) == [("pkg/renamed.py", 2, 2), ("pkg/renamed.py", 23, 23), ("side.go", 1, 2)]
    assert hunks.where("file = 'side.go'").count() == 1
    assert history(spark, root, "hunks", range="HEAD..HEAD").count() == 0


def test_blobs(spark, repo):
    root, run = repo
    first = run("rev-list", "--max-parents=0", "HEAD").strip()
    blobs = history(spark, root, "blobs", ref=first, slice="1")
    got = {r.file: r for r in blobs.collect()}
    assert set(got) == {"pkg/a.py", "b é.py", "data.bin"} and bytes(got["data.bin"].content) == bytes(range(256)) and got["data.bin"].size == 256
    assert blobs.rdd.getNumPartitions() == 3
    assert [r.file for r in blobs.where("file like 'pkg/%'").collect()] == ["pkg/a.py"]
    assert blobs.where("file = 'nope'").count() == 0 and blobs.where(F.col("file").isin("b é.py", "data.bin")).count() == 2
    symbols = files.symbols_of(files.extract(git.sources_at(spark, root, "HEAD")))
    assert {(r.file, r.name) for r in symbols.collect()} == {("b é.py", "g"), ("pkg/renamed.py", "f"), ("side.go", "S")}


def test_filters_reach_git(spark, repo):
    root, run = repo
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, StringStartsWith
    from datetime import datetime, timezone

    head = run("rev-parse", "HEAD").strip()
    r = GitReader({"repo": root, "table": "commits"})
    kept = list(r.pushFilters([EqualTo(("commit_hash",), head)]))
    assert len(kept) == 1 and [p.items for p in r.partitions()] == [[head]]
    r = GitReader({"repo": root, "table": "commits"})
    list(r.pushFilters([GreaterThanOrEqual(("committed",), datetime(2024, 1, 4, tzinfo=timezone.utc))]))
    assert [p.items for p in r.partitions()] == [[head]]
    r = GitReader({"repo": root, "table": "blobs"})
    list(r.pushFilters([StringStartsWith(("file",), "pkg/ren")]))
    assert [[f[0] for f in p.items] for p in r.partitions()] == [["pkg/renamed.py"]]
    assert history(spark, root, "commits").where(F.col("commit_hash") == head).count() == 1
    assert history(spark, root, "commits").where(F.col("commit_hash") == "0" * 40).count() == 0


def test_refusals(spark, repo, tmp_path):
    for options in ({"repo": repo[0], "table": "nope"}, {"table": "commits"}, {"repo": repo[0], "table": "diff"}):
        with pytest.raises(ValueError):
            GitReader(options)
    with pytest.raises(git.GitError):
        GitReader({"repo": str(tmp_path), "table": "commits"}).partitions()
