"""A repository's history as tables: ``spark.read.format("git_history").option("repo", path).option("table", name)``.

- commits: the commits of ``range`` (or of all that ``ref`` reaches), the first ``limit`` of them if it is given.
- changes: what each of these commits changed against its first parent.
- diff, hunks: files that differ between the ends of ``range``, and their changed lines on the new side.
- blobs: the files at ``ref``, with their contents.

Lists of commits and files are cut into slices, a partition each, so that histories are read by many tasks; the
repository must be in a folder that all executors see. Filters on commits' ids and times and on files' names go to git;
Spark applies all filters again, so what git leaves too much is no fault.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

NAME = "git_history"
TABLES = {
    "commits": "commit_hash string, short_hash string, parents array<string>, message string, author string, email string, ts timestamp, ts_raw string, committed timestamp, files_changed int",
    "changes": "commit_hash string, status string, file string, old_file string",
    "diff": "status string, file string, old_file string",
    "hunks": "file string, lo int, hi int",
    "blobs": "file string, blob string, size long, content binary",
}
#: Commits or files of a partition, unless ``slice`` says how many, and bytes of its files.
SLICE, BYTES = 2_000, 32 << 20


class GitError(RuntimeError):
    """git is missing, timed out, or failed."""


def run_git(args: list[str], cwd: str, timeout: int = 60, given: bytes | None = None) -> str:
    return run_raw(args, cwd, timeout, given).decode("utf-8", "replace")


def run_raw(args: list[str], cwd: str, timeout: int = 600, given: bytes | None = None) -> bytes:
    try:
        done = subprocess.run(["git", *args], cwd=cwd, capture_output=True, timeout=timeout, input=given)
    except FileNotFoundError as e:
        raise GitError("git is not installed") from e
    except subprocess.TimeoutExpired as e:
        raise GitError(f"git {args[0]} took more than {timeout} s") from e
    if done.returncode:
        raise GitError(done.stderr.decode("utf-8", "replace").strip() or f"git {args[0]} failed")
    return done.stdout


@dataclass
class Slice(InputPartition):
    """Commits or files that one task reads."""

    items: list


class GitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.repo, self.table = options.get("repo"), options.get("table", "commits")
        self.range, self.ref = options.get("range"), options.get("ref", "HEAD")
        self.limit = [f"--max-count={int(options['limit'])}"] if "limit" in options else []
        if not self.repo or self.table not in TABLES:
            raise ValueError(f"options repo and table are needed, a table of {', '.join(TABLES)}")
        if self.table in ("diff", "hunks") and not self.range:
            raise ValueError(f"{self.table} needs a range")
        self.slice = int(options.get("slice", SLICE))
        self.only: list[str] | None = None  # commits by id
        self.times: list[str] = []
        self.paths: list[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what git can narrow down; all filters are given back, to be applied again."""
        for f in filters:
            column = ".".join(f.attribute) if hasattr(f, "attribute") else None
            values = [f.value] if isinstance(f, (EqualTo, StringStartsWith)) else list(f.value) if isinstance(f, In) else []
            if column == "commit_hash" and isinstance(f, (EqualTo, In)) and self.table in ("commits", "changes"):
                self.only = [v for v in values if v] if self.only is None else [v for v in self.only if v in values]
            elif column == "file" and isinstance(f, (EqualTo, In)) and self.table in ("diff", "hunks", "blobs"):
                self.paths = [v for v in values if v] if self.paths is None else [v for v in self.paths if v in values]
            elif column == "file" and isinstance(f, StringStartsWith) and self.table == "blobs" and self.paths is None and "/" in f.value:
                self.paths = [f.value.rsplit("/", 1)[0] + "/"]  # the folder; what it has besides is filtered again
            elif column == "committed" and self.table == "commits" and isinstance(getattr(f, "value", None), datetime):
                at = int(f.value.replace(tzinfo=f.value.tzinfo or timezone.utc).timestamp())
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.times.append(f"--since-as-filter={at}")
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.times.append(f"--until={at + 1}")
        yield from filters

    def _commits(self) -> list[str]:
        if self.only is not None:
            there = run_git(["cat-file", "--batch-check=%(objecttype) %(objectname)"], self.repo, given="\n".join(self.only).encode() + b"\n")
            known = [x.split(" ")[1] for x in there.splitlines() if x.startswith("commit ")]
            reached = set(run_git(["rev-list", *self.limit, self.range or self.ref], self.repo, 600).split()) if known else set()
            return [x for x in dict.fromkeys(known) if x in reached]
        return run_git(["rev-list", *([] if self.limit else self.times), *self.limit, self.range or self.ref], self.repo, 600).split()

    def _files(self) -> list[tuple]:
        """(file, blob, size) of the files at the ref."""
        text = run_raw(["--literal-pathspecs", "ls-tree", "-r", "-l", "-z", "--full-tree", self.ref, *(["--", *self.paths] if self.paths else [])], self.repo).decode("utf-8", "surrogateescape")
        rows = (x.split("\t", 1) for x in text.split("\0") if x)
        return [(name, meta.split()[2], int(meta.split()[3])) for meta, name in rows if meta.split()[1] == "blob"]

    def partitions(self) -> list[Slice]:
        if self.paths == [] or self.only == []:
            return [Slice([])]
        if self.table in ("commits", "changes"):
            found = self._commits()
            return [Slice(found[k : k + self.slice]) for k in range(0, len(found), self.slice)] or [Slice([])]
        if self.table == "blobs":
            slices, size = [[]], 0
            for f in self._files():
                if slices[-1] and (size + f[2] > BYTES or len(slices[-1]) == self.slice):
                    slices.append([])
                    size = 0
                slices[-1].append(f)
                size += f[2]
            return [Slice(x) for x in slices]
        if self.table == "diff":
            return [Slice(["all"])]
        names = [(f, old) for s, f, old in self._diff() if s != "D"]
        return [Slice(names[k : k + self.slice]) for k in range(0, len(names), self.slice)] or [Slice([])]

    def _diff(self) -> Iterator[tuple[str, str, str | None]]:
        """The files that differ; those wanted are picked after git has paired the renamed ones."""
        for status, file, old in _name_status(run_raw(["diff", "-M", "--name-status", "-z", self.range], self.repo)):
            if self.paths is None or file in self.paths:
                yield status, file, old

    def read(self, partition: Slice) -> Iterator:
        if partition.items:
            yield from getattr(self, f"_read_{self.table}")(partition.items)

    def _read_commits(self, commits: list[str]) -> Iterator[tuple]:
        ids = "\n".join(commits).encode() + b"\n"
        text = run_git(["log", "--no-walk=unsorted", "--stdin", "-z", "--format=%H%x01%h%x01%P%x01%s%x01%an%x01%ae%x01%aI%x01%cI"], self.repo, 600, ids)
        counts: dict[str, int] = {}
        for commit, _, _, _ in _changes(self.repo, commits):
            counts[commit] = counts.get(commit, 0) + 1
        moment = lambda x: datetime.fromisoformat(x).astimezone(timezone.utc)
        for row in text.split("\0"):
            if row:
                h, short, parents, subject, author, email, when, committed = row.split("\x01")
                yield h, short, parents.split(), subject, author, email, moment(when), when, moment(committed), counts.get(h, 0)

    def _read_changes(self, commits: list[str]) -> Iterator[tuple]:
        yield from _changes(self.repo, commits)

    def _read_diff(self, _: list) -> Iterator[tuple]:
        yield from self._diff()

    def _read_hunks(self, names: list[tuple[str, str | None]]) -> Iterator[tuple]:
        both = [x for pair in names for x in pair if x]  # a renamed file with its old name, for git to pair them
        text = run_git(["-c", "core.quotePath=false", "--literal-pathspecs", "diff", "-M", "--unified=0", "--no-color", self.range, "--", *both], self.repo, 600)
        wanted = {f for f, _ in names}
        file, inside = None, 0
        for line in text.split("\n"):
            if inside:  # lines of a hunk, which may look like anything
                inside -= not line.startswith("\\")
            elif line.startswith("+++ "):
                file = line[6:].rstrip("\t") if line.startswith("+++ b/") else None
            elif line.startswith("@@ -"):
                old, new = (x[1:].split(",") for x in line.split(" ")[1:3])
                n = int(new[1]) if len(new) > 1 else 1
                inside = n + (int(old[1]) if len(old) > 1 else 1)
                if n and file in wanted:
                    yield file, int(new[0]), int(new[0]) + n - 1

    def _read_blobs(self, files: list[tuple]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("blob", pa.string()), ("size", pa.int64()), ("content", pa.binary())])
        process = subprocess.Popen(["git", "cat-file", "--batch"], cwd=self.repo, stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        try:
            for name, blob, size in files:
                process.stdin.write(f"{blob}\n".encode())
                process.stdin.flush()
                head = process.stdout.readline().split()
                if len(head) != 3:
                    raise GitError(f"{name} can't be read")
                content = process.stdout.read(int(head[2]))
                process.stdout.read(1)
                yield pa.RecordBatch.from_pylist([{"file": name.encode("utf-8", "surrogateescape").decode("utf-8", "replace"), "blob": blob, "size": size, "content": content}], schema=schema)
        finally:
            process.stdin.close()
            process.stdout.close()
            process.wait()


def _name_status(raw: bytes) -> Iterator[tuple[str, str, str | None]]:
    """(status, file, old file) from a listing with zero bytes between its fields."""
    fields = iter(raw.decode("utf-8", "replace").split("\0"))
    for status in fields:
        if status:
            name = next(fields)
            yield (status[0], next(fields), name) if status[0] in "RC" else (status[0], name, None)


def _changes(repo: str, commits: list[str]) -> Iterator[tuple[str, str, str, str | None]]:
    """(commit, status, file, old file) of what commits changed against their first parents."""
    raw = run_raw(["diff-tree", "--stdin", "--root", "-r", "-M", "-z", "--name-status", "--diff-merges=first-parent"], repo, given="\n".join(commits).encode() + b"\n")
    commit, fields = "", iter(raw.decode("utf-8", "replace").split("\0"))
    for x in fields:
        x = x.lstrip("\n")
        if len(x) >= 40:
            commit = x[:40] if len(x) < 64 else x[:64]
        elif x:
            name = next(fields)
            yield (commit, x[0], next(fields), name) if x[0] in "RC" else (commit, x[0], name, None)


class GitSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return TABLES[self.options.get("table", "commits")]

    def reader(self, schema) -> DataSourceReader:
        return GitReader(dict(self.options))


def history(spark: SparkSession, repo: str, table: str, **options: str) -> DataFrame:
    """A table of a repository; registers the source in the session, and lets it take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GitSource)
    return spark.read.format(NAME).options(repo=repo, table=table, **options).load()
