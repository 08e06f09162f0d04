"""Version-control history: what the jobs ask of it, from the tables of the history source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import LANGUAGES, ignore_rules, is_ignored
from .git_source import GitError, history, run_git

__all__ = ["GitError", "blob", "changed", "changed_hunks", "commit", "commit_count", "commits_behind", "history", "log_between", "run_git", "sources_at"]


def changed(spark: SparkSession, repo: str, range_: str) -> DataFrame:
    """(status, file, old_file) of a commit range."""
    return history(spark, repo, "diff", range=range_)


def changed_hunks(spark: SparkSession, repo: str, range_: str) -> DataFrame:
    """(file, lo, hi): the changed lines of the new side; a hunk of no lines is left out."""
    return history(spark, repo, "hunks", range=range_)


def commit(spark: SparkSession, repo: str, ref: str = "HEAD") -> DataFrame:
    """One row of commit data; the time also as git wrote it."""
    branch = run_git(["rev-parse", "--abbrev-ref", "HEAD"], repo).strip()
    return history(spark, repo, "commits", ref=ref, limit="1").select("commit_hash", "short_hash", "message", "author", "ts", "ts_raw", F.lit(branch).alias("branch"), "files_changed")


def sources_at(spark: SparkSession, repo: str, ref: str = "HEAD", ignore: str = "", project: str = "") -> DataFrame:
    """(project_id, file, language, content) of the sources of a commit, without a working tree."""
    by_ext = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    rows = history(spark, repo, "blobs", ref=ref).select(F.lit(project).alias("project_id"), "file", F.element_at(by_ext, F.lower(F.substring_index("file", ".", -1))).alias("language"), "content")
    return rows.where(F.col("language").isNotNull() & F.contains(F.col("file"), F.lit(".")) & ~is_ignored(F.col("file"), ignore_rules(ignore)))


def blob(repo: str, ref: str, path: str) -> str:
    return run_git(["show", f"{ref}:{path}"], repo)


def commits_behind(repo: str, since: str) -> tuple[int, list[str]]:
    """Commits after one, and the files they touch; -1 if it is unknown here."""
    try:
        return len(run_git(["log", "--oneline", f"{since}..HEAD"], repo).splitlines()), run_git(["diff", "--name-only", since, "HEAD"], repo).splitlines()
    except GitError:
        return -1, []


def commit_count(repo: str) -> int:
    return int(run_git(["rev-list", "--count", "HEAD"], repo))


def log_between(spark: SparkSession, repo: str, after: str, before: str) -> DataFrame:
    """(commit_hash, ts_raw, message) of commits in a time window."""
    at = F.col("committed")
    rows = history(spark, repo, "commits").where((at >= F.lit(after).cast("timestamp")) & (at <= F.lit(before).cast("timestamp")))
    return rows.select(F.col("short_hash").alias("commit_hash"), "ts_raw", "message")
