"""Whole jobs over a source tree: full build, sync of a commit range, and comparison of contracts between two commits."""

from __future__ import annotations

import json
import time
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import contracts
from .functions.diffs import as_changes
from .operators import build as building
from .operators import incremental
from .operators.vector_index import VectorIndex
from .runtime import durable
from .schema import LABEL_OF_TYPE, PropertyGraph, qualified_name
from .sources import files, git
from .sources.store import UPDATES, GraphStore

# The layers that a new configuration starts with, from the highest to the lowest.
DEFAULT_LAYERS = [
    ("cli", ["cli/", "cmd/", "main.py", "_cli.py"]),
    ("api", ["api/", "routes/", "views/", "handlers/"]),
    ("services", ["services/", "usecases/", "application/"]),
    ("domain", ["domain/", "models/", "entities/"]),
    ("infra", ["db/", "repo", "storage/", "clients/"]),
    ("config", ["config.py", "settings.py", "config/"]),
]


def layer_config(path: str) -> tuple[list[tuple[str, list[str]]], list[tuple[str, str]]]:
    """(layers, allowed pairs) of a JSON file, which is written with the default layers if it is missing."""
    try:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
    except FileNotFoundError:
        spec = {"layers": [{"name": n, "paths": p} for n, p in DEFAULT_LAYERS], "allowlist": []}
        with open(path, "w", encoding="utf-8") as f:
            json.dump(spec, f, indent=2)
    return [(x["name"], x["paths"]) for x in spec["layers"]], [(x["from"], x["to"]) for x in spec.get("allowlist", [])]


def read_env(path: str) -> dict[str, str]:
    """key=value lines of a file; comments, blanks and a missing file give nothing, quotes around a value go."""
    try:
        with open(path, encoding="utf-8") as f:
            lines = [x.strip() for x in f]
    except FileNotFoundError:
        return {}
    pairs = (x.split("=", 1) for x in lines if x and not x.startswith("#") and "=" in x)
    return {k.strip(): v.strip().strip("'\"") for k, v in pairs}


# Preferences and what they are where no file sets them.
PREFERENCES = {"models_dir": None, "default_depth": None, "compact": False, "brief": False}


def preferences(*paths: str) -> dict:
    """The preferences of JSON files, of which the first that sets a valid value decides: a project's file goes before the user's.

    A depth is a whole number from 1 to 10, compact and brief are true or false, a folder is a text. Files that are
    missing or not JSON set nothing, and keys that are unknown are left out.
    """
    fits = {
        "models_dir": lambda v: isinstance(v, str), "default_depth": lambda v: isinstance(v, int) and not isinstance(v, bool) and 1 <= v <= 10,
        "compact": lambda v: isinstance(v, bool), "brief": lambda v: isinstance(v, bool),
    }
    out = dict(PREFERENCES)
    for path in reversed(paths):
        try:
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
        except (FileNotFoundError, json.JSONDecodeError):
            continue
        out |= {k: v for k, v in spec.items() if k in fits and fits[k](v)} if isinstance(spec, dict) else {}
    return out


def set_preference(path: str, key: str, value) -> None:
    """Writes one known preference to a file, whose other keys stay."""
    if key not in PREFERENCES:
        raise ValueError(f"unknown preference {key}")
    try:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
    except FileNotFoundError:
        spec = {}
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec | {key: value}, f, indent=2)


def build(spark: SparkSession, root: str, store: GraphStore, ignore: str = "", repo: str | None = None, embeddings: bool = False) -> DataFrame:
    """Parses a tree once, writes its graph and if wanted its vectors, and records the commit; returns the rows of files that could not be parsed."""
    rows = durable(files.extract(files.discover(spark, root, ignore, store.project)))
    store.replace(building.build(files.symbols_of(rows), files.calls_of(rows)))
    if repo:
        store.record_commit(git.commit(spark, repo))
    if embeddings:
        VectorIndex(store).build(git.run_git(["rev-parse", "HEAD"], repo).strip() if repo else None)
    return rows.where("kind = 'error'").select("file", "error")


def symbols_in_graph(g: PropertyGraph) -> DataFrame:
    """Symbol rows of the graph's nodes, but for files and commits."""
    back = F.create_map(*[F.lit(x) for t, label in LABEL_OF_TYPE.items() for x in (label, t)])
    n = g.nodes.where(~F.col("label").isin("File", "Commit"))
    return n.select(
        "project_id", F.struct("file", F.col("line").alias("seq")).alias("ord"), "node_id", F.coalesce(F.element_at(back, F.col("label")), F.lit("variable")).alias("type"), "name",
        qualified_name(F.col("parent"), F.col("name")).alias("qualified_name"), "file", "line", "column", "end_line", "docstring", "parent", F.lit(None).cast("string").alias("language"),
    )


def sync(spark: SparkSession, root: str, repo: str, range_: str, store: GraphStore, ignore: str = "") -> DataFrame:
    """Brings the graph up to a commit range and returns the delta.

    Symbols of changed files are compared with the graph's by qualified name; a rename is a deletion and an addition.
    Edges of the changed files are built anew, and edges of other files to symbols that are gone are dropped. The
    commit and its links to new and modified symbols are recorded, and vectors of those are made anew if the store has
    vectors. A repository of one commit has no range to compare: that commit is recorded, and the delta is empty.
    """
    if range_ == "HEAD~1..HEAD" and git.commit_count(repo) == 1:
        store.record_commit(git.commit(spark, repo))
        return spark.createDataFrame([], "file string, qualified_name string, op string, line int, type string")
    changes = as_changes(git.changed(spark, repo, range_)).where(F.lower(F.substring_index("file", ".", -1)).isin(*files.LANGUAGES)).select("file", "status").distinct()
    touched = durable(changes)
    names = [r["file"] for r in touched.where("status <> 'D'").select("file").distinct().collect()]  # of one commit range
    rows = durable(files.extract(files.discover(spark, root, ignore, store.project, names)))
    after, calls = files.symbols_of(rows), files.calls_of(rows)
    g = store.graph()
    known = symbols_in_graph(g)
    changed_files = touched.select("file").distinct()
    # A file that can't be parsed keeps what the graph has of it.
    changed_files = durable(changed_files.join(rows.where("kind = 'error'").select("file"), "file", "left_anti"))
    before = known.join(changed_files, "file", "left_semi")
    delta = durable(incremental.delta(before, after))
    kept = known.join(changed_files, "file", "left_anti")
    both = kept.unionByName(after)
    nodes = building.nodes_of(both)
    fresh = building.edges_of(both.join(changed_files, "file", "left_semi"), calls.limit(0)).where("type = 'DEFINES'")
    own = building.edges_of(both, calls)
    ids = after.select(F.col("node_id").alias("src_id"))
    own = own.join(ids, "src_id", "left_semi").unionByName(fresh)
    files_of = own.select("project_id", "src_id", "dst_id", "type", "src_label", "dst_label", "props")
    gone = before.select(F.col("node_id").alias("src_id"))
    old = g.edges.join(gone, "src_id", "left_anti").where("type <> 'MODIFIED_BY'")
    links = g.edges.where("type = 'MODIFIED_BY'")
    edges = incremental.valid_edges(nodes, old.unionByName(files_of)).unionByName(links.join(nodes.select(F.col("node_id").alias("src_id")), "src_id", "left_semi"))
    store.replace(PropertyGraph(durable(nodes), durable(edges)))
    head = git.commit(spark, repo, range_.rsplit("..", 1)[-1] or "HEAD")
    key = ["file", "qualified_name"]
    new = after.join(delta.where("op <> 'deleted'").select(*key), key, "left_semi").select("node_id")
    links = new.select(F.lit(head.first()["commit_hash"]).alias("commit_hash"), F.array("node_id").alias("node_ids"))
    store.record_commit(head, links)
    index = VectorIndex(store)
    if index.exists():
        index.refresh(new, head.first()["commit_hash"])
    return delta


def update(spark: SparkSession, root: str, repo: str, range_: str, store: GraphStore, ignore: str = "") -> DataFrame:
    """sync() with its result as a row (see store.UPDATES): whether it succeeded, what it changed, how long it took, or its error.

    The result and the delta are recorded in the store. A failure leaves the graph as it was: the versions that a sync
    had published before it failed are taken back.
    """
    began, at, delta, error = time.monotonic(), datetime.now(timezone.utc).replace(tzinfo=None), None, None
    before = store.manifest()
    try:
        delta = sync(spark, root, repo, range_, store, ignore)
        counts = {r["op"]: r["count"] for r in delta.groupBy("op").count().collect()}
        changed = delta.select("file").distinct().count()
    except Exception as e:  # the caller gets it as a result
        error, counts, changed, delta = f"{type(e).__name__}: {e}", {}, 0, None
        store.restore(before)
    row = (uuid.uuid4().hex, store.project, range_, at, error is None, changed, *(counts.get(op, 0) for op in ("added", "deleted", "modified")), 1000 * (time.monotonic() - began), error)
    result = spark.createDataFrame([row], UPDATES)
    store.record_update(result, delta)
    return result


def breaking_changes(spark: SparkSession, repo: str, path: str, before: str, after: str, symbol: str | None = None) -> DataFrame:
    """Comparison of a file's contracts at two commits, of all its functions or of one."""
    read = lambda ref: contracts.extract_contracts(git.history(spark, repo, "blobs", ref=ref).where(F.col("file") == path).select("file", F.col("content").cast("string").alias("source")))
    out = contracts.compare(read(before), read(after), ("file", "qualified_name"))
    return out if symbol is None else out.where(F.col("qualified_name") == symbol)
