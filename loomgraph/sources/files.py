"""Discovery of source files, ignore rules, and extraction of symbols and calls in one pass over the files."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..schema import node_id, qualified_name
from .braces import extract_braces
from .python_source import extract_python

# Languages by extension, and folders that are never sources.
LANGUAGES = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript", "go": "go", "rs": "rust", "java": "java", "cs": "csharp"}
SKIP_DIRS = (
    "node_modules", ".next", ".venv", "venv", "__pycache__", "generated", "dist", "build", "target", ".git", ".tox",
    "coverage", "htmlcov", ".mypy_cache", ".pytest_cache", ".ruff_cache", "bin", "obj",
)


def ignore_rules(text: str) -> tuple[list[str], list[str]]:
    """(patterns of path parts, patterns of paths) of an ignore file: comments and blanks out, trailing slashes off."""
    rules = [r.rstrip("/") for line in text.splitlines() if (r := line.strip()) and not r.startswith("#")]
    return [r for r in rules if "/" not in r], [r for r in rules if "/" in r]


def _regex(glob: str) -> str:
    return fnmatch.translate(glob).replace("(?s:", "(?:").replace(r"\Z", "").replace(r"\z", "")


def is_ignored(path: Column, rules: tuple[list[str], list[str]]) -> Column:
    """A rule without a slash fits any part of the path; one with a slash the whole path, or all below it."""
    parts, paths = rules
    out = F.exists(F.split(path, "/"), lambda p: p.isin(*SKIP_DIRS))
    for r in parts:
        pattern = f"(?s)^{_regex(r)}$"
        out = out | F.exists(F.split(path, "/"), lambda p: p.rlike(pattern))
    for r in paths:
        out = out | path.rlike(f"(?s)^{_regex(r)}$") | path.rlike(f"(?s)^{_regex(r + '/*')}$")
    return out


def discover(spark: SparkSession, root: str, ignore: str = "", project: str = "", only: list[str] | None = None) -> DataFrame:
    """(project_id, file, language, content) of the sources below a folder; file is relative to it.

    only: files to read in place of all, of which those that are missing are left out.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(LANGUAGES) + "}")
    if only is None:
        raw = reader.load(root)
    else:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        paths = [jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{f}") for f in only]
        there = [f"{root.rstrip('/')}/{f}" for f, p in zip(only, paths, strict=True) if p.getFileSystem(conf).exists(p)]
        raw = reader.load([re.sub(r"([\[\]{}*?\\])", r"\\\1", x) for x in there]) if there else spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    plain = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    at = F.regexp_replace(F.lit(root), r"^[a-z]+:/+", "/")
    file = F.regexp_replace(F.replace(plain, F.regexp_replace(at, "/+$", ""), F.lit("")), "^/+", "")
    by_ext = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    rows = raw.select(F.lit(project).alias("project_id"), file.alias("file"), F.element_at(by_ext, F.lower(F.substring_index(file, ".", -1))).alias("language"), "content")
    return rows.where(~is_ignored(F.col("file"), ignore_rules(ignore)))


def extract_source(language: str, file: str, content: bytes) -> tuple[list[dict], list[dict]]:
    """(symbols, calls) of one file; calls are (caller line, name and call text)."""
    text = content.decode("utf-8", "replace")
    return extract_python(text, file) if language == "python" else extract_braces(text, file, language)


#: kind is symbol, call or error; an error row keeps the message of a file that could not be read.
ROWS = (
    "project_id string, file string, language string, kind string, seq int, type string, name string, line int, column int, end_line int, docstring string, parent string, "
    "caller_type string, caller_line int, caller_name string, call_text string, error string"
)


def extract(files: DataFrame) -> DataFrame:
    """All rows of all files, each parsed once; a file that fails yields one error row and stops nothing."""
    schema = to_arrow_schema(StructType.fromDDL(ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for f in batch.to_pylist():
                base = {k: f[k] for k in ("project_id", "file", "language")}
                try:
                    symbols, calls = extract_source(f["language"], f["file"], f["content"] or b"")
                except Exception as e:  # one broken file is a row, not the end of the job
                    out.append(base | {"kind": "error", "seq": 0, "error": f"{type(e).__name__}: {e}"})
                    continue
                out += [base | {"kind": "symbol", "seq": k} | s for k, s in enumerate(symbols)]
                out += [base | {"kind": "call", "seq": k} | c for k, c in enumerate(calls)]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return files.select("project_id", "file", "language", "content").mapInArrow(run, ROWS)


def symbols_of(rows: DataFrame) -> DataFrame:
    """The symbol table; ord follows the files' names and the order inside each, in sortable form: file, then seq."""
    own = rows.where("kind = 'symbol'")
    order = F.struct("file", "seq")
    return own.select(
        "project_id", order.alias("ord"), node_id(F.col("type"), F.col("file"), F.col("line"), F.col("name")).alias("node_id"), "type", "name",
        qualified_name(F.col("parent"), F.col("name")).alias("qualified_name"), "file", "line", "column", "end_line", "docstring", "parent", "language",
    )


def calls_of(rows: DataFrame) -> DataFrame:
    own = rows.where("kind = 'call'")
    return own.select("project_id", node_id(F.col("caller_type"), F.col("file"), F.col("caller_line"), F.col("caller_name")).alias("caller_id"), F.col("file").alias("caller_file"), "call_text").distinct()
