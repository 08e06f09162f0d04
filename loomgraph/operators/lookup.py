"""Lookups and text search over nodes: ranked filters, top-k and bounded expansion by one hop."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import PropertyGraph, priority

BRIEF = ("node_id", "name", "label", "file", "line")


def has(column: Column | str, part: str) -> Column:
    """Case-insensitive substring."""
    return F.contains(F.lower(F.col(column) if isinstance(column, str) else column), F.lit(part.lower()))


def _ranked(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy(priority(F.col("label")), "file", "line", "node_id")


def node_by_id(g: PropertyGraph, node_id: str) -> DataFrame:
    return g.nodes.where(F.col("node_id") == node_id).limit(1)


def _named(g: PropertyGraph, name: str, file: str | None = None) -> DataFrame:
    found = g.nodes.where(F.col("name") == name)
    return found.where(F.contains("file", F.lit(file))) if file else found


def callees_of(g: PropertyGraph, nodes: DataFrame) -> DataFrame:
    """Distinct callees of the given nodes: (node_id, callee_id, callee, callee_file); callees without a name are dropped."""
    e = g.calls().join(nodes.select(F.col("node_id").alias("src_id")), "src_id", "left_semi")
    d = g.nodes.select(F.col("node_id").alias("dst_id"), F.col("name").alias("callee"), F.col("file").alias("callee_file")).where("callee is not null")
    return e.join(d, "dst_id").select(F.col("src_id").alias("node_id"), F.col("dst_id").alias("callee_id"), "callee", "callee_file")


def definition(g: PropertyGraph, name: str, file: str | None = None) -> DataFrame:
    """The best node of the name, a row per callee; one row with null callee if it calls nothing."""
    best = _ranked(_named(g, name, file)).limit(1)
    return best.select(*BRIEF).join(callees_of(g, best), "node_id", "left")


def homonyms(g: PropertyGraph, name: str) -> DataFrame:
    """All nodes of the name, if there are several."""
    found = _named(g, name).select(*BRIEF)
    many = found.agg((F.count(F.lit(1)) > 1).alias("many"))
    return found.crossJoin(F.broadcast(many)).where("many").drop("many")  # many is one row


def definition_by_name(g: PropertyGraph, name: str) -> DataFrame:
    """Callees of all nodes of the name, distinct by name and file."""
    return callees_of(g, _named(g, name)).select("callee", "callee_file").distinct()


def dotted(g: PropertyGraph, symbol: str) -> DataFrame:
    """Class.method by name and parent."""
    parent, _, name = symbol.rpartition(".")
    return g.nodes.where((F.col("name") == name) & (F.col("parent") == parent.rpartition(".")[2]))


def suggestions(g: PropertyGraph, text: str, limit: int = 5) -> DataFrame:
    """Names that contain the last part of the text, the shortest first."""
    part = text.rpartition(".")[2]
    return g.nodes.where(has("name", part)).select("name", "file", "label").distinct().orderBy(F.length("name"), "name", "file", "label").limit(limit)


def definition_fallback(g: PropertyGraph, symbol: str) -> DataFrame:
    """(stage, ...): by name and parent, else by the last name alone, else suggestions; rows of the first stage that has any."""
    cols = ("name", "file", "label", "line")
    stages = dotted(g, symbol).select(F.lit(1).alias("stage"), *cols)
    stages = stages.unionAll(g.nodes.where(F.col("name") == symbol.rpartition(".")[2]).select(F.lit(2), *cols))
    stages = stages.unionAll(suggestions(g, symbol).select(F.lit(3), "name", "file", "label", F.lit(None).cast("int")))
    first = stages.agg(F.min("stage").alias("first"))
    return stages.crossJoin(F.broadcast(first)).where("stage = first").drop("first")  # first is one row


def lookup(g: PropertyGraph, text: str) -> DataFrame:
    """One node by exact name, else dotted name, else shortest partial name, with its caller count and five callees; via tells how."""
    by = [(0, "exact", F.col("name") == text)]
    parent, dot, name = text.rpartition(".")
    if dot:
        by.append((1, "dotted", (F.col("name") == name) & (F.col("parent") == parent.rpartition(".")[2])))
    by.append((2, "partial", has("name", name)))
    how = F.lit(None).cast("int")
    for k, _, cond in reversed(by):
        how = F.when(cond, k).otherwise(how)
    names = F.create_map(*[x for k, n, _ in by for x in (F.lit(k), F.lit(n))])
    ranked = g.nodes.select(*BRIEF, how.alias("how")).where("how is not null")
    best = ranked.orderBy("how", F.when(F.col("how") == 2, F.length("name")).otherwise(0), priority(F.col("label")), "file", "line", "node_id").limit(1)
    e = g.calls()
    callers = e.join(best.select(F.col("node_id").alias("dst_id")), "dst_id", "left_semi").groupBy(F.col("dst_id").alias("node_id")).agg(F.count(F.lit(1)).alias("callers"))
    callees = callees_of(g, best).groupBy("node_id").agg(F.array_join(F.slice(F.array_sort(F.collect_set("callee")), 1, 5), ",").alias("callees"))
    return best.join(callers, "node_id", "left").join(callees, "node_id", "left").select(*BRIEF, F.element_at(names, F.col("how")).alias("via"), F.coalesce("callers", F.lit(0)).alias("callers"), F.coalesce("callees", F.lit("")).alias("callees"))


def grep(g: PropertyGraph, pattern: str, field: str = "both", label: str | None = None, module: str | None = None, top: int = 20) -> DataFrame:
    """Case-insensitive search in names and docstrings; alternatives by ``|``, each with its own top rows, deduplicated by (file, name, line)."""
    pattern = re.sub(r"^(?:def|class|async def)\s+", "", pattern.strip())
    nodes = g.nodes.where(~F.col("label").isin("Commit", "File"))
    if label:
        nodes = nodes.where(F.col("label") == label.capitalize())
    if module:
        nodes = nodes.where(F.contains("file", F.lit(module)))
    out = None
    for k, alt in enumerate(a.strip() for a in re.split(r"\\?\|", pattern) if a.strip()):
        name, doc = has("name", alt), has(F.coalesce("docstring", F.lit("")), alt)
        hit = {"name": name, "docstring": doc, "both": name | doc}[field]
        rows = nodes.where(hit).select(*BRIEF, "docstring", F.when(name, 0).otherwise(1).alias("rank"), F.lit(k).alias("alt"), F.lit(alt).alias("term"))
        rows = rows.orderBy("rank", "file", "line", "node_id").limit(top)
        out = rows if out is None else out.unionAll(rows)
    if out is None:
        return nodes.limit(0).select(*BRIEF, F.lit(0).alias("rank"), F.lit("").alias("snippet"))
    first = Window.partitionBy("file", "name", "line").orderBy("alt", "rank", "node_id")
    out = out.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return out.select(*BRIEF, "rank", snippet(F.coalesce("docstring", F.lit("")), F.col("term")).alias("snippet"))


def snippet(text: Column, term: Column, around: int = 40) -> Column:
    """The first hit with up to ``around`` characters on either side, on one line; empty without a hit."""
    at = F.call_function("locate", F.lower(term), F.lower(text))
    begin = F.greatest(F.lit(1), at - around)
    end = F.least(F.length(text), at + F.length(term) - 1 + around)
    cut = F.regexp_replace(F.substring(text, begin, end - begin + 1), "\n", " ")
    return F.when(at > 0, F.concat(F.when(begin > 1, "...").otherwise(""), cut, F.when(end < F.length(text), "...").otherwise(""))).otherwise("")


def list_symbols(g: PropertyGraph, module: str | None = None, label: str | None = None, limit: int = 0) -> DataFrame:
    """All nodes with a file but commits, ordered by file and line, with the number of rows their file has."""
    nodes = g.nodes.where((F.col("label") != "Commit") & F.col("file").isNotNull())
    if module:
        nodes = nodes.where(F.contains("file", F.lit(module)))
    if label:
        nodes = nodes.where(F.col("label") == label.capitalize())
    nodes = nodes.select(*BRIEF)
    if limit:
        nodes = nodes.orderBy("file", "line", "node_id").limit(limit)
    return nodes.join(nodes.groupBy("file").agg(F.count(F.lit(1)).alias("in_file")), "file").select(*BRIEF, "in_file")


def view_window(lines: DataFrame, name: str, line: int, end_line: int | None = None, context: int = 0, compact: bool = False) -> DataFrame:
    """Rows (line_no, text) of a source file around a symbol; a definition that moved by up to 20 lines is found again."""
    pattern = rf"^\s*(?:async\s+def|def|class)\s+{re.escape(name)}\b"
    near = lines.where(F.col("line_no").between(line - 20, line + 20) & F.col("text").rlike(pattern))
    moved = near.agg(F.min(F.struct(F.abs(F.col("line_no") - line).alias("d"), "line_no")).alias("m")).select(F.coalesce("m.line_no", F.lit(line)).alias("anchor"))
    length = (end_line - line) if end_line else 29
    length = min(length, 59) if compact else length
    return lines.crossJoin(F.broadcast(moved)).where(F.col("line_no").between(F.col("anchor") - context, F.col("anchor") + length + context)).select("line_no", "text")  # moved is one row


def resolve(g: PropertyGraph, symbol: str, file: str | None = None) -> DataFrame:
    """The node that a name means, as one row at most: functions before classes before others; a dotted name also by its last part, within its parent."""
    named = F.col("name") == symbol
    rank = F.when(named, 0).otherwise(1)
    if "." in symbol:
        owner, own = symbol.rsplit(".", 1)
        named = named | ((F.col("name") == own) & F.contains("parent", F.lit(owner)))
    found = g.nodes.where(named if file is None else named & F.contains("file", F.lit(file)))
    return found.orderBy(rank, priority(F.col("label")), "file", "line", "node_id").limit(1)


def view(g: PropertyGraph, lines: DataFrame, symbol: str, file: str | None = None, context: int = 0, compact: bool = False) -> DataFrame:
    """(file, line_no, text) of a symbol's source from (file, line_no, text) of all files; nothing if the graph lacks the symbol or its line."""
    row = resolve(g, symbol, file).first()
    if row is None or row["file"] is None or row["line"] is None:
        return lines.limit(0).select("file", "line_no", "text")
    end = row["end_line"] if "end_line" in g.nodes.columns else None
    own = lines.where(F.col("file") == row["file"])
    return view_window(own, symbol.rsplit(".", 1)[-1], row["line"], end, context, compact).select(F.lit(row["file"]).alias("file"), "line_no", "text")


# Words of a task that name no symbol.
STOP_WORDS = (
    "about", "after", "also", "around", "argument", "before", "between", "broad", "call", "calls", "change", "class", "code", "concept", "could",
    "define", "defined", "does", "entry", "every", "file", "files", "find", "first", "from", "function", "handle", "handles", "handling", "have",
    "here", "hook", "hooks", "implement", "implemented", "immediately", "improve", "into", "just", "library", "look", "main", "make", "method",
    "methods", "need", "only", "other", "place", "point", "points", "return", "should", "some", "struct", "structure", "symbol", "than", "that",
    "their", "then", "there", "these", "this", "those", "understand", "used", "using", "what", "when", "where", "which", "will", "with", "work",
    "would", "write", "your",
)
# What looks like a class or method name, and like a function name.
CAMEL, SNAKE = r"\b[A-Z][a-z][A-Za-z]{2,}\b", r"\b[a-z][a-z_]{4,}\b"


def task_terms(task: str, most: int = 5) -> list[str]:
    out: dict[str, str] = {}
    for word in re.findall(CAMEL, task) + re.findall(SNAKE, task):
        if word.lower() not in STOP_WORDS:
            out.setdefault(word.lower(), word)
    return list(out.values())[:most]


def orient(g: PropertyGraph, task: str, top: int = 6) -> DataFrame:
    """For each of a task's terms, the nodes whose names contain it: exact names first, then by file."""
    code = g.nodes.where(~F.col("label").isin("File", "Module")).select(*BRIEF)
    terms = task_terms(task)
    if not terms:
        return code.limit(0).select(F.lit("").alias("term"), *BRIEF)
    hit = F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.lower("name"), F.lower(t)))
    rows = code.withColumn("term", F.explode(hit))
    exact = F.when(F.lower("name") == F.lower("term"), 0).otherwise(1)
    best = Window.partitionBy("term").orderBy(exact, "file", "line", "node_id")
    return rows.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= top).select("term", *BRIEF)


def callers(g: PropertyGraph, name: str) -> DataFrame:
    """Distinct nodes that call a node of the name."""
    e = g.calls().join(_named(g, name).select(F.col("node_id").alias("dst_id")), "dst_id", "left_semi")
    return g.nodes.join(e.select(F.col("src_id").alias("node_id")).distinct(), "node_id", "left_semi").select(*BRIEF)
