"""Analytics of session logs: from JSON lines to timelines, tool and pattern counts, and comparisons over time.

Logs are (session, seq, type, content array<struct>). Each operator is a grouping, a window over a session, or an
interval join; the pattern detectors are boolean expressions evaluated in one pass and unpivoted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CONTENT = "array<struct<type:string,id:string,name:string,input:map<string,string>,tool_use_id:string,content:string,is_error:boolean,text:string>>"
EVENT = f"type string, subtype string, num_turns long, total_cost_usd double, usage struct<cache_read_input_tokens:long,output_tokens:long>, message struct<content:{CONTENT}>"


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """(session, seq, type, content, subtype, num_turns, total_cost_usd, usage) from JSON lines; a session is a file, seq its line."""
    # Lines in their files' order: by the block that they were read in, and within it as they came.
    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    number = F.row_number().over(Window.partitionBy("path").orderBy("block", "at")) - 1
    raw = lines.select(F.regexp_extract("name", r"^(.*?)(?:\.jsonl)?$", 1).alias("session"), number.alias("seq"), "line")
    parsed = raw.where(F.trim("line") != "").select("session", F.col("seq").cast("long").alias("seq"), F.from_json("line", EVENT).alias("e"))
    return parsed.select("session", "seq", F.col("e.type").alias("type"), F.col("e.message.content").alias("content"), "e.subtype", "e.num_turns", "e.total_cost_usd", "e.usage")


def session_time(session: Column) -> Column:
    """The time at the end of a file's stem: YYYY-MM-DDTHH-MM-SS."""
    stamp = F.regexp_extract(session, r"(\d{4}-\d{2}-\d{2}T\d{2}-\d{2}-\d{2})$", 1)
    return F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd'T'HH-mm-ss"))


def instance_of(session: Column) -> Column:
    """What precedes the tool and the time in a file's stem: instance__tool__time."""
    return F.regexp_extract(session, r"^(.*?)__[^_]+__\d{4}-", 1)


def batch_label(ts: Column) -> Column:
    """MM-DDTHH: one label per hour, in order of time within a year."""
    return F.date_format(ts, "MM-dd'T'HH")


def timeline(logs: DataFrame) -> DataFrame:
    """(session, turn, seq, pos, name, input, result, is_error): tool uses with their results.

    turn counts assistant events so far; the last result of an id counts; without a flag a result is an error if it
    starts with Exit code but for Exit code 0; a use without a result has ``(no result)``.
    """
    so_far = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    turned = logs.withColumn("turn", F.sum(F.when(F.col("type") == "assistant", 1).otherwise(0)).over(so_far))
    uses = turned.where("type = 'assistant'").select("session", "turn", "seq", F.posexplode("content").alias("pos", "c")).where("c.type = 'tool_use'")
    results = logs.select("session", "seq", F.posexplode("content").alias("pos", "c")).where("c.type = 'tool_result'")
    results = results.groupBy("session", F.col("c.tool_use_id").alias("id")).agg(F.max_by("c", F.struct("seq", "pos")).alias("r"))
    text = F.coalesce(F.col("r.content"), F.lit(""))
    error = F.coalesce(F.col("r.is_error"), text.startswith("Exit code") & ~F.contains(text, F.lit("Exit code 0")))
    met = uses.select("session", "turn", "seq", "pos", F.col("c.id").alias("id"), F.col("c.name").alias("name"), F.col("c.input").alias("input")).join(results, ["session", "id"], "left")
    return met.select("session", "turn", "seq", "pos", "name", "input", F.when(F.col("r").isNull(), "(no result)").otherwise(text).alias("result"), F.col("r").isNotNull() & error)\
        .toDF("session", "turn", "seq", "pos", "name", "input", "result", "is_error")


def arg(key: str) -> Column:
    return F.coalesce(F.element_at("input", key), F.lit(""))


def detectors(tool: str) -> dict[str, tuple[str, Column]]:
    """Pattern -> (severity, condition on a timeline row) for logs in which ``tool`` is the command of the graph tool."""
    cmd = F.trim(arg("command"))
    bash, err, result = F.col("name") == "Bash", F.col("is_error"), F.col("result")
    failed, read = bash & err, (F.col("name") == "Read") & F.col("is_error")
    says = lambda s: F.contains(result, F.lit(s))
    runs = lambda sub: cmd.rlike(rf"^{tool}\s+{sub}\b")
    part = F.element_at(F.split(cmd, r"\s+&&\s+|\s+\|\s+"), 1)
    blocked, offset = read & says("Full-file read blocked"), F.element_at("input", "offset")
    empty_offset = offset.isNotNull() & offset.isin("", "0")
    # Names, severities, and what the conditions look for.
    return {
        "P01_symbol_not_found": ("HIGH", failed & runs("(?:definition|view|lookup)") & says("not found in graph")),
        "P02_view_depth_flag": ("MED", failed & cmd.rlike(rf"{tool}\s+view\b.*--depth")),
        "P03_grep_wrong_flag": ("HIGH", bash & runs("grep") & part.rlike(r"--compact|--head(?:_limit)?")),
        "P04_unsupported_file": ("MED", failed & cmd.rlike(rf"{tool}\s+(?:impact|grep|lookup)\b.*--file")),
        "P05_multiple_symbols": ("MED", failed & says("Multiple symbols")),
        "P06_cd_bad_path": ("HIGH", failed & cmd.rlike(r"^cd\s+") & (says("No such file") | says("bash: line"))),
        "P07_backslash_path": ("HIGH", failed & cmd.rlike(r'(?<!")(?:grep|find|cat|head)\b[^"]*[A-Z]:\\')),
        "P08_windows_cmd_tools": ("HIGH", failed & cmd.rlike(r"\b(?:findstr|Get-Content|Select-String)\b")),
        "P09_scope_ambiguous": ("HIGH", failed & F.contains(cmd, F.lit(f"{tool} scope")) & says("Multiple files match")),
        "P10_dotenv_errors": ("CRIT", failed & says("python-dotenv could not parse")),
        "P11_view_file_missing": ("MED", failed & cmd.rlike(rf"{tool}\s+view\b") & says("File not found")),
        "P12_pytest_broken": ("LOW", failed & F.contains(cmd, F.lit("pytest")) & says("ImportError")),
        "P13_wsl_path": ("MED", failed & F.contains(cmd, F.lit("/mnt/c/"))),
        "P14_pipe_masks_error": ("MED", bash & ~err & cmd.rlike(rf"^{tool}\s+") & F.contains(cmd, F.lit("|")) & cmd.rlike(r"--output_mode\b")),
        "P15_read_directory": ("MED", read & says("EISDIR")),
        "P16_read_empty_offset": ("HIGH", blocked & empty_offset),
        "P17_read_blocked": ("HIGH", blocked & ~empty_offset),
        "P18_grep_tool_blocked": ("HIGH", (F.col("name") == "Grep") & err & says("Grep blocked")),
        "P19_lookup_regen": ("MED", bash & cmd.startswith(f"{tool} lookup") & says("Generating embeddings")),
        "P20_list_empty": ("LOW", bash & cmd.startswith(f"{tool} list") & says("No symbols found")),
    }


#: Patterns in words.
MEANINGS = {
    "P01_symbol_not_found": "the symbol asked for is not in the graph, often a method under another name",
    "P02_view_depth_flag": "view takes no --depth; context does",
    "P03_grep_wrong_flag": "grep called with a flag of another command",
    "P04_unsupported_file": "--file given to a command without it; definition, view and context have it",
    "P05_multiple_symbols": "several symbols have the name; --file would tell them apart",
    "P06_cd_bad_path": "cd to a folder that is not there, so what follows fails or runs elsewhere",
    "P07_backslash_path": "a path with backslashes without quotes, which the shell takes out",
    "P08_windows_cmd_tools": "a command of another operating system's shell",
    "P09_scope_ambiguous": "scope of a bare file name that several files have",
    "P10_dotenv_errors": "the environment file cannot be parsed, which fails every command of the project",
    "P11_view_file_missing": "the symbol is in the graph, but its source file is not checked out",
    "P12_pytest_broken": "the tests cannot be imported in this environment",
    "P13_wsl_path": "a path of a subsystem that is not there",
    "P14_pipe_masks_error": "a pipe's last command hides that the first one failed",
    "P15_read_directory": "a folder read as a file",
    "P16_read_empty_offset": "an empty offset counts as reading the whole file, which is blocked",
    "P17_read_blocked": "reading a whole file is blocked until the tool was asked",
    "P18_grep_tool_blocked": "the search tool is blocked; the graph tool's own search is meant",
    "P19_lookup_regen": "lookup built the vectors anew; a build should have made them",
    "P20_list_empty": "list found nothing: a module's name differs from its path",
}


def pattern_meta(spark: SparkSession, tool: str) -> DataFrame:
    """(pattern, severity, description): a row per pattern, to join with hits."""
    return spark.createDataFrame([(p, s, MEANINGS[p]) for p, (s, _) in detectors(tool).items()], "pattern string, severity string, description string")


def scan_detectors(tool: str) -> dict[str, tuple[str, Column]]:
    """The detectors of a scan over all sessions: narrower P03 and P04, wider P02, P07, P08 and P14, P14b more, P19 and P20 not."""
    cmd = F.trim(arg("command"))
    bash, err = F.col("name") == "Bash", F.col("is_error")
    failed, part = bash & err, F.element_at(F.split(cmd, r"\s+&&\s+|\s+\|\s+"), 1)
    out = {p: d for p, d in detectors(tool).items() if p not in ("P19_lookup_regen", "P20_list_empty")}
    # What the conditions look for.
    return dict(sorted((out | {
        "P02_view_depth_flag": ("MED", failed & cmd.rlike(rf"{tool} view.*--depth")),
        "P03_grep_wrong_flag": ("HIGH", failed & cmd.rlike(rf"^{tool} grep") & part.rlike(r"--compact|--head(?:_limit)?")),
        "P04_unsupported_file": ("MED", failed & cmd.rlike(rf"{tool} (?:impact|grep)\b.*--file")),
        "P07_backslash_path": ("HIGH", failed & cmd.rlike(r"(?:grep|find|cat|head)\b.*[A-Z]:\\\\")),
        "P08_windows_cmd_tools": ("HIGH", failed & cmd.rlike(r"findstr|Get-Content|Select-String")),
        "P14_pipe_masks_error": ("MED", bash & ~err & F.contains(cmd, F.lit("|")) & cmd.rlike(rf"^{tool}\s+") & F.contains(cmd, F.lit("--output_mode"))),
        "P14b_grep_output_mode": ("MED", failed & F.contains(cmd, F.lit(f"{tool} grep")) & F.contains(cmd, F.lit("--output_mode"))),
    }).items()))


def example() -> Column:
    """What a hit shows: the command, the file, or the pattern."""
    name = F.col("name")
    path = arg("file_path")
    return F.when(name == "Read", F.substring_index(path, "/", -1)).when(name == "Grep", F.substring(arg("pattern"), 1, 60)).otherwise(F.substring(arg("command"), 1, 80))


def pattern_rows(tl: DataFrame, tool: str, of: Callable[[str], dict[str, tuple[str, Column]]] = detectors) -> DataFrame:
    """(session, pattern, severity, seq, pos, example): a row per hit, all detectors in one pass."""
    hits = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(p).alias("pattern"), F.lit(s).alias("severity"))) for p, (s, c) in of(tool).items()]), lambda x: x.isNotNull())
    return tl.select("session", "seq", "pos", F.explode(hits).alias("h"), example().alias("example")).select("session", "h.pattern", "h.severity", "seq", "pos", "example")


def pattern_hits(tl: DataFrame, tool: str) -> DataFrame:
    return pattern_rows(tl, tool).groupBy("session", "pattern", "severity").agg(F.count(F.lit(1)).alias("hits"))


def pattern_scan(tl: DataFrame, tool: str, examples: int = 5) -> DataFrame:
    """Hits of each pattern of the scan over all sessions, with the first few examples; the few are picked before they are gathered."""
    rows = pattern_rows(tl, tool, scan_detectors)
    first = Window.partitionBy("pattern").orderBy("session", "seq", "pos")
    some = rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= examples).groupBy("pattern").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "example"))), lambda x: x["example"]).alias("examples"))
    return rows.groupBy("pattern", "severity").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("session").alias("sessions")).join(some, "pattern")


def pattern_matrix(hits: DataFrame, patterns: list[str]) -> DataFrame:
    """A row per session, a column per pattern."""
    return hits.groupBy("session").pivot("pattern", patterns).agg(F.sum("hits")).na.fill(0)


def tool_totals(tl: DataFrame, by: tuple[str, ...] = ("session", "name")) -> DataFrame:
    return tl.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), F.count_if("is_error").alias("errors"))


def tool_usage(tl: DataFrame, tool: str) -> DataFrame:
    """(session, tool_ok, tool_err, fallback, first_fallback_turn, abandoned_turn) over Bash calls.

    abandoned: the last turn with the tool if Bash goes on for more than four turns after it; 1 if it was never used.
    """
    b = tl.where("name = 'Bash'").withColumn("own", F.trim(arg("command")).rlike(rf"^{tool}\b"))
    last_tool, last = F.max(F.when(F.col("own"), F.col("turn"))), F.max("turn")
    return b.groupBy("session").agg(
        F.count_if(F.col("own") & ~F.col("is_error")).alias("tool_ok"), F.count_if(F.col("own") & F.col("is_error")).alias("tool_err"), F.count_if(~F.col("own")).alias("fallback"),
        F.min(F.when(~F.col("own"), F.col("turn"))).alias("first_fallback_turn"), F.when(last_tool.isNull(), 1).when(last > last_tool + 4, last_tool).alias("abandoned_turn"),
    )


def subcommands(tl: DataFrame, tool: str) -> DataFrame:
    sub = F.regexp_extract(F.trim(arg("command")), rf"^{tool}\s+([\w-]+)", 1)
    return tl.where("name = 'Bash'").select("session", sub.alias("subcommand")).where("subcommand <> ''").groupBy("session", "subcommand").agg(F.count(F.lit(1)).alias("calls"))


def call_classes(tl: DataFrame) -> DataFrame:
    """(session, name, class, calls) of Read, Grep, Skill, Edit, Write and Glob calls."""
    blocked = F.col("is_error") | F.contains("result", F.lit(" blocked"))
    offset = F.element_at("input", "offset").isNotNull() | F.element_at("input", "limit").isNotNull()
    kind = F.when(F.col("name") == "Read", F.when(F.col("is_error") | F.contains("result", F.lit("Full-file read blocked")), "blocked").when(offset, "partial").otherwise("ok"))
    kind = kind.when(F.col("name") == "Grep", F.when(blocked, "blocked").otherwise("ok")).otherwise(F.when(F.col("is_error"), "failed").otherwise("ok"))
    return tl.where(F.col("name").isin("Read", "Grep", "Skill", "Edit", "Write", "Glob")).groupBy("session", "name", kind.alias("class")).agg(F.count(F.lit(1)).alias("calls"))


def failed_commands(tl: DataFrame, tool: str, subcommand: str, width: int = 80) -> DataFrame:
    """(session, turn, command, result): failed calls of one subcommand, with the start of what they printed."""
    failed = (F.col("name") == "Bash") & F.col("is_error") & F.trim(arg("command")).startswith(f"{tool} {subcommand}")
    return tl.where(failed).select("session", "turn", F.trim(arg("command")).alias("command"), F.substring("result", 1, width).alias("result"))


def task_text(logs: DataFrame, width: int = 200) -> DataFrame:
    """(session, task): the line after **Task:** of the first user text with one, else the start of the first arguments of an analysis skill, else ``?``."""
    line = r"(?d)\*\*Task:\*\*\s*(.+?)(?:\n|$)"
    blocks = logs.select("session", "type", "seq", F.posexplode("content").alias("pos", "c"))
    said = F.when((F.col("type") == "user") & (F.col("c.type") == "text") & F.col("c.text").rlike(line), F.trim(F.regexp_extract("c.text", line, 1)))
    args = F.element_at("c.input", "args")
    asked = (F.col("type") == "assistant") & (F.col("c.type") == "tool_use") & (F.col("c.name") == "Skill") & F.element_at("c.input", "skill").endswith("-analysis") & (args != "")
    at = F.struct("seq", "pos")
    first = lambda x: F.min_by(x, F.when(x.isNotNull(), at))
    found = blocks.groupBy("session").agg(first(said).alias("said"), first(F.when(asked, F.substring(args, 1, width))).alias("asked"))
    return logs.select("session").distinct().join(found, "session", "left").select("session", F.coalesce("said", "asked", F.lit("?")).alias("task"))


def prompt_with(logs: DataFrame, marker: str) -> DataFrame:
    """(session, prompt): the first text block that holds the marker."""
    texts = logs.select("session", "seq", F.posexplode("content").alias("pos", "c")).where(F.contains("c.text", F.lit(marker)))
    return texts.groupBy("session").agg(F.min_by("c.text", F.struct("seq", "pos")).alias("prompt"))


def line_difference(a: Column, b: Column) -> Column:
    """Lines of a that b lacks, sorted."""
    return F.array_sort(F.array_except(F.split(a, "\n"), F.split(b, "\n")))


def session_facts(logs: DataFrame, tool: str) -> DataFrame:
    """One wide row per session: outcome, turns, cost, tokens, calls, errors, tool use and pattern hits."""
    tl = timeline(logs)
    end = logs.where("type = 'result'").groupBy("session").agg(F.max_by(F.struct("subtype", "num_turns", "total_cost_usd", "usage"), "seq").alias("r"))
    calls = tl.groupBy("session").agg(F.count(F.lit(1)).alias("total_calls"), F.count_if("is_error").alias("total_errors"), *[F.count_if(F.col("name") == n).alias(n.lower()) for n in ("Bash", "Read", "Skill", "Edit", "Grep")])
    names = list(detectors(tool))
    base = logs.select("session").distinct().select("session", session_time(F.col("session")).alias("ts"), instance_of(F.col("session")).alias("instance"))
    out = base.join(end, "session", "left").join(calls, "session", "left").join(tool_usage(tl, tool), "session", "left").join(pattern_matrix(pattern_hits(tl, tool), names), "session", "left")
    fixed = ["session", "instance", "ts", F.col("r.subtype").alias("outcome"), F.col("r.num_turns").alias("turns"), F.col("r.total_cost_usd").alias("cost"), F.col("r.usage.cache_read_input_tokens").alias("cache_tokens"), F.col("r.usage.output_tokens").alias("output_tokens")]
    counts = ["total_calls", "total_errors", "bash", "read", "skill", "edit", "grep", "tool_ok", "tool_err", "fallback", *names]
    return out.select(*fixed, "first_fallback_turn", "abandoned_turn", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


# Metrics that may rise without being a regression, and one that must not fall.
MAY_RISE, MUST_RISE = ("total_calls", "bash", "read", "tool_ok", "edit", "read_partial"), ("tool_ok",)
#: What a batch is compared by, besides its patterns.
METRICS = ("cost", "turns", "total_calls", "total_errors", "bash", "read", "skill", "edit", "grep", "tool_ok", "tool_err", "fallback")


def session_counts(tl: DataFrame, tool: str) -> DataFrame:
    """(session, total_calls, total_errors, a column per tool, read_partial, read_blocked, tool_ok, tool_err, fallback, a column per pattern) of each session with calls."""
    names = list(detectors(tool))
    read = call_classes(tl).where("name = 'Read'").groupBy("session").agg(*[F.sum(F.when(F.col("class") == c, F.col("calls"))).alias(f"read_{c}") for c in ("partial", "blocked")])
    calls = tl.groupBy("session").agg(F.count(F.lit(1)).alias("total_calls"), F.count_if("is_error").alias("total_errors"), *[F.count_if(F.col("name") == n).alias(n.lower()) for n in ("Bash", "Read", "Skill", "Edit", "Grep", "Glob", "Write")])
    used = tool_usage(tl, tool).select("session", "tool_ok", "tool_err", "fallback")
    out = calls.join(read, "session", "left").join(used, "session", "left").join(pattern_matrix(pattern_hits(tl, tool), names), "session", "left")
    return out.na.fill(0, [c for c in out.columns if c != "session"])


def batch_report(facts: DataFrame, tool: str) -> DataFrame:
    """batch_trend over every metric: METRICS, and all patterns, from facts with ts and a column for each."""
    return batch_trend(facts, [*METRICS, *detectors(tool)])


def batch_trend(facts: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, first_total, first_avg, last_total, last_avg, trend, verdict): the first batch of an hour against the last."""
    long = facts.select(batch_label(F.col("ts")).alias("batch"), "ts", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.coalesce(F.col(m), F.lit(0)).cast("double").alias("x")) for m in metrics])).alias("m")).select("batch", "ts", "m.*")
    sums = long.groupBy("metric", "batch").agg(F.min("ts").alias("begin"), F.sum("x").alias("total"), F.avg("x").alias("avg"))
    ends = sums.groupBy("metric").agg(F.min_by(F.struct("batch", "total", "avg"), F.struct("begin", "batch")).alias("a"), F.max_by(F.struct("batch", "total", "avg"), F.struct("begin", "batch")).alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    t1, t2 = F.col("a.total"), F.col("b.total")
    d = t2 - t1
    percent = lambda x: F.concat(F.round(100 * F.abs(d) / t1).cast("long").cast("string"), F.lit("%"))
    trend = F.when(F.abs(d) < 0.001, "=").when(d > 0, F.when(t1 < 0.001, F.concat(F.lit("+"), t2.cast("long").cast("string"), F.lit(" NEW"))).otherwise(F.concat(F.lit("+"), percent(d)))).when(t1 < 0.001, "=").otherwise(F.concat(F.lit("-"), percent(d)))
    verdict = F.when(F.abs(d) < 0.001, "same").when(d > 0, F.when(F.col("metric").isin(*MAY_RISE), "neutral").otherwise("regression")).when(F.col("metric").isin(*MUST_RISE), "regression").otherwise("improvement")
    return ends.select("metric", t1.alias("first_total"), F.col("a.avg").alias("first_avg"), t2.alias("last_total"), F.col("b.avg").alias("last_avg"), trend.alias("trend"), verdict.alias("verdict"))


def _ends(facts: DataFrame, *columns: str) -> DataFrame:
    """(instance, a, b): structs of an instance's first and last session; numbers that are missing are 0."""
    at, x = F.struct("ts", "session"), F.struct(*[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in columns])
    return facts.groupBy("instance").agg(F.min_by(x, at).alias("a"), F.max_by(x, at).alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")


def _verdict(margin: float) -> Column:
    d = F.col("b.cost") - F.col("a.cost")
    return F.when(d < -margin, "better").when(d > margin, "worse").otherwise("same")


def first_last_verdict(facts: DataFrame, margin: float = 0.005) -> DataFrame:
    """(instance, first_cost, last_cost, verdict): an instance's first session against its last, by cost; no cost is 0."""
    return _ends(facts, "cost").select("instance", F.col("a.cost").alias("first_cost"), F.col("b.cost").alias("last_cost"), _verdict(margin).alias("verdict"))


def pattern_deltas(facts: DataFrame, patterns: list[str], margin: float = 0.005) -> DataFrame:
    """(instance, pattern, first_hits, last_hits): of instances that got worse, the patterns with more hits in the last session than in the first."""
    worse = _ends(facts, "cost", *patterns).where(_verdict(margin) == "worse")
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(f"a.{p}").alias("first_hits"), F.col(f"b.{p}").alias("last_hits")) for p in patterns]))
    return worse.select("instance", each.alias("d")).select("instance", "d.*").where("last_hits > first_hits")


def batch_gap_commits(batches: DataFrame, commits: DataFrame, keywords: dict[str, str] | None = None) -> DataFrame:
    """Commits between consecutive batches, as (batch, next_batch, commit_hash, ts, pattern).

    batches (batch, begin); commits (commit_hash, ts, message). Gaps are cut at day borders, so that a commit meets
    only the gaps of its day by an equi join. pattern is the first whose keyword the message holds.
    """
    order = Window.orderBy("begin", "batch")  # a row per batch
    gaps = batches.select("batch", F.col("begin").alias("lo"), F.lead("begin").over(order).alias("hi"), F.lead("batch").over(order).alias("next_batch")).where("hi is not null")
    days = gaps.withColumn("day", F.explode(F.sequence(F.to_date("lo"), F.to_date("hi"))))
    pattern = F.lit(None).cast("string")
    for word, name in reversed(list((keywords or {}).items())):
        pattern = F.when(F.contains(F.lower("message"), F.lit(word.lower())), name).otherwise(pattern)
    met = commits.withColumn("day", F.to_date("ts")).join(days, "day").where("ts > lo and ts <= hi")
    return met.select("batch", "next_batch", "commit_hash", "ts", pattern.alias("pattern"))
