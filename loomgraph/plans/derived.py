"""A property graph, sessions and tasks derived from ordinary tables, and the same in SQL.

Parts are symbols (their brand is the file, their size the line); consecutive lines of an order are calls; orders are
commits; users' events are session logs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import PropertyGraph

#: Lines among which a task looks for equal ones.
LINES_A_TASK = 1_000_000
LABELS = {"STANDARD": "Function", "SMALL": "Function", "PROMO": "Function", "MEDIUM": "Class", "LARGE": "Variable", "ECONOMY": "Module"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    p = table(spark, sf_dir, "part")
    label = F.element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), F.col("p_type"))
    nodes = p.select(
        F.lit("").alias("project_id"), F.col("p_partkey").cast("string").alias("node_id"), label.alias("label"), F.col("p_name").alias("name"), F.col("p_brand").alias("file"),
        F.col("p_size").alias("line"), F.concat_ws(" ", "p_type", "p_brand", "p_name").alias("docstring"), F.substring_index("p_name", " ", 1).alias("parent"),
    )
    items = table(spark, sf_dir, "lineitem")
    a = items.select("l_orderkey", F.col("l_partkey").cast("string").alias("src_id"), (F.col("l_linenumber") + 1).alias("l_linenumber"))
    b = items.select("l_orderkey", F.col("l_partkey").cast("string").alias("dst_id"), "l_linenumber")
    calls = a.join(b, ["l_orderkey", "l_linenumber"]).select("src_id", "dst_id").distinct()
    return PropertyGraph(nodes, calls.withColumn("type", F.lit("CALLS")))


GRAPH_SQL = f"""nodes AS (SELECT p_partkey::VARCHAR AS node_id, CASE p_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items())} END AS label, p_name AS name, p_brand AS file, p_size AS line,
  p_type || ' ' || p_brand || ' ' || p_name AS docstring, split_part(p_name, ' ', 1) AS parent FROM part),
calls AS (SELECT DISTINCT a.l_partkey::VARCHAR AS src_id, b.l_partkey::VARCHAR AS dst_id FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1),
ends AS (SELECT c.src_id, c.dst_id, s.name AS s_name, s.file AS s_file, s.label AS s_label, d.name AS d_name, d.file AS d_file, d.label AS d_label
  FROM calls c JOIN nodes s ON s.node_id = c.src_id JOIN nodes d ON d.node_id = c.dst_id)"""


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a timeline of tool calls, a session per user."""
    e = table(spark, sf_dir, "events")
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    v, kind = F.col("value"), F.col("event_type")
    command = F.when(v < 15, "tool view sym --depth 2").when(v < 30, "tool grep sym --compact").when(v < 45, "tool lookup sym --file a.py").when(v < 60, "findstr sym").otherwise("tool list")
    return e.select(
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session"), F.row_number().over(by).alias("turn"), F.row_number().over(by).alias("seq"), F.lit(0).alias("pos"),
        F.when(kind.isin("click", "error"), "Bash").when(kind == "view", "Read").when(kind == "purchase", "Edit").otherwise("Grep").alias("name"),
        F.create_map(F.lit("command"), command, F.lit("pattern"), F.get_json_object("props", "$.k")).alias("input"),
        F.when(v < 50, "not found in graph").otherwise("No symbols found").alias("result"), (kind == "error").alias("is_error"), "ts",
    )


TIMELINE_SQL = """tl AS (SELECT 's' || user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn, ts,
  CASE WHEN event_type IN ('click', 'error') THEN 'Bash' WHEN event_type = 'view' THEN 'Read' WHEN event_type = 'purchase' THEN 'Edit' ELSE 'Grep' END AS name,
  CASE WHEN value < 15 THEN 'tool view sym --depth 2' WHEN value < 30 THEN 'tool grep sym --compact' WHEN value < 45 THEN 'tool lookup sym --file a.py' WHEN value < 60 THEN 'findstr sym' ELSE 'tool list' END AS command,
  CASE WHEN value < 50 THEN 'not found in graph' ELSE 'No symbols found' END AS result, event_type = 'error' AS is_error FROM events),
hits AS (SELECT session, turn, unnest(list_filter([
    CASE WHEN name = 'Bash' AND is_error AND regexp_matches(command, '^tool (definition|view|lookup)') AND result = 'not found in graph' THEN 'P01_symbol_not_found' END,
    CASE WHEN name = 'Bash' AND is_error AND command LIKE 'tool view%--depth%' THEN 'P02_view_depth_flag' END,
    CASE WHEN name = 'Bash' AND command LIKE 'tool grep%--compact%' THEN 'P03_grep_wrong_flag' END,
    CASE WHEN name = 'Bash' AND is_error AND command LIKE 'tool lookup%--file%' THEN 'P04_unsupported_file' END,
    CASE WHEN name = 'Bash' AND is_error AND command LIKE 'findstr%' THEN 'P08_windows_cmd_tools' END,
    CASE WHEN name = 'Bash' AND command LIKE 'tool list%' AND result = 'No symbols found' THEN 'P20_list_empty' END], lambda x: x IS NOT NULL)) AS pattern FROM tl)"""


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers are tasks, whose targets are the parts of all their lines, under names of their own: distinct (task, symbol)."""
    i = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("task"), "l_partkey")
    i = i.repartition(max(spark.sparkContext.defaultParallelism, -(-i.count() // LINES_A_TASK)), "task", "l_partkey").distinct()
    return i.join(_target_names(spark, sf_dir), "l_partkey").select("task", "symbol")


def _target_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.expr("concat_ws(' ', p_name, p_partkey)").alias("symbol")).distinct()  # a symbol ends with its key


def wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of all targets, from the lines' keys alone: tasks are not paired with them, nor names shuffled with every line."""
    keys = table(spark, sf_dir, "lineitem").select("l_partkey").distinct()
    return keys.join(_target_names(spark, sf_dir), "l_partkey").select(F.col("symbol").alias("name"))


TASKS_SQL = """targets AS (SELECT DISTINCT l_suppkey AS task, p_name || ' ' || p_partkey AS symbol FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rows of a symbol table: those of one type are imports."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.concat_ws(".", F.substring_index("p_name", " ", 1), F.col("p_name")).alias("qualified_name"),
        F.when((F.col("p_type") == "ECONOMY") & (F.col("p_size") <= 5), "import").when(F.col("p_type") == "MEDIUM", "class").otherwise("function").alias("type"),
        F.concat(F.col("p_brand"), F.lit("/"), (F.col("p_size") % 4).cast("string")).alias("file"), F.col("p_size").alias("line"), F.col("p_type").alias("docstring"), F.substring_index("p_name", " ", 1).alias("parent"),
    )


SYMBOLS_SQL = """symbols AS (SELECT p_partkey AS ord, p_name AS name, split_part(p_name, ' ', 1) || '.' || p_name AS qualified_name,
  CASE WHEN p_type = 'ECONOMY' AND p_size <= 5 THEN 'import' WHEN p_type = 'MEDIUM' THEN 'class' ELSE 'function' END AS type,
  p_brand || '/' || p_size % 4 AS file, p_size AS line, p_type AS docstring, split_part(p_name, ' ', 1) AS parent FROM part)"""


def unique_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same symbols under names of their own."""
    own = F.concat_ws(" ", "name", F.col("ord").cast("string"))
    return symbols(spark, sf_dir).withColumn("name", own).withColumn("qualified_name", F.concat_ws(".", "parent", "name"))


UNIQUE_SQL = SYMBOLS_SQL.replace("p_name AS name", "p_name || ' ' || p_partkey AS name").replace("|| '.' || p_name AS", "|| '.' || p_name || ' ' || p_partkey AS")
