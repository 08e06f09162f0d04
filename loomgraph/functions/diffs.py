"""Unified diffs and version-control listings as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Extensions whose changes are followed.
FOLLOWED = ("py", "ts", "tsx", "js", "jsx", "go", "rs", "java", "cs")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def parse_diff(diffs: DataFrame, text: str = "diff_text", id: str = "diff_id") -> DataFrame:
    """(id, path, old_path, status, added, deleted): a row per file of each unified diff."""
    part = F.explode(F.filter(F.split(F.col(text), r"(?m)^diff --git "), lambda s: s.startswith("a/")))
    rows = diffs.select(id, part.alias("part"))
    head = F.regexp_extract("part", r"^a/(.*) b/(.*?)(?:\r?\n|$)", 1), F.regexp_extract("part", r"^a/(.*) b/(.*?)(?:\r?\n|$)", 2)
    lines = F.split("part", "\n")
    top = F.array_join(F.slice(lines, 1, 6), "\n")
    status = F.when(F.contains(top, F.lit("new file mode")), "added").when(F.contains(top, F.lit("deleted file mode")), "deleted").when(F.contains(top, F.lit("rename from")), "renamed").otherwise("modified")
    count = lambda sign: F.size(F.filter(lines, lambda s: s.startswith(sign) & ~s.startswith(sign * 3)))
    return rows.select(id, head[1].alias("path"), F.when(head[0] != head[1], head[0]).alias("old_path"), status.alias("status"), count("+").alias("added"), count("-").alias("deleted"))


def diff_summary(files: DataFrame, id: str = "diff_id") -> DataFrame:
    """(id, files, added, deleted) totals."""
    return files.groupBy(id).agg(F.count(F.lit(1)).alias("files"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))


def changed_files(files: DataFrame, extensions: tuple[str, ...] = ("py", "ts", "tsx", "js", "jsx")) -> DataFrame:
    """Paths that were not deleted and have one of the extensions."""
    return files.where((F.col("status") != "deleted") & extension(F.col("path")).isin(*extensions)).select("path").distinct()


def name_status(lines: DataFrame, line: str = "line") -> DataFrame:
    """(status, file, old_file) from name-status lines: the first letter, the last field; a rename also names the old one."""
    fields = F.split(F.col(line), "\t")
    good = lines.where(F.size(fields) > 1)
    status = F.substring(F.col(line), 1, 1)
    return good.select(status.alias("status"), F.element_at(fields, -1).alias("file"), F.when(status.isin("R", "C"), F.element_at(fields, 2)).alias("old_file"))


def as_changes(listed: DataFrame) -> DataFrame:
    """(file, status) with a rename as a deletion and an addition."""
    renamed = listed.where("status = 'R'")
    return listed.where("status <> 'R'").select("file", "status").unionAll(renamed.select("old_file", F.lit("D"))).unionAll(renamed.select("file", F.lit("A")))


def hunks(lines: DataFrame, line: str = "line", order: str = "seq") -> DataFrame:
    """(file, lo, hi) of the new side of each hunk of one diff without context lines; a hunk of no lines is left out."""
    so_far = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)  # one diff's lines, read on the driver
    path = F.nullif(F.regexp_extract(line, r"^\+\+\+ b/(.*)$", 1), F.lit(""))
    mark = r"^@@ -\S+ \+(\d+)(?:,(\d+))? @@"
    rows = lines.select(F.last(path, ignorenulls=True).over(so_far).alias("file"), F.col(line).alias("line")).where(F.col("line").rlike(mark))
    n = F.coalesce(F.nullif(F.regexp_extract("line", mark, 2), F.lit("")).cast("int"), F.lit(1))
    lo = F.regexp_extract("line", mark, 1).cast("int")
    return rows.select("file", lo.alias("lo"), (lo + n - 1).alias("hi")).where("hi >= lo")
