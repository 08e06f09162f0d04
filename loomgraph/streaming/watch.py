"""Watching a folder: files that appear are parsed in micro-batches, and files that change are handed on when the folder is quiet."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.incremental import delta, is_empty
from ..runtime import durable
from ..sources.files import LANGUAGES, discover, extract, ignore_rules, is_ignored, symbols_of

FILE = "path string, modificationTime timestamp, length long, content binary"


def _file(root: str) -> Column:
    """A path's part below the root."""
    at = root.split("://")[-1].removeprefix("file:").rstrip("/")
    return F.regexp_replace(F.replace(F.regexp_replace("path", r"^[a-z]+:/+", "/"), F.lit(at), F.lit("")), "^/+", "")


def watch(spark: SparkSession, root: str, checkpoint: str, on_batch: Callable[[DataFrame, list[str], int], None], ignore: str = "", every: str | None = "2 seconds") -> StreamingQuery:
    """Calls on_batch(symbols, files, batch) for each micro-batch of files that appear: of a file that comes several times the newest counts.

    ``every`` is the time between batches, in which events of a file come together; None takes what is there and ends.
    A file source reads each path once: files that change in place are for watch_changes.
    """
    stream = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(LANGUAGES) + "}").load(root)

    def flush(batch: DataFrame, number: int) -> None:
        newest = Window.partitionBy("path").orderBy(F.desc("modificationTime"))
        by_ext = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
        rows = batch.withColumn("_n", F.row_number().over(newest)).where("_n = 1")
        rows = rows.select(F.lit("").alias("project_id"), _file(root).alias("file"), F.element_at(by_ext, F.lower(F.substring_index("path", ".", -1))).alias("language"), "content")
        rows = rows.where(~is_ignored(F.col("file"), ignore_rules(ignore)))
        files = [r["file"] for r in rows.select("file").collect()]  # the names of a micro-batch
        if files:
            on_batch(symbols_of(extract(rows)), files, number)

    writer = stream.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


class Debounced:
    """A tree's files as they were last handed on, and as they are now: changes are handed on when the tree was quiet for ``debounce`` seconds.

    Every change starts the wait anew. New, changed and deleted files count; what was there at the start does not.
    A listing has a row a file and no content; listings are compared by a digest, and kept as durable tables.
    """

    def __init__(self, spark: SparkSession, root: str, on_batch: Callable[[DataFrame, list[str], int], None], ignore: str = "", debounce: float = 2, clock: Callable[[], float] = time.monotonic):
        self.spark, self.root, self.on_batch, self.ignore, self.debounce, self.clock = spark, root, on_batch, ignore, debounce, clock
        self.number, self.since = 0, None
        self.seen = self.last = durable(self._list())
        self.mark = self._digest(self.last)

    def _list(self) -> DataFrame:
        raw = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(LANGUAGES) + "}").load(self.root)
        return raw.select(_file(self.root).alias("file"), "modificationTime", "length").where(~is_ignored(F.col("file"), ignore_rules(self.ignore)))

    @staticmethod
    def _digest(listing: DataFrame) -> tuple:
        return tuple(listing.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("file", "modificationTime", "length"))).first())

    def tick(self) -> list[str]:
        """Looks at the tree once; returns the files that were handed on."""
        now = self.clock()
        listing = self._list()
        if self._digest(listing) != self.mark:
            self.last, self.since = durable(listing), now
            self.mark = self._digest(self.last)
            return []
        if self.since is None or now - self.since < self.debounce:
            return []
        old = self.seen.select("file", F.struct("modificationTime", "length").alias("old"))
        new = self.last.select("file", F.struct("modificationTime", "length").alias("new"))
        changed = old.join(new, "file", "full").where(~F.col("old").eqNullSafe(F.col("new")))
        names = sorted(r["file"] for r in changed.select("file").collect())  # the names of a few quiet seconds
        self.seen, self.since = self.last, None
        if names:
            self.on_batch(symbols_of(extract(discover(self.spark, self.root, self.ignore, "", names))), names, self.number)
            self.number += 1
        return names


def watch_changes(spark: SparkSession, root: str, checkpoint: str, on_batch: Callable[[DataFrame, list[str], int], None], ignore: str = "", debounce: float = 2, every: str = "500 milliseconds") -> StreamingQuery:
    """Calls on_batch(symbols, files, batch) for files that came, changed or went, once the tree was quiet for ``debounce`` seconds; a file that went has no symbols."""
    tree = Debounced(spark, root, on_batch, ignore, debounce)
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 4).load()
    return ticks.writeStream.foreachBatch(lambda _, number: tree.tick() and None).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def changes_of(before: DataFrame, after: DataFrame, files: list[str]) -> DataFrame | None:
    """The delta of the given files, or None if there is none."""
    d = delta(before.where(F.col("file").isin(files)), after)
    return None if is_empty(d) else d


def windowed_totals(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Event-time totals by type, for streams and batches alike: events later than ``late`` are dropped by a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("begin"), "event_type", "n", "total")
