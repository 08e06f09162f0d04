"""Watching a tree with state: a listing stream, and a state and a timer for each file, all kept in the checkpoint.

A tick of the stream lists the tree, a row a file. A file's state is what it was when it was last handed on, what it is
now, and when it was last seen. A change starts the file's timer anew; when it runs out the file is handed on, so a
file that is being written waits until it is quiet. A file that ticks no longer show has gone. After a restart the first
tick is compared with the state of before, so what changed, came or went meanwhile is handed on too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..sources.files import LANGUAGES, SKIP_DIRS, discover, extract, ignore_rules, is_ignored, symbols_of

NAME = "tree_listing"
LISTING = "file string, modified long, size long, known boolean"
CHANGE = "file string, op string"
STATE = "modified long, size long, told_modified long, told_size long, changed long, seen long"
#: Fixed value: the state store that keeps timers.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Folder(InputPartition):
    """A folder below the root that one task lists; whether with all that is below it, and whether it is the very first listing."""

    path: str
    whole: bool
    first: bool


class ListingReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root = options["path"]

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root)

    def initialOffset(self) -> dict:
        return {"tick": 0}

    def latestOffset(self) -> dict:
        import time

        return {"tick": time.time_ns()}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        """One for the root's own files, and one for each folder in it."""
        from pyarrow import fs

        system, root = self._open()
        first = start["tick"] == 0
        below = [x.path for x in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if x.type == fs.FileType.Directory and x.base_name not in SKIP_DIRS]
        return [Folder(root, False, first), *[Folder(x, True, first) for x in sorted(below)]]

    def read(self, partition: Folder) -> Iterator[tuple]:
        from pyarrow import fs

        system, root = self._open()
        for x in system.get_file_info(fs.FileSelector(partition.path, recursive=partition.whole, allow_not_found=True)):
            if x.type == fs.FileType.File and x.extension.lower() in LANGUAGES:
                yield x.path[len(root.rstrip("/")) + 1 :], (x.mtime_ns or 0) // 1000, x.size, partition.first

    def commit(self, end: dict) -> None:
        pass


class ListingSource(DataSource):
    """A stream whose every batch is a listing of the sources below a folder."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return LISTING

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ListingReader(dict(self.options))


class Quiet(StatefulProcessor):
    """Tells of a file once it has been quiet for ``debounce`` milliseconds, and that it has gone once ticks don't show it for ``gone``."""

    def __init__(self, debounce: int, gone: int):
        self.debounce, self.gone = debounce, gone

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("file", STATE)

    def _wake(self, at: int) -> None:
        """The one timer of a file."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        last = pd.concat(list(rows)).iloc[-1]
        modified, size, known = int(last["modified"]), int(last["size"]), bool(last["known"])
        if not self.state.exists():
            told = (modified, size) if known else (-1, -1)
            self.state.update((modified, size, *told, now, now))
            self._wake(now + (self.gone if known else self.debounce))
        else:
            old = self.state.get()
            changed = (modified, size) != (old[0], old[1])
            self.state.update((modified, size, old[2], old[3], now if changed else old[4], now))
            if changed:
                self._wake(now + self.debounce)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        modified, size, told_modified, told_size, changed, seen = self.state.get()
        if now - seen >= self.gone:
            self.state.clear()
            if told_size >= 0:
                yield pd.DataFrame({"file": [key[0]], "op": ["deleted"]})
            return
        if (modified, size) != (told_modified, told_size) and now - changed >= self.debounce:
            self.state.update((modified, size, modified, size, changed, seen))
            self._wake(seen + self.gone)
            yield pd.DataFrame({"file": [key[0]], "op": ["changed" if told_size >= 0 else "added"]})
            return
        waits = (modified, size) != (told_modified, told_size)
        self._wake(min(changed + self.debounce, seen + self.gone) if waits else seen + self.gone)

    def close(self) -> None:
        pass


def changes(spark: SparkSession, root: str, ignore: str = "", debounce: float = 2, gone: float = 5) -> DataFrame:
    """A stream of (file, op), op added, changed or deleted, of the sources below a folder. gone: seconds without a sight of a file, more than the time between ticks."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    spark.dataSource.register(ListingSource)
    listing = spark.readStream.format(NAME).load(root)
    kept = listing.where(~is_ignored(F.col("file"), ignore_rules(ignore)))
    return kept.groupBy("file").transformWithStateInPandas(Quiet(int(debounce * 1000), int(gone * 1000)), CHANGE, "append", "ProcessingTime")


def watch_tree(spark: SparkSession, root: str, checkpoint: str, on_batch: Callable[[DataFrame, list[str], int], None], ignore: str = "", debounce: float = 2, gone: float = 5, every: str = "1 second") -> StreamingQuery:
    """Calls on_batch(symbols, files, batch) for files that came, changed or went, each when it has been quiet; a file that went has no symbols.

    What is there when a checkpoint is first used is no change. A query that starts again from its checkpoint hands on
    what happened while it was down. A batch that was not over when the query stopped comes again, under its number.
    """

    def flush(batch: DataFrame, number: int) -> None:
        names = sorted(r["file"] for r in batch.select("file").distinct().collect())  # what got quiet in a tick
        if names:
            on_batch(symbols_of(extract(discover(spark, root, ignore, "", names))), names, number)

    return changes(spark, root, ignore, debounce, gone).writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=every).start()
