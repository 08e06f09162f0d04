"""What the operators of this subpackage share: tables, white space, durable intermediate results."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import durable, shared_dir

__all__ = ["batches_of", "bit_filter", "bounded_batches", "durable", "hex64", "in_filter", "map_batches", "map_stream", "shared_dir", "stored", "table", "word_count"]

#: White space of the word definition: space and the five controls from tab to carriage return.
#: ``bytes.split()`` without arguments splits on exactly these six bytes.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches that feed Python small: texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


@contextmanager
def batches_of(spark: SparkSession, records: int) -> Iterator[None]:
    """Batches of so many rows for what is run inside: each row is much work, or large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(records))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Spark's setting by which the shuffle files of a statement go when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """The rows as Parquet in the shared folder: durable, compressed, and read by column. Shuffles that led there are done with and go.

    Row groups are small, since rows may be large and a reader decodes thousands of a group at once. Their size is looked
    at from the first row on, and not from the hundredth; it counts compressed bytes, so very large rows name a number of rows, too.
    """
    spark = df.sparkSession
    path, before = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        out = df.write.option("compression", "zstd").option("parquet.block.size", str(8 << 20)).option("parquet.page.size.row.check.min", "1")
        (out.option("parquet.block.row.count.limit", str(rows)) if rows else out).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hex64(value: Column) -> Column:
    """A long's 64 bits as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def map_batches(df: DataFrame, rows: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """``mapInArrow`` over plain Python columns: rows() gets and returns a dict of equally long lists."""
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = rows({n: c.to_pylist() for n, c in zip(batch.schema.names, batch.columns, strict=True)})
            made = pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
            yield made

    return df.mapInArrow(run, schema)


def map_stream(df: DataFrame, rows: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]], schema: str) -> DataFrame:
    """As map_batches, for functions that keep a bounded state over the batches of a partition."""
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in rows({n: c.to_pylist() for n, c in zip(b.schema.names, b.columns, strict=True)} for b in batches):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


#: Bits of the filters that are broadcast, so their size is fixed. A full filter passes more than it must, never less.
FILTER_BITS = 30


def bit_filter(keys: DataFrame, key: Column, n: int) -> np.ndarray:
    """Bits at the leading bits of each key, a long; at most 2 ** FILTER_BITS of them, whatever n is."""
    bits = min(FILTER_BITS, max(10, (16 * n).bit_length()))
    at = F.shiftrightunsigned(key, 64 - bits)
    words = keys.select(F.shiftrightunsigned(at, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int")).alias("b"))
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # 2 ** (FILTER_BITS - 6) rows at most
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[got.column("w").to_numpy()] = got.column("b").to_numpy().view(np.uint64)
    return out


def in_filter(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys >> np.uint64(64 - 6 - (len(words).bit_length() - 1))
    return words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1) == 1
