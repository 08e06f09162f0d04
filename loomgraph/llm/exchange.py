"""Documents in chunks, and questions that chunks ask about keys of the whole corpus.

A chunk is some megabytes of whole texts, stored as one row, so that each later pass sees the same texts together. A
chunk asks about its distinct 64-bit keys, sorted and cut into ranges of equal hash space, so a hot key is one entry
of each chunk, whatever its count. The task of a range meets the entries of all chunks and answers each chunk in the
order of its question: what comes back needs no keys. Both ways, rows are few and their columns packed bytes.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _arrow_schema, bounded_batches, stored

#: Texts of a chunk, and of the corpus for each range of keys.
CHUNK_BYTES, CHUNK_ROWS, RANGE_BYTES = 3 << 20, 1 << 14, 6 << 20
#: Chunks that a reader decodes at once.
CHUNKS_AT_ONCE = 2


def chunks(docs: DataFrame, text: str, more: Callable[[list[str | None]], tuple[bytes, ...]] | None = None, names: tuple[str, ...] = ()) -> DataFrame:
    """(chunk, size, and an array of each column) with the rows of docs in order, which the chunks' names keep.

    size counts the bytes of the texts. more(texts) gives a chunk binary columns of these names. Kept in the shared folder.
    """
    bounded_batches(docs.sparkSession)
    schema = ", ".join(["chunk string", "size long", *[f"`{n}` array<{k}>" for n, k in docs.dtypes], *[f"{n} binary" for n in names]])
    arrow = _arrow_schema(docs.sparkSession, schema)
    own = list(docs.columns).index(text)

    def packed(held: list[pa.RecordBatch], size: int, k: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        columns = [pa.array([f"{TaskContext.get().partitionId():08d}-{k:08d}-{uuid.uuid4().hex}"]), pa.array([size])]
        for f, c in zip(list(arrow)[2:], table.columns, strict=False):
            whole = c.chunk(0) if c.num_chunks else pa.array([], c.type)
            columns.append(pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole).cast(f.type))
        if more:
            columns += [pa.array([x], pa.binary()) for x in more(table.columns[own].to_pylist())]
        return pa.RecordBatch.from_arrays(columns, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = rows = made = 0
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                before = int(ends[at - 1]) if at else 0
                stop = max(at + 1, int(np.searchsorted(ends, before + CHUNK_BYTES - size, "right")))
                stop = min(stop, at + CHUNK_ROWS - rows, batch.num_rows)
                held.append(batch.slice(at, stop - at))
                size, rows, at = size + int(ends[stop - 1]) - before, rows + stop - at, stop
                if size >= CHUNK_BYTES * 3 // 4 and at < batch.num_rows or size >= CHUNK_BYTES or rows >= CHUNK_ROWS:
                    yield packed(held, size, made)
                    held, size, rows, made = [], 0, 0, made + 1
        if held:
            yield packed(held, size, made)

    return stored(docs.mapInArrow(run, schema), "chunks", CHUNKS_AT_ONCE)


def range_bits(parts: DataFrame, text: int = RANGE_BYTES) -> int:
    """As many leading bits of the keys as there are ranges for this much text, so many bytes each."""
    size = parts.agg(F.sum("size")).first()[0] or 0
    return min(40, max(3, math.ceil(math.log2(max(1, size / text)))))


def cuts(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(range, from, to) of the ranges that sorted keys fall into."""
    own = keys >> np.uint64(64 - bits)
    edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(keys) else np.empty(0, np.int64)
    return list(zip(own[edge].astype(int).tolist(), edge.tolist(), [*edge[1:].tolist(), len(keys)], strict=True))


def shortened(keys: np.ndarray, bits: int) -> np.ndarray:
    """Keys cut to their range and the 44 bits after it."""
    off = np.uint64(max(0, 20 - bits))
    return keys >> off << off


def packed_keys(keys: np.ndarray, bits: int, whole: bool = False) -> bytes:
    """The sorted keys of one range, cut to 44 bits after it or whole, by their differences: low bytes as they are, and what is above them compressed."""
    if not len(keys):
        return b""
    off, base = np.uint64(0 if whole else max(0, 20 - bits)), keys[0] >> np.uint64(64 - bits) << np.uint64(64 - bits)
    d = np.diff(keys - base >> off, prepend=np.uint64(0))
    width = min(7, max(0, math.ceil((math.log2(max(1.0, float(d.mean()))) - 6) / 8)))
    high = d >> np.uint64(8 * width)
    over = np.flatnonzero(high >= 255)
    head = np.array([width, len(d), len(over)], np.uint64).tobytes() + over.astype(np.uint32).tobytes() + d[over].tobytes()
    return head + d.view(np.uint8).reshape(-1, 8)[:, :width].tobytes() + _small(np.minimum(high, np.uint64(255)))


def from_keys(data: bytes) -> np.ndarray:
    """The keys again, counted from the start of their range."""
    if not data:
        return np.empty(0, np.uint64)
    width, n, k = np.frombuffer(data, np.uint64, 3).astype(int).tolist()
    at = 24 + 12 * k
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
    d = out.view(np.uint64).ravel() | _from_small(data[at + n * width :]).astype(np.uint64) << np.uint64(8 * width)
    d[np.frombuffer(data, np.uint32, k, 24)] = np.frombuffer(data, np.uint64, k, 24 + 4 * k)
    return np.cumsum(d, dtype=np.uint64)


def _small(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.astype(np.uint8).tobytes())


def _from_small(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)


def packed_counts(n: np.ndarray) -> bytes:
    """A byte for each count, compressed; those of 255 and more follow in full."""
    over = np.flatnonzero(n >= 255)
    return np.uint64(len(over)).tobytes() + over.astype(np.uint32).tobytes() + n[over].astype(np.int64).tobytes() + _small(np.minimum(n, 255))


def from_counts(data: bytes) -> np.ndarray:
    k = int(np.frombuffer(data, np.uint64, 1)[0])
    out = _from_small(data[8 + 12 * k :]).astype(np.int64)
    out[np.frombuffer(data, np.uint32, k, 8)] = np.frombuffer(data, np.int64, k, 8 + 4 * k)
    return out


def with_answers(parts: DataFrame, answers: DataFrame) -> DataFrame:
    """The chunks with a column answers, an array of structs of the columns of answers but chunk; null without any."""
    own = answers.groupBy("chunk").agg(F.collect_list(F.struct(*[c for c in answers.columns if c != "chunk"])).alias("answers"))  # a row for each range at most
    return parts.join(own, "chunk", "left")
