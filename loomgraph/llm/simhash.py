"""SimHash near-dedup: tiled exact comparison with exclusive-or and bit counts.

Distinct fingerprints are laid into tiles by the population counts of their segments. Two fingerprints within
the radius have segment counts that differ by no more than the radius in sum, so tile pairs beyond it are
skipped; the other pairs of tiles are compared whole, in numpy. A pair of tiles returns a spanning forest of its
links, never all of them, and the components are found on the executors.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, bounded_batches, durable, hex64, map_batches, table
from .components import components

SEED = 42
#: Fingerprints in a tile at most, roughly; more are dealt over several by a hash.
TILE = 8192
BITS = 64


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64 bits: a bit is 1 if set in over half the shingles' hashes; repeats count; 0 if there is no word."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(BITS, np.int64), len(starts)
    stops = ends[shingle - 1 :].tolist()
    for at in range(0, n, 1 << 16):
        part = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)], strict=True)], np.uint64)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp) of every row, fp the fingerprint's bits as a long. A null text has no words."""
    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id]

    def rows(batch):
        return {id: batch["_id"], "fp": np.array([fingerprint(t, shingle) for t in batch["_text"]], np.uint64).view(np.int64).tolist()}

    return map_batches(docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")), rows, f"`{id}` {kind}, fp long")


def union_links(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merges the sets of i[k] and j[k]; label[x] is the smallest member of x's set, before and after."""
    while len(i):
        a, b = label[i], label[j]
        open_ = a != b
        if not open_.any():
            return
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def tile_links(a: np.ndarray, b: np.ndarray, radius: int, block: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between the fingerprints of two tiles."""
    both = np.concatenate([a, b])
    label, step = np.arange(len(both)), max(1, block // max(1, len(b)))
    for at in range(0, len(a), step):
        near = np.bitwise_count(a[at : at + step, None] ^ b[None, :]) <= radius
        if near.any():
            i, j = np.nonzero(near)
            union_links(label, i + at, j + len(a))
    child = np.nonzero(label != np.arange(len(both)))[0]
    return both[child], both[label[child]]


def links(fps: DataFrame, radius: int, segments: int | None = None, tile: int = TILE) -> DataFrame:
    """Edges (u, v) that connect the same fingerprints as all links within the radius do. fps: a column fp, distinct."""
    spark = fps.sparkSession
    n = fps.count()
    segments = segments or (2 if n < 2e6 else 3 if n < 1e8 else 4)
    cuts = [BITS * k // segments for k in range(segments + 1)]
    key = F.lit(0).cast("long")
    for lo, hi in zip(cuts, cuts[1:]):
        mask = ((1 << (hi - lo)) - 1) << lo
        mask -= (1 << 64) if mask >= 1 << 63 else 0
        key = key * 128 + F.bit_count(F.col("fp").bitwiseAND(F.lit(mask).cast("long")))
    # The fullest tile holds about (1 / sqrt(pi * width / 2)) ** segments of all.
    widest = n * float(np.prod([1 / np.sqrt(np.pi * (b - a) / 2) for a, b in zip(cuts, cuts[1:])]))
    chunks = max(1, -(-int(widest) // tile))
    tiles = fps.select("fp", (key * chunks + F.pmod(F.xxhash64("fp"), F.lit(chunks))).alias("tile"))
    # Fingerprints of few distinct population counts may crowd a tile: a second deal keeps each row of fps bounded.
    crowd = tiles.groupBy("tile").count().select("tile", F.ceil(F.col("count") / tile).cast("long").alias("parts"))
    tiles = tiles.join(crowd, "tile").withColumn("part", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")))
    tiles = durable(tiles.groupBy("tile", "part").agg(F.sort_array(F.collect_list("fp")).alias("fps")))
    moves = [d for d in product(range(-radius, radius + 1), repeat=segments) if sum(map(abs, d)) <= radius]
    offsets = sorted(sum(x * 128 ** (segments - 1 - k) for k, x in enumerate(d)) for d in moves)
    base = F.floor(F.col("tile") / chunks).cast("long")
    others = F.explode(F.flatten(F.transform(F.array(*[F.lit(o).cast("long") for o in offsets]), lambda o: F.transform(F.sequence(F.lit(0), F.lit(chunks - 1)).cast("array<long>"), lambda c: (base + o) * chunks + c))))
    left = tiles.select(F.col("tile").alias("from"), F.col("part").alias("fp_part"), F.col("fps").alias("a"), others.alias("tile")).where("tile >= from")
    met = left.join(tiles.withColumnRenamed("fps", "b"), "tile").where("from < tile or fp_part <= part").select("a", "b")
    # Tile pairs are far fewer than rows, and each is much work.
    met = met.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def rows(batch):
        out = [tile_links(np.array(a, np.int64).view(np.uint64), np.array(b, np.int64).view(np.uint64), radius) for a, b in zip(batch["a"], batch["b"], strict=True)]
        flat = [np.concatenate([x[k] for x in out]).view(np.int64).tolist() if out else [] for k in (0, 1)]
        return {"u": flat[0], "v": flat[1]}

    with batches_of(spark, 32):
        return durable(map_batches(met, rows, "u long, v long").where("u <> v"))


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp, component_id) of every row; component_id is the smallest id reachable over links.

    - Fingerprints link when at most ``radius`` bits differ; equal ones always do. A text without words, or null, has fingerprint 0.
    - Null ids count as larger than all others; a component of null ids alone has a null component_id.
    - Rows that repeat an id are linked by their texts like any others. An empty table gives an empty result.
    - Very long texts count with all their shingles. Other columns are not read, whatever their names.
    """
    own = durable(fingerprints(docs, shingle, id, text))
    nodes = durable(own.groupBy("fp").agg(F.min(id).alias("_first")))
    roots = components(links(nodes.select("fp"), radius))
    joined = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "_first", F.coalesce("root", "fp").alias("_root"))
    least = joined.groupBy("_root").agg(F.min("_first").alias("component_id"))
    classes = joined.join(least, "_root").select("fp", "component_id")
    return own.join(classes, "fp").select(id, "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")
