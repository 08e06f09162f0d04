"""Near-duplicates by Jaccard similarity of word shingles, found with wide SimHash fingerprints.

The method of simhash.py with fingerprints of 512 bits, taken from distinct shingles, so that the share of differing
bits estimates the angle between the shingle sets, and with it their Jaccard similarity. Documents are tiled by
their number of shingles: sets whose sizes differ by more than the similarity allows can't reach it, so those tile
pairs are skipped. Pairs far below the expected distance of the threshold link at once; pairs around it are checked
on the shingles themselves; pairs above have no part. The upper bound holds for the sizes at hand: a pair of the
similarity exceeds it with probability MISS at most.

No pair is ever listed. A pair of tiles returns a spanning forest of its sure links, and the documents that have open
pairs left. Once the components of the sure links are known, those documents alone are tiled again, with their roots
and shingles, and a pair of tiles compares the shingles of open pairs from different components, joining as it goes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, bit_filter, bounded_batches, durable, in_filter, map_batches, stored
from .components import components
from .simhash import SEED, union_links

WORDS = 8
TILE = 16384
#: Shingles of the documents in a tile of the second look.
SET_BYTES = 6 << 20
#: Standard deviations below the threshold's expected distance that are checked exactly.
SURE = 2.7
#: The chance that a pair of the similarity lies above the distance up to which pairs are checked.
MISS = 1e-7
#: Up to this size the share of differing bits is computed for each pair of sizes; the words of a first look.
SMALL, LOOK = 64, 2


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; the whole sequence if it is shorter; empty without words."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64))


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """WORDS words of 64 bits, each from its own mix of the shingles' hashes."""
    counts = np.zeros((WORDS, 64), np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        for k in range(WORDS):
            x = part ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
            counts[k] += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes), axis=1, bitorder="little").tobytes()


@cache
def differing(n: int, m: int, similarity: float) -> float:
    """The largest share of differing bits of sets of n and m shingles that reach the similarity: ties give 0 bits, so for small sets it isn't the angle's."""
    chances = lambda k: np.array([math.comb(k, i) for i in range(k + 1)]) / 2.0**k
    most = 0.0
    for shared in range(max(0, math.ceil(similarity / (1 + similarity) * (n + m) - 1e-9)), min(n, m) + 1):
        of = np.arange(shared + 1)
        one = [np.array([own[2 * (s + np.arange(len(own))) > k].sum() for s in of]) for k, own in ((n, chances(n - shared)), (m, chances(m - shared)))]
        most = max(most, float((chances(shared) * (one[0] * (1 - one[1]) + one[1] * (1 - one[0]))).sum()))
    return most


@cache
def largest(similarity: float) -> float:
    """The same for all larger sets: the excess over the angle's share falls with the size."""
    sizes = range(SMALL * 3 // 4, SMALL + 1)
    return max(differing(n, m, similarity) for n in sizes for m in sizes if n <= m)


@cache
def bound(bits: int, p: float) -> int:
    """The least distance that a pair with the share p exceeds with probability MISS at most."""
    if p <= 0:
        return 0
    tail = 0.0
    for k in range(bits, -1, -1):
        tail += math.exp(math.lgamma(bits + 1) - math.lgamma(k + 1) - math.lgamma(bits - k + 1) + k * math.log(p) + (bits - k) * math.log1p(-p))
        if tail > MISS:
            return k
    return 0


def distances(similarity: float, a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """For sets of these sizes, distances over all words: up to the first a pair is sure, up to the second open; the third holds for the first LOOK words alone."""
    cosine = 2 * similarity / (1 + similarity)
    p = math.acos(cosine) / math.pi
    bits = 64 * WORDS
    sure = int(bits * p - SURE * math.sqrt(bits * p * (1 - p)))
    of = lambda sizes: np.unique(sizes[sizes <= SMALL]).tolist()
    most = max((differing(min(n, m), max(n, m), similarity) for n in of(a) for m in of(b)), default=0.0)
    if max(a.max(initial=0), b.max(initial=0)) > SMALL:
        most = max(most, largest(similarity))
    return sure, bound(bits, most), bound(64 * LOOK, most)


def near_pairs(a: tuple, b: tuple, similarity: float, block: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, sure) of the pairs of two tiles of (ids, sizes, fingerprints) that may reach the similarity, a block of i at a time; j counts on from a's last."""
    sure, open_, first = distances(similarity, a[1], b[1])
    step = max(1, block // max(1, len(b[0])))
    for at in range(0, len(a[0]), step):
        look = sum(np.bitwise_count(a[2][at : at + step, None, k] ^ b[2][None, :, k]) for k in range(LOOK))
        i, j = np.nonzero(look <= first)
        i += at
        good = (a[0][i] != b[0][j]) & (np.minimum(a[1][i], b[1][j]) >= similarity * np.maximum(a[1][i], b[1][j]) - 1e-9)
        i, j = i[good], j[good]
        far = np.zeros(len(i), np.int64)
        for k in range(WORDS):
            far += np.bitwise_count(a[2][i, k] ^ b[2][j, k])
        near = far <= open_
        yield i[near], j[near] + len(a[0]), far[near] <= sure


def forest(ids: np.ndarray, label: np.ndarray) -> tuple[list[int], list[int]]:
    child = np.flatnonzero(label != np.arange(len(ids)))
    return ids[child].tolist(), ids[label[child]].tolist()


def sure_links(a: tuple, b: tuple, similarity: float, most: int = 1 << 19) -> tuple[list, list, list]:
    """(u, v) of a spanning forest of the sure links of two tiles, and the ids with an open pair that it doesn't join."""
    ids = np.concatenate([a[0], b[0]])
    label, flagged = np.arange(len(ids)), np.zeros(len(ids), bool)
    maybe, held = [], 0

    def apart(pairs: list) -> np.ndarray:
        i, j = np.concatenate(pairs, axis=1) if pairs else np.empty((2, 0), np.int64)
        other = (label[i] != label[j]) & ~(flagged[i] & flagged[j])
        return np.stack([i[other], j[other]])

    for i, j, sure in near_pairs(a, b, similarity):
        union_links(label, i[sure], j[sure])
        maybe.append(apart([np.stack([i[~sure], j[~sure]])]))
        held += maybe[-1].shape[1]
        if held > most:
            maybe = [apart(maybe)]
            held = maybe[0].shape[1]
            if held > most // 2:
                # Some of these may be joined later on: they are looked at again in vain, and none is lost.
                flagged[maybe[0].ravel()] = True
                maybe, held = [], 0
    flagged[apart(maybe).ravel()] = True
    return *forest(ids, label), ids[flagged].tolist()


def checked_links(a: tuple, b: tuple, similarity: float) -> tuple[list, list]:
    """(u, v) of links of the similarity between the classes of two tiles of (ids, sizes, fingerprints, roots, sets): enough to join all classes that have one.

    The shingles of a text are compared with those of its open partners in other classes, all at once; whatever has
    been joined by then is not looked at again.
    """
    ids = np.concatenate([a[0], b[0]])
    _, label = np.unique(np.concatenate([a[3], b[3]]), return_inverse=True)
    _, least = np.unique(label, return_index=True)
    label = least[label]  # each class under its first member
    sets = [*a[4], *b[4]]
    u, v = [], []
    for i, j, _ in near_pairs(a, b, similarity):
        cut = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1], [True]])) if len(i) else [0]
        for lo, hi in zip(cut, cut[1:]):
            x, rest = int(i[lo]), j[lo:hi]
            rest = rest[label[rest] != label[x]]
            for at in range(0, len(rest), 256):
                some = rest[at : at + 256]
                some = some[label[some] != label[x]]
                if not len(some):
                    continue
                own, sizes = sets[x], np.array([len(sets[y]) for y in some])
                every = np.concatenate([sets[y] for y in some])
                spot = np.minimum(np.searchsorted(own, every), len(own) - 1)
                shared = np.add.reduceat((own[spot] == every).astype(np.int64), np.cumsum(sizes) - sizes)
                met = some[shared >= similarity * (len(own) + sizes - shared) - 1e-9]
                u += [int(ids[x])] * len(met)
                v += ids[met].tolist()
                union_links(label, np.full(len(met), x), met)
    return u, v


def tile_pairs(rows: DataFrame, size: Column, tile: int, pack: Callable[[pd.DataFrame], bytes]) -> DataFrame:
    """(a, b): the blobs of all tile pairs of a size class and itself or the next. size: what a row counts for in a tile, at least."""
    # A set of n shingles reaches the similarity only with sets of its own or the next class. A row for each class: some dozens.
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / tile, F.sum(size))).cast("long")
    dealt = rows.join(F.broadcast(rows.groupBy("class").agg(parts.alias("parts"))), "class").withColumn("part", F.pmod(F.xxhash64("id", "fp"), F.col("parts")))

    def packed(df: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"class": [df["class"].iloc[0]], "part": [df["part"].iloc[0]], "blob": [pack(df)]})

    spark = rows.sparkSession
    tiles = durable(dealt.groupBy("class", "part").applyInPandas(packed, "class long, part long, blob binary"))
    left = tiles.select(F.col("class").alias("c"), F.col("part").alias("p"), F.col("blob").alias("a"), F.explode(F.array(F.col("class"), F.col("class") + 1)).alias("class"))
    met = left.join(tiles.withColumnRenamed("blob", "b"), "class").where("c < class or p <= part").select("a", "b")
    # Tile pairs are far fewer than rows, and each is much work: one to a partition, about.
    return met.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def packed_prints(df: pd.DataFrame) -> bytes:
    return np.int64(len(df)).tobytes() + df["id"].to_numpy(np.int64).tobytes() + df["n"].to_numpy(np.int64).tobytes() + b"".join(df["fp"])


def packed_sets(df: pd.DataFrame) -> bytes:
    return packed_prints(df) + df["root"].to_numpy(np.int64).tobytes() + b"".join(df["set"])


def unpacked(blob: bytes) -> tuple:
    """(ids, sizes, fingerprints), and where there are sets (.., roots, sets)."""
    every = np.frombuffer(blob, np.uint64)
    n = int(every[0])
    ids, sizes, prints = every[1 : 1 + n].view(np.int64), every[1 + n : 1 + 2 * n].view(np.int64), every[1 + 2 * n : 1 + (2 + WORDS) * n].reshape(n, WORDS)
    rest = every[1 + (2 + WORDS) * n :]
    return (ids, sizes, prints, rest[:n].view(np.int64), np.split(rest[n:], np.cumsum(sizes)[:-1])) if len(rest) else (ids, sizes, prints)


def similar_links(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id: str = "doc_id", text: str = "text", tile: int = TILE) -> DataFrame:
    """Edges (u, v) of integer ids that connect the same documents as all links of the similarity or more do."""
    spark = docs.sparkSession
    bounded_batches(spark)
    base = docs.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))

    def prints(batch):
        sets = [shingle_set(t, shingle) for t in batch["text"]]
        return {"id": batch["id"], "n": [len(s) for s in sets], "fp": [wide_fingerprint(s) for s in sets]}

    size_class = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / similarity) + 1e-9).cast("long")
    own = durable(map_batches(base, prints, "id long, n long, fp binary").where("n > 0").withColumn("class", size_class))

    def sure(batch):
        out: dict[str, list] = {"u": [], "v": []}
        for a, b in zip(batch["a"], batch["b"], strict=True):
            u, v, open_ = sure_links(unpacked(a), unpacked(b), similarity)
            out["u"] += u + open_
            out["v"] += v + [None] * len(open_)
        return out

    met = tile_pairs(own, F.lit(0), tile, packed_prints)
    with batches_of(spark, 2):
        found = durable(map_batches(met, sure, "u long, v long"))
    links = found.where("v is not null and u <> v")
    roots = components(links).select(F.col("node").alias("id"), "root")
    ends = durable(found.where("v is null").select(F.col("u").alias("id")).distinct().join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root")))
    held = spark.sparkContext.broadcast(bit_filter(ends, F.xxhash64("id"), ends.count()))

    def sets(batch):
        keys = np.array(batch["k"], np.int64).view(np.uint64)
        some = np.flatnonzero(in_filter(held.value, keys)).tolist() if len(keys) else []
        of = [shingle_set(batch["text"][i], shingle) for i in some]
        return {"id": [batch["id"][i] for i in some], "n": [len(s) for s in of], "fp": [wide_fingerprint(s) for s in of], "set": [s.tobytes() for s in of]}

    with_sets = map_batches(base.withColumn("k", F.xxhash64("id")), sets, "id long, n long, fp binary, set binary").where("n > 0")
    with_sets = stored(with_sets.join(ends, "id").withColumn("class", size_class), "similar")

    def check(batch):
        out: dict[str, list] = {"u": [], "v": []}
        for a, b in zip(batch["a"], batch["b"], strict=True):
            u, v = checked_links(unpacked(a), unpacked(b), similarity)
            out["u"] += u
            out["v"] += v
        return out

    met = tile_pairs(with_sets, F.col("n") * 8 / SET_BYTES, tile, packed_sets)
    with batches_of(spark, 1):
        checked = durable(map_batches(met, check, "u long, v long"))
    return links.unionByName(checked)


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id: str = "doc_id", text: str = "text", tile: int = TILE) -> DataFrame:
    """The rows that stay, with all their columns: of each group of linked documents, the one with the smallest id.

    - Texts without words link to nothing, and neither do rows with a null id: they stay.
    - Ids are integers. Rows that repeat an id are one document with the links of all its texts, and share its verdict.
    - Very long texts count with all their shingles. An empty table gives an empty result. Columns may have any names.
    """
    gone = components(similar_links(docs, shingle, similarity, id, text, tile)).select(F.col("node").alias("_gone"))
    return docs.join(gone, docs[id] == gone["_gone"], "left_anti")
