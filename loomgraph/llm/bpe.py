"""BPE encoding and decoding with a contiguous rank array per short word.

A word's parts are held as their boundaries next to the rank of each part's merge with its successor. The
smallest rank is found by scanning, its boundary is deleted, and the two neighbouring ranks are refreshed;
words are short, so the scans stay in one cache line or two. Distinct chunks of text are encoded once per
worker and remembered up to a fixed number.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _arrow_schema, bounded_batches, map_batches, table

#: Fixed value of the vocabulary: how byte-level BPE splits text before it merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks and words that a worker remembers.
CHUNKS, WORDS = 200_000, 100_000
#: Bytes of a word up to which the ranks are scanned.
LONG = 256
NONE = 1 << 60  # no such merge: above every rank


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in plain else next(free)) for b in range(256)]


class ByteBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: bytes([b]) for b, c in enumerate(byte_symbols())}
        raw = lambda s: b"".join(back[c] for c in s)
        self.ids = {raw(s): i for s, i in spec["model"]["vocab"].items() if all(c in back for c in s)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.numbers = {i: str(i) for i in self.bytes}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        #: (left id << 20 | right id) -> rank << 20 | id of the merged part: ranks order as these numbers do.
        self.ranks: dict[int, int] = {}
        for rank, (a, b) in enumerate(pairs):
            a, b = raw(a), raw(b)
            self.ranks.setdefault(self.ids[a] << 20 | self.ids[b], rank << 20 | self.ids[a + b])
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        self.find = regex.compile(PATTERN).findall
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.chunks: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def merge(self, word: bytes) -> tuple[int, ...]:
        """The rank array: parts[i] is the part that starts at the i-th boundary, ranks[i] its merge with the next part. Long words have a heap."""
        if len(word) > LONG:
            return self.merge_long(word)
        table = self.byte_ids
        parts = [table[b] for b in word]
        get = self.ranks.get
        ranks = [get(a << 20 | b, NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            part = parts[i] = least & 0xFFFFF
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(part << 20 | parts[i + 1], NONE)
            if i:
                ranks[i - 1] = get(parts[i - 1] << 20 | part, NONE)
        return tuple(parts)

    def merge_long(self, word: bytes) -> tuple[int, ...]:
        """The same merges in the same order, the least rank and then the leftmost first: parts are linked, and a heap finds the least."""
        parts = [self.byte_ids[b] for b in word]
        n, get = len(parts), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        now = [get(a << 20 | b, NONE) for a, b in zip(parts, parts[1:])]  # the merge of each part with the next one
        heap = [(r, i) for i, r in enumerate(now) if r != NONE]
        heapify(heap)
        now.append(NONE)
        while heap:
            r, i = heappop(heap)
            if now[i] != r:
                continue  # one of the two has changed since
            gone = after[i]
            parts[i], after[i] = r & 0xFFFFF, after[gone]
            parts[gone], now[gone] = -1, NONE
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0:
                    now[k] = get(parts[k] << 20 | parts[after[k]], NONE) if after[k] < n else NONE
                    if now[k] != NONE:
                        heappush(heap, (now[k], k))
        return tuple(p for p in parts if p >= 0)

    def chunk(self, text: str) -> tuple[int, ...]:
        """Ids of a piece of text that no pre-token crosses the borders of."""
        out: list[int] = []
        for w in self.find(text):
            ids = self.words.get(w)
            if ids is None:
                ids = self.merge(w.encode())
                if len(w) <= 64:
                    if len(self.words) >= WORDS:
                        self.words.clear()
                    self.words[w] = ids
            out += ids
        return tuple(out)

    def plain(self, text: str) -> list[int]:
        """A space and what follows it up to the next space is a chunk of its own, if no white space touches that space."""
        if not text:
            return []
        head, *rest = text.split(" ")
        if not head or head[-1].isspace():
            return list(self.chunk(text))
        get, learn = self.chunks.get, self.learn
        pieces = [self.chunk(head), *[get(x) or learn(x) for x in rest]]
        if () in pieces:
            return list(self.chunk(text))
        return list(chain.from_iterable(pieces))

    def learn(self, piece: str) -> tuple[int, ...]:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return ()
        ids = self.chunk(" " + piece)
        if len(piece) <= 64:
            if len(self.chunks) >= CHUNKS:
                self.chunks.clear()
            self.chunks[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        if self.split_special is None or not any(s in text for s in self.special):
            return self.plain(text)
        out: list[int] = []
        for part in self.split_special.split(text):
            out += [self.special[part]] if part in self.special else self.plain(part)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")

    def joined(self, ids: list[int]) -> str:
        return ",".join(map(self.numbers.__getitem__, ids))


@lru_cache(maxsize=4)
def codec(path: str) -> ByteBpe:
    """One codec per worker and vocabulary: its memory of chunks serves all tasks that the worker runs."""
    return ByteBpe(path)


def encode_texts(docs: DataFrame, path: str | None = None, text: str = "text", check: bool = False) -> DataFrame:
    """The rows with a column ``ids array<int>``, and with check one ``round_trip``: whether the ids decode to the text.

    A null text counts as empty. Other columns are kept as they are, but for those of the new names. Repeated rows are
    encoded each; long texts whole. Ids go from numpy into Arrow, so a batch never becomes lists of Python numbers.
    """
    bounded_batches(docs.sparkSession)
    path = path or os.environ.get("LOOMGRAPH_BPE") or default_vocabulary()
    kept = docs.drop("ids", *["round_trip"] * check)
    schema = ", ".join(f"`{n}` {k}" for n, k in kept.dtypes) + ", ids array<int>" + ", round_trip boolean" * check
    arrow = _arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 250):
                batch = whole.slice(at, 250)
                flat, ends, good = [], [0], []
                for t in batch.column(text).to_pylist():
                    ids = own.encode(t or "")
                    flat.append(np.array(ids, np.int32))
                    ends.append(ends[-1] + len(ids))
                    if check:
                        good.append(own.decode(ids) == (t or ""))
                made = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat) if flat else np.empty(0, np.int32)))
                new = [made.cast(arrow.field("ids").type)] + [pa.array(good, pa.bool_())] * check
                yield pa.RecordBatch.from_arrays([*[c.cast(f.type) for c, f in zip(batch.columns, arrow)], *new], schema=arrow)

    return kept.mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """The rows with a column ``decoded string``; null ids decode to an empty text."""
    path = path or os.environ.get("LOOMGRAPH_BPE") or default_vocabulary()
    kept = encoded.drop("decoded")

    def rows(batch):
        own = codec(path)
        return batch | {"decoded": [own.decode(x or []) for x in batch[ids]]}

    return map_batches(kept, rows, ", ".join(f"`{n}` {k}" for n, k in kept.dtypes) + ", decoded string")


def round_trip(docs: DataFrame, path: str | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row: encoded, then decoded from the ids, in one pass.

    A null text counts as empty. Rows that repeat an id are each encoded. An empty table gives an empty result. Very
    long texts are encoded whole, in time that grows little faster than they do, also where they are one word. Other
    columns are not read, whatever their names.
    """
    bounded_batches(docs.sparkSession)
    path = path or os.environ.get("LOOMGRAPH_BPE") or default_vocabulary()
    sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()

    def rows(batch):
        own = codec(path)
        out = {"_id": batch["_id"], "n": [], "a": [], "b": []}
        for t in batch["_text"]:
            ids = own.encode(t or "")
            out["n"].append(len(ids))
            out["a"].append(sha(own.joined(ids)))
            out["b"].append(sha(own.decode(ids)))
        return {id: out["_id"], "n_tokens": out["n"], "ids_sha256": out["a"], "decoded_sha256": out["b"]}

    kind = dict(docs.dtypes)[id]
    return map_batches(docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")), rows, f"`{id}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
