"""Alignment of two tokenizers over the same bytes, by byte-owner arrays.

The index of each token is repeated over its bytes, for A and for B. Where either owner changes, a new pair of tokens
begins to overlap: the consecutive distinct pairs are the links. Where both change at once, both have ended a token: a cut
between groups. Texts are cut into units at white space that no token of either vocabulary crosses, and what a unit
gives is remembered per worker, so the arrays run over distinct units.

How many documents hold a pair of linked ids is a table of the whole corpus, bounded by the two vocabularies. Chunks of
texts name their distinct pairs, the table is joined to these, and a chunk's answers meet its texts again.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import PATTERN, byte_symbols, default_vocabulary
from .common import _arrow_schema, bounded_batches, map_batches, map_stream, stored, table

#: White space as Unicode has it, which is where A's words end.
SPACES = "\t\n\v\f\r \x85\xa0                　"
#: Units and their links that a worker remembers, and bytes of the texts of a chunk.
UNITS, LINKS, CHUNK_BYTES = 300_000, 6_000_000, 4 << 20
#: Units that are encoded as one text.
JOINED = 50


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Aligner:
    """A: byte-level BPE of the tokenizers library, over a space and the text; B: a sentencepiece model, which adds that space itself."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        back = {c: bytes([x]) for x, c in enumerate(byte_symbols())}
        entries = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        pieces = [self.b.IdToPiece(i) for i in range(self.b.GetPieceSize())]
        of_a = [b"".join(back[c] for c in t) if all(c in back for c in t) else t.encode() for t in entries]
        of_b = [bytes([int(p[3:5], 16)]) if self.b.IsByte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.bytes_a, self.start_a, self.len_a = _flat(of_a)
        self.bytes_b, self.start_b, self.len_b = _flat(of_b)
        self.names_a, self.names_b = ([f"{i}{sep}" for sep in ",|;" for i in range(len(x))] for x in (of_a, of_b))
        self.ranked = self._ranked(spec, of_a)
        self.find = self.ranked and self._cuts(spec, [p for i, p in enumerate(pieces) if not self.b.IsByte(i)])
        self.forget()

    def _ranked(self, spec: dict, entries: list[bytes]):
        """A's vocabulary as ranks, for an encoder that makes the same merges some times as fast; None where ids don't go up as the merges do."""
        special = {t["id"] for t in spec["added_tokens"]}
        ranks = {x: i for i, x in enumerate(entries) if i not in special}
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        if len(ranks) != 256 + len(merged) or [self.a.token_to_id(m) for m in merged] != list(range(256, 256 + len(merged))) or spec["model"].get("ignore_merges"):
            return None
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _cuts(self, spec: dict, pieces: list[str]):
        """What finds the units of a text; None where the vocabularies don't show that both tokenize units as they do the text.

        A's words must end at white space. B must leave texts as they are, fall back to bytes, have no piece with a line
        feed, and none in which a space, or another character at which a unit starts, follows something else.
        """
        pre = spec.get("pre_tokenizer") or {}
        sample = " ﬁ①  a　é­\t́ \r\n x "
        plain = self.b.Normalize(sample) == "▁" + sample.replace(" ", "▁")
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or not plain or sum(map(self.b.IsByte, range(self.b.GetPieceSize()))) < 256:
            return None
        later = {c for p in pieces for c in p.replace("▁", " ").lstrip(" ")[1:]} | {c for p in pieces if p[0] == "▁" for c in p.lstrip("▁")[:1]}
        if " " in later or any("\n" in p for p in pieces):
            return None
        within = "".join(c for c in SPACES if c in later)
        tail = f"(?:[{within}][{SPACES}]*[^{SPACES}]*)*" if within else ""
        return re.compile(f"[{SPACES}]*[^{SPACES}]+{tail}|[{SPACES}]+").findall

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.counts = np.empty((0, 5), np.int64)  # tokens of A and of B, groups, links, and whether the bytes are those of the unit
        self.links = np.empty(0, np.int64)  # id of A << 32 | id of B, unit after unit
        self.ends = np.zeros(1, np.int64)
        self.groups: list[str] = []

    def tokens(self, units: list[str], whole: bool) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, the unit of each) of A and of B. whole: each unit is a space and a text, encoded on its own.

        Else units that end in no white space are encoded as one text, since nothing crosses from one to the next, and
        B gets a line feed first, so that its added space stands alone.
        """
        if whole:
            a = [self.a.encode(u, add_special_tokens=False).ids for u in units]
            return [_joined(a), _joined(self.b.encode([u[1:] for u in units], num_threads=1))]
        texts: list[str] = []
        held: list[str] = []
        for u in units:
            loose = u[-1] in SPACES
            if held and (loose or len(held) == JOINED):
                texts.append("".join(held))
                held = []
            (texts if loose else held).append(u)
        texts += ["".join(held)] if held else []
        flat_a = np.concatenate([self.ranked.encode_to_numpy(t) for t in texts]).astype(np.int64)
        flat_b = np.array([i for x in self.b.encode(["\n" + t for t in texts], num_threads=1) for i in x[2:]], np.int64)
        out = []
        for flat, size, raw in ((flat_a, self.len_a, units), (flat_b, self.len_b, [u.replace("▁", " ") for u in units])):
            ends = np.cumsum([len(u.encode()) for u in raw])
            out.append((flat, np.searchsorted(ends, np.cumsum(size[flat]))))
        return out

    def owners(self, units: list[str], whole: bool) -> Owners:
        """The links of units that both tokenizers give back byte for byte; of others none, and no tokens."""
        return Owners(self, units, *self.tokens(units, whole))

    def learn(self, units: list[str]) -> None:
        for k in range(0, len(units), 20_000):
            o = self.owners(units[k : k + 20_000], self.find is None)
            self.counts = np.concatenate([self.counts, np.stack([o.n_a, o.n_b, o.n_groups, o.n_links, o.good], 1)])
            self.links = np.concatenate([self.links, o.ids_a[o.link_a] << 32 | o.ids_b[o.link_b]])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(o.n_links)])
            self.groups += o.group_texts()

    def units_of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(unit, text) of each unit that occurs; all units are learned then. Texts that are null or empty have none."""
        if len(self.at) > UNITS or len(self.links) > LINKS:
            self.forget()
        at, flat, counts = self.at, [], []
        for t in texts:
            own = [] if not t else self.find(" " + t) if self.find else [" " + t]
            flat += [at.setdefault(u, len(at)) for u in own]
            counts.append(len(own))
        if len(at) > len(self.groups):
            self.learn(list(at)[len(self.groups) :])
        return np.array(flat, np.int64), np.repeat(np.arange(len(texts)), counts)


def _joined(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([i for x in ids for i in x], np.int64), np.repeat(np.arange(len(ids)), [len(x) for x in ids])


def _flat(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in entries], np.int64)
    return np.frombuffer(b"".join(entries), np.uint8), np.cumsum(sizes) - sizes, sizes


def _spread(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each size."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _changes(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], x[1:] != x[:-1]]) if len(x) else np.empty(0, bool)


class Owners:
    """What byte-owner arrays show of some units: tokens, links as pairs of token places, and cuts."""

    def __init__(self, own: Aligner, units: list[str], a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]):
        n, raw = len(units), [u.encode() for u in units]
        held = []
        for (flat, of), data, start, size in ((a, own.bytes_a, own.start_a, own.len_a), (b, own.bytes_b, own.start_b, own.len_b)):
            held.append((flat, of, data[np.repeat(start[flat], size[flat]) + _spread(size[flat])], np.bincount(of, size[flat], n).astype(np.int64)))
        sizes = np.array([len(x) for x in raw], np.int64)
        good = (held[0][3] == sizes) & (held[1][3] == sizes)
        text = np.frombuffer(b"".join(x for x, g in zip(raw, good, strict=True) if g), np.uint8)
        for _, _, data, own_sizes in held:
            differs = data[np.repeat(good, own_sizes)] != text
            good[np.repeat(np.flatnonzero(good), sizes[good])[differs]] = False
            if differs.any():  # rare: judge again what is left
                text = np.frombuffer(b"".join(x for x, g in zip(raw, good, strict=True) if g), np.uint8)
        self.good = good
        (self.ids_a, self.of_a), (self.ids_b, self.of_b) = ((flat[good[of]], of[good[of]]) for flat, of, _, _ in held)
        owner_a, owner_b = (np.repeat(np.arange(len(x)), s[x]) for x, s in ((self.ids_a, own.len_a), (self.ids_b, own.len_b)))
        turn_a, turn_b = _changes(owner_a), _changes(owner_b)
        begins = np.flatnonzero(turn_a | turn_b)
        self.link_a, self.link_b, self.cut = owner_a[begins], owner_b[begins], (turn_a & turn_b)[begins]
        self.unit = self.of_a[self.link_a]
        self.n_a, self.n_b = np.bincount(self.of_a, minlength=n), np.bincount(self.of_b, minlength=n)
        self.n_links, self.n_groups = np.bincount(self.unit, minlength=n), np.bincount(self.unit[self.cut], minlength=n)
        self.names = own.names_a, own.names_b

    def group_of(self) -> tuple[np.ndarray, np.ndarray]:
        """The group of each token of A and of B, counted over all units."""
        group = np.cumsum(self.cut) - 1
        return group[_changes(self.link_a)], group[_changes(self.link_b)]

    def group_texts(self) -> list[str]:
        """Each unit's groups as ``a1,a2|b1;`` one after the other."""
        in_a, in_b = self.group_of()
        m, k = len(in_a), int(self.cut.sum())
        place_a = np.arange(m) + np.searchsorted(in_b, in_a)  # A's tokens of a group stand before B's
        place_b = np.arange(len(in_b)) + np.searchsorted(in_a, in_b, "right")
        last_a, last_b = (np.concatenate([x[1:] != x[:-1], [True]])[: len(x)] for x in (in_a, in_b))
        names = np.empty(m + len(in_b), object)
        size_a, size_b = len(self.names[0]) // 3, len(self.names[1]) // 3
        names[place_a] = [self.names[0][i] for i in (self.ids_a + size_a * last_a).tolist()]
        names[place_b] = [self.names[1][i] for i in (self.ids_b + 2 * size_b * last_b).tolist()]
        flat, ends = names.tolist(), np.cumsum(self.n_a + self.n_b).tolist()
        assert k == (in_a[-1] + 1 if m else 0)
        return ["".join(flat[i:j]) for i, j in zip([0, *ends], ends, strict=False)]


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One per worker and pair of vocabularies."""
    return Aligner(a_path, b_path)


def _paths(a_path: str | None, b_path: str | None) -> tuple[str, str]:
    return a_path or os.environ.get("LOOMGRAPH_BPE") or default_vocabulary(), b_path or os.environ.get("LOOMGRAPH_PIECES") or default_pieces()


def align_texts(docs: DataFrame, text: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """The rows with columns a_ids and b_ids, groups (an array of structs of the places of A's and B's tokens) and links (an array of pairs of places).

    A null or empty text has no tokens, nor has one that the two tokenizers don't both give back byte for byte (the
    space before it included). Repeated rows are aligned each; long texts whole. Input columns of the new names are
    replaced. An empty table gives an empty one.
    """
    bounded_batches(docs.sparkSession)
    paths = _paths(a_path, b_path)
    kept = docs.drop("a_ids", "b_ids", "groups", "links")

    def rows(batch: dict) -> dict:
        own = aligner(*paths)
        new: dict[str, list] = {"a_ids": [], "b_ids": [], "groups": [], "links": []}
        for t in batch[text]:
            o = own.owners([" " + t] if t else [], True)
            in_a, in_b = (np.split(np.arange(len(g)), np.flatnonzero(_changes(g))[1:]) for g in o.group_of())
            new["a_ids"].append(o.ids_a.tolist())
            new["b_ids"].append(o.ids_b.tolist())
            new["groups"].append([{"a": x.tolist(), "b": y.tolist()} for x, y in zip(in_a, in_b, strict=True)] if len(o.ids_a) else [])
            new["links"].append([{"a": x, "b": y} for x, y in zip(o.link_a.tolist(), o.link_b.tolist(), strict=True)])
        return batch | new

    schema = ", ".join(f"`{n}` {k}" for n, k in kept.dtypes) + ", a_ids array<int>, b_ids array<int>, groups array<struct<a array<int>, b array<int>>>, links array<struct<a int, b int>>"
    return map_batches(kept, rows, schema)


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.astype(np.uint32).tobytes())


def _unpack(x: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint32).astype(np.int64)


def aligned_chunks(docs: DataFrame, paths: tuple[str, str], id: str, text: str) -> DataFrame:
    """Texts in chunks of some megabytes, kept in the shared folder: a row of each with its documents' figures, its distinct pairs of linked ids, in how many of its documents each is, and which documents hold which pair how often."""
    kind = dict(docs.dtypes)[id]

    def packed(ids: list, texts: list, name: str) -> dict[str, list]:
        own = aligner(*paths)
        n = len(ids)
        unit, doc = own.units_of(texts)
        bad = np.bincount(doc, own.counts[unit, 4] == 0, n) > 0
        fine = ~bad[doc]
        sums = [np.bincount(doc[fine], own.counts[unit[fine], k], n).astype(np.int64) for k in range(4)]
        parts, edge = [own.groups[u] for u in unit.tolist()], np.searchsorted(doc, np.arange(n + 1)).tolist()
        shas = [hashlib.sha256("".join(parts[i:j])[:-1].encode()).hexdigest() if j > i and not b else "" for i, j, b in zip(edge, edge[1:], bad.tolist(), strict=False)]
        # pairs of the chunk's distinct units, each unit of a document with how often it occurs there
        seen, local = np.unique(unit[fine], return_inverse=True)
        sizes = own.counts[seen, 3]
        keys, of_link = np.unique(own.links[np.repeat(own.ends[seen], sizes) + _spread(sizes)], return_inverse=True)
        start = np.cumsum(sizes) - sizes
        held, times = np.unique(doc[fine] * max(1, len(seen)) + local, return_counts=True)
        of, u = np.divmod(held, max(1, len(seen)))
        link = of_link[np.repeat(start[u], sizes[u]) + _spread(sizes[u])]
        both, at = np.unique(np.repeat(of, sizes[u]) * max(1, len(keys)) + link, return_inverse=True)
        each = np.bincount(at, np.repeat(times, sizes[u]), len(both))
        of, link = np.divmod(both, max(1, len(keys)))
        return {
            "chunk": [name], "id": [ids], "n_a": [sums[0].tolist()], "n_b": [sums[1].tolist()], "n_groups": [sums[2].tolist()], "n_links": [sums[3].tolist()], "sha": [shas],
            "keys": [keys.tolist()], "n_docs": [np.bincount(link, minlength=len(keys)).tolist()], "own": [np.bincount(of, minlength=n).tolist()], "pair": [_pack(link)], "times": [_pack(each)],
        }

    def rows(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        ids: list = []
        texts: list = []
        size = made = 0
        for batch in batches:
            for i, t in zip(batch["_id"], batch["_text"], strict=True):
                if texts and (size + len(t or "") > CHUNK_BYTES or len(texts) == 1 << 14):
                    yield packed(ids, texts, f"{TaskContext.get().partitionId():08d}-{made:08d}-{uuid.uuid4().hex}")
                    ids, texts, size, made = [], [], 0, made + 1
                ids.append(i)
                texts.append(t)
                size += len(t or "")
        if texts:
            yield packed(ids, texts, f"{TaskContext.get().partitionId():08d}-{made:08d}-{uuid.uuid4().hex}")

    schema = f"chunk string, id array<{kind}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, sha array<string>, keys array<long>, n_docs array<long>, own array<long>, pair binary, times binary"
    return stored(map_stream(docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")), rows, schema), "aligned")


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(key, n, best): of each pair of linked ids in how many documents it is, and whether no other pair of its A id is in more. An A id has as many pairs as B has ids, at most."""
    from pyspark.sql import Window

    each = chunks.select(F.explode(F.arrays_zip("keys", "n_docs")).alias("x")).groupBy(F.col("x.keys").alias("key")).agg(F.sum("x.n_docs").alias("n"))
    top = F.max("n").over(Window.partitionBy(F.shiftright("key", 32)))
    return each.select("key", "n", (F.col("n") == top).alias("best"))


def link_figures(docs: DataFrame, id: str = "doc_id", text: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row; see align_texts for texts without tokens: zeros, and '' for the hash.

    A pair's count is that of the rows that hold it linked, so rows that repeat an id or a text count each. An empty
    table gives an empty result. Other columns are not read, whatever their names.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id]
    bounded_batches(spark)
    chunks = aligned_chunks(docs, _paths(a_path, b_path), id, text)
    asked = chunks.select(F.col("chunk").alias("to"), F.posexplode("keys").alias("pos", "key"))
    answers = asked.join(pair_counts(chunks), "key").select("to", "pos", "n", "best")
    figures = ["n_a", "n_b", "n_groups", "n_links"]
    arrow = _arrow_schema(spark, f"`{id}` {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")

    def finish(part: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        pos = found.column("pos").to_numpy()
        n, best = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
        n[pos], best[pos] = found.column("n").to_numpy(), found.column("best").to_numpy()
        for r in part.to_pylist():
            pair, times = _unpack(r["pair"]), _unpack(r["times"])
            of, m = np.repeat(np.arange(len(r["id"])), r["own"]), len(r["id"])
            # whole numbers below 2 ** 53 for a document of less than some petabytes
            counted = [np.bincount(of, w * times, m).astype(np.int64) for w in (best[pair], n[pair])]
            columns = [r["id"], *[r[k] for k in figures], *counted, r["sha"]]
            out.append(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow))
        return pa.concat_tables(out) if out else arrow.empty_table()

    own = chunks.select("chunk", "id", *figures, "sha", "own", "pair", "times")
    return own.groupBy("chunk").cogroup(answers.groupBy("to")).applyInArrow(finish, f"`{id}` {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_figures(table(spark, sf_dir, "documents"))
