"""Language ID by prediction by partial matching.

Each language has a byte context tree of orders 0 to ORDER with escape probabilities (method C, without exclusion): a
byte seen in the longest context that the language knows costs -log2(n / (total + kinds)); else the escape costs
-log2(kinds / (total + kinds)), and the next shorter context decides; below order 0 every byte costs 8 bits. Contexts
that a language doesn't know cost nothing. The statistics are frozen after training, so the trees of all languages are
tabulated together: for each byte after its longest context that any language has seen it in, its cost in every
language, and for each context what escaping from it costs. A text's code lengths are sums over these tables.

The trees are fitted on a bounded sample of the labelled rows: whole texts, chosen by a hash, of SAMPLE_BYTES of each
language, expected. Counting is distributed; what reaches the driver is bounded by the number of sampled bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, map_stream, table

SAMPLE_BYTES = 2 << 20
ORDER = 4
UNDECIDED = "und"
#: Texts are looked up together up to so many bytes.
TOGETHER = 1 << 18


def id_crc(id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(id.cast("string"), F.lit(""))), F.lit(mod))


def symbols_of(text: str) -> bytes:
    """The text's bytes, ASCII letters lower-cased, after ORDER spaces of context."""
    return b" " * ORDER + text.encode("utf-8").lower()


def grams_of(data: np.ndarray) -> np.ndarray:
    """Each byte with the ORDER before it, as one number."""
    n, out = len(data) - ORDER, np.zeros(max(0, len(data) - ORDER), np.uint64)
    for k in range(ORDER + 1):
        out = out << np.uint64(8) | data[k : k + n]
    return out


def gram_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, gram, n) over all bytes of the given texts, pre-aggregated by batch."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            by: dict[str, list] = {}
            for t, name in zip(batch[text], batch[lang], strict=True):
                by.setdefault(name, []).append(grams_of(np.frombuffer(symbols_of(t), np.uint8)))
            for name, parts in by.items():
                gram, n = np.unique(np.concatenate(parts), return_counts=True)
                yield {"lang": [name] * len(gram), "gram": gram.astype(np.int64), "n": n}

    return map_stream(docs.select(text, lang), rows, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Lookup:
    """Places of keys in a sorted array, by hash tables in levels: keys that meet in a slot go on to the next level."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.levels = keys, []
        left = np.arange(len(keys), dtype=np.int32)
        while len(left):
            mult = np.uint64((0x9E3779B97F4A7C15 * (2 * len(self.levels) + 1)) % (1 << 64))
            shift = np.uint64(64 - max(4, (2 * len(left)).bit_length()))
            slots = np.full(1 << (64 - int(shift)), -1, np.int32)
            at = keys[left] * mult >> shift
            slots[at] = left
            self.levels.append((mult, shift, slots))
            left = left[slots[at] != left]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        out = np.full(len(keys), -1, np.int32)
        rest = np.arange(len(keys))
        for mult, shift, slots in self.levels:
            at = slots[keys[rest] * mult >> shift]
            used = at >= 0  # where a slot is empty, the key is nowhere
            rest, at = rest[used], at[used]
            same = self.keys[at] == keys[rest]
            out[rest[same]] = at[same]
            rest = rest[~same]
            if not len(rest):
                break
        return out


class Trees:
    """Costs in bits, a column for each language: of a byte after 0 to ORDER others, and of escaping from those."""

    def __init__(self, rows: list[tuple[str, np.ndarray, np.ndarray]]):
        """rows: (language, grams, counts)."""
        self.langs = [r[0] for r in sorted(rows, key=lambda r: r[0])]
        tables = {r[0]: r[1:] for r in rows}
        wide = len(self.langs)
        self.costs: list[tuple[Lookup, np.ndarray]] = []
        self.escapes: list[tuple[Lookup, np.ndarray]] = []
        shorter = np.empty(0)
        for k in range(ORDER + 1):  # k bytes of context
            mask = np.uint64((1 << 8 * (k + 1)) - 1)
            own = {}
            for name in self.langs:
                gram, at = np.unique(tables[name][0] & mask, return_inverse=True)
                own[name] = gram, np.bincount(at, tables[name][1])
            grams = np.unique(np.concatenate([g for g, _ in own.values()])) if own else np.empty(0, np.uint64)
            contexts = np.unique(grams >> np.uint64(8))
            escape, cost = np.zeros((len(contexts), wide), np.float32), np.zeros((len(grams), wide), np.float32)
            below = self.costs[-1][1][self.costs[-1][0].find(grams & (mask >> np.uint64(8)))] if k else np.full((len(grams), wide), 8.0)
            context_of = np.searchsorted(contexts, grams >> np.uint64(8))
            for j, name in enumerate(self.langs):
                gram, n = own[name]
                context, at = np.unique(gram >> np.uint64(8), return_inverse=True)
                total, kinds = np.bincount(at, n), np.bincount(at)
                escape[np.searchsorted(contexts, context), j] = -np.log2(kinds / (total + kinds))
                cost[:, j] = escape[context_of, j] + below[:, j]
                cost[np.searchsorted(grams, gram), j] = -np.log2(n / (total + kinds)[at])
            self.costs.append((Lookup(grams), cost))
            self.escapes.append((Lookup(contexts), escape))

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language; texts as symbols_of gives them."""
        whole = np.frombuffer(b"".join(texts), np.uint8)
        size = np.array([len(t) for t in texts])
        text = np.repeat(np.arange(len(texts)), size)[ORDER:]
        gram = grams_of(whole)
        inside = np.arange(ORDER, len(whole)) - np.repeat(np.cumsum(size) - size, size)[ORDER:] >= ORDER
        text, gram = text[inside], gram[inside]
        bits = np.zeros((len(texts), len(self.langs)))

        def add(of: np.ndarray, values: np.ndarray) -> None:
            for j in range(len(self.langs)):
                bits[:, j] += np.bincount(of, values[:, j], len(texts))

        for k in range(ORDER, -1, -1):
            gram = gram & np.uint64((1 << 8 * (k + 1)) - 1)
            lookup, cost = self.costs[k]
            at = lookup.find(gram)
            hit = at >= 0
            add(text[hit], cost[at[hit]])
            text, gram = text[~hit], gram[~hit]
            if not len(text):
                return bits
            lookup, escape = self.escapes[k]
            at = lookup.find(gram >> np.uint64(8))
            add(text[at >= 0], escape[at[at >= 0]])
        return bits + 8.0 * np.bincount(text, minlength=len(texts))[:, None]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, posterior under equal priors, bits a byte in that language) of each text."""
        out = [(UNDECIDED, 0.0, math.inf)] * len(texts)
        if not self.langs:
            return out
        held: list[tuple[int, bytes]] = []
        size = 0
        told = [i for i, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))]
        for i in [*told, -1]:
            if held and (i < 0 or size >= TOGETHER):
                for (k, data), bits in zip(held, self.code_lengths([d for _, d in held]), strict=True):
                    odds = np.exp2(np.maximum(bits.min() - bits, -1000))
                    best = int(bits.argmin())
                    out[k] = self.langs[best], float(odds[best] / odds.sum()), float(bits[best] / (len(data) - ORDER))
                held, size = [], 0
            if i >= 0:
                held.append((i, symbols_of(texts[i])))
                size += len(held[-1][1])
        return out


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id", sample_bytes: int = SAMPLE_BYTES) -> Trees:
    """Trees of the languages that occur; rows with a null text or language teach nothing, repeated rows each by the same draw."""
    good = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    sizes = {r["lang"]: r["n"] or 0 for r in good.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect()}  # a row per language
    if not sizes:
        return Trees([])
    rate = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample_bytes / max(1, n)))])
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 40)) / float(1 << 40)
    found = gram_counts(good.where(draw < F.element_at(rate, F.col("lang"))), "text", "lang").toArrow()  # as many rows as bytes in the sample at most
    name, gram, n = np.array(found["lang"].to_pylist(), object), found["gram"].to_numpy().astype(np.uint64), found["n"].to_numpy()
    return Trees([(x, gram[name == x], n[name == x]) for x in sorted(set(name.tolist()))])


def identify(docs: DataFrame, trees: Trees, id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, lang_pred, score, *keep) of every row; score is the posterior under equal priors.

    - A text that is null or has no letter gets ``und`` and score 0, and so does any text if nothing was learned.
    - Equal code lengths go to the first language by name. Long texts are judged whole.
    - Rows are judged one by one, whatever their ids: null and repeated ones too. An empty table gives an empty result.
    - Of other columns only those of ``keep`` are read; lang_pred and score may not be among them.
    """
    bounded_batches(docs.sparkSession)
    kinds = dict(docs.dtypes)
    held = docs.sparkSession.sparkContext.broadcast(trees)  # a few numbers for each sampled byte and language at most
    names = {f"_{i}": n for i, n in enumerate((id, *keep))}

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            got = held.value.predict(batch["_text"])
            yield {n: batch[k] for k, n in names.items()} | {"lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

    picked = docs.select(*[F.col(n).alias(k) for k, n in names.items()], F.col(text).alias("_text"))
    return map_stream(picked, rows, ", ".join(f"`{n}` {kinds[n]}" for n in names.values()) + ", lang_pred string, score double")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", id_crc(F.col("doc_id"), 4) == 2)
    trees = fit(docs.where("not held_out"))
    return identify(docs, trees, keep=("held_out",)).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, trees: Trees, most_bits: float = 8.0, text: str = "text") -> DataFrame:
    """The rows whose language can be told, unchanged and with all their columns.

    - Texts that are null or have no letter go, and so do those that the predicted language's tree takes ``most_bits``
      or more a byte for: no better than no model at all. All rows go if nothing was learned.
    - Long texts are judged whole; repeated rows, null ids and columns of any name are kept as they are.
    """
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = held.value.predict(batch.column(text).to_pylist())
            yield batch.filter(pa.array([lang != UNDECIDED and bits < most_bits for lang, _, bits in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
