"""LM scoring with a weighted backoff automaton of words, word pairs and triples.

The n-grams of the training texts are the automaton's states. Each order is smoothed towards the next shorter one with
the weight MASS (Dirichlet smoothing): the arc of a counted n-gram hw has the probability
(n(hw) + MASS * p(w | shorter h)) / (n(h) + MASS), and a state's failure arc has the weight MASS / (n(h) + MASS). So an
arc's weight needs five counts and nothing else: of the triple, its two pairs and its last two words.

No n-gram is left out, and none is held by all tasks: each chunk of texts asks for the counts of its own n-grams
(exchange.py), and then has all arcs that its texts can take. The state after a word is the longest counted context of
the two words before it, so the traversal from left to right is done at all positions of a chunk at once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, map_batches, stored, table
from .exchange import chunks, cuts, from_counts, from_keys, packed_counts, packed_keys, range_bits, shortened, with_answers
from .langid import id_crc

#: Weight of the shorter context's distribution, in occurrences.
MASS = 2.0
#: Before the first word of a text and at its end: no word is empty.
END = b""
#: Words whose hashes a worker remembers.
KNOWN = 200_000


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased; bytes.split() splits on the six white space bytes."""
    return (text or "").encode("utf-8").lower().split()


class Automaton:
    """The model in one process, with its states, arcs and failure arcs: what the distributed scores must equal."""

    def __init__(self, texts: list[list[bytes]]):
        self.count: Counter = Counter()
        for words in texts:
            s = [END, *words, END]
            self.count.update((w,) for w in s[1:])
            self.count.update(zip(s, s[1:]))
            self.count.update(zip(s, s[1:], s[2:]))
        words = {g: n for g, n in self.count.items() if len(g) == 1}
        self.norm = sum(words.values()) + len(words) + 1
        #: State: counts of the word or pair that it stands for. An arc needs its state's failure arc, so both are found by length.
        self.failure: dict[tuple, tuple[float, tuple]] = {}
        self.arc: dict[tuple, float] = {(): math.log10(1 / self.norm)}
        for g in sorted(self.count, key=len):
            context = self.count[g[:-1]] if len(g) > 1 else 0
            lower = 10 ** self.weight(g[1:-1], g[-1]) if len(g) > 1 else 0.0
            self.arc[g] = math.log10((self.count[g] + MASS * lower) / (context + MASS)) if len(g) > 1 else math.log10((self.count[g] + 1) / self.norm)
            if len(g) < 3 and (g[-1] != END or len(g) == 1):  # nothing follows an end
                self.failure[g] = (math.log10(MASS / (self.count[g] + MASS)), g[1:])

    def weight(self, state: tuple, word: bytes) -> float:
        """The arc of a word out of a state, over failure arcs if need be."""
        total = 0.0
        while (*state, word) not in self.arc:
            if not state:
                return total + self.arc[()]
            down, state = self.failure.get(state, (0.0, state[1:]))
            total += down
        return total + self.arc[(*state, word)]

    def score(self, words: list[bytes]) -> float:
        state, total = (END,), 0.0
        for w in [*words, END]:
            total += self.weight(state, w)
            state = (*state, w)[-2:]
            while state and state not in self.failure:
                state = state[1:]
        return total


def mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """64 bits of two 64-bit values, in their order."""
    h = x * np.uint64(0x9E3779B97F4A7C15) ^ (y + np.uint64(0x165667B19E3779F9)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def hashed(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """64 bits of each word; known is a bounded memory."""
    if len(known) > KNOWN:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


class Chunk:
    """The tokens of a chunk's texts, and its questions: distinct words, and distinct pairs and triples, as sorted keys.

    words[word_at] and grams[pair_at], grams[triple_at] are those that end in each token; START, before each text, is
    END's word. A text's first token has no triple: its place is its pair's.
    """

    def __init__(self, texts: list[str | None], bits: int, known: dict[bytes, int]):
        split = [words_of(t) for t in texts]
        self.lengths = np.array([len(w) + 1 for w in split], np.int64)
        h = hashed([w for words in split for w in (END, *words, END)], known)
        text = np.repeat(np.arange(len(split)), self.lengths + 1)
        self.token = np.flatnonzero(np.concatenate([[False], text[1:] == text[:-1]]))  # all but START
        self.text = text[self.token]
        self.first = np.concatenate([[True], self.text[1:] != self.text[:-1]])[: len(self.text)]
        self.words, word_at = np.unique(h, return_inverse=True)
        self.word_at, self.before = word_at[self.token], word_at[self.token - 1]
        pair = mixed(h[self.token - 1], h[self.token])
        triple = mixed(np.concatenate([pair[:1], pair[:-1]]), h[self.token] ^ np.uint64(0x5851F42D4C957F2D))
        triple[self.first] = pair[self.first]
        self.grams, at = np.unique(shortened(np.concatenate([pair, triple]), bits), return_inverse=True)
        self.pair_at, self.triple_at = at[: len(pair)], at[len(pair) :]

    def counts(self, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of words and of n-grams, in the texts to learn from. The start of a text is no token."""
        own = learn[self.text]
        words = np.bincount(self.word_at[own], minlength=len(self.words))
        grams = np.bincount(self.pair_at[own], minlength=len(self.grams)) + np.bincount(self.triple_at[own & ~self.first], minlength=len(self.grams))
        return words, grams

    def log_probabilities(self, words: np.ndarray, grams: np.ndarray, total: int, kinds: int) -> tuple[np.ndarray, np.ndarray]:
        """(base, log10 probability) of each token, from the counts of the whole corpus."""
        one = (words[self.word_at] + 1.0) / (total + kinds + 1)
        pair, triple = grams[self.pair_at], grams[self.triple_at]
        two = (pair + MASS * one) / (words[self.before] + MASS)
        context = np.concatenate([[0], pair[:-1]])  # the pair before this token is the context of its triple
        three = np.where(self.first, two, (triple + MASS * two) / (context + MASS))
        return np.log10(one), np.log10(three)


def ask(parts: DataFrame, bits: int) -> DataFrame:
    """(range, chunk, words, word_n, grams, gram_n): distinct keys of the chunks with their counts in texts to learn from."""

    def rows(batch: dict) -> dict:
        out: dict[str, list] = {k: [] for k in ("range", "chunk", "words", "word_n", "grams", "gram_n")}
        known: dict[bytes, int] = {}
        for name, texts, learn in zip(batch["chunk"], batch["text"], batch["learn"], strict=True):
            c = Chunk(texts, bits, known)
            word_n, gram_n = c.counts(np.array(learn, bool))
            by = {r: (w, (0, 0)) for r, *w in cuts(c.words, bits)}
            for r, *g in cuts(c.grams, bits):
                by[r] = (by.get(r, ((0, 0),))[0], g)
            for r, ((a, b), (x, y)) in by.items():
                row = (r, name, packed_keys(c.words[a:b], bits, whole=True), packed_counts(word_n[a:b]), packed_keys(c.grams[x:y], bits), packed_counts(gram_n[x:y]))
                for held, v in zip(out.values(), row, strict=True):
                    held.append(v)
        return out

    return map_batches(parts.select("chunk", "text", "learn"), rows, "range int, chunk string, words binary, word_n binary, grams binary, gram_n binary")


def answer(asked: DataFrame) -> DataFrame:
    """(chunk, range, word_n, gram_n, total, kinds): counts of the whole corpus in the order of the questions; total and kinds of a range's words stand in one row of it."""

    def summed(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[list[bytes], np.ndarray]:
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        whole = np.bincount(at, np.concatenate(n)).astype(np.int64)  # exact below 2 ** 53
        edge = np.cumsum([0, *map(len, keys)])
        return [packed_counts(whole[at[a:b]]) for a, b in zip(edge, edge[1:], strict=False)], whole

    def judge(df: pd.DataFrame) -> pd.DataFrame:
        words, whole = summed([from_keys(x) for x in df["words"]], [from_counts(x) for x in df["word_n"]])
        grams, _ = summed([from_keys(x) for x in df["grams"]], [from_counts(x) for x in df["gram_n"]])
        once = np.arange(len(df)) == 0
        return pd.DataFrame({"chunk": df["chunk"], "range": df["range"], "word_n": words, "gram_n": grams, "total": whole.sum() * once, "kinds": (whole > 0).sum() * once})

    return asked.groupBy("range").applyInPandas(judge, "chunk string, range int, word_n binary, gram_n binary, total long, kinds long")


def score_texts(docs: DataFrame, learn: Column, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row, from the n-grams of the rows where learn holds.

    - A null text is empty: its one token is the end. Long texts are counted and scored whole.
    - Without training rows each token has probability 1 / (0 + 1), so all scores are 0.
    - Rows that repeat an id are learned from and scored on their own. An empty table gives an empty result.
    - Words are told apart by 64-bit hashes, longer n-grams by 47 bits or more, growing with the corpus. Ties don't arise.
    - Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = dict(docs.dtypes)[id]
    picked = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    parts = chunks(picked, "text")
    bits = range_bits(parts)
    answers = stored(answer(ask(parts, bits)), "lm")
    total, kinds = (int(x or 0) for x in answers.agg(F.sum("total"), F.sum("kinds")).first())

    def rows(batch: dict) -> dict:
        out: dict[str, list] = {k: [] for k in ("id", "n_tokens", "n_known", "base_score", "score")}
        known: dict[bytes, int] = {}
        for ids, texts, got in zip(batch["id"], batch["text"], batch["answers"], strict=True):
            c = Chunk(texts, bits, known)
            got = sorted(got, key=lambda x: x["range"])
            words, grams = (np.concatenate([from_counts(x[k]) for x in got]) for k in ("word_n", "gram_n"))
            base, score = c.log_probabilities(words, grams, total, kinds)
            sums = lambda x, c=c, n=len(ids): np.bincount(c.text, x, n)
            out["id"] += ids
            out["n_tokens"] += c.lengths.tolist()
            out["n_known"] += sums(words[c.word_at] > 0).astype(int).tolist()
            out["base_score"] += sums(base).tolist()
            out["score"] += sums(score).tolist()
        return out

    met = with_answers(parts.select("chunk", "id", "text"), answers.select("chunk", "range", "word_n", "gram_n"))
    scored = map_batches(met.select("id", "text", "answers"), rows, f"id {kind}, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("id").alias(id), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = id_crc(F.col("doc_id"), 7) == 2
    out = score_texts(docs, ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
