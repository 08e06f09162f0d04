"""Scores from the counts that chunks ask for, against a recursion over all counts and a walk over the automaton."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import exchange, lm


def brute(train, texts):
    seqs = [[b"", *lm.words_of(t), b""] for t in train]
    n = Counter(tuple(s[i : i + k]) for s in seqs for k in (2, 3) for i in range(len(s) - k + 1))
    n.update((w,) for s in seqs for w in s[1:])
    words = [g for g in n if len(g) == 1]
    norm = sum(n[g] for g in words) + len(words) + 1

    def p(c, w):
        if not c:
            return (n[w,] + 1) / norm
        return (n[*c, w] + lm.MASS * p(c[1:], w)) / (n[c] + lm.MASS)

    out = []
    for t in texts:
        s = [b"", *lm.words_of(t), b""]
        out.append(sum(math.log10(p(tuple(s[max(0, i - 2) : i]), s[i])) for i in range(1, len(s))))
    return out


def texts():
    r = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    heavy = lambda: words[min(3999, int(r.paretovariate(0.5)))]
    lines = [" ".join(heavy() for _ in range(r.randrange(0, 60))) for _ in range(300)]
    return [*lines, *[" ".join(words[i : i + 40]) for i in range(0, 4000, 40)], *lines[:50], *["same words again"] * 400, "", None, "w1", "W1 w2"]


@pytest.mark.parametrize("size, rows", [(8 << 20, 1 << 15), (2000, 1 << 15), (8 << 20, 7)])
def test_scores_of_all_n_grams(spark, monkeypatch, size, rows):
    monkeypatch.setattr(exchange, "CHUNK_BYTES", size)
    monkeypatch.setattr(exchange, "CHUNK_ROWS", rows)
    known = texts()
    data = [*known, "w5 unseen w6 w7", "unseen unseen", "w3999 w3998 w3997 w3"]
    df = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in lm.score_texts(df, F.col("doc_id") < len(known)).collect()}
    walk = lm.Automaton([lm.words_of(t) for t in known])
    assert len(got) == len(data)
    for i, x in enumerate(brute(known, data)):
        assert got[i] == pytest.approx(x, abs=1e-6), data[i]
        assert walk.score(lm.words_of(data[i])) == pytest.approx(x, abs=1e-9), data[i]


def test_every_state_is_a_distribution():
    walk = lm.Automaton([lm.words_of(t) for t in ("a b a b c", "b c", "", "a a a")])
    vocabulary = [b"a", b"b", b"c", b"", b"unknown"]
    for state in [(), *walk.failure, (b"unknown",), (b"c", b"a")]:
        assert sum(10 ** walk.weight(state, w) for w in vocabulary) == pytest.approx(1, abs=1e-9), state


def test_counts_survive_packing():
    import numpy as np

    n = np.array([0, 1, 254, 255, 256, 10**12, 3])
    assert exchange.from_counts(exchange.packed_counts(n)).tolist() == n.tolist()
    r = np.random.default_rng(1)
    for bits, most in ((5, 64), (5, 40), (30, 64), (3, 20)):
        keys = np.unique(np.concatenate([r.integers(0, 1 << most, 1000, np.uint64, False) if most < 64 else r.integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2), np.array([0, (1 << 64) - 1], np.uint64)]))
        for whole in (True, False):
            own = keys if whole else np.unique(exchange.shortened(keys, bits))
            for r_, a, b in exchange.cuts(own, bits):
                back = exchange.from_keys(exchange.packed_keys(own[a:b], bits, whole))
                off = 0 if whole else max(0, 20 - bits)
                assert back.tolist() == [(int(k) - (r_ << 64 - bits)) >> off for k in own[a:b]]
    assert len(exchange.from_keys(exchange.packed_keys(np.empty(0, np.uint64), 5))) == 0
