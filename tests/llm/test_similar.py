"""Near-duplicates by shingle similarity against all pairs."""

import random

import numpy as np
import pytest

from loomgraph.llm.similar import one_of_each, shingle_set


def brute(rows, similarity):
    sets = {i: shingle_set(t, 5) for i, t in rows if i is not None}
    ids = sorted(sets)
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if len(sets[a]) and len(sets[b]):
                shared = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if shared >= similarity * (len(sets[a]) + len(sets[b]) - shared) - 1e-9:
                    x, y = find(a), find(b)
                    up[max(x, y)] = min(x, y)
    return {i for i in ids if find(i) == i}


def rows():
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghij") for _ in range(4)) for _ in range(400)]
    out = []
    for base in range(12):
        text = [r.choice(words) for _ in range(r.choice([30, 120, 400]))]
        for _ in range(8):
            t = list(text)
            for _ in range(r.randrange(0, 7)):
                t[r.randrange(len(t))] = r.choice(words)
            out.append(" ".join(t[: len(t) - r.randrange(0, 9)]))
    out += ["", None, "  ", "one two", "One  two", "x", "x y z w v", "x y z w v u"]
    return list(enumerate(out))


@pytest.mark.parametrize("tile", [16384, 7])
def test_against_all_pairs(spark, tile, monkeypatch):
    from loomgraph.llm import similar

    monkeypatch.setattr(similar, "SET_BYTES", tile * 1000)
    data = rows()
    df = spark.createDataFrame([*data, (None, "a b c"), (None, "a b c")], "doc_id long, text string").repartition(3)
    got = [x.doc_id for x in one_of_each(df, tile=tile).collect()]
    assert got.count(None) == 2
    assert {x for x in got if x is not None} == brute(data, 0.8)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    data = [(x.doc_id, x.text) for x in docs.collect()]
    assert {x.doc_id for x in one_of_each(docs).collect()} == brute(data, 0.8)


def test_a_large_group_around_the_threshold(spark):
    # Each text differs from a common one in some words: nearly all pairs are open, and they are decided in the tiles.
    r = random.Random(9)
    text = [f"{r.randrange(10**9)}" for _ in range(104)]
    data = []
    for i in range(400):
        t = list(text)
        for k in r.sample(range(0, 104, 8), 2):
            t[k] = f"x{i}"
        data.append((i, " ".join(t)))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    assert {x.doc_id for x in one_of_each(df, tile=100).collect()} == brute(data, 0.8)


def test_repeated_ids(spark):
    data = [(1, "a b c d e f g h"), (1, "k l m n o p q r"), (2, "K l m n o p q r"), (3, "u v w x y z a b"), (3, "u v w x y z a b"), (4, "a B c d e f g h")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert sorted(x.doc_id for x in one_of_each(df).collect()) == [1, 1, 3, 3]


def test_empty(spark):
    assert one_of_each(spark.createDataFrame([], "doc_id long, text string, u long, id int")).count() == 0


@pytest.mark.parametrize("words, more", [(8, 1), (9, 1), (16, 1), (24, 3), (100, 12)])
def test_small_sets_at_the_threshold(spark, words, more):
    # The same text with some words more, of a similarity of 0.8 or just above.
    r = random.Random(words)
    texts = [[f"{r.randrange(10**9)}" for _ in range(words + more)] for _ in range(250)]
    data = list(enumerate(x for t in texts for x in (" ".join(t[:words]), " ".join(t))))
    df = spark.createDataFrame(data, "doc_id long, text string")
    want = brute([*data[:2]], 0.8)
    assert len(want) == 1
    assert {x.doc_id for x in one_of_each(df).collect()} == {i for i, _ in data if i % 2 == 0}
