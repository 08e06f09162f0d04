"""The pipeline's stages in turn against brute force, over whole texts, null and repeated ids."""

import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

import corpus_pipeline
from loomgraph.llm import bpe
from loomgraph.llm.similar import shingle_set


@pytest.fixture(scope="module")
def folder(spark, sf_dir, tmp_path_factory):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    text = rows[0][1] or "the cat and the dog are in the house"
    more = [(None, text, "en", "src_0", 1), (None, "Of the two cats in the house one is red.", "en", None, 1), (None, "Of the two cats in the house one is red.", "en", None, 1), (rows[3][0], rows[3][1], *rows[3][2:])]
    more += [(10_001, None, "en", "src_1", 0), (10_002, " \n\t", "en", "src_1", 0), (10_003, "12 34 !!", None, "src_1", 0), (10_004, "word " * 30_000, "en", "src_2", 0), (10_005, "word " * 30_001, "en", "src_2", 0), (rows[5][0], "another text of the same id, and of some words", "en", "src_2", 0)]
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame([*rows, *more], docs.schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def kept_texts(rows):
    """Of equal texts the row with the smallest id, null ids last."""
    best = {}
    for r in rows:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        order = (r.doc_id is None, r.doc_id or 0)
        if norm not in best or order < best[norm][0]:
            best[norm] = (order, r)
    return [r for _, r in best.values()]


def apart(rows):
    """Of each group linked by shared shingles, the rows of the smallest id; null ids stay."""
    sets = {}
    for r in rows:
        if r.doc_id is not None:
            sets.setdefault(r.doc_id, []).append(shingle_set(r.text, 5))
    ids, up = sorted(sets), {}

    def find(x):
        while x in up:
            x = up[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            for x in sets[a]:
                for y in sets[b]:
                    shared = len(np.intersect1d(x, y))
                    if len(x) and len(y) and shared >= 0.8 * (len(x) + len(y) - shared) - 1e-9:
                        u, v = find(a), find(b)
                        if u != v:
                            up[max(u, v)] = min(u, v)
    return [r for r in rows if r.doc_id is None or find(r.doc_id) == r.doc_id]


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def key(r):
    return (r.doc_id, r.text, r.source)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, rows = docs.columns, docs.collect()
    stages = dict(corpus_pipeline.STAGES)

    language = stages["language"](spark, docs, folder)
    told = language.collect()
    assert language.columns == columns
    assert Counter(map(key, told)) == Counter(key(r) for r in rows if any(map(str.isalpha, r.text or "")))

    exact = stages["exact_dedup"](spark, spark.createDataFrame(told, docs.schema).repartition(3), folder)
    once = exact.collect()
    assert exact.columns == columns and Counter(map(key, once)) == Counter(key(r) for r in kept_texts(told))

    near = stages["near_dedup"](spark, spark.createDataFrame(once, docs.schema).repartition(3), folder)
    single = near.collect()
    assert near.columns == columns and Counter(map(key, single)) == Counter(key(r) for r in apart(once))

    mixed = stages["mixing"](spark, spark.createDataFrame(single, docs.schema).repartition(3), folder)
    taken = mixed.collect()
    assert mixed.columns == columns
    sizes = Counter()
    for r in single:
        sizes[r.source] += words(r.text)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), Fraction(3, 2) * sum(sizes.values())
    while open_:
        whole = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] > 2 * sizes[s] * whole}
        target |= {s: Fraction(2 * sizes[s]) for s in over} if over else {s: left * weight[s] / whole for s in open_}
        if not over:
            break
        left -= sum(target[s] for s in over)
        open_ -= over
    got, copies, there = Counter(), Counter(map(key, taken)), Counter(map(key, single))
    for r in taken:
        got[r.source] += words(r.text)
    for s in order:
        assert abs(got[s] - target[s]) <= max(words(r.text) for r in single if r.source == s) / 2 + 1, s
    assert all(n <= 2 * there[k] for k, n in copies.items())

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    out = stages["tokens"](spark, spark.createDataFrame(taken, docs.schema), folder).collect()
    want = Counter((r.doc_id, r.lang, r.source, tuple(library.encode(r.text, add_special_tokens=False).ids)) for r in taken)
    assert Counter((r.doc_id, r.lang, r.source, tuple(r.ids)) for r in out) == want
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in out)
    assert Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, folder).collect()) == Counter((r.doc_id, tuple(r.ids)) for r in out)


def test_empty_table(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
