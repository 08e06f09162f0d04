"""The prefix trie against one built turn by turn on the driver."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from loomgraph.llm import prefix_trie as pt

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def slow(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            digest = hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest()[:16]
            convs[c].append((t is not None, t or 0, r, digest, x))
    for own in convs.values():
        own.sort()
    members, ends = defaultdict(set), defaultdict(list)
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        path = tuple((r, x) for _, _, r, _, x in convs.get(base, [])[:h] + convs[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
        ends[path].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = own + sum(saved[q] for q in children[p])
    return [
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest() if p in ends else hashlib.sha256().hexdigest())
        for p, m in members.items()
    ]


def found(conversations):
    nodes, ends = pt.build_trie(conversations)
    from pyspark.sql import functions as F

    got = nodes.join(pt.digests_of_ends(ends), "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    return sorted(map(tuple, got.select(*COLUMNS).collect()), key=repr)


def made(seed):
    r = random.Random(seed)
    rows = []
    for c in [*range(0, 12), *range(100, 108), *range(215, 222), 300, 305, 411, -3, -100, -107, 20000, 20001, 20099, 1_000_000_007]:
        like = r.choice([0, 0, 1, c])
        own = random.Random(like)
        for t in range(r.choice([0, 1, 2, 5, 6, 7, 9, 30])):
            rows.append((c, t, "user" if t % 2 == 0 else None, own.choice(["a", "bb", "", "日本🎉", None, "c" * 50])))
    rows += [(c, t, "user", f"same {t}") for c in range(500, 560) for t in range(8)]
    rows += [(600, None, "x", "null turn"), (600, None, "x", "null turn"), (600, -1, "x", "minus"), (600, 3, "x", "b"), (600, 3, "a", "b"), (600, 3, "a", "a"), (None, 1, "u", "nobody"), (601, 1, "u", "z" * 200000), (602, 1, "u", "z" * 200000)]
    rows += [(700 + c, t, "u", "hot") for c in range(5) for t in range(40 if c else 90)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_nodes(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame([(*x, 1, 2, "e") for x in rows], SCHEMA + ", depth int, base int, ends string").repartition(4)
    assert found(df) == sorted(slow(rows), key=repr)


@pytest.mark.parametrize(("limit", "piece"), [(0, 3), (0, 1), (20, 7), (40, 4096)])
def test_large_families_by_pieces(spark, monkeypatch, limit, piece):
    monkeypatch.setattr(pt, "FAMILY_TURNS", limit)
    monkeypatch.setattr(pt, "PIECE_TURNS", piece)
    rows = made(3)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(4)) == sorted(slow(rows), key=repr)


def test_many_ends_in_slices(spark, monkeypatch):
    monkeypatch.setattr(pt, "ENDS_TOGETHER", 2)
    rows = [(c, t, "u", "x") for c in range(0, 2000, 7) for t in range(6)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == sorted(slow(rows), key=repr)


def test_a_chain_of_chains(spark):
    """Each conversation goes one turn further than the one before, in families of their own."""
    rows = [(100 * c, t, "u", f"t{t}") for c in range(40) for t in range(c + 1)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == sorted(slow(rows), key=repr)


def test_empty_and_last_turns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert found(empty) == []
    rows = [(0, 0, "u", "hello"), (0, 1, None, None), (100, 0, "u", "hello")]
    df = spark.createDataFrame(rows, SCHEMA)
    nodes, _ = pt.build_trie(df)
    got = pt.last_turns(nodes, df)
    said = {(r.depth, r.role, r.text) for r in got.collect()}
    assert (0, None, None) in said and said <= {(0, None, None), (1, "u", "hello"), (2, "", ""), (1, "", "")}


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = pt.op13_prefix_trie(spark, sf_dir)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(slow(rows), key=repr)
