"""Long repeats against a table of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from loomgraph.llm import repeats
from loomgraph.llm.repeats import LEAST, anchors_of, remove_repeats


def texts() -> list[tuple]:
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh ") for _ in range(6))
    prose = lambda n: "".join(word() for _ in range(n // 6 + 1))[:n]
    p1, p2 = prose(400), prose(230)
    out = [prose(r.randrange(0, 1500)) for _ in range(20)]
    out += [prose(90) + p1 + prose(50), p1, p1[:250], p1[150:] + prose(40), prose(300) + p1[60:300] + prose(100) + p1[100:330]]
    out += [prose(k) + p2 + prose(30 + k) for k in range(12)] + [p2[:199], p2[1:200] + "z" * 40, p2[:200]]
    out += ["x" * 700, "ab" * 400, "y" * 199, "z" * 200, "z" * 201, "é" * 150 + "q", out[3], out[3], "", None, "   ", p1 + p1]
    rows = [(i, t) for i, t in enumerate(out)]
    return rows + [(3, out[3]), (None, p2 + "!"), (5, prose(20) + p2)]


def brute(rows: list[tuple]) -> list[tuple]:
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + LEAST] for b in raw for i in range(len(b) - LEAST + 1))
    out = []
    for (i, _), b in zip(rows, raw):
        gone = np.zeros(len(b) + 2, bool)
        for k in range(len(b) - LEAST + 1):
            if seen[b[k : k + LEAST]] > 1:
                gone[k + 1 : k + 1 + LEAST] = True
        spans = int((np.diff(gone.astype(int)) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone[1:]) if not g)).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("together", [20_000, 3])
def test_all_copies(spark, together):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = remove_repeats(df, keep_first=False, together=together).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


@pytest.mark.parametrize("together", [20_000, 2])
def test_first_copy_stays(spark, together):
    rows = [x for x in texts() if x[0] is not None]
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in remove_repeats(df, together=together).collect()}
    seen = set()
    for k, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - LEAST + 1):
            if b[i : i + LEAST] in seen:
                gone[i : i + LEAST] = True
            seen.add(b[i : i + LEAST])
        assert got[k].n_removed == gone.sum(), k


def test_previous_factors_by_brute_force():
    r = random.Random(2)
    for _ in range(200):
        n = r.randrange(0, 12)
        run = np.cumsum([r.random() < 0.4 for _ in range(n)]).astype(np.int64)
        place = np.array(r.sample(range(30), n), np.int64)
        want = [any(run[j] == run[i] and place[j] < place[i] for j in range(n)) for i in range(n)]
        assert repeats.previous_factors(run, place).tolist() == want


def test_chunks_of_any_size(spark, monkeypatch):
    from loomgraph.llm import exchange

    monkeypatch.setattr(exchange, "CHUNK_ROWS", 3)
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = remove_repeats(df, keep_first=False).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_segments_of_long_texts_agree(monkeypatch):
    r = random.Random(1)
    text = bytes(r.choice(b"abcdef ") for _ in range(20_000))

    def strings(texts):
        return sorted((int(t), int(p), int(h), s) for found in anchors_of(texts) for t, p, h, lo, hi in zip(*found) for s in range(lo, hi + 1))

    whole = strings([b"short", text, text[:900]])
    assert {(t, s) for t, _, _, s in whole} == {(1, s) for s in range(20_000 - LEAST + 1)} | {(2, s) for s in range(900 - LEAST + 1)}
    monkeypatch.setattr(repeats, "SEGMENT", 3000)
    assert strings([b"short", text, text[:900]]) == whole


def test_empty_table_and_other_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, key string, raw int, h long")
    assert remove_repeats(empty).count() == 0
    rows = [(1, "a" * 250, "k", 1, 2), (2, "a" * 250, "k", 1, 2)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, key string, raw int, h long"), keep_first=False).collect()
    assert [r.n_removed for r in got] == [250, 250]


def test_anchors_spread_evenly_over_ranges():
    """The task of a range meets its share of the anchors, though anchors have the smallest hashes."""
    r = random.Random(3)
    h = np.frombuffer(repeats.anchored(["".join(r.choice("abcdefgh ") for _ in range(200_000))])[0], np.uint64)
    share = np.bincount((h >> np.uint64(61)).astype(int), minlength=8) / len(h)
    assert len(h) > 2000 and share.max() < 0.2


def row_groups(df):
    import pyarrow.parquet as pq

    files = [pq.ParquetFile(x.removeprefix("file://").removeprefix("file:")).metadata for x in df.inputFiles()]
    return [f.row_group(k).num_rows for f in files for k in range(f.num_row_groups)]


def test_readers_decode_few_chunks_at_once(spark, monkeypatch):
    """However well texts compress, a row group of chunks has few of them: readers decode a group's rows together."""
    from loomgraph.llm import exchange

    monkeypatch.setattr(exchange, "CHUNK_ROWS", 1)
    docs = spark.range(30).selectExpr("id AS doc_id", "repeat('same ', 100) AS text").coalesce(1)
    groups = row_groups(exchange.chunks(docs, "text"))
    assert sum(groups) == 30 and max(groups) <= 2


def test_row_groups_of_large_rows_are_small(spark):
    """The size of a row group counts from its first row, not from the hundredth."""
    from loomgraph.llm.common import stored

    df = spark.range(60).selectExpr("id", "array_join(transform(sequence(1, 10000), x -> sha2(concat(id, ' ', x), 256)), '') AS text").coalesce(1)
    groups = row_groups(stored(df, "large"))
    assert sum(groups) == 60 and max(groups) < 40
