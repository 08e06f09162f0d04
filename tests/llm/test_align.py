"""Cross-tokenizer alignment against loops over bytes and tokens."""

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from loomgraph.llm import align
from loomgraph.llm.bpe import byte_symbols, default_vocabulary

A = Tokenizer.from_file(default_vocabulary())
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=align.default_pieces())
BACK = {c: bytes([x]) for x, c in enumerate(byte_symbols())}
ODD = [
    "a\r\nb ;\r x", "  a   b ", "▁ x", "a▁b", "\t\n\n x\n", "<|endoftext|> <s> </s>\x00\x1c y", "é　日 🎉   x ", " ", "\n", "  ", "x" * 3000, "a \r\r b;\r;\r\n c", "don't I'LL 12³ ⅷ٣", "<0x41> <unk>", " ", "a  b",
    "the cat sat on the mat", "the cat sat on the mat", "The Cat", "\x85 x ﬁ① ", "zero​width ﻿",
]


def tokens(text):
    if not text:
        return [], []
    a = [(i, b"".join(BACK[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(B.IdToPiece(i)[3:5], 16)]) if B.IsByte(i) else B.IdToPiece(i).replace("▁", " ").encode()) for i in B.encode(text)]
    whole = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])


def spans(own):
    at, out = 0, []
    for i, x in own:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def slow(rows):
    """Of each (id, text) the contract's columns."""
    seen = []
    for _, t in rows:
        a, b = map(spans, tokens(t))
        links, j = [], 0
        for p, (_, s, e) in enumerate(a):
            while j < len(b) and b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                links.append((p, k))
                k += 1
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups = []
        for s, e in zip([0, *ends], ends):
            groups.append(([p for p, x in enumerate(a) if s < x[2] <= e], [p for p, x in enumerate(b) if s < x[2] <= e]) if len(a) < 500 else None)
        seen.append((a, b, links, groups))
    counts = Counter(pair for a, b, links, _ in seen for pair in {(a[p][0], b[q][0]) for p, q in links})
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for (i, _), (a, b, links, groups) in zip(rows, seen, strict=True):
        own = [(a[p][0], b[q][0]) for p, q in links]
        text = ";".join(",".join(str(a[p][0]) for p in x) + "|" + ",".join(str(b[q][0]) for q in y) for x, y in groups) if None not in groups else None
        sha = None if text is None else hashlib.sha256(text.encode()).hexdigest() if a else ""
        out.append((i, len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[0]] for x in own), sum(counts[x] for x in own), sha))
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def same(got, want):
    got, want = sorted(map(tuple, got), key=repr), sorted(want, key=repr)
    assert len(got) == len(want)
    for x, y in zip(got, want, strict=True):
        assert x[:7] == y[:7], (x, y)
        assert y[7] is None or x[7] == y[7], (x, y)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    made = ["".join(r.choice(["a", "b", " ", "  ", "\n", "é", "▁" if k % 9 == 0 else "e", "the ", "\r", "日", ";", "1"]) for _ in range(r.randrange(1, 60))) for k in range(150)]
    return [*enumerate([*ODD, *made]), (900, None), (901, ""), (None, "the cat"), (7, "again"), (902, "word " * 30000 + "the mat")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*x, [1], 2, "k") for x in rows], "doc_id long, text string, a_ids array<int>, links int, chunk string").repartition(5)


def test_figures(docs, rows):
    got = align.link_figures(docs)
    assert got.columns == COLUMNS
    same(got.collect(), slow(rows))
    assert align.link_figures(docs.limit(0)).count() == 0


def test_units_give_what_texts_give(rows):
    """Cut into units, a text has the same tokens, groups and links."""
    paths = align._paths(None, None)
    own = align.Aligner(*paths)
    texts = [t for _, t in rows if t]
    want = [own.owners([" " + t], True) for t in texts]
    for t, o in zip(texts, want, strict=True):
        own.forget()
        unit, _ = own.units_of([t])
        good = own.counts[unit, 4].all()
        assert bool(o.good[0]) == bool(good), t
        if good:
            assert own.counts[unit, :4].sum(0).tolist() == [o.n_a[0], o.n_b[0], o.n_groups[0], o.n_links[0]]
            assert "".join(own.groups[u] for u in unit) == o.group_texts()[0]
    assert own.find(" a b") == [" a", " b"]


def test_texts_that_can_not_be_cut(rows):
    """Without a proof that units are apart, whole texts are encoded, with the same results."""
    own = align.Aligner(*align._paths(None, None))
    own.find = None
    for t in [t for _, t in rows if t][:60]:
        unit, _ = own.units_of([t])
        a, b = tokens(t)
        assert own.counts[unit, :2].tolist() == [[len(a), len(b)]]


def test_alignments_as_arrays(docs, rows):
    got = align.align_texts(docs.where("doc_id is null or doc_id != 902")).collect()
    by = {(r.doc_id, r.text): r for r in got}
    for i, t in rows[:-1]:
        r = by[i, t]
        a, b = tokens(t)
        assert (r.a_ids, r.b_ids) == ([x for x, _ in a], [x for x, _ in b])
        sa, sb = spans(a), spans(b)
        if len(a) < 500:
            assert {(x.a, x.b) for x in r.links} == {(p, q) for p, (_, s, e) in enumerate(sa) for q, (_, u, v) in enumerate(sb) if s < v and u < e}
        assert [p for g in r.groups for p in g.a] == list(range(len(a))) and [q for g in r.groups for q in g.b] == list(range(len(b)))
        assert all(sa[g.a[-1]][2] == sb[g.b[-1]][2] for g in r.groups)
        assert r.chunk == "k"


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = align.op12_alignment(spark, sf_dir)
    assert got.columns == COLUMNS
    same(got.collect(), slow([tuple(r) for r in docs]))
