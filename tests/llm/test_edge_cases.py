"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from loomgraph.llm import bpe, exact_dedup, langid, lm, mixing, simhash, topk, url_filter, warc

EXTRA = "ids array<int>, _id string, _h int, h int, key int, size int, target int, keep_id int, fp int, word int, n int, label int, rule int, kept int, payload int, _text int, rank int, v int, id int"
CLASH = [[1], "x", *[7] * 17]
DOCS = [
    (1, "The cat  sat\ton the mat", "en", "b"), (2, "the cat sat on the mat", "en", "b"), (3, "The cat sat on the mat", "en", "a"), (4, None, None, None), (5, "", "en", "a"),
    (6, " \t\n", "de", "b"), (7, "x" * 3000 + " " + "wort " * 5000, "de", "c"), (8, "x" * 3000 + " " + "wort " * 5000, "de", "c"), (9, "1234 !?", "en", None), (9, "1234 !?", "en", None),
    (None, "le chat est sur la table", None, "c"), (10, "<|endoftext|> naïve 日本語 🎉", "fr", "é"), (11, "one two", "fr", "a"), (12, "One Two", "fr", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*d, *CLASH) for d in DOCS], f"doc_id long, text string, lang string, source string, {EXTRA}").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def plain(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


# 1. BPE


def test_bpe_as_the_library_does(docs, empty):
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(bpe.default_vocabulary())
    want = []
    for i, t, *_ in DOCS:
        ids = ref.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(ref.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, bpe.round_trip(docs).collect()), key=repr) == sorted(want, key=repr)
    assert bpe.round_trip(empty).count() == 0
    kept = bpe.decode_ids(bpe.encode_texts(docs))
    assert {(r.text or "") == r.decoded for r in kept.collect()} == {True}


def test_long_words_merge_alike():
    import random
    import time

    own, r = bpe.ByteBpe(bpe.default_vocabulary()), random.Random(4)
    words = ["".join(r.choice(x) for _ in range(n)) for x in ("ab", "etaoin shrdlu".replace(" ", ""), "é日x") for n in (1, 2, 57, 300, 900)] + ["a" * 777, "ing" * 200]
    short = bpe.LONG
    for w in words:
        bpe.LONG = 10**9
        want = own.merge(w.encode())
        bpe.LONG = short
        assert own.merge_long(w.encode()) == want, w
    began, word = time.time(), "".join(r.choice("abcdefgh") for _ in range(1 << 20))
    assert own.decode(own.encode(word)) == word and time.time() - began < 30


@pytest.mark.parametrize("text", ["  a", "a  b", "a ", " a\n b", "a\n\n b", "don't I'LL", "\u3000x \u00a0y", "12³ ⅷ٣", "x\x1c y", "\x85 a", "a\r\nb", "tab\tx y", "é" * 300, "<|endoftext|>", "a <|endoftext|> b", "\u200b \ufeff"])
def test_bpe_of_odd_white_space(text):
    from tokenizers import Tokenizer

    own, ref = bpe.codec(bpe.default_vocabulary()), Tokenizer.from_file(bpe.default_vocabulary())
    ids = ref.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids and own.encode(text) == ids
    assert own.decode(ids) == ref.decode(ids, skip_special_tokens=False)


def test_bpe_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CHUNKS", 5)
    monkeypatch.setattr(bpe, "WORDS", 5)
    own = bpe.ByteBpe(bpe.default_vocabulary())
    text = " ".join(f"word{i}" for i in range(50))
    assert own.decode(own.encode(text)) == text
    assert len(own.chunks) <= 5 and len(own.words) <= 5


# 2. URL filters


def test_url_rules(spark):
    urls = [
        (1, "http://a.com/"), (2, "http://a.com"), (3, "HTTP://WWW.Example.COM/en/x?q#f"), (4, "https://example.com/en/"), (5, "https://m.example.com/en/1"), (6, "https://example.com/de/"), (7, "http://x.net/es/"),
        (8, "http://x.net/ES/"), (9, "net/es/"), (10, None), (11, ""), (12, "https://spam-farm.example.org/en"), (13, "x://y://z.com/"), (14, "http://notnet/fr/"), (15, "http://net/fr/"), (16, "http://com/"), (17, "http://"),
        (17, "http://"), (None, "http://casino.org/"), (18, "http://example.org/phishing?x"), (19, "http://a.com:80/"), (20, "http://spam.example.org/#" + "a" * 20000), (21, "http://EXAMPLE.com/en/"), (22, "http://a.com?x=/"),
    ]
    got = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(urls, "page_id long, url string")).collect()}
    assert [got[k].rule for k in (1, 2, 3, 4, 5, 6, 7, 8)] == ["com/", None, "www.example.com/en/", "example.com/en/", "example.com/en/", "com/", "net/es/", None]
    assert [got[k].verdict for k in (3, 5, 6, 7, 8, 9, 10, 12, 18, None)] == ["allow", "block", "allow", "block", "allow", "allow", "allow", "block", "block", "block"]
    assert (got[3].host, got[3].path, got[9].host, got[10].path, got[13].host, got[13].path) == ("www.example.com", "/en/x", "", "", "y:", "//z.com/")
    assert (got[14].rule, got[15].rule, got[16].rule, got[19].rule, got[20].verdict, got[21].rule, got[22].path) == (None, "net/fr/", "com/", None, "block", "example.com/en/", "")
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string, host int")).count() == 0


def test_url_index_runs_few_rules():
    rules = [url_filter.host_rule("block", f"site{i}.org/a/") for i in range(1000)]
    index = url_filter.RuleIndex(rules, {"org": 1000, "a": 1000})
    assert len(index.candidates({"http", "site7", "org", "a"})) == 1
    assert index.judge("http://www.site7.org/a/b")[3] == "block"


# 3. Mixing


def test_rows_are_repeated_by_their_own_plan(spark):
    rows = [(None if i % 2 else i % 7, "w " * (i % 5), "ab"[i % 3 == 0], i, "r", 1) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _row int, _again string, _reps int").repartition(3)
    plan = mixing.mix(df).collect()
    want = Counter()
    for r in plan:
        want[r.doc_id, r.size, r.source] += r.reps
    got = mixing.repeat_rows(df)
    assert got.columns == df.columns
    rows = got.collect()
    assert Counter((r.doc_id, len(r.text.split()), r.source) for r in rows) == +want and len(rows) == sum(r.reps for r in plan)
    assert max(Counter(r._row for r in rows).values()) <= 2 and mixing.repeat_rows(df.limit(0)).count() == 0


def test_mixing(docs, empty, spark):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(DOCS)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r["size"]) for r in rows) == Counter((d[0], words(d[1])) for d in DOCS)
    for name in {d[3] for d in DOCS}:
        own = [r for r in rows if r.source == name]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r["size"] for r in own) / 2 + 1e-9
        assert all(r.taken <= 2 * r["size"] for r in own)
    again = mixing.mix(docs.repartition(5)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, None, "a")], "doc_id long, text string, source string")).first().taken == 0


def test_water_fill():
    assert mixing.water_fill([100, 100, 100], [5, 2, 1], 450, 2) == [200, pytest.approx(500 / 3), pytest.approx(250 / 3)]
    assert sum(mixing.water_fill([10, 1000], [5, 2], 1515, 2)) == 1515
    assert mixing.water_fill([10, 20], [1, 1], 1000, 2) == [20, 40]
    assert mixing.water_fill([0, 10], [5, 2], 15, 2) == [0, 15]


# 4. SimHash


def brute_components(rows):
    fp = [simhash.fingerprint(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fp[a] ^ fp[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    first = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            first[find(k)] = min(i, first.get(find(k), i))
    return sorted(((i, fp[k], first.get(find(k))) for k, (i, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("tile, segments", [(8192, None), (3, 3), (5, 4)])
def test_simhash(spark, docs, empty, tile, segments, monkeypatch):
    rows = [d[:2] for d in DOCS] + [(100 + k, f"a b c d e f g {'z' * (k % 5)} h i j k l m n o p q r s t u v w {k // 9}") for k in range(60)] + [(300 + k, "w" * k) for k in range(30)]
    fps = simhash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    edges = simhash.links(fps.select("fp").distinct(), 4, segments, tile)
    from loomgraph.llm.components import components

    root = {r.node: r.root for r in components(edges).collect()}
    want = brute_components(rows)
    by_root, by_want = {}, {}
    for (i, t), (_, _, c) in zip(sorted(rows, key=repr), sorted(zip(rows, [None] * len(rows), [None] * len(rows)), key=repr)):
        f = simhash.fingerprint(t)
        f -= (1 << 64) if f >= 1 << 63 else 0
        by_root.setdefault(root.get(f, f), set()).add((i, t))
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got), key=repr) == want
    assert len(by_root) == len({c if c is not None else "none" for *_, c in want})
    if tile == 8192:
        assert simhash.near_duplicates(empty).count() == 0
        assert simhash.near_duplicates(docs).count() == len(DOCS)


# 5. Exact dedup


def brute_dedup(rows):
    out = []
    for i, t, *_ in rows:
        own = [j for j, u, *_ in rows if plain(u) == plain(t)]
        keep = min((j for j in own if j is not None), default=None)
        first = (i, plain(t)) not in [(o[0], o[5]) for o in out]
        out.append((i, keep, len(own), i == keep and first, sha(plain(t)), plain(t)))
    return sorted((o[:5] for o in out), key=repr)


def test_exact_dedup(docs, empty):
    from pyspark.sql import functions as F

    assert sorted(map(tuple, exact_dedup.exact_dedup(docs).collect()), key=repr) == brute_dedup(DOCS)
    collide = lambda norm: F.length(norm).cast("string").cast("binary")
    assert sorted(map(tuple, exact_dedup.exact_dedup(docs, hash_of=collide).collect()), key=repr) == brute_dedup(DOCS)
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert sorted((r.doc_id for r in exact_dedup.keep_first(docs).collect()), key=repr) == sorted([i for i, k, _, y, _ in brute_dedup(DOCS) if y], key=repr)


def test_first_rows_of_repeated_ids(spark):
    rows = [(5, "a", "p"), (5, "a", "q"), (3, "b", "r"), (7, "b", "s"), (7, "c", "t"), (None, "d", "u"), (None, "d", "v"), (None, "c", "w"), (8, None, "x"), (9, "", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _stay string").repartition(3)
    assert df.columns == exact_dedup.keep_first(df).columns
    got = sorted(((r.doc_id, r.text) for r in exact_dedup.keep_first(df).collect()), key=repr)
    assert got == sorted([(5, "a"), (3, "b"), (7, "c"), (None, "d"), (8, None)], key=repr)
    assert exact_dedup.keep_first(df.limit(0)).count() == 0


# 6. Top-k


@pytest.mark.parametrize("block", [16384, 16])
def test_topk(spark, block, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", block)
    import random

    r = random.Random(5)
    rows = [(k, [r.uniform(-1, 1) for _ in range(8)]) for k in range(180)]
    rows += [(403, [1e12] * 4), (404, [0.5] * 4), (405, [1e300] * 8), (406, [-1.7e308] * 8), (407, [3e6] * 8), (450, [1.7e308, 1e9, 0.0, 0.0, 0.0, 0.0, 0.0, -2.5e6]), (500, [-1e10] * 4)]
    rows += [(200 + k, [0.5] * 8) for k in range(40)] + [(50, rows[50][1]), (None, [0.1] * 8), (300, None), (301, [None] * 8), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (400, [0.25] * 3), (401, [0.5] * 3), (350, []), (351, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    most = 1.7976931348623157e308
    good = [(i, [math.floor(max(-most, min(most, 256 * x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    fits = lambda s: max(-(2**63), min(2**63 - 1, s))
    want = []
    for q, a in {i: v for i, v in good if i % 50 == 0}.items():
        scored = sorted((-fits(sum(x * y for x, y in zip(a, b))), i) for i, b in good if i != q and len(a) == len(b))[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    assert sorted(map(tuple, topk.top_k(df).collect())) == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0


def test_pivots_eliminate_in_clusters():
    import numpy as np

    r = np.random.default_rng(3)
    centres = r.normal(0, 300, (30, 16))
    v = np.floor(centres[r.integers(0, 30, 3000)] + r.normal(0, 8, (3000, 16))).astype(np.int64)
    ids, f = np.arange(3000), v.astype(float)
    top, pivots = float((f * f).sum(1).max()), f[:24]
    lift = np.sqrt(top - (pivots * pivots).sum(1))
    scored: list[int] = []
    own = np.sqrt(np.maximum(top - (f * f).sum(1), 0))
    tables = [topk.pivot_distances(x, y, pivots, lift).astype(np.float32) for x, y in ((f[:60], np.zeros(60)), (f, own))]
    got = topk.search_block(ids[:60], f[:60], tables[0], ids, f, tables[1], top, 5, scored)
    for q in range(60):
        s = v @ v[q]
        s[q] = -(10**12)
        best = sorted(zip((-s).tolist(), ids.tolist()))[:5]
        assert sorted((-x, c) for a, c, x in got if a == q) == best
    assert sum(scored) < 0.5 * 60 * 3000


# 8. Language ID


def test_language_id(spark, docs, empty, sf_dir):
    trees = langid.fit(docs)
    got = {r.doc_id: r for r in langid.identify(docs, trees).collect()}
    assert got[4].lang_pred == got[5].lang_pred == got[6].lang_pred == got[9].lang_pred == "und" and got[9].score == 0
    assert got[7].lang_pred == "de" and all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(empty, langid.fit(empty)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, langid.fit(empty)).collect()} == {"und"}
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pred = langid.op8_langid(spark, sf_dir).join(table.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(pred) > 20 and sum(r.lang == r.lang_pred for r in pred) >= 0.97 * len(pred)


def ppm(train, text):
    """Bits of a text by the definition: the longest context that was seen, and escapes from it."""
    seen = {}
    for t in train:
        s = langid.symbols_of(t)
        for i in range(langid.ORDER, len(s)):
            for k in range(langid.ORDER + 1):
                seen.setdefault(s[i - k : i], Counter())[s[i]] += 1
    s, bits = langid.symbols_of(text), 0.0
    for i in range(langid.ORDER, len(s)):
        for k in range(langid.ORDER, -1, -1):
            if (c := seen.get(s[i - k : i])) is None:
                continue
            whole = sum(c.values()) + len(c)
            if s[i] in c:
                bits -= math.log2(c[s[i]] / whole)
                break
            bits -= math.log2(len(c) / whole)
        else:
            bits += 8
    return bits


def test_code_lengths_by_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null and lang is not null").orderBy("doc_id").limit(60).collect()
    train = {x: [r.text[:1500] for r in rows[:40] if r.lang == x] for x in sorted({r.lang for r in rows[:40]})}
    df = spark.createDataFrame([(i, t, x) for x, ts in train.items() for i, t in enumerate(ts)], "doc_id long, text string, lang string")
    trees = langid.fit(df)
    texts = [*[r.text[:800] for r in rows[40:]], "x", "Ünïcode 日本語 \x00\x01", "aaaa", train[trees.langs[0]][0]]
    got = trees.code_lengths([langid.symbols_of(t) for t in texts])
    for t, row in zip(texts, got, strict=True):
        assert row.tolist() == pytest.approx([ppm(train[x], t) for x in trees.langs], rel=1e-4)


def test_languages_that_can_be_told(spark, docs, empty, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    trees = langid.fit(table)
    clean = ["The cat and the dog.", "Das ist ein Haus", "el perro es", "Le chat est sur la table", "Of."]
    junk = ["x\u4e2d\u6587\u5b57\u7b26\u6c49\u5b57", "a\x01\x02\x03\x04\x05\x06\x07", "12 34 -- ??", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*clean, *junk])], "doc_id long, text string")
    assert sorted(r.doc_id for r in langid.keep_identified(df, trees).collect()) == list(range(len(clean)))
    assert langid.keep_identified(docs, trees).columns == docs.columns
    assert langid.keep_identified(empty, trees).count() == langid.keep_identified(docs, langid.fit(empty)).count() == 0
    kept = {r.doc_id for r in langid.keep_identified(table, trees).collect()}
    assert all(r.doc_id in kept for r in table.collect() if r.text and sum(map(str.isalpha, r.text)) > len(r.text) / 2)


# 9. LM scoring


def test_lm(spark, docs, empty):
    train = [d for d in DOCS if zlib.crc32(str(d[0]).encode() if d[0] is not None else b"") % 7 != 2]
    from pyspark.sql import functions as F

    c = Counter(w for d in train for w in [*lm.words_of(d[1]), b""])
    total, kinds = sum(c.values()), len(c)
    rows = lm.score_texts(docs, langid.id_crc(F.col("doc_id"), 7) != 2).collect()
    got = Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)
    want = Counter()
    for i, t, *_ in DOCS:
        w = [*lm.words_of(t), b""]
        want[i, len(w), sum(c[x] > 0 for x in w), total, round(sum(math.log10((c[x] + 1) / (total + kinds + 1)) for x in w), 6)] += 1
    assert got == want and all(r.score <= 0 for r in rows)
    assert {(r.base_score, r.score) for r in lm.score_texts(docs, F.lit(False)).collect()} == {(0.0, 0.0)}
    assert lm.score_texts(empty, F.lit(True)).count() == 0


# 10. WARC


PAGES = [(1, "http://a/", "p" * 100), (2, "http://b/", "p" * 100), (3, "http://c/", "q" * 99), (4, None, "q" * 99), (5, "", None), (6, "u\r\nv é", ""), (7, "http://l/", "é" * 200_000), (7, "http://l/", "é" * 200_000), (None, "x", "p" * 100), (8, "x", "a\r\n\r\nWARC/1.1\r\n\r\n" * 9)]


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"payload": __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1), "uri": __import__("pyspark.sql.functions", fromlist=["lit"]).lit("z")})
    index = warc.archive_pages(pages.repartition(2), f"file://{tmp_path}/w")
    back = warc.read_bundles(index).collect()
    want = Counter()
    for i, _, h in PAGES:
        b = (h or "").encode()
        first = min(j for j, _, g in PAGES if j is not None and (g or "") == (h or ""))
        revisit = len(b) >= 100 and i != first
        want[f"urn:page:{'null' if i is None else i}", "revisit" if revisit else "response", len(b), hashlib.sha256(b).hexdigest(), f"urn:page:{first}" if revisit else None] += 1
    assert Counter((r.record_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to) for r in back) == want
    assert {r.uri for r in back} >= {"u\r\nv é", None}
    for row in index.collect():
        got = warc.BundleReader(row.bundle).fetch(row.frame, row.offset)
        assert got["record_id"] == row.record_id
    assert warc.read_bundles(warc.archive_pages(pages.limit(0), f"file://{tmp_path}/e")).count() == 0


def test_bundle_is_plain_zstandard(spark, tmp_path):
    import zstandard

    index = warc.archive_pages(spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/w").collect()
    with open(index[0].bundle.removeprefix("file://"), "rb") as f:
        text = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    assert text.count(b"WARC-Type: ") == len(PAGES)
