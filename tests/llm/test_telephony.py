"""Companding, ADPCM, resampling and media columns against sample-by-sample versions."""

import hashlib
import struct
import zlib

import numpy as np
import pytest

from loomgraph.llm import telephony as tel

DOCS = [(1, "The cat sat"), (2, "The cat sat"), (3, None), (4, ""), (5, "x" * 64), (6, "y" * 65), (7, "naïve 日本語 🎉 " * 9000), (None, "z"), (8, "\0\0tail\0"), (8, "again")]


def slow_adpcm(block: bytes) -> list[int]:
    now, at = struct.unpack_from("<hB", block)
    at = min(at, 88)
    out = [now]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = tel.STEPS[at]
            d = step >> 3
            d += step if code & 4 else 0
            d += step >> 1 if code & 2 else 0
            d += step >> 2 if code & 1 else 0
            now = max(-32768, min(32767, now - d if code & 8 else now + d))
            at = max(0, min(88, at + tel.MOVES[code & 7]))
            out.append(now)
    return out


def slow_resample(x, rate, to):
    g = np.gcd(rate, to)
    up, down = to // g, rate // g
    taps, half = tel.taps_of(up, down), tel.TAPS * max(up, down)
    out = []
    for n in range(-(-len(x) * up // down)):
        newest, phase = divmod(n * down + half, up)
        total = sum(int(w) * int(x[newest - k]) for k, w in enumerate(taps[phase]) if 0 <= newest - k < len(x))
        out.append(max(-32768, min(32767, total + 8192 >> 14)))
    return out


def test_expansion_tables():
    mu, a = tel.EXPAND["mulaw"], tel.EXPAND["alaw"]
    assert mu[[0x00, 0x80, 0xFF, 0x7F, 0x01]].tolist() == [-32124, 32124, 0, 0, -31100]
    assert a[[0xD5, 0x55, 0x2A, 0xAA]].tolist() == [8, -8, -32256, 32256]
    assert sorted(set(mu.tolist())) == sorted({-x for x in mu.tolist()}) and len(set(mu.tolist())) == 255
    assert sorted(set(a.tolist())) == sorted({-x for x in a.tolist()}) and len(set(a.tolist())) == 256


def test_adpcm_across_blocks():
    blocks = np.random.default_rng(1).integers(0, 256, (40, 64), np.uint8)
    assert tel.decode_adpcm(blocks).tolist() == [slow_adpcm(b.tobytes()) for b in blocks]


@pytest.mark.parametrize(("rate", "to"), [(8000, 16000), (8000, 4000), (8000, 11025), (11025, 8000), (8000, 8000), (8000, 24000)])
def test_resampling_alone_and_together(rate, to):
    r = np.random.default_rng(2)
    signals = [r.integers(-32768, 32768, n).astype(np.int16) for n in (1, 2, 63, 200, 0, 331)]
    got = tel.resample(signals, rate, to)
    for x, y in zip(signals, got, strict=True):
        assert y.tolist() == (slow_resample(x, rate, to) if rate != to else x.tolist())
        assert tel.resample([x], rate, to)[0].tolist() == y.tolist()


def test_a_tone_keeps_its_pitch():
    tone = lambda rate: 10000 * np.sin(2 * np.pi * 440 * np.arange(rate // 4) / rate)
    for to in (16000, 11025, 4000):
        got = tel.resample([tone(8000).astype(np.int16)], 8000, to)[0]
        assert np.abs(got[200:-200] - 10000 * np.sin(2 * np.pi * 440 * np.arange(len(got)) / to)[200:-200]).max() < 40


@pytest.mark.parametrize("codec", tel.CODECS)
def test_files_keep_their_payload(codec):
    for n in (0, 1, 63, 64, 65, 251, 252, 253, 5000):
        data = bytes(range(256)) * 20
        payload = tel.padded(data[:n])
        file = tel.write_file(payload, codec, n)
        assert tel.payload_of(file) == (payload, n)
        got, rate, _, samples, _ = tel.read_file(file)
        assert (got, rate, samples) == (codec, 8000, 2 * n if codec == "adpcm" else n)
    # chunks that other programs add are passed over
    more = file[:12] + b"LIST" + struct.pack("<I", 3) + b"abc\0" + file[12:]
    assert tel.payload_of(more) == (payload, n)
    for bad in (b"", b"RIFFxxxxWAVE", file[:-8], file[:22] + b"\2" + file[23:], file[:20] + b"\x55" + file[21:]):
        with pytest.raises(ValueError):
            tel.read_file(bad)


def expected(text):
    data = (text or "").encode()
    payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
    codec = tel.codec_of(payload)
    file = tel.write_file(payload, codec, len(data))
    if codec == "adpcm":
        stored = file[file.index(b"data") + 8 :]
        signal = [s for k in range(0, len(stored), 256) for s in slow_adpcm(stored[k : k + 256])]
    else:
        signal = tel.EXPAND[codec][list(payload)].tolist()
    pcm = np.array(slow_resample(signal, 8000, 16000), np.int64)
    low = pcm < 0
    feature = f"rate=16000;samples={len(pcm)};peak={abs(pcm).max()};energy={(pcm * pcm).sum()};crossings={(low[1:] != low[:-1]).sum()};crc32={zlib.crc32(pcm.astype('<i2').tobytes())}"
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return len(data), len(payload), sha(payload), zlib.crc32(payload[-64:]), len(file), sha(file), feature, codec


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "m", b"p", "f") for i, t in DOCS]
    return spark.createDataFrame(rows, "doc_id long, text string, n_bytes int, media string, pcm binary, feature string").repartition(3)


def test_texts_as_audio(docs):
    short = [d for d in DOCS if d[0] != 7]
    got = tel.describe(tel.store_texts(docs))
    assert got.columns == ["doc_id", *tel.NAMES]
    rows = {tuple(r) for r in got.where("doc_id is null or doc_id != 7").collect()}
    assert rows == {(i, *expected(t)) for i, t in short}
    assert len({r[-1] for r in rows}) > 1  # more than one codec is met
    long = got.where("doc_id = 7").first()
    assert (long.n_bytes, long.payload_sha256) == (len(DOCS[6][1].encode()), hashlib.sha256(tel.padded(DOCS[6][1].encode())).hexdigest())
    assert tel.describe(tel.store_texts(docs.limit(0))).count() == 0


def test_pcm_columns(docs, spark):
    media = tel.store_texts(docs.where("doc_id < 7"), codec="alaw")
    wide = media.selectExpr("doc_id", "media", "1 as pcm").union(spark.createDataFrame([(99, None, 1)], media.selectExpr("doc_id", "media", "1 as pcm").schema))
    for r in tel.expand(wide, 4000).collect():
        if r.media is None:
            assert r.pcm is None
            continue
        codec, rate, _, n, data = tel.read_file(r.pcm)
        assert (codec, rate) == ("pcm", 4000)
        assert np.frombuffer(data, "<i2").tolist() == slow_resample(tel.EXPAND["alaw"][list(tel.payload_of(r.media)[0])], 8000, 4000)
    assert [r.feature for r in tel.describe(wide).collect() if r.doc_id == 99] == [None]


def test_the_query_covers_every_document(spark, sf_dir):
    got = tel.op11_media(spark, sf_dir)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    seen = {r.doc_id: r for r in got.collect()}
    assert seen.keys() == texts.keys()
    for i, t in texts.items():
        assert seen[i].payload_sha256 == hashlib.sha256(tel.padded((t or "").encode())).hexdigest()
    for i in sorted(texts, key=lambda k: len(texts[k] or ""))[:20]:
        assert tuple(seen[i]) == (i, *expected(texts[i]))
