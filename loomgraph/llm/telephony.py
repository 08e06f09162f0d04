"""Telephony audio in binary columns: mu-law, A-law and ADPCM files, their expansion to PCM, and resampling.

Files are RIFF WAVE, one channel. Mu-law and A-law keep a byte a sample and are expanded by tables of 256 entries.
ADPCM keeps four bits a sample, in blocks that start anew: a step of the decoder is a few numpy operations over all
blocks of a batch, so its loop is as long as a block, whatever the number of files. Resampling is one pass of
an integer filter over all files of a batch, laid out with silence between them; results are exact and don't depend on
what else is in the batch.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, map_batches, stored, table

# Fixed values of the formats: tags, the steps of ADPCM, and how a code moves the place in the steps.
TAGS = {"pcm": 1, "alaw": 6, "mulaw": 7, "adpcm": 17}
STEPS = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544,
    598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
)
MOVES = (-1, -1, -1, -1, 2, 4, 6, 8)

#: Bytes of a payload's unit, samples a second, and bytes of an ADPCM block: a head of four, then two samples a byte.
UNIT, RATE, BLOCK = 64, 8000, 256
#: Samples a second of what is resampled, and taps of the filter on either side at the lower rate.
TO_RATE, TAPS = 16000, 12


def mulaw_table() -> np.ndarray:
    """The 16-bit sample of each mu-law byte: inverted; sign, three bits of segment, four of place; biased by 132."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """The 16-bit sample of each A-law byte: every other bit inverted; the lowest segment is linear, the sign bit set means positive."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    segment, place = code >> 4 & 7, (code & 15) << 4
    size = np.where(segment == 0, place + 8, place + 264 << np.maximum(segment - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


EXPAND = {"mulaw": mulaw_table(), "alaw": alaw_table()}


def padded(data: bytes) -> bytes:
    """Bytes 0 are added up to a positive multiple of the unit."""
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def write_file(payload: bytes, codec: str, valid: int) -> bytes:
    """A file whose stored units are the payload's bytes: samples of mu-law or A-law, pairs of ADPCM codes. valid: how many of the bytes aren't padding, which the file says in samples.

    ADPCM blocks start at sample 0 and step 0; the last block is filled with zeros.
    """
    if codec == "adpcm":
        room = BLOCK - 4
        held = np.zeros((-(-len(payload) // room), BLOCK), np.uint8)
        held[:, 4:] = np.frombuffer(payload.ljust(len(held) * room, b"\0"), np.uint8).reshape(-1, room)
        data, align, bits, samples, more = held.tobytes(), BLOCK, 4, 2 * valid, struct.pack("<H", 2 * room + 1)
    else:
        data, align, bits, samples, more = payload, 1, 8, valid, b""
    each = 2 * (align - 4) + 1 if codec == "adpcm" else 1
    head = struct.pack("<HHIIHHH", TAGS[codec], 1, RATE, RATE * align // each, align, bits, len(more)) + more
    chunks = b"fmt " + struct.pack("<I", len(head)) + head + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def write_pcm(samples: np.ndarray, rate: int) -> bytes:
    """A file of 16-bit samples."""
    data = samples.astype("<i2").tobytes()
    head = struct.pack("<HHIIHH", TAGS["pcm"], 1, rate, 2 * rate, 2, 16)
    chunks = b"fmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def read_file(file: bytes) -> tuple[str, int, int, int, bytes]:
    """(codec, rate, block, samples that the file says, data) of a file of one channel; chunks of other names are passed over."""
    if file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, found = 12, {}
    while at + 8 <= len(file):
        size = struct.unpack_from("<I", file, at + 4)[0]
        if at + 8 + size > len(file):
            raise ValueError("a chunk is cut off")
        found.setdefault(file[at : at + 4], (at + 8, size))
        at += 8 + size + (size & 1)
    if b"fmt " not in found or b"data" not in found:
        raise ValueError("the file lacks its format or its data")
    tag, channels, rate, _, align, bits = struct.unpack_from("<HHIIHH", file, found[b"fmt "][0])
    codec = {v: k for k, v in TAGS.items()}.get(tag)
    if codec is None or channels != 1 or codec == "pcm" and bits != 16:
        raise ValueError(f"format {tag} of {channels} channels and {bits} bits isn't read")
    start, size = found[b"data"]
    samples = struct.unpack_from("<I", file, found[b"fact"][0])[0] if b"fact" in found else size // max(1, align) * (2 * (align - 4) + 1 if codec == "adpcm" else 1)
    return codec, rate, align, samples, file[start : start + size]


def payload_of(file: bytes) -> tuple[bytes, int]:
    """(payload, valid bytes) of a file that write_file made."""
    codec, _, align, samples, data = read_file(file)
    if codec != "adpcm":
        return data, samples
    valid = samples // 2
    held = np.frombuffer(data, np.uint8).reshape(-1, align)[:, 4:].tobytes()
    return held[: max(UNIT, -(-valid // UNIT) * UNIT)], valid


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples of blocks of equal size, a row each: the first sample and the step from the head, then two codes a byte, the low one first. A step off the table counts as its last."""
    steps, moves = np.array(STEPS, np.int32), np.array(MOVES * 2, np.int32)
    head = np.ascontiguousarray(blocks[:, :4])
    now = head[:, :2].copy().view("<i2").ravel().astype(np.int32)
    at = np.minimum(head[:, 2].astype(np.int32), len(STEPS) - 1)
    codes = np.empty((2 * (blocks.shape[1] - 4), len(blocks)), np.uint8)  # a row for each step, so each step reads in a line
    codes[0::2], codes[1::2] = blocks[:, 4:].T & 15, blocks[:, 4:].T >> 4
    out = np.empty((len(codes) + 1, len(blocks)), np.int16)
    out[0] = now
    for k, code in enumerate(codes, 1):
        step = steps[at]
        d = (step >> 3) + (step & -(code >> 2 & 1).astype(np.int32)) + (step >> 1 & -(code >> 1 & 1).astype(np.int32)) + (step >> 2 & -(code & 1).astype(np.int32))
        now = np.clip(now + np.where(code & 8, -d, d), -32768, 32767)
        at = np.clip(at + moves[code], 0, len(STEPS) - 1)
        out[k] = now
    return out.T


def decode(files: Iterable[bytes]) -> list[tuple[int, np.ndarray]]:
    """(rate, samples) of each file; ADPCM blocks of one size are decoded together, of all files."""
    read = [read_file(f) for f in files]
    out: list[tuple[int, np.ndarray]] = [(0, np.empty(0, np.int16))] * len(read)
    blocks: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, (codec, rate, align, _, data) in enumerate(read):
        if codec == "adpcm":
            if align <= 4:
                raise ValueError(f"a block of {align} bytes has no samples")
            blocks.setdefault(align, []).append((i, np.frombuffer(data, np.uint8, len(data) // align * align).reshape(-1, align)))
        else:
            out[i] = rate, np.frombuffer(data, "<i2", len(data) // 2) if codec == "pcm" else EXPAND[codec][np.frombuffer(data, np.uint8)]
    for held in blocks.values():
        whole = decode_adpcm(np.concatenate([b for _, b in held]))
        ends = np.cumsum([len(b) for _, b in held])
        for (i, b), end in zip(held, ends.tolist(), strict=True):
            out[i] = read[i][1], whole[end - len(b) : end].ravel()
    return out


def taps_of(up: int, down: int) -> np.ndarray:
    """A low-pass filter below the lower of both rates, in 1/16384: for each of up phases, weights that sum to 16384. Sums over 16-bit samples stay within 32 bits."""
    wide = max(up, down)
    n = np.arange(-TAPS * wide, TAPS * wide + 1)
    h = np.sinc(n / wide) * np.cos(np.pi * n / (2 * TAPS * wide)) ** 2
    out = np.zeros((up, -(-len(n) // up)))
    for k in range(up):
        own = h[k::up]
        out[k, : len(own)] = own / own.sum()
    whole = np.rint(out * 16384).astype(np.int32)
    whole[np.arange(up), np.abs(whole).argmax(1)] += 16384 - whole.sum(1, dtype=np.int32)
    assert np.abs(whole).sum(1).max() < 1 << 16
    return whole


def resample(signals: list[np.ndarray], rate: int, to: int) -> list[np.ndarray]:
    """Each signal at another rate, as 16-bit samples: ceil(n * to / rate) of them, by integers alone. Beyond its ends a signal is silent.

    The signals are laid out one after the other, each from a multiple of the step on and with silence before it. So all
    share the phases of the filter, and a weight of a phase is one multiplication of a slice of the whole.
    """
    up, down = to // math.gcd(rate, to), rate // math.gcd(rate, to)
    if up == down or not signals:
        return signals
    taps, half = taps_of(up, down), TAPS * max(up, down)
    gap = taps.shape[1] + half // up + 1
    whole_steps = lambda n: -(-n // down) * down
    rooms = [whole_steps(gap + len(s)) for s in signals]
    starts = np.cumsum([whole_steps(gap), *rooms])
    x = np.zeros(int(starts[-1]) + whole_steps(2 * gap), np.int32)
    for s, at in zip(signals, starts.tolist(), strict=False):
        x[at : at + len(s)] = s
    steps = int(starts[-1]) // down  # each makes a sample of every phase
    out = np.empty((steps, up), np.int16)
    first = whole_steps(gap) // down  # what comes before is silent, and stays out of reach of the weights
    total, part = np.empty(steps - first, np.int32), np.empty(steps - first, np.int32)
    for j in range(up):
        phase, newest = (j * down + half) % up, (j * down + half) // up + first * down
        total[:] = 8192
        for k in np.flatnonzero(taps[phase]).tolist():
            np.multiply(x[newest - k :: down][: len(total)], taps[phase, k], out=part)
            total += part
        out[:first, j] = 0
        out[first:, j] = np.clip(total >> 14, -32768, 32767)
    flat = out.ravel()
    return [flat[at // down * up :][: -(-len(s) * up // down)] for s, at in zip(signals, starts.tolist(), strict=False)]


def features(signal: np.ndarray, rate: int) -> str:
    """Samples, peak, energy, changes of sign and a CRC of a signal, all whole numbers."""
    wide = signal.astype(np.int64)
    low = wide < 0
    peak = int(np.abs(wide).max()) if len(wide) else 0
    return f"rate={rate};samples={len(wide)};peak={peak};energy={int((wide * wide).sum())};crossings={int((low[1:] != low[:-1]).sum())};crc32={zlib.crc32(signal.astype('<i2').tobytes())}"


CODECS = ("mulaw", "alaw", "adpcm")


def codec_of(payload: bytes) -> str:
    """Equal payloads share a codec; which one goes by their checksum."""
    return CODECS[zlib.crc32(payload) % len(CODECS)]


def store_texts(docs: DataFrame, id: str = "doc_id", text: str = "text", codec: str | None = None) -> DataFrame:
    """(id, media binary): each whole text as a file, in a table in the shared folder.

    The text's bytes and their padding are the samples (of ADPCM: pairs of codes), so nothing is lost; codec None deals
    the three out by the payloads. A null text is empty, and an empty one is one unit of zeros. Rows that repeat an id
    are stored each; null ids are kept. An empty table gives an empty one. Other columns are not read, whatever their names.
    A text needs to fit a file, of 4 GB at most.
    """
    bounded_batches(docs.sparkSession)

    def rows(batch: dict) -> dict:
        media = []
        for t in batch["_text"]:
            data = (t or "").encode()
            payload = padded(data)
            media.append(write_file(payload, codec or codec_of(payload), len(data)))
        return {"_id": batch["_id"], "media": media}

    made = map_batches(docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")), rows, f"_id {dict(docs.dtypes)[id]}, media binary")
    return stored(made, "media").select(F.col("_id").alias(id), "media")


def expand(media: DataFrame, rate: int = TO_RATE, column: str = "media") -> DataFrame:
    """The rows with their files as 16-bit PCM at one rate in a column ``pcm binary``, to be written as a table; null files give null. An input column pcm is replaced."""
    kept = media.drop("pcm")

    def rows(batch: dict) -> dict:
        held = [f for f in batch[column] if f is not None]
        made = iter(resampled(held, rate))
        return batch | {"pcm": [f if f is None else write_pcm(next(made), rate) for f in batch[column]]}

    return map_batches(kept, rows, ", ".join(f"`{n}` {k}" for n, k in kept.dtypes) + ", pcm binary")


def resampled(files: list[bytes], rate: int) -> list[np.ndarray]:
    """Each file's signal at this rate; those of one rate are filtered together."""
    read = decode(files)
    out: list[np.ndarray] = [np.empty(0, np.int16)] * len(read)
    for own in {r for r, _ in read}:
        at = [i for i, (r, _) in enumerate(read) if r == own]
        for i, s in zip(at, resample([read[i][1] for i in at], own, rate), strict=True):
            out[i] = s
    return out


#: Files that are decoded and resampled together: as many as hold so many bytes, or one.
TOGETHER = 128 << 10


def describe(media: DataFrame, id: str = "doc_id", rate: int = TO_RATE, column: str = "media") -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, codec) from the stored files alone: the payload read back, and features of the resampled PCM.

    Features of a file depend on it alone. Null files are passed over as rows of nulls.
    """
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def of(files: list[bytes]) -> list[tuple]:
        out = []
        for f, s in zip(files, resampled(files, rate), strict=True):
            payload, valid = payload_of(f)
            out.append((valid, len(payload), sha(payload), zlib.crc32(payload[-UNIT:]), len(f), sha(f), features(s, rate), read_file(f)[0]))
        return out

    def rows(batch: dict) -> dict:
        found: list[tuple] = []
        held: list[bytes] = []
        for f in [x for x in batch["_media"] if x is not None]:
            if held and sum(map(len, held)) + len(f) > TOGETHER:
                found += of(held)
                held = []
            held.append(f)
        found += of(held)
        each = iter(found)
        full = [(None,) * len(NAMES) if f is None else next(each) for f in batch["_media"]]
        return {"_id": batch["_id"]} | {n: [x[k] for x in full] for k, n in enumerate(NAMES)}

    schema = f"_id {dict(media.dtypes)[id]}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string"
    bounded_batches(media.sparkSession)
    return map_batches(media.select(F.col(id).alias("_id"), F.col(column).alias("_media")), rows, schema).withColumnRenamed("_id", id)


NAMES = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec")


def op11_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe(store_texts(table(spark, sf_dir, "documents")))
