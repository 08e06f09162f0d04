"""Removal of long repeated byte strings, by longest previous factors over shared suffixes.

A string of LEAST bytes counts as repeated if it also starts anywhere else. Sorting all suffixes of a corpus is
out of reach, so only those are sorted that can have a long match. Every LEAST-byte string holds an anchor: the
first GRAM-byte part with the smallest hash, which depends on the string alone. Strings that share an anchor lie
side by side; the bytes they cover together are the anchor's context.

Anchors are found once, and stored with the chunk of texts they are in (exchange.py). Chunks send the hashes of their
distinct (anchor, context) entries, without bytes, and learn which contexts occur again as a whole: all strings of
those are repeated. Where an anchor has several contexts, one copy of each sends its bytes. Contexts of an anchor are
aligned at it, so for each start before the anchor the suffixes that begin there are in suffix order once the contexts
are sorted by what follows the anchor and by what precedes it: suffixes share LEAST bytes exactly if they fall into the
same run of both orders. Within a run, a suffix has a previous factor of LEAST bytes exactly if a smaller position
stands before or after it in suffix order (its previous or next smaller value).

Anchors with very many different contexts, which no task could hold, are not gathered: their strings are counted one by
one, pre-aggregated. Both ways give the same verdicts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, map_batches, map_stream, stored, table
from .exchange import chunks, cuts, from_counts, from_keys, packed_counts, packed_keys, range_bits, with_answers

LEAST, GRAM = 200, 50
REACH = LEAST - GRAM
SEGMENT = 1 << 20
#: Text for each range of anchors: an entry comes every 75 bytes or so, and takes a task some 150 bytes.
RANGE_TEXT = 48 << 20
#: Different contexts of an anchor up to which they are sorted together.
TOGETHER = 20_000
#: What a chunk learns of an entry: its context occurs again; it is the first entry of that context; it sends its bytes;
#: it does so for an anchor of more contexts than are sorted together.
AGAIN, FIRST, SENDS, CROWDED = 1, 2, 4, 8

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Anchors have the smallest hashes, so most would fall into the first ranges; times an odd number they spread evenly, and stay distinct.
_EVEN = np.uint64(0xD1342543DE82EF95)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, SEGMENT + 2 * LEAST), _powers(_BACK, SEGMENT + 2 * LEAST)


def sliding(values: np.ndarray, width: int, pick: np.ufunc, fill: int) -> np.ndarray:
    """pick over each run of ``width`` values: prefixes and suffixes of blocks of that width meet."""
    n = len(values)
    blocks = np.concatenate([values, np.full(-n % width, fill, values.dtype)]).reshape(-1, width)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    back = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[: n - width + 1], ahead[width - 1 : n])


def anchors(piece: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, hash, first string, last string) of the anchors of all LEAST-byte strings in texts laid end to end; ends: where each text ends."""
    n = len(piece)
    if n < LEAST:
        return (np.empty(0, np.int64), np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 2)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * _UP[:n], out=total[1:])
    x = (total[GRAM:] - total[:-GRAM]) * _DOWN[: n - GRAM + 1]
    for shift, by in ((32, 0xD6E8FEB86659FD93), (29, 0xD6E8FEB86659FD93)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(by)
    x ^= x >> np.uint64(32)
    np.maximum(x, np.uint64(1), out=x)
    least = sliding(x, REACH + 1, np.minimum, np.iinfo(np.uint64).max)  # one for each string
    inside = np.ones(len(least), bool)
    for e in ends[:-1]:
        inside[max(0, e - LEAST + 1) : e] = False
    least[~inside] = 0
    pad = np.zeros(REACH, np.uint64)
    top = sliding(np.concatenate([pad, least, pad]), REACH + 1, np.maximum, 0)
    at = np.nonzero(top == x)[0]
    values = x[at]
    # A string belongs to the first anchor in it that has its smallest hash; the strings of an anchor are neighbours.
    strings = np.nonzero(inside)[0]
    owner, wanted = np.searchsorted(at, strings), least[strings]
    open_ = np.nonzero(values[owner] != wanted)[0]
    while len(open_):
        owner[open_] += 1
        open_ = open_[values[owner[open_]] != wanted[open_]]
    edge = np.nonzero(np.concatenate([[True], owner[1:] != owner[:-1], [True]]))[0]
    own = owner[edge[:-1]] if len(owner) else np.empty(0, np.int64)
    return at[own], values[own], strings[edge[:-1][: len(own)]], strings[edge[1:][: len(own)] - 1]


def pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]]:
    """Texts laid end to end in pieces of bounded size: (bytes, ends, (text, offset) of each part). Longer texts overlap by LEAST - 1."""
    held, size, where = [], 0, []

    def out():
        return np.frombuffer(b"".join(held), np.uint8), np.cumsum([len(x) for x in held]), where

    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t) - LEAST + 1), SEGMENT - LEAST):
            part = t[at : at + SEGMENT - 1]  # its strings start before the next part does
            if len(part) < LEAST:
                continue
            if size + len(part) > SEGMENT:
                yield out()
                held, size, where = [], 0, []
            held.append(part)
            where.append((k, at))
            size += len(part)
    if held:
        yield out()


def anchors_of(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, position in it, hash, first string, last string) arrays.

    Each string is in one part of a long text, so an anchor in the overlap of two parts may come twice, in the same
    position, with different strings.
    """
    for data, ends, where in pieces(texts):
        at, h, lo, hi = anchors(data, ends)
        part = np.searchsorted(ends, at, side="right")
        text, offset = np.array(where, np.int64).reshape(-1, 2).T
        shift = offset[part] - np.concatenate([[0], ends[:-1]])[part]
        yield text[part], at + shift, h, lo + shift, hi + shift


#: Columns that anchored() gives a chunk: of distinct entries by rising anchor, the anchor's hash, the context's, and the
#: number of occurrences; of occurrences in order, the text, the position, the bytes before it of the first and the last
#: string, and the entry.
ENTRIES, PLACES = ("anchor", "context", "copies"), ("of", "pos", "most", "least", "entry")


def anchored(texts: list[str | None]) -> tuple[bytes, ...]:
    raw = [(t or "").encode("utf-8") for t in texts]
    parts = list(anchors_of(raw))
    of, pos, h, lo, hi = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.int64) for i in range(5))
    by = np.lexsort((lo, pos, of))
    of, pos, h, lo, hi = of[by], pos[by], h[by].astype(np.uint64) * _EVEN, lo[by], hi[by]
    digest = xxhash.xxh3_64_intdigest  # told apart within an anchor's 64 bits; the seed is the place of the anchor
    c = np.fromiter((digest(raw[k][a : b + LEAST], l) for k, a, b, l in zip(of.tolist(), lo.tolist(), hi.tolist(), (pos - lo).tolist(), strict=True)), np.uint64, len(of))
    order = np.lexsort((c, h))
    h, c = h[order], c[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])[: len(h)]
    entry = np.empty(len(h), np.uint32)
    entry[order] = np.cumsum(new) - 1
    n = np.diff(np.append(np.flatnonzero(new), len(h)))
    places = (of.astype(np.uint32), pos.astype(np.uint32), (pos - lo).astype(np.uint8), (pos - hi).astype(np.uint8), entry)
    return h[new].tobytes(), c[new].tobytes(), packed_counts(n), *[x.tobytes() for x in places]


def places_of(row: dict) -> tuple[np.ndarray, ...]:
    kinds = (np.uint32, np.uint32, np.uint8, np.uint8, np.uint32)
    return tuple(np.frombuffer(row[k], t).astype(np.int64) for k, t in zip(PLACES, kinds, strict=True))


def each_row(batch: dict) -> Iterator[dict]:
    return (dict(zip(batch, x, strict=True)) for x in zip(*batch.values(), strict=True))


def compared(parts: DataFrame, bits: int, together: int) -> DataFrame:
    """(chunk, range, codes): a byte for each entry of a chunk in the range, of AGAIN, FIRST, SENDS and CROWDED."""

    def ask(batch: dict) -> dict:
        out: dict[str, list] = {k: [] for k in ("range", "chunk", "anchor", "context", "copies")}
        for row in each_row(batch):
            h, c, n = np.frombuffer(row["anchor"], np.uint64), np.frombuffer(row["context"], np.uint64), from_counts(row["copies"])
            for r, a, b in cuts(h, bits):
                for held, v in zip(out.values(), (r, row["chunk"], packed_keys(h[a:b], bits), c[a:b].tobytes(), packed_counts(n[a:b])), strict=True):
                    held.append(v)
        return out

    def judge(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("chunk")
        h, c, n = (np.concatenate([f(x) for x in df[k]]) for f, k in ((from_keys, "anchor"), (lambda x: np.frombuffer(x, np.uint64), "context"), (from_counts, "copies")))
        order = np.lexsort((c, h))  # stable: of a context, the entry of the first chunk comes first
        h, c, n = h[order], c[order], n[order]
        other = np.concatenate([[True], h[1:] != h[:-1]])[: len(h)]
        new = np.concatenate([[True], c[1:] != c[:-1]])[: len(h)] | other
        context, anchor = np.cumsum(new) - 1, np.cumsum(other) - 1
        kinds = np.bincount(anchor, new)[anchor]
        code = AGAIN * (np.bincount(context, n)[context] > 1) + FIRST * new + SENDS * (new & (kinds > 1)) + CROWDED * (new & (kinds > together))
        out = np.empty(len(h), np.uint8)
        out[order] = code
        edge = np.cumsum([0, *[len(x) // 8 for x in df["context"]]])
        return pd.DataFrame({"chunk": df["chunk"], "range": df["range"], "codes": [out[a:b].tobytes() for a, b in zip(edge, edge[1:], strict=False)]})

    asked = map_batches(parts.select("chunk", *ENTRIES), ask, "range int, chunk string, anchor binary, context binary, copies binary")
    return stored(asked.groupBy("range").applyInPandas(judge, "chunk string, range int, codes binary"), "repeats")


def codes_of(answers: list[dict] | None) -> np.ndarray:
    return np.frombuffer(b"".join(x["codes"] for x in sorted(answers or [], key=lambda x: x["range"])), np.uint8)


def contexts(met: DataFrame) -> DataFrame:
    """(h, chunk, at, entry, l, again, crowded, ctx) of the entries that send their bytes, l of which precede the anchor; at is the first place."""

    def rows(batch: dict) -> dict:
        out: dict[str, list] = {k: [] for k in ("h", "chunk", "at", "entry", "l", "again", "crowded", "ctx")}
        for row in each_row(batch):
            code, h = codes_of(row["answers"]), np.frombuffer(row["anchor"], np.int64)
            of, pos, most, least, entry = places_of(row)
            _, first = np.unique(entry, return_index=True)
            some = np.flatnonzero(code & SENDS)
            at = first[some]
            raw = {k: (row["text"][k] or "").encode("utf-8") for k in set(of[at].tolist())}
            out["ctx"] += [raw[k][p - l : p - m + LEAST] for k, p, l, m in zip(of[at].tolist(), pos[at].tolist(), most[at].tolist(), least[at].tolist(), strict=True)]
            for k, v in (("h", h[some]), ("at", at), ("entry", some), ("l", most[at]), ("again", code[some] & AGAIN > 0), ("crowded", code[some] & CROWDED > 0)):
                out[k] += v.tolist()
            out["chunk"] += [row["chunk"]] * len(some)
        return out

    return map_batches(met.select("chunk", "text", "anchor", *PLACES, "answers"), rows, "h long, chunk string, at int, entry int, l int, again boolean, crowded boolean, ctx binary")


def shared_depths(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lexicographic order of equally wide byte rows within groups, and each row's common prefix with the one before it (-1: another group)."""
    n, width = rows.shape
    keys = np.empty((n, 8 + width), np.uint8)
    keys[:, :8] = group.astype(">u8").view(np.uint8).reshape(n, 8)
    keys[:, 8:] = rows
    order = np.argsort(keys.view(f"V{8 + width}").ravel(), kind="stable")
    ranked = rows[order]
    differ = ranked[1:] != ranked[:-1]
    lcp = np.where(differ.any(1), differ.argmax(1), width)
    lcp[group[order][1:] != group[order][:-1]] = -1
    return order, np.concatenate([[-1], lcp])


def previous_factors(run: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For suffixes in suffix order, whether a factor of LEAST bytes starts at a smaller place: their run has a smaller one before or after them.

    run rises along the suffix order; places are distinct.
    """
    above = int(place.max(initial=0)) + 1
    previous_smaller, next_smaller = np.zeros(len(run), bool), np.zeros(len(run), bool)
    key = run * above + place  # later runs lie above all of the earlier ones
    least = np.minimum.accumulate(key[::-1])[::-1]
    next_smaller[:-1] = least[1:] < key[:-1]
    key = (run.max(initial=0) - run) * above + place  # and now the other way round
    least = np.minimum.accumulate(key)
    previous_smaller[1:] = least[:-1] < key[1:]
    return previous_smaller | next_smaller


def repeated_starts(group: np.ndarray, left: np.ndarray, ctx: list[bytes], again: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each context (in the order of their first places) and start s before the anchor: whether its string occurs again, and whether earlier.

    Suffixes that start s bytes before the anchor share LEAST bytes if they are in one run of the order by the bytes
    before the anchor, of depth s, and in one run of the order by the bytes from the anchor on, of depth LEAST - s.
    """
    m = len(ctx)
    after, before = np.zeros((m, LEAST), np.uint8), np.zeros((m, REACH), np.uint8)
    right = np.empty(m, np.int64)
    for i, (c, l) in enumerate(zip(ctx, left.tolist(), strict=True)):
        b = np.frombuffer(c, np.uint8)
        right[i] = len(b) - l
        after[i, : min(LEAST, right[i])] = b[l : l + LEAST]
        before[i, :l] = b[:l][::-1]
    orders = [shared_depths(after, group), shared_depths(before, group)]
    run = np.empty((2, m), np.int64)
    twice, earlier = np.zeros((m, REACH + 1), bool), np.zeros((m, REACH + 1), bool)
    for s in range(REACH + 1):
        ok = np.flatnonzero((left >= s) & (right >= LEAST - s))
        if not len(ok):
            continue
        for k, depth in ((0, LEAST - s), (1, s)):
            order, lcp = orders[k]
            run[k, order] = np.cumsum(lcp < depth)
        code = run[0, ok] * (m + 1) + run[1, ok]
        rank = np.argsort(code, kind="stable")
        code, at = code[rank], ok[rank]
        number = np.cumsum(np.concatenate([[False], code[1:] != code[:-1]]))
        twice[at, s] = np.bincount(number, 1 + again[at])[number] >= 2
        earlier[at, s] = previous_factors(number, at)
    return twice, earlier


def ranges(flags: np.ndarray) -> list[int]:
    """Runs of set flags as lo, hi, lo, hi ..."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.stack([np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0] - 1], 1).ravel().tolist()


def sorted_together(own: DataFrame) -> DataFrame:
    """Verdicts on anchors whose contexts fit a task: (chunk, entry, twice, earlier), from contexts sorted by anchor and place."""

    def judge(cols: dict) -> dict:
        h = np.array(cols["h"], np.int64)
        group = np.cumsum(np.concatenate([[0], h[1:] != h[:-1]]))
        twice, earlier = repeated_starts(group, np.array(cols["l"]), cols["ctx"], np.array(cols["again"], np.int64))
        some = np.flatnonzero(twice.any(1)).tolist()
        return {k: [cols[k][i] for i in some] for k in ("chunk", "entry")} | {"twice": [ranges(twice[i]) for i in some], "earlier": [ranges(earlier[i]) for i in some]}

    def rows(batches):
        held: dict = {}
        for batch in batches:
            held = {k: held.get(k, []) + v for k, v in batch.items()}
            h = held["h"]
            if len(h) >= 4000:
                # An anchor's contexts are judged together, so the last one waits for the next batch.
                cut = next((i for i in range(len(h) - 1, -1, -1) if h[i] != h[-1]), -1) + 1
                if cut:
                    yield judge({k: v[:cut] for k, v in held.items()})
                    held = {k: v[cut:] for k, v in held.items()}
        if held.get("h"):
            yield judge(held)

    return map_stream(own.select("h", "l", "ctx", "again", "chunk", "entry"), rows, VERDICT)


VERDICT = "chunk string, entry int, twice array<int>, earlier array<int>"


def counted_apart(own: DataFrame) -> DataFrame:
    """The same for anchors with very many contexts: every string is counted by its hash, pre-aggregated."""
    start = F.explode(F.sequence(F.greatest(F.lit(0), F.lit(LEAST) - (F.length("ctx") - F.col("l"))), F.col("l")))
    place = F.struct("chunk", "at")
    cut = own.select("h", "chunk", "at", "entry", "again", "l", "ctx", start.alias("s"))
    cut = cut.select("h", "chunk", "at", "entry", "again", "s", F.unhex(F.md5(F.substring("ctx", F.col("l") - F.col("s") + 1, F.lit(LEAST)))).alias("w"))
    total = cut.groupBy("h", "s", "w").agg(F.sum(F.when(F.col("again"), 2).otherwise(1)).alias("copies"), F.min(place).alias("least")).where("copies > 1")
    hits = cut.join(total, ["h", "s", "w"]).select("chunk", "entry", "s", (place != F.col("least")).alias("later"))
    pair = lambda xs: F.flatten(F.transform(xs, lambda s: F.array(s, s)))  # noqa: E731  one start is a range, too
    runs = hits.groupBy("chunk", "entry").agg(F.collect_list("s").alias("a"), F.collect_list(F.when(F.col("later"), F.col("s"))).alias("b"))  # REACH + 1 at most
    return runs.select("chunk", "entry", pair(F.col("a")).alias("twice"), pair(F.col("b")).alias("earlier"))


def removed(row: dict, keep_first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, lo, hi) of the spans of a chunk, by rising place and merged."""
    code = codes_of(row["answers"])
    of, pos, most, least, entry = places_of(row)
    gone = code[entry] & AGAIN > 0
    if keep_first:
        _, first = np.unique(entry, return_index=True)
        gone[first[code & FIRST > 0]] = False  # what stays of these, their verdicts say
    starts, ends, texts = [pos[gone] - most[gone]], [pos[gone] - least[gone] + LEAST], [of[gone]]
    verdicts = row["verdicts"] or []
    if verdicts:
        _, first = np.unique(entry, return_index=True)
        runs = [np.array(x["runs"], np.int64).reshape(-1, 2) for x in verdicts]
        at = np.repeat(first[[x["entry"] for x in verdicts]], [len(x) for x in runs])
        runs = np.concatenate(runs)
        starts.append(pos[at] - runs[:, 1])
        ends.append(pos[at] - runs[:, 0] + LEAST)
        texts.append(of[at])
    text, lo, hi = np.concatenate(texts), np.concatenate(starts), np.concatenate(ends)
    by = np.lexsort((lo, text))
    text, lo, hi = text[by], lo[by], hi[by]
    if not len(text):
        return text, lo, hi
    gap = int(hi.max()) + 1  # texts end to end, apart
    reach = np.maximum.accumulate(hi + text * gap)
    new = np.flatnonzero(np.concatenate([[True], (lo + text * gap)[1:] > reach[:-1]]))
    return text[new], lo[new], reach[np.append(new[1:], len(reach)) - 1] - text[new] * gap


def remove_repeats(docs: DataFrame, keep_first: bool = True, id: str = "doc_id", text: str = "text", together: int = TOGETHER) -> DataFrame:
    """(id, n_bytes, spans, n_removed, n_spans, kept_sha256) of every row; spans are the removed bytes, from lo up to hi.

    Bytes covered by a string of LEAST bytes that also starts elsewhere are removed, in the same text or another; with
    keep_first the first copy stays, by (id, position), null ids last. Strings are judged on the input, and never cross texts.

    - A null text is empty. Texts shorter than LEAST bytes are kept whole. Very long texts are read in overlapping segments.
    - Rows that repeat an id are texts of their own; if they repeat its text too, one of them comes first.
    - Removal works on bytes, so what is kept may end inside a character. An empty table gives an empty result.
    - Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = dict(docs.dtypes)[id]
    base = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if keep_first:
        base = base.orderBy(F.col("id").asc_nulls_last(), F.md5("text"))
    parts = chunks(base, "text", anchored, (*ENTRIES, *PLACES))
    codes = compared(parts, range_bits(parts, RANGE_TEXT), together)
    own = stored(contexts(with_answers(parts, codes)), "repeats")
    verdict = sorted_together(own.where("not crowded").repartition("h").sortWithinPartitions("h", "chunk", "at"))
    if own.where("crowded").limit(1).count():
        verdict = verdict.unionByName(counted_apart(own.where("crowded")))
    verdict = stored(verdict, "repeats")
    by_chunk = verdict.groupBy("chunk").agg(F.collect_list(F.struct("entry", F.col("earlier" if keep_first else "twice").alias("runs"))).alias("verdicts"))  # its entries at most
    met = with_answers(parts.select("chunk", "id", "text", *PLACES), codes).join(by_chunk, "chunk", "left")

    def finish(batch: dict) -> dict:
        out: dict[str, list] = {k: [] for k in ("id", "n_bytes", "spans", "n_removed", "n_spans", "kept_sha256")}
        for row in each_row(batch):
            k, lo, hi = removed(row, keep_first)
            edge = np.searchsorted(k, np.arange(len(row["id"]) + 1)).tolist()
            lo, hi = lo.tolist(), hi.tolist()
            for i, t in enumerate(row["text"]):
                data, at, digest = t.encode("utf-8"), 0, hashlib.sha256()
                cut = list(zip(lo[edge[i] : edge[i + 1]], hi[edge[i] : edge[i + 1]], strict=True))
                for a, b in cut:
                    digest.update(data[at:a])
                    at = b
                digest.update(data[at:])
                done = (row["id"][i], len(data), [{"lo": a, "hi": b} for a, b in cut], sum(b - a for a, b in cut), len(cut), digest.hexdigest())
                for held, v in zip(out.values(), done, strict=True):
                    held.append(v)
        return out

    done = map_batches(met.select("id", "text", *PLACES, "answers", "verdicts"), finish, f"id {kind}, n_bytes long, spans array<struct<lo:int,hi:int>>, n_removed long, n_spans long, kept_sha256 string")
    return done.withColumnRenamed("id", id)


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), keep_first=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
