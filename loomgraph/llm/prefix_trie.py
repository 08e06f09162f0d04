"""The prefix trie of rebuilt conversations, family first.

A conversation takes its first turns from its family's base and goes on with its own. Families are cogrouped with their
base's turns; each task rebuilds one family and builds its small trie, and only combined family nodes are shuffled for
the global merge. A node is known by 128 bits of the turns that lead to it: the exclusive or of a mixed digest of
each turn and its place, so a path's key can be had from pieces. Families of more turns than a task should hold go by
pieces of fixed size instead, with the same nodes.

What a node needs of its whole subtree is summed by doubling: after k rounds a node has the sum over the 2 ** k levels
below it, and points as far up. Only nodes of two or more conversations take part, since below the others is one leaf.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _arrow_schema, bounded_batches, durable, stored, table

#: Ids of a family are those with the same id - id % FAMILY.
FAMILY, HEADS = 100, 6
#: Turns of a family that one task holds, and of a piece of a larger one.
FAMILY_TURNS, PIECE_TURNS = 100_000, 4_096
#: Families whose ends are put together before the ends of a node pass through one task.
ENDS_TOGETHER = 100
NODE = "depth long, a long, b long, up_a long, up_b long, chars long, n long, least long, base long, ends string, said binary"


def _said(role: str, text: str) -> list[Column]:
    """role, text and said, 128 bits of both; null is empty."""
    role_, text_ = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in (role, text))
    both = F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_)
    return [role_.alias("role"), text_.alias("text"), F.substring(F.unhex(F.sha2(both, 256)), 1, 16).alias("said")]


def turns_of(conversations: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, base, heads, known, turn, role, digest, chars) of each turn that has a conversation: null role and text are empty, a text is kept as 128 bits of role and text and its length. known is 0 for null turns, which come first."""
    role_, text_, said = _said(role, text)
    conv = F.col(id).cast("long")
    known = F.col(turn).isNotNull()
    return conversations.where(F.col(id).isNotNull()).select(
        conv.alias("conv"), (conv - conv % FAMILY).alias("base"), (F.crc32(conv.cast("string").cast("binary")) % HEADS).alias("heads"), known.cast("int").alias("known"), F.coalesce(F.col(turn).cast("long"), F.lit(0)).alias("turn"), role_,
        said.alias("digest"), F.length(text_).cast("long").alias("chars"),
    )


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64 bits."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def terms(digests: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """What a turn at a depth adds to the key of a path: two columns of 64 bits."""
    place = _mixed(depth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    low = _mixed(digests[:, 0] ^ place)
    return np.stack([low, _mixed(digests[:, 1] + place ^ low)], 1)


def _digests(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 2)


def family_nodes(base: pa.Table, own: pa.Table, arrow: pa.Schema) -> pa.Table:
    """The combined nodes of one family, from the turns of its base and of all its conversations."""
    order = [("known", "ascending"), ("turn", "ascending"), ("role", "ascending"), ("digest", "ascending")]
    if not own.num_rows:
        return arrow.empty_table()
    family = own.column("base")[0].as_py()
    base, own = base.sort_by(order), own.sort_by([("conv", "ascending"), *order])
    first, first_chars = _digests(base.column("digest")[:HEADS]), base.column("chars")[:HEADS].to_numpy()
    conv, heads, digests, chars = own.column("conv").to_numpy(), own.column("heads").to_numpy(), _digests(own.column("digest")), own.column("chars").to_numpy()
    convs, at, counts = np.unique(conv, return_index=True, return_counts=True)
    parts_d, parts_c, sizes = [], [], []
    for i, n in zip(at.tolist(), counts.tolist(), strict=True):
        h = int(heads[i])
        parts_d += [first[:h], digests[i + h : i + n]]
        parts_c += [first_chars[:h], chars[i + h : i + n]]
        sizes.append(len(first[:h]) + max(0, n - h))
    digests, chars, sizes = np.concatenate(parts_d), np.concatenate(parts_c), np.array(sizes, np.int64)
    start = np.cumsum(sizes) - sizes
    who = np.repeat(np.arange(len(convs)), sizes)
    depth = np.arange(len(digests)) - start[who] + 1
    key = np.bitwise_xor.accumulate(terms(digests, depth)) if len(digests) else np.empty((0, 2), np.uint64)
    before = np.concatenate([np.zeros((1, 2), np.uint64), key])[start]  # what the conversations before have left
    key = key ^ before[who]
    up = np.concatenate([np.zeros((1, 2), np.uint64), key])[: len(key)]
    up[start[sizes > 0]] = 0
    # the root, then each distinct path; conversations are in the order of their ids, so the first that meets a path is its least
    node, place, of, n = np.unique(np.column_stack([depth.astype(np.uint64), key]), axis=0, return_index=True, return_inverse=True, return_counts=True)
    last = np.where(sizes > 0, of.ravel()[np.maximum(start + sizes - 1, 0)] + 1 if len(of) else 0, 0)
    ends: dict[int, list[str]] = {}
    for c, k in zip(convs.tolist(), last.tolist(), strict=True):
        ends.setdefault(k, []).append(str(c))
    signed = lambda x: np.ascontiguousarray(x, np.uint64).view(np.int64)
    columns = [
        np.concatenate([[0], depth[place]]), *(np.concatenate([[0], signed(key[place, k])]) for k in (0, 1)), *(np.concatenate([[0], signed(up[place, k])]) for k in (0, 1)), np.concatenate([[0], chars[place]]),
        np.concatenate([[len(convs)], n]), np.concatenate([[convs[0]], convs[who[place]]]), np.full(len(node) + 1, family), [",".join(ends[k]) if k in ends else None for k in range(len(node) + 1)],
        [None, *[x.tobytes() for x in digests[place]]],
    ]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


def pieces(turns: DataFrame) -> DataFrame:
    """(conv, base, heads, part, k, n, digests, chars, before, whole): each conversation's turns in order, cut into rows of at most PIECE_TURNS; before counts the turns of earlier pieces, whole all.

    The order comes from ranges of (conversation, turn, ...), so a conversation of any length is spread over tasks; rows
    that are alike in all of these are interchangeable, and dealt by their number.
    """
    order = ["conv", "known", "turn", "role", "digest"]
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = turns.withColumn("dealt", F.monotonically_increasing_id()).repartitionByRange(n, *order, "dealt").sortWithinPartitions(*order, "dealt")
    schema = "conv long, base long, heads long, part int, k long, n long, digests binary, chars array<long>"
    arrow = _arrow_schema(turns.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            t = pa.Table.from_batches([batch])
            convs = t.column("conv").to_numpy()
            edges = [0, *(np.flatnonzero(convs[1:] != convs[:-1]) + 1).tolist(), len(convs)] if len(convs) else []
            out = []
            for i, j in zip(edges, edges[1:], strict=False):
                for s in range(i, j, PIECE_TURNS):
                    own = t.slice(s, min(PIECE_TURNS, j - s))
                    head = [own.column(c)[0].as_py() for c in ("conv", "base", "heads")]
                    out.append((*head, part, made, own.num_rows, b"".join(own.column("digest").to_pylist()), own.column("chars").to_pylist()))
                    made += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(arrow)], schema=arrow)

    kept = stored(ranged.select("conv", "base", "heads", "digest", "chars").mapInArrow(run, schema), "pieces")
    w = Window.partitionBy("conv").orderBy("part", "k").rowsBetween(Window.unboundedPreceding, -1)
    whole = kept.groupBy(F.col("conv").alias("_c")).agg(F.sum("n").alias("whole"))
    places = kept.select(F.col("conv").alias("_c"), F.col("part").alias("_p"), F.col("k").alias("_k"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before")).join(whole, "_c")
    return kept.join(places, [F.col("conv") == F.col("_c"), F.col("part") == F.col("_p"), F.col("k") == F.col("_k")]).drop("_c", "_p", "_k")


def long_family_nodes(turns: DataFrame) -> DataFrame:
    """The nodes of conversations, one by one, of families that no task should hold: a piece of a conversation gives its own part of the path.

    A key of a path is an exclusive or over its turns, so pieces are summed apart, put together by a window over the
    pieces, and gone through once more. A base gives each conversation of its family five turns at most.
    """
    spark = turns.sparkSession
    cut = stored(pieces(turns), "cut")
    early = cut.where(f"conv = base and before < {HEADS}").select("base", "before", "digests", F.posexplode("chars").alias("i", "chars")).withColumn("at", F.col("before") + F.col("i")).where(f"at < {HEADS}")
    first = early.groupBy(F.col("base").alias("_base")).agg(F.array_sort(F.collect_list(F.struct("at", "chars", F.expr("substring(digests, 16 * i + 1, 16)").alias("digest")))).alias("first"))
    ready = cut.join(first, cut["base"] == first["_base"], "left").drop("_base")
    schema = "conv long, part int, k long, a long, b long"
    first_arrow, arrow = _arrow_schema(spark, schema), _arrow_schema(spark, NODE)

    def path(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Digests, lengths and depths of the turns that a piece gives, the base's with the first piece, and how long the conversation gets."""
        h, base = r["heads"], (r["first"] or [])[: r["heads"]]
        skip = min(max(0, h - r["before"]), r["n"])
        d, chars = np.frombuffer(r["digests"], np.uint64).reshape(-1, 2)[skip:], np.array(r["chars"][skip:], np.int64)
        depth = len(base) + r["before"] + skip - h + 1 + np.arange(len(d))
        if not r["before"]:
            d = np.concatenate([np.frombuffer(b"".join(x["digest"] for x in base), np.uint64).reshape(-1, 2), d])
            chars, depth = np.concatenate([np.array([x["chars"] for x in base], np.int64), chars]), np.concatenate([1 + np.arange(len(base)), depth])
        return d, chars, depth, len(base) + max(0, r["whole"] - h)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                d, _, depth, _ = path(r)
                out.append((r["conv"], r["part"], r["k"], *np.bitwise_xor.reduce(terms(d, depth), axis=0).view(np.int64).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(first_arrow)], schema=first_arrow)

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                d, chars, depth, whole = path(r)
                key = np.bitwise_xor.accumulate(np.concatenate([np.array([[r["a"], r["b"]]], np.int64).view(np.uint64), terms(d, depth)]))
                up, key, said = key[:-1], key[1:], [x.tobytes() for x in d]
                if not r["before"]:  # the root
                    up, key = (np.concatenate([np.zeros((1, 2), np.uint64), x]) for x in (up, key))
                    chars, depth, said = np.concatenate([[0], chars]), np.concatenate([[0], depth]), [None, *said]
                ends = [str(r["conv"]) if x == whole else None for x in depth.tolist()]
                signed = [np.ascontiguousarray(x[:, k]).view(np.int64) for x in (key, up) for k in (0, 1)]
                columns = [depth, *signed, chars, np.ones(len(depth), np.int64), np.full(len(depth), r["conv"]), np.full(len(depth), r["base"]), ends, said]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    w = Window.partitionBy("conv").orderBy("part", "k").rowsBetween(Window.unboundedPreceding, -1)
    sums = ready.mapInArrow(summed, schema)
    starts = sums.select(F.col("conv").alias("_c"), F.col("part").alias("_p"), F.col("k").alias("_k"), *[F.coalesce(F.bit_xor(x).over(w), F.lit(0)).alias(x) for x in "ab"])
    return ready.join(starts, [F.col("conv") == F.col("_c"), F.col("part") == F.col("_p"), F.col("k") == F.col("_k")]).mapInArrow(nodes, NODE)


KEY = ["depth", "a", "b"]


def family_merge(turns: DataFrame) -> DataFrame:
    """The nodes of all families, those of a family combined."""
    spark = turns.sparkSession
    large = durable(turns.groupBy("base").count().where(F.col("count") > FAMILY_TURNS).select("base"))
    longer = bool(large.limit(1).count())
    usual = turns.join(large, "base", "left_anti") if longer else turns
    own = ["known", "turn", "role", "digest", "chars"]
    bases = usual.where("conv = base").select(F.col("base").alias("family"), *[F.col(c).alias(c) for c in own])
    arrow = _arrow_schema(spark, NODE)
    made = bases.groupBy("family").cogroup(usual.groupBy("base")).applyInArrow(lambda base, own: family_nodes(base, own, arrow), NODE)
    return made.unionByName(long_family_nodes(turns.join(large, "base", "left_semi"))) if longer else made


def subtree_sums(shared: DataFrame) -> DataFrame:
    """(depth, a, b, n_leaves, saved_tokens) of nodes with up_a and up_b, leaves and saved: what is summed over each subtree, by doubling.

    After k rounds a node has the sums of the 2 ** k levels from it downwards, and knows the node that many levels up.
    So rounds grow with the logarithm of the depth. Each is a written table, whose size is known to the next.
    """
    deepest = shared.agg(F.max("depth")).first()[0] or 0
    s = shared.select(*KEY, F.col("up_a"), F.col("up_b"), "leaves", "saved")  # up: of the node 1, 2, 4, ... levels up, where there is one
    for k in range(deepest.bit_length()):
        far = 1 << k
        below = s.where(F.col("depth") >= far).groupBy((F.col("depth") - far).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"))
        higher = s.where(F.col("depth") >= far).select((F.col("depth") + far).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("up_a").alias("_a"), F.col("up_b").alias("_b"))
        added = s.join(below, KEY, "left").join(higher, ["depth", "up_a", "up_b"], "left")
        s = stored(added.select(*KEY, F.col("_a").alias("up_a"), F.col("_b").alias("up_b"), (F.col("leaves") + F.coalesce("_l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("_s", F.lit(0))).alias("saved")), "trie-sums")
    return s.select(*KEY, F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))


def build_trie(conversations: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of the conversations' prefix trie.

    nodes: node (hex), depth, conv_id (its smallest member), parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, and said, the digest of its last turn (see last_turns). ends: node, slice, ids, the conversations that
    end there, in order and comma-joined; a slice holds a bounded range of ids.

    - Ids and turns are whole numbers. Rows without an id belong to no conversation. The base of a negative id is nearer to 0.
    - Turns are ordered with null first; turns of one number by role, then by digest. Repeated rows are turns of their own.
    - Null role or text is empty. Long texts count whole: by code points, and by 128 bits of role and text.
    - An empty table gives no nodes. Other columns are not read, whatever their names.
    """
    spark = conversations.sparkSession
    bounded_batches(spark)
    family = stored(family_merge(turns_of(conversations, id, turn, role, text)), "trie-families")
    nodes = stored(family.groupBy(*KEY).agg(F.max("up_a").alias("up_a"), F.max("up_b").alias("up_b"), F.max("chars").alias("chars"), F.sum("n").alias("n_convs"), F.min("least").alias("conv_id"), F.max("said").alias("said")), "trie")
    inner = nodes.where("depth > 0")
    children = inner.groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count(F.lit(1)).alias("n_children"), F.sum((F.col("n_convs") == 1).cast("long")).alias("single"))
    counted = stored(nodes.join(children, KEY, "left").fillna(0, ["n_children", "single"]), "trie-children")
    shared = counted.where("n_convs > 1").withColumn("leaves", F.when(F.col("n_children") == 0, 1).otherwise(F.col("single"))).withColumn("saved", (F.col("n_convs") - 1) * F.col("chars"))
    sums = subtree_sums(shared)
    parents = counted.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    with_parents = counted.join(parents, ["depth", "up_a", "up_b"], "left").join(sums, KEY, "left")
    name = F.concat(F.col("depth").cast("string"), F.lit("-"), F.lower(F.lpad(F.hex("a"), 16, "0")), F.lower(F.lpad(F.hex("b"), 16, "0")))
    out = with_parents.select(name.alias("node"), "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"), "said")
    # a family's ids stand together, so slices of some families are in the order of their ids
    held = family.where("ends is not null").groupBy(name.alias("node"), F.floor(F.col("base") / (FAMILY * ENDS_TOGETHER)).alias("slice")).agg(F.array_sort(F.collect_list(F.struct("base", "least", "ends"))).alias("x"))
    return out, held.select("node", "slice", F.concat_ws(",", F.transform("x", lambda x: x["ends"])).alias("ids"))


def last_turns(nodes: DataFrame, conversations: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """The nodes with the role and text of their last turn; the root's are null."""
    own = conversations.select(*_said(role, text)).groupBy("said").agg(F.max("role").alias("role"), F.max("text").alias("text"))
    return nodes.join(own, "said", "left")


def digests_of_ends(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): SHA-256 of a node's ids, comma-joined in order. Slices pass one by one, so a node of very many ends takes no memory."""
    schema = "node string, ends_sha256 string"
    arrow = _arrow_schema(ends.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        done = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], schema=arrow)
        for batch in batches:
            out = []
            for n, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if n == node:
                    state.update(b"," + ids.encode())
                    continue
                if state:
                    out.append((node, state.hexdigest()))
                node, state = n, hashlib.sha256(ids.encode())
            if out:
                yield done(out)
        if state:
            yield done([(node, state.hexdigest())])

    return ends.repartition("node").sortWithinPartitions("node", "slice").select("node", "ids").mapInArrow(run, schema)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, ends = build_trie(table(spark, sf_dir, "conversations"))
    found = nodes.join(digests_of_ends(ends), "node", "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
