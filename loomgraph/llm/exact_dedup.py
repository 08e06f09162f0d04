"""Exact dedup: group by a 128-bit content hash, keep the smallest id, compare bytes inside groups.

Everything is a DataFrame expression. The texts cross the network once, and only to be compared: each
hash group is folded to its smallest and largest normalised text, which are equal exactly if all its
texts are; the fold is combined on the map side, so a group that holds a third of all rows leaves each
task as one row. Groups whose texts differ (collisions) are grouped anew by SHA-256.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, durable, table


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def content_hash(norm: Column) -> Column:
    """128 bits of the text's UTF-8 bytes."""
    return F.unhex(F.md5(norm))


def _named(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def exact_dedup(docs: DataFrame, text: str = "text", id: str = "doc_id", hash_of=content_hash) -> DataFrame:
    """Verdict on every row: (id, keep_id, group_size, kept, text_sha256).

    - A null text counts as empty, and equals an empty one. Very long texts are compared whole.
    - The smallest id of a group stays; a null id comes after all others, and stays only if its group has no other.
    - Of rows that repeat an id and its text, one stays; which one makes no difference. All count in group_size.
    - No row is dropped. An empty table gives an empty result. Other columns are not read, whatever their names.
    """
    base = docs.select(F.col(id).alias("_id"), normalised(F.col(text)).alias("_norm"))
    base = base.withColumn("_h", hash_of(F.col("_norm")))
    # Numbered once: later joins see the same numbers.
    rows = durable(base.select(F.monotonically_increasing_id().alias("_row"), "_id", "_h", F.unhex(F.sha2("_norm", 256)).alias("_sha")))
    folded = base.groupBy("_h").agg(F.min("_norm").alias("_lo"), F.max("_norm").alias("_hi"))
    odd = folded.where("_lo <> _hi").select("_h")
    first = F.min(F.struct(F.col("_id").isNull().alias("_none"), "_id", "_row")).alias("_first")

    def judged(some: DataFrame, keys: list[str]) -> DataFrame:
        groups = some.groupBy(*keys).agg(first, F.count(F.lit(1)).alias("_n")).select(*keys, F.col("_first._id").alias("_keep"), F.col("_first._row").alias("_stays"), "_n")
        # Kept apart from its aggregation, the join can split a group that holds very many rows.
        return some.join(durable(groups), keys).select("_id", "_keep", "_n", (F.col("_row") == F.col("_stays")).alias("_kept"), "_sha")

    if odd.limit(1).count():
        # A collision: its texts are told apart by their own 256 bits.
        odd = durable(odd)
        out = judged(rows.join(odd, "_h", "left_anti"), ["_h"]).unionByName(judged(rows.join(odd, "_h", "left_semi"), ["_h", "_sha"]))
    else:
        out = judged(rows, ["_h"])
    return out.select(F.col("_id").alias(id), F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"), F.col("_kept").alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"))


def keep_first(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The rows that stay, with all their columns: of equal texts the one with the smallest id, null ids last.

    - Where the smallest id comes again with the same text, one of these rows stays.
    - Null, empty and very long texts are treated as in exact_dedup; columns may have any names. An empty table stays empty.
    """
    verdict = exact_dedup(docs, text, id).where(F.col(id).eqNullSafe(F.col("keep_id"))).select(F.col(id).alias("_stay"), F.col("text_sha256").alias("_sha"), "kept")
    verdict = durable(verdict)
    sha = _named(docs, "_text_sha")
    own = docs.withColumn(sha, F.sha2(normalised(docs[text]), 256))

    def those(some: DataFrame, how: str) -> DataFrame:
        return own.join(some, own[id].eqNullSafe(some["_stay"]) & (own[sha] == some["_sha"]), how)

    again = verdict.where("not kept").select("_stay", "_sha").distinct()
    once = verdict.where("kept").select("_stay", "_sha")
    if not verdict.where("not kept").limit(1).count():
        return those(once, "left_semi").drop(sha)
    same = once["_stay"].eqNullSafe(again["_stay"]) & (once["_sha"] == again["_sha"])
    return those(once.join(again, same, "left_anti"), "left_semi").unionByName(those(again, "left_semi").dropDuplicates([id, sha])).drop(sha)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
