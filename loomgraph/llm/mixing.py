"""Mixing sources to target weights by capped water-filling, then seeded whole and fractional repetitions.

The weights meet the sizes in a table of one row per source, small by its nature; everything that has
a row per document stays distributed. A source's fractional part is the leading part of its documents
in a seeded order. That order is cut where the wanted words are reached: sums per (source, order bucket)
find the bucket of the cut, and only that bucket is sorted, so a hot source never meets in one task.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, table, word_count

WEIGHTS = (5, 2, 1)
SHARE = Fraction(3, 2)
MAX_EPOCHS = 2
#: Buckets of the seeded order, a power of 16 to be read off the hash's leading hex digits.
ORDER_DIGITS = 3
BROADCAST_SOURCES = 100_000


def water_fill(sizes: list[int], weights: list[int], total: Fraction, max_epochs: int) -> list[Fraction]:
    """Targets in proportion to the weights, none above max_epochs times its size.

    Each round shares what is left by weight among the sources not yet clamped, and clamps those above
    their cap; it ends when none is above. If all are clamped, the targets sum to less than the total.
    """
    target: list[Fraction] = [Fraction(0)] * len(sizes)
    free = [i for i in range(len(sizes))]
    left = Fraction(total)
    while free:
        weight = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] > max_epochs * sizes[i] * weight]
        if not over:
            for i in free:
                target[i] = left * weights[i] / weight
            break
        for i in over:
            target[i] = Fraction(max_epochs * sizes[i])
            left -= target[i]
        free = [i for i in free if i not in set(over)]
    return target


def order_key(id: Column, seed: int) -> Column:
    """The seeded order: 128 bits in hex, the same wherever it is computed."""
    return F.md5(F.concat(F.coalesce(id.cast("string"), F.lit("null")), F.lit(f":{seed}")))


def _planned(docs: DataFrame, rows: bool, weights: tuple[int, ...], share: Fraction, max_epochs: int, seed: int, id: str, text: str, source: str) -> DataFrame:
    """(_id, _size, _source, source_size, target, _reps) of each row, and the row itself as _row if asked for."""
    spark = docs.sparkSession
    own = [F.struct(*[docs[c] for c in docs.columns]).alias("_row")] if rows else []
    sized = docs.select(F.col(id).alias("_id"), F.col(source).alias("_source"), word_count(F.col(text)).alias("_size"), *own)
    if not rows:
        sized = durable(sized)  # the texts are read once
    bucketed = sized.withColumn("_key", order_key(F.col("_id"), seed)).withColumn("_bucket", F.substring("_key", 1, ORDER_DIGITS))
    sums = bucketed.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_words"))
    sums = durable(sums.coalesce(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)))  # 16 ** ORDER_DIGITS short rows a source at most
    sources = sums.groupBy("_source").agg(F.sum("_words").alias("_words")).collect()  # a row per source
    sources.sort(key=lambda r: (r["_source"] is None, (r["_source"] or "").encode("utf-8")))
    sizes = [int(r["_words"]) for r in sources]
    dealt = [weights[i % len(weights)] for i in range(len(sizes))]
    targets = water_fill(sizes, dealt, share * sum(sizes), max_epochs)
    plan = []
    for row, size, target in zip(sources, sizes, targets, strict=True):
        whole = int(target // size) if size else 0
        plan.append((row["_source"], size, float(target), whole, float(target - whole * size)))
    planned = spark.createDataFrame(plan, "_source string, source_size long, target double, _whole long, _extra double")
    by_source = lambda a, b: a["_source"].eqNullSafe(b["_p"])
    # A row per source: broadcast while their number, which is known here, is small.
    small = (lambda df: F.broadcast(df)) if len(plan) <= BROADCAST_SOURCES else (lambda df: df)
    planned = small(planned.withColumnRenamed("_source", "_p"))

    ahead = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cuts = sums.withColumn("_before", F.coalesce(F.sum("_words").over(ahead), F.lit(0)))
    cuts = cuts.join(planned, by_source(cuts, planned))
    cuts = cuts.where((F.col("_before") < F.col("_extra")) & (F.col("_before") + F.col("_words") >= F.col("_extra")))
    cuts = cuts.select(F.col("_source").alias("_c"), F.col("_bucket").alias("_cut"), F.col("_before"))
    cuts = small(cuts.groupBy("_c").agg(F.min_by(F.struct("_cut", "_before"), "_cut").alias("_at")).select("_c", "_at.*"))

    out = bucketed.join(planned, by_source(bucketed, planned)).drop("_p")
    out = out.join(cuts, out["_source"].eqNullSafe(cuts["_c"]), "left").drop("_c")
    inside = out.where(F.col("_bucket") == F.col("_cut"))
    order = Window.partitionBy("_source").orderBy("_key", "_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("_at", F.col("_before") + F.coalesce(F.sum("_size").over(order), F.lit(0)))
    inside = inside.withColumn("_more", F.when(F.col("_at") + F.col("_size") / 2 <= F.col("_extra"), 1).otherwise(0)).drop("_at")
    outside = out.where(F.col("_cut").isNull() | (F.col("_bucket") != F.col("_cut")))
    outside = outside.withColumn("_more", F.when(F.col("_bucket") < F.col("_cut"), 1).otherwise(0))
    reps = F.when(F.col("_size") > 0, F.least(F.col("_whole") + F.col("_more"), F.lit(max_epochs))).otherwise(0).cast("long")
    return inside.unionByName(outside).withColumn("_reps", reps)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = 42, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Every row with (id, size, source, source_size, target, reps, taken); taken = reps * size.

    - size counts words; a null or empty text has size 0 and takes nothing. Very long texts count whole.
    - Sources in code point order, a null source last, get the weights in turn, repeating.
    - Rows that repeat an id are ordered by their size; equal ones are interchangeable, and each is taken on its own.
    - The words a source takes differ from its target by half a document at most. An empty table gives an empty result.
    - Other columns are not read, whatever their names.
    """
    rows = _planned(docs, False, weights, share, max_epochs, seed, id, text, source)
    return rows.select(
        F.col("_id").alias(id), F.col("_size").alias("size"), F.col("_source").alias(source), "source_size", "target",
        F.col("_reps").alias("reps"), (F.col("_reps") * F.col("_size")).alias("taken"),
    )


def repeat_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = 42, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: each row of docs, all its columns under any names, as often as the mix takes it.

    Each row is repeated by its own plan, also where ids are null or repeated. Rows of size 0 go. An empty table stays empty.
    """
    rows = _planned(docs, True, weights, share, max_epochs, seed, id, text, source).where("_reps > 0")
    return rows.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_reps"))).alias("_again")).select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, 'null') || ':42') AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS z, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, CASE r % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 2.0 * z / w, r) AS i FROM w),
c AS (SELECT *, (SELECT 1.5::DOUBLE * sum(z)::DOUBLE FROM w) - coalesce(2.0::DOUBLE * (sum(z) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::DOUBLE, 0) AS left_over,
             (sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS open FROM o),
f AS (SELECT min(i) AS i FROM c WHERE left_over * w <= 2.0 * z * open),
t AS (SELECT c.source, c.z, CASE WHEN c.i < f.i OR f.i IS NULL THEN 2.0 * c.z
             ELSE (SELECT left_over FROM c c2 WHERE c2.i = f.i) * c.w / (SELECT open FROM c c2 WHERE c2.i = f.i) END::DOUBLE AS target FROM c, f),
e AS (SELECT *, CASE WHEN z > 0 THEN floor(target / z) ELSE 0 END AS whole FROM t),
x AS (SELECT d.doc_id, d.size, e.z, e.target, e.whole, e.target - e.whole * e.z AS extra,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, z AS source_size, target,
       (CASE WHEN size > 0 THEN least(whole + CASE WHEN upto + size / 2.0 <= extra AND upto < extra THEN 1 ELSE 0 END, 2) ELSE 0 END * size)::BIGINT AS taken
FROM x
"""
