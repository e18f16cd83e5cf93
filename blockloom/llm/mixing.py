"""Mixing sources to target weights with hash-threshold histograms.

Every document gets a 60-bit uniform hash. Sizes are summed by source and leading hash bits; the bucket
in which a source's cumulative size crosses its budget is the only one looked into again, with more bits,
until the hash has no more. What is below the threshold so found is taken: nothing is sorted, and each
source's take is nested (a larger budget keeps all that a smaller one takes).

Only DataFrame operations are used. Rows of a hot source meet in partial sums before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, cut, table

#: Bits of the hash that each level of the histogram reads; 5 levels read all 60.
LEVEL_BITS, LEVELS = 12, 5


def document_hash(doc_id: Column) -> Column:
    """First 60 bits of the id's MD5, as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: tuple[int, int], most: int) -> DataFrame:
    """Budgets of the sources by water-filling.

    sizes: source, source_size. The sources' weights repeat in code-point order, null last. Together they
    get share[0]/share[1] of all sizes; no target exceeds ``most`` times its source's size, the excess
    going to the others by weight. Sources in order of size by weight are capped up to the first that
    is not, so running sums give the level at once. The frame has a row for each source only.
    """
    listed = W.orderBy(F.col("source").cast("binary").asc_nulls_last())
    ordered = W.orderBy("ratio", "rank")
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    x = sizes.withColumn("rank", F.row_number().over(listed) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    x = x.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("w"))
    x = x.withColumn("all", F.sum("source_size").over(everything) * F.lit(float(share[0])) / F.lit(float(share[1])))
    x = x.withColumn("rest", F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    x = x.withColumn("rest_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    x = x.withColumn("capped", F.col("cap") * F.col("rest_w") <= F.col("w") * F.col("rest"))
    open_rest = F.max(F.when(~F.col("capped"), F.col("rest"))).over(everything)
    open_w = F.max(F.when(~F.col("capped"), F.col("rest_w"))).over(everything)
    return x.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(open_rest * F.col("w") / open_w).alias("target"))


def thresholds(docs: DataFrame, budgets: DataFrame) -> DataFrame:
    """For each source the largest hash taken: the one after which the running sum is nearest to the budget.

    docs: source, size, h. budgets: source, extra (words still wanted). Level by level, the first bucket
    whose end lies beyond the budget is refined; all before it are taken.
    """
    found = budgets.select("source", "extra", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    for level in range(LEVELS):
        left, last = LEVEL_BITS * (LEVELS - 1 - level), level == LEVELS - 1
        state = broadcast_if_small(found.withColumnRenamed("source", "s"))
        inside = docs.join(state, docs["source"].eqNullSafe(F.col("s")) & (F.shiftright("h", left + LEVEL_BITS) == F.col("prefix")))
        sums = inside.groupBy("source", "extra", "prefix", "below", F.shiftright("h", left).alias("bucket")).agg(F.sum("size").alias("words"))
        run = W.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("incl", F.col("below") + F.sum("words").over(run)).withColumn("excl", F.col("incl") - F.col("words"))
        beyond = (F.col("incl") + F.col("excl") > 2 * F.col("extra")) if last else (F.col("incl") > F.col("extra"))
        first = sums.groupBy(F.col("source").alias("s")).agg(F.min(F.when(beyond, F.struct("bucket", "excl"))).alias("x"))
        # Where no bucket lies beyond, the whole range is taken and later levels find nothing there.
        end = F.shiftleft(F.col("prefix") + 1, LEVEL_BITS)
        found = found.join(first, found["source"].eqNullSafe(F.col("s")), "left").select("source", "extra", F.coalesce("x.bucket", end).alias("prefix"), F.coalesce("x.excl", "below").alias("below"))
        found = cut(found)
    return found.select("source", (F.col("prefix") - 1).alias("threshold"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """The mix of ``docs`` (doc_id, text, source; further columns are kept) as copies of each document.

    Adds size (words), source_size, target (double) and copies (0, 1 or 2 with the defaults), in place of columns
    of these names. A source whose
    target is r times its size gets floor(r) copies of every document, and one more of those whose hash is
    at most the source's threshold. Null texts have size 0, null sources are one source, rows with one id
    share their hash and so their fate. An empty table stays empty. Reruns give the same rows.
    """
    docs = docs.drop("size", "source_size", "target", "copies")
    sized = docs.select("*", F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long").alias("size"), document_hash(F.col("doc_id")).alias("__h"))
    small = cut(sized.select("source", "size", F.col("__h").alias("h")))
    goal = cut(targets(small.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("base", base).withColumn("extra", F.col("target") - F.col("base") * F.col("source_size"))
    limit = thresholds(small, goal.select("source", "extra"))
    plan = cut(goal.join(limit.withColumnRenamed("source", "s"), goal["source"].eqNullSafe(F.col("s")), "left").drop("s"))
    plan = plan.select(F.col("source").alias("__source"), "source_size", "target", F.col("base").alias("__base"), F.coalesce("threshold", F.lit(-1)).alias("__t"))
    more = F.when((F.col("__base") < most) & (F.col("__h") <= F.col("__t")), F.lit(1)).otherwise(F.lit(0))
    # A row for each source: broadcast where they are checked to be few, so that no text is shuffled.
    plan = broadcast_if_small(plan)
    out = sized.join(plan, sized["source"].eqNullSafe(F.col("__source")), "left").withColumn("copies", (F.col("__base") + more).cast("long"))
    return out.drop("__source", "__t", "__base", "__h")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS rank FROM s
), w AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap FROM r
), o AS (
  SELECT *, cap / w AS ratio, sum(source_size) OVER () * 3.0::DOUBLE / 2.0::DOUBLE AS everything, sum(w) OVER () AS all_w FROM w
), c AS (
  SELECT *, everything - coalesce(sum(cap) OVER prior, 0) AS rest, all_w - coalesce(sum(w) OVER prior, 0) AS rest_w
  FROM o WINDOW prior AS (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT *, cap * rest_w <= w * rest AS capped FROM c
), t AS (
  SELECT source, source_size,
         CASE WHEN capped THEN cap
              ELSE max(CASE WHEN NOT capped THEN rest END) OVER () * w / max(CASE WHEN NOT capped THEN rest_w END) OVER () END AS target
  FROM f
), b AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS base FROM t
), j AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.base, b.target - b.base * b.source_size AS extra,
         sum(d.size) OVER run AS incl, sum(d.size) OVER (PARTITION BY d.source, d.h) AS same
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
  WINDOW run AS (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
SELECT doc_id, size, source_size, target,
       (size * (base + CASE WHEN base < 2 AND incl + (incl - same) <= 2 * extra THEN 1 ELSE 0 END))::BIGINT AS taken
FROM j
"""
