"""Read-only access to blocks: sums and XORs over all values or over random draws, metadata, visiting order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import draw, wrap32
from ..functions.params import Access, Pattern


def metadata(cells: DataFrame) -> DataFrame:
    """What a stored block keeps beside its payload: n, least, greatest, sum64, sum32 and xor of its values."""
    total = F.sum(F.col("v").cast("long"))
    return cells.groupBy("block_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("greatest"), total.alias("sum64"), wrap32(total).alias("sum32"), F.bit_xor("v").alias("xor")
    )


def drawn(spark: SparkSession, cells: DataFrame, n: int) -> DataFrame:
    """n reproducible draws with replacement from each block of n cells: the cells' rows, with draw_no."""
    ids = cells.select("block_id").distinct()
    draws = ids.select("block_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw_no"))
    draws = draws.select("block_id", "draw_no", draw(F.col("block_id"), F.col("draw_no"), F.lit(n)).cast("int").alias("pos"))
    return draws.join(cells, ["block_id", "pos"])


def access(spark: SparkSession, cells: DataFrame, kind: Access, n: int) -> DataFrame:
    """block_id and result of a read-only operation; n is the number of a block's cells.

    The places of cells do not matter to any of them but the random ones. The fused sum comes from the block's
    metadata alone.
    """
    if kind.mutates:
        raise ValueError(f"{kind} changes blocks; use transform()")
    total = F.sum(F.col("v").cast("long"))
    if kind is Access.SUM_FUSED:
        return metadata(cells).select("block_id", F.col("sum32").alias("result"))
    rows = drawn(spark, cells, n) if kind in (Access.RANDOM_XOR, Access.RANDOM_SUM) else cells
    result = {Access.XOR: F.bit_xor("v"), Access.RANDOM_XOR: F.bit_xor("v"), Access.SUM_SIMD: wrap32(total)}.get(kind, total)
    return rows.groupBy("block_id").agg(result.alias("result"))


def visit_order(ids: DataFrame, pattern: Pattern, seed: int = 1) -> DataFrame:
    """block_id with the key that a visit sorts by: its own number, or a reproducible scrambling of it."""
    if pattern is Pattern.LINEAR:
        return ids.select("block_id", F.col("block_id").cast("long").alias("visit_key"))
    # A second step of the congruence: one alone leaves small numbers in order.
    key = draw(draw(F.col("block_id"), F.lit(seed), F.lit(2147483647)) * 48271, F.lit(seed), F.lit(2147483647))
    return ids.select("block_id", key.alias("visit_key"))


def running_stats(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean, population variance and total of a column by keys."""
    return values.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("variance"), F.sum(value).alias("total"))
