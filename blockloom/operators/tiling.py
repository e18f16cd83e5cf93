"""Tiling, sampling and value range of rasters.

Blocks are kept in long form: one row per cell, (block_id, pos, v). The block of a cell is computed from its
place, so tiling moves no rows; whatever first needs a block together (a window, an aggregate) shuffles once by
block_id, and further operators on the same blocks reuse that partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import trunc_div
from ..sources.raster import Raster


def grid(spark: SparkSession, raster: Raster, size: int) -> DataFrame:
    """The full blocks: block_id, bx, by, x_off, y_off; partial ones at the edges are not part of the grid."""
    across, down = raster.width // size, raster.height // size
    ids = spark.range(across * down).withColumnRenamed("id", "block_id")
    bx, by = (F.col("block_id") % max(across, 1)).cast("int"), trunc_div(F.col("block_id"), F.lit(max(across, 1))).cast("int")
    return ids.select("block_id", bx.alias("bx"), by.alias("by"), (bx * size).alias("x_off"), (by * size).alias("y_off"))


def blocks(raster: Raster, size: int) -> DataFrame:
    """Cells of full blocks: block_id (row-major), pos (row-major within the block), v."""
    across, down = raster.width // size, raster.height // size
    bx, by = trunc_div(F.col("x"), F.lit(size)), trunc_div(F.col("y"), F.lit(size))
    inside = raster.cells.filter((F.col("x") < across * size) & (F.col("y") < down * size))
    pos = (F.col("y") % size) * size + F.col("x") % size
    return inside.select((by * across + bx).alias("block_id"), pos.cast("int").alias("pos"), "v")


def full_blocks(raster: Raster, size: int) -> DataFrame:
    """Blocks that hold all their cells, by counting: block_id over the grid with partial blocks, and n."""
    across = -(-raster.width // size)
    block = trunc_div(F.col("y"), F.lit(size)) * across + trunc_div(F.col("x"), F.lit(size))
    return raster.cells.groupBy(block.alias("block_id")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == size * size)


def sample(spark: SparkSession, raster: Raster, size: int, n: int) -> DataFrame:
    """n evenly spaced blocks: sample_no, block_id, x_off, y_off.

    Neighbours are max(1, total / n) blocks apart; beyond the last block the sample starts over, so n greater
    than the number of blocks gives blocks more than once, as rows of their own.
    """
    across, total = raster.width // size, (raster.width // size) * (raster.height // size)
    if n < 1 or total < 1:
        raise ValueError("a sample needs at least one block to take and one to take it from")
    step = max(1, total // n)
    block = (F.col("sample_no") * step) % total
    rows = spark.range(n).withColumnRenamed("id", "sample_no").withColumn("block_id", block)
    return rows.select("sample_no", "block_id", (F.col("block_id") % across * size).cast("int").alias("x_off"), (trunc_div(F.col("block_id"), F.lit(across)) * size).cast("int").alias("y_off"))


def sampled(cells: DataFrame, chosen: DataFrame) -> DataFrame:
    """Cells of the chosen blocks, once for each time a block was chosen, with sample_no."""
    return cells.join(chosen.select("sample_no", "block_id"), "block_id")


def least(cells: DataFrame) -> DataFrame:
    """The smallest value, as a frame of one row."""
    return cells.agg(F.min("v").alias("least"))


def shift_nonnegative(cells: DataFrame, lowest: DataFrame | None = None) -> DataFrame:
    """Values less the global minimum where that is negative; ``lowest`` may bring the minimum of other blocks."""
    one = F.broadcast(lowest if lowest is not None else least(cells))  # one row
    shifted = F.col("v").cast("long") - F.least(F.col("least"), F.lit(0)).cast("long")
    return cells.join(one).withColumn("v", shifted.cast("int")).drop("least")


def profile(raster: Raster) -> DataFrame:
    """width, height, least, greatest and number of distinct values of the cells."""
    found = raster.cells.agg(F.min("v").alias("least"), F.max("v").alias("greatest"), F.count_distinct("v").alias("n_unique"))
    return found.select(F.lit(raster.width).alias("width"), F.lit(raster.height).alias("height"), "least", "greatest", "n_unique")


def is_lossless(values: DataFrame, value: Column) -> DataFrame:
    """Whether truncation to 32-bit integers keeps every value: one row, lossless and n."""
    v = value.cast("double")
    whole = F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v)).cast("double")
    fits = (whole == v) & v.between(-2147483648.0, 2147483647.0)
    return values.agg(F.bool_and(fits).alias("lossless"), F.count(F.lit(1)).alias("n"))


def compare_reads(one: DataFrame, two: DataFrame) -> DataFrame:
    """Whether two readings (x, y, v) of a raster agree cell by cell: one row, equal, n and mismatches."""
    both = one.select("x", "y", F.col("v").cast("double").alias("a")).join(two.select("x", "y", F.col("v").cast("double").alias("b")), ["x", "y"], "full_outer")
    differ = F.count_if(~F.col("a").eqNullSafe(F.col("b")))
    return both.agg((differ == 0).alias("equal"), F.count(F.lit(1)).alias("n"), differ.alias("mismatches"))
