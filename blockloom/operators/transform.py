"""Transforms of a block's values in the order of their places.

Frames are (block_id, pos, v, ..); ``keys`` names what makes a block where one frame holds several versions of
it. Windows are always within a block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import trunc_div
from ..functions.params import Transform

#: Classes of both classifications; what a shift adds.
CLASSES, SHIFT = 8, 1 << 23


def transform(cells: DataFrame, kind: Transform, keys: tuple[str, ...] = ("block_id",)) -> DataFrame:
    """``cells`` with v transformed."""
    whole = W.partitionBy(*keys)
    along = whole.orderBy("pos")
    v = F.col("v").cast("long")
    if kind is Transform.THRESHOLD:
        mean = trunc_div(F.sum(v).over(whole), F.count(F.lit(1)).over(whole))
        return cells.withColumn("v", F.when(v >= mean, F.lit(1)).otherwise(F.lit(0)))
    if kind is Transform.SMOOTH_AND_SHIFT:
        before, after = F.lag(v).over(along), F.lead(v).over(along)
        inner = trunc_div(before + v + after, F.lit(3))
        smooth = F.when(before.isNull() & after.isNull(), v).when(before.isNull(), trunc_div(v + after, F.lit(2))).when(after.isNull(), trunc_div(before + v, F.lit(2))).otherwise(inner)
        rows = cells.withColumn("__s", smooth).withColumn("__n", F.count(F.lit(1)).over(whole))
        low = F.when(F.col("__n") > 1, F.least(F.min("__s").over(whole), F.lit(0))).otherwise(F.lit(0))
        return rows.withColumn("v", (F.col("__s") - low).cast("int")).drop("__s", "__n")
    if kind is Transform.INDEX_CLASSES:
        # Blocks of fewer cells than classes have classes of one cell.
        width = F.greatest(trunc_div(F.count(F.lit(1)).over(whole), F.lit(CLASSES)), F.lit(1))
        return cells.withColumn("v", F.least(trunc_div(F.col("pos"), width), F.lit(CLASSES - 1)).cast("int"))
    if kind is Transform.VALUE_CLASSES:
        low, high = F.min(v).over(whole), F.max(v).over(whole)
        rows = cells.withColumn("__low", low).withColumn("__bin", trunc_div(high - low, F.lit(CLASSES - 1)))
        # The last of the classes takes what is beyond seven full ones.
        found = F.when(F.col("__bin") == 0, F.lit(0)).otherwise(F.least(trunc_div(v - F.col("__low"), F.greatest(F.col("__bin"), F.lit(1))), F.lit(CLASSES - 1)))
        return rows.withColumn("v", found.cast("int")).drop("__low", "__bin")
    if kind is Transform.VALUE_SHIFT:
        return cells.withColumn("v", (v + SHIFT).cast("int"))
    return cells


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once: an expression used within a lambda is else computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def array_transform(data: Column, kind: Transform) -> Column:
    """The same transforms on a block kept as an array: no window and no shuffle, linear in the block's size."""
    if kind is Transform.NONE:
        return data
    n = F.size(data)

    def threshold(x: Column) -> Column:
        mean = trunc_div(F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v), F.greatest(n, F.lit(1)))
        return bound(mean, lambda m: F.transform(x, lambda v: F.when(v >= m, F.lit(1)).otherwise(F.lit(0))))

    def smooth(x: Column, last: Column) -> Column:
        def near(v: Column, i: Column) -> Column:
            before, after = F.get(x, i - 1), F.get(x, i + 1)
            inner = trunc_div(before + v + after, F.lit(3))
            return F.when(last == 0, v).when(i == 0, trunc_div(v + after, F.lit(2))).when(i == last, trunc_div(before + v, F.lit(2))).otherwise(inner)

        def shifted(y: Column) -> Column:
            low = F.when(last > 0, F.least(F.array_min(y), F.lit(0))).otherwise(F.lit(0))
            return bound(low, lambda b: F.transform(y, lambda v: (v - b).cast("int")))

        return bound(F.transform(x, near), shifted)

    def index_classes(width: Column) -> Column:
        return F.transform(data, lambda v, i: F.least(trunc_div(i, width), F.lit(CLASSES - 1)).cast("int"))

    def value_classes(x: Column) -> Column:
        def classed(low: Column, step: Column) -> Column:
            found = lambda v: F.least(trunc_div(v - low, F.greatest(step, F.lit(1))), F.lit(CLASSES - 1))
            return F.transform(x, lambda v: F.when(step == 0, F.lit(0)).otherwise(found(v)).cast("int"))

        ends = F.struct(F.array_min(x).alias("low"), trunc_div(F.array_max(x) - F.array_min(x), F.lit(CLASSES - 1)).alias("step"))
        return bound(ends, lambda e: bound(e["low"], lambda low: bound(e["step"], lambda step: classed(low, step))))

    longs = F.transform(data, lambda v: v.cast("long"))
    if kind is Transform.THRESHOLD:
        return bound(longs, threshold)
    if kind is Transform.SMOOTH_AND_SHIFT:
        return bound(longs, lambda x: bound(F.size(x) - 1, lambda last: smooth(x, last)))
    if kind is Transform.INDEX_CLASSES:
        return bound(F.greatest(trunc_div(n, F.lit(CLASSES)), F.lit(1)), index_classes)
    if kind is Transform.VALUE_CLASSES:
        return bound(longs, value_classes)
    return F.transform(data, lambda v: (v.cast("long") + SHIFT).cast("int"))
