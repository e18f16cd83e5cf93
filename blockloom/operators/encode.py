"""Logical encodings of blocks (integers to integers), their inverses, and the sizes of physical ones.

Frames are (block_id, pos, v). Encoded values are longs, as the differences of 32-bit values need 33 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from enum import Enum

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import bit_width, trunc_div, unsigned, unzigzag, varint_bytes, whole_bytes, zigzag
from .codecs.logical import followed


def _whole() -> W:
    return W.partitionBy("block_id")


def _along() -> W:
    return _whole().orderBy("pos")


class Stride(Enum):
    """Which earlier value a value is held against."""

    ADJACENT = "adjacent"
    GROUP_4 = "group4_last"
    GROUP_8 = "group8_pair"
    GROUP_16 = "group16_last"


def _groups_end(n: Column, group: int, head: int) -> Column:
    """End of the whole groups behind ``head`` first values that a following value still delimits."""
    count = F.ceil((n - head - group) / F.lit(group))
    return head + group * F.greatest(count, F.lit(0))


def anchor(pos: Column, n: Column, stride: Stride) -> Column:
    """Place of the value that the one at ``pos`` is held against; null: against 0."""
    none = F.lit(None).cast("int")
    near = F.when(pos == 0, none).otherwise(pos - 1)
    if stride is Stride.GROUP_4:
        grouped = 4 * trunc_div(pos - 1, F.lit(4))
        found = F.when(pos == 0, none).when((n >= 4) & (pos < _groups_end(n, 4, 1)), grouped).otherwise(pos - 1)
    elif stride is Stride.GROUP_8:
        end = _groups_end(n, 8, 8)
        found = F.when((n < 8) | (pos < 8), none).when(pos >= end, pos - 1).when(pos < 16, pos - 8).otherwise(8 * trunc_div(pos, F.lit(8)) - 2 + pos % 2)
    elif stride is Stride.GROUP_16:
        end = _groups_end(n, 16, 16)
        wide = F.when(pos < 16, none).when(pos >= end, pos - 1).when(pos < 32, pos - 16).otherwise(16 * trunc_div(pos, F.lit(16)) - 1)
        found = F.when(n < 16, near).otherwise(wide)
    else:
        found = near
    return found.cast("int")


def delta(cells: DataFrame, stride: Stride) -> DataFrame:
    """block_id, pos, enc: zig-zagged differences. The adjacent form keeps its first value raw, the pairs form blocks under eight."""
    v = F.col("v").cast("long")
    if stride is Stride.ADJACENT:
        before = F.lag(v).over(_along())
        return cells.select("block_id", "pos", F.when(before.isNull(), v).otherwise(zigzag(v - before)).alias("enc"))
    rows = _as_arrays(cells, "v")
    n = F.size("values")

    def coded(v: Column, i: Column) -> Column:
        at = anchor(i, n, stride)
        base = F.when(at.isNull(), F.lit(0)).otherwise(F.get("values", at))
        raw = (n < 8) if stride is Stride.GROUP_8 else F.lit(False)
        return F.when(raw, v).otherwise(zigzag(v - base)).cast("long")

    return rows.select("block_id", F.posexplode(F.transform("values", coded)).alias("pos", "enc"))


def _as_arrays(cells: DataFrame, column: str) -> DataFrame:
    """block_id and the column's values, as longs in order of their places."""
    listed = F.array_sort(F.collect_list(F.struct("pos", F.col(column).cast("long").alias("v"))))
    return cells.groupBy("block_id").agg(listed.alias("values")).select("block_id", F.transform("values", lambda x: x["v"]).alias("values"))


def undelta(encoded: DataFrame, stride: Stride) -> DataFrame:
    """block_id, pos, v from ``delta``'s frame.

    Adjacent differences are running sums. In the grouped forms each value needs an earlier one: blocks travel as
    arrays, and all chains of values are followed at once, by array operations.
    """
    if stride is Stride.ADJACENT:
        step = F.when(F.col("pos") == 0, F.col("enc")).otherwise(unzigzag(F.col("enc")))
        return encoded.select("block_id", "pos", F.sum(step).over(_along()).cast("int").alias("v"))
    rows = _as_arrays(encoded, "enc")
    n = F.size("values")
    at = F.transform("values", lambda z, i: F.coalesce(anchor(i, n, stride), F.lit(-1)))
    raw = (n < 8) if stride is Stride.GROUP_8 else F.lit(False)
    plain = F.transform("values", lambda z: F.when(raw, z).otherwise(unzigzag(z)))
    decoded = rows.select("block_id", plain.alias("d"), at.alias("at")).mapInArrow(_follow, "block_id long, values array<bigint>")
    return decoded.select("block_id", F.posexplode("values").alias("pos", "v")).withColumn("v", F.col("v").cast("int"))


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each difference the decoded value that it was held against, and so on; blocks of a batch at once."""
    for batch in batches:
        steps, at = batch.column("d"), batch.column("at")
        counts = np.asarray(steps.value_lengths().fill_null(0))
        first = np.repeat(np.cumsum(counts) - counts, counts)
        places = at.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        values = followed(steps.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.where(places < 0, -1, places + first))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))
        yield pa.RecordBatch.from_arrays([batch.column("block_id"), lists], ["block_id", "values"])


def frame_of_reference(cells: DataFrame) -> DataFrame:
    """block_id, pos, enc: the least value at place 0, then twice each value's distance from it."""
    v = F.col("v").cast("long")
    low = cells.groupBy("block_id").agg(F.min(v).alias("enc")).select("block_id", F.lit(0).alias("pos"), "enc")
    return low.unionByName(cells.select("block_id", (F.col("pos") + 1).alias("pos"), zigzag(v - F.min(v).over(_whole())).alias("enc")))


def unframe(encoded: DataFrame) -> DataFrame:
    low = F.max(F.when(F.col("pos") == 0, F.col("enc"))).over(_whole())
    rows = encoded.withColumn("low", low).filter("pos > 0")
    return rows.select("block_id", (F.col("pos") - 1).alias("pos"), (unzigzag(F.col("enc")) + F.col("low")).cast("int").alias("v"))


def run_lengths(cells: DataFrame) -> DataFrame:
    """block_id, run_no, value, run: stretches of equal values in order."""
    new = F.when(F.lag("v").over(_along()).eqNullSafe(F.col("v")), F.lit(0)).otherwise(F.lit(1))
    rows = cells.withColumn("new", new).withColumn("run_no", (F.sum("new").over(_along()) - 1).cast("int"))
    return rows.groupBy("block_id", "run_no").agg(F.first("v").alias("value"), F.count(F.lit(1)).alias("run"))


def unrun(runs: DataFrame) -> DataFrame:
    start = F.coalesce(F.sum("run").over(_whole().orderBy("run_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = runs.withColumn("start", start).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("run") - 1)))
    return rows.select("block_id", (F.col("start") + F.col("i")).cast("int").alias("pos"), F.col("value").alias("v"))


#: Zero pairs that the four widths of run-length encoder put before their output, by values per group.
STALE_GROUPS = {"scalar": None, "sse": 4, "avx2": 8, "avx512": 16}


def run_length_sizes(cells: DataFrame) -> DataFrame:
    """Integers that a block takes as runs: n, runs, clean (two per run), and with each encoder's stale pairs."""
    runs = run_lengths(cells).groupBy("block_id").agg(F.count(F.lit(1)).alias("runs"), F.sum("run").alias("n"))
    stale = [(2 * F.col("runs") + 2 * (F.lit(1) if g is None else F.floor(F.col("n") / g) + 1)).cast("long").alias(name) for name, g in STALE_GROUPS.items()]
    return runs.select("block_id", "n", "runs", (2 * F.col("runs")).alias("clean"), *stale)


def sizes(cells: DataFrame) -> DataFrame:
    """Bytes of each block under the physical models, from its values alone.

    bitpack: one width for the whole block, in groups of 128 integers; varint: seven bits a byte; varint_delta:
    the same of adjacent differences modulo 2^32; streamvbyte: two control bits and one to four bytes a value;
    frame: the least value, a width and packed distances.
    """
    u = unsigned(F.col("v"))
    before = F.coalesce(F.lag("v").over(_along()), F.lit(0)).cast("long")
    rows = cells.withColumn("d", unsigned(F.col("v").cast("long") - before))
    return rows.groupBy("block_id").agg(
        F.count(F.lit(1)).alias("n"),
        (F.ceil(F.count(F.lit(1)) / 128) * 16 * F.max(bit_width(u))).cast("long").alias("bitpack"),
        F.sum(varint_bytes(u)).cast("long").alias("varint"),
        F.sum(varint_bytes(F.col("d"))).cast("long").alias("varint_delta"),
        (F.ceil(F.count(F.lit(1)) / 4) + F.sum(whole_bytes(u))).cast("long").alias("streamvbyte"),
        (5 + F.ceil(F.count(F.lit(1)) * bit_width(F.max(F.col("v").cast("long")) - F.min(F.col("v").cast("long"))) / 8)).cast("long").alias("frame"),
    )
