"""Places of cells within a square block under the three orderings, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .params import Ordering


def _bits(size: int) -> int:
    if size < 1 or size & (size - 1):
        raise ValueError(f"Morton order needs a side that is a power of two, not {size}")
    return size.bit_length() - 1


def _spread(v: Column, bits: int) -> Column:
    """Bit i of v at bit 2i."""
    out = F.lit(0)
    for i in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(v, i).bitwiseAND(F.lit(1)), 2 * i))
    return out


def _gather(v: Column, bits: int) -> Column:
    """Bit 2i of v at bit i."""
    out = F.lit(0)
    for i in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(v, 2 * i).bitwiseAND(F.lit(1)), i))
    return out


def position(x: Column, y: Column, size: int, ordering: Ordering) -> Column:
    """Place of cell (x, y) of a size x size block."""
    x, y = x.cast("int"), y.cast("int")
    if ordering is Ordering.ZIGZAG:
        return (y * size + F.when(y % 2 == 0, x).otherwise(size - 1 - x)).cast("int")
    if ordering is Ordering.MORTON:
        bits = _bits(size)
        return _spread(x, bits).bitwiseOR(F.shiftleft(_spread(y, bits), 1)).cast("int")
    return (y * size + x).cast("int")


def cell(pos: Column, size: int, ordering: Ordering) -> tuple[Column, Column]:
    """(x, y) of the cell at a place: the inverse of ``position``."""
    pos = pos.cast("int")
    if ordering is Ordering.MORTON:
        bits = _bits(size)
        return _gather(pos, bits).cast("int"), _gather(F.shiftright(pos, 1), bits).cast("int")
    y = F.floor(pos / size).cast("int")
    x = pos % size
    return (F.when(y % 2 == 0, x).otherwise(size - 1 - x) if ordering is Ordering.ZIGZAG else x).cast("int"), y


def reorder(blocks: DataFrame, size: int, ordering: Ordering) -> DataFrame:
    """Row-major places of ``blocks`` (.., pos, ..) replaced by those of the ordering; no row moves."""
    if ordering is Ordering.ROW_MAJOR:
        return blocks
    x, y = cell(F.col("pos"), size, Ordering.ROW_MAJOR)
    return blocks.withColumn("pos", position(x, y, size, ordering))
