"""Column expressions on integers that both 32-bit and wider arithmetic need; all stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap32(x: Column) -> Column:
    """A long reduced to a signed 32-bit value."""
    return F.shiftright(F.shiftleft(x.cast("long"), 32), 32).cast("int")


def trunc_div(a: Column, b: Column) -> Column:
    """Integer division that truncates toward zero, as a long."""
    return F.call_function("div", a.cast("long"), b.cast("long"))


def zigzag(d: Column) -> Column:
    """0, -1, 1, -2, ... to 0, 1, 2, 3, ... in long arithmetic."""
    d = d.cast("long")
    return F.when(d >= 0, 2 * d).otherwise(-2 * d - 1)


def unzigzag(z: Column) -> Column:
    z = z.cast("long")
    return F.when(z % 2 == 0, F.shiftright(z, 1)).otherwise(-F.shiftright(z + 1, 1))


def unsigned(v: Column) -> Column:
    """The 32-bit pattern of an integer, as a non-negative long."""
    return v.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))


def bit_width(u: Column) -> Column:
    """Bits that a non-negative long below 2^32 needs; 0 for 0."""
    return F.when(u == 0, F.lit(0)).otherwise(F.length(F.bin(u))).cast("int")


def varint_bytes(u: Column) -> Column:
    """Bytes of seven bits each, one at least."""
    return F.greatest(F.lit(1), F.ceil(bit_width(u) / 7)).cast("int")


def whole_bytes(u: Column) -> Column:
    """Bytes of eight bits each, one at least."""
    return F.greatest(F.lit(1), F.ceil(bit_width(u) / 8)).cast("int")


def draw(block: Column, number: Column, n: Column) -> Column:
    """A reproducible index below n for a block's draw, from a linear congruence that any SQL engine can compute."""
    return ((block.cast("long") * 16807 + number.cast("long") * 48271 + 11) % 2147483647) % n
