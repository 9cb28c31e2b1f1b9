"""Integer arithmetic of video coding as Column expressions: truncating division, clamps, codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tdiv(a: Column, b: Column | int) -> Column:
    """Quotient of integers, truncated towards zero."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def clamp(v: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def median3(a: Column, b: Column, c: Column) -> Column:
    return F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))


def zigzag_encode(v: Column) -> Column:
    """0, -1, 1, -2, 2 ... as 0, 1, 2, 3, 4 ..."""
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def zigzag_decode(u: Column) -> Column:
    return F.shiftrightunsigned(u, 1).bitwiseXOR(-u.bitwiseAND(F.lit(1)))


def bit_class(v: Column) -> Column:
    """Number of bits of a non-negative number; 0 has none."""
    return F.when(v == 0, 0).otherwise(F.length(F.bin(v)))


def floor_log2(v: Column) -> Column:
    return F.length(F.bin(v)) - 1


def exp_golomb_bits(v: Column) -> Column:
    """Length of the unsigned exponential Golomb code of v."""
    return 2 * floor_log2(v + 1) + 1


def leb128_hex(v: Column) -> Column:
    """The little-endian base-128 code of a non-negative number, as hexadecimal text."""
    places = F.sequence(F.lit(0), tdiv(F.greatest(F.lit(0), bit_class(v) - 1), 7).cast("int"))
    groups = F.transform(places, lambda i: F.call_function("shiftrightunsigned", v, i * 7) % 128)
    return F.array_join(F.transform(groups, lambda g, i: F.lpad(F.hex(F.when(i < F.size(places) - 1, g + 128).otherwise(g)), 2, "0")), "")


def implicit_weight(current: Column, past: Column, future: Column) -> Column:
    """Weight of the first reference in implicit bi-prediction, of 64, from three display counts."""
    tb, td = clamp(current - past, -128, 127), clamp(future - past, -128, 127)
    return F.when(td == 0, 32).otherwise(_scaled(tb, td))


def _scaled(tb: Column, td: Column) -> Column:
    tx = tdiv(F.lit(16384) + F.shiftright(F.abs(td), 1), td)
    scale = F.shiftright(tb * tx + 32, 8)
    return F.when((scale >= -64) & (scale <= 128), F.lit(64) - scale).otherwise(F.lit(32))
