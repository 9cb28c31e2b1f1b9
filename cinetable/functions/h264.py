"""Integer arithmetic of H.264 (and VP8) blocks as Column expressions over arrays of 16 values in raster order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the standard: dequantisation factors by qp mod 6 (corners, centres, others), and chroma qp from 30 on.
LEVEL_SCALE = [(10, 16, 13), (11, 18, 14), (13, 20, 16), (14, 23, 18), (16, 25, 20), (18, 29, 23)]
CHROMA_QP = [29, 30, 31, 32, 32, 33, 34, 34, 35, 35, 36, 36, 37, 37, 37, 38, 38, 38, 39, 39, 39, 39]


def chroma_qp(qp: Column, offset: int = 0) -> Column:
    at = F.least(F.greatest(qp + offset, F.lit(0)), F.lit(51)).cast("int")
    return F.when(at < 30, at).otherwise(F.get(F.array(*map(F.lit, CHROMA_QP)), at - 30))


def dequantised(levels: Column, qp: int) -> Column:
    """Flat scaling of 16 levels."""
    corner, centre, other = LEVEL_SCALE[qp % 6]
    factor = [corner if r % 2 == 0 and c % 2 == 0 else centre if r % 2 and c % 2 else other for r in range(4) for c in range(4)]
    return F.zip_with(levels, F.array(*[F.lit(f << (qp // 6)) for f in factor]), lambda v, f: v * f)


def _lines(block: Column, rows: bool) -> list[list[Column]]:
    return [[F.get(block, 4 * i + j if rows else 4 * j + i) for j in range(4)] for i in range(4)]


def _inverse_line(a: Column, b: Column, c: Column, d: Column) -> list[Column]:
    even, odd = [a + c, a - c], [F.shiftright(b, 1) - d, b + F.shiftright(d, 1)]
    return [even[0] + odd[1], even[1] + odd[0], even[1] - odd[0], even[0] - odd[1]]


def _hadamard_line(a: Column, b: Column, c: Column, d: Column) -> list[Column]:
    return [a + b + c + d, a + b - c - d, a - b - c + d, a - b + c - d]


def _both(block: Column, line, last=lambda v: v, rows_first: bool = True) -> Column:  # noqa: ANN001
    """A line transform of rows, then of columns, or the other way round; each half is one array, so nothing is written
    out twice."""
    first = F.array(*[v for row in _lines(block, rows_first) for v in line(*row)])
    if not rows_first:  # what came out is a list of columns
        return F.get(F.transform(F.array(first), lambda m: F.array(*[last(v) for row in _lines(m, False) for v in line(*row)])), 0)
    second = F.transform(F.array(first), lambda m: _transposed([v for col in _lines(m, False) for v in line(*col)], last))
    return F.get(second, 0)


def _transposed(columns: list[Column], last) -> Column:  # noqa: ANN001
    return F.array(*[last(columns[4 * c + r]) for r in range(4) for c in range(4)])


def inverse_transform(block: Column) -> Column:
    """Residual of 16 coefficients, rounded by 64ths."""
    return _both(block, _inverse_line, lambda v: F.shiftright(v + 32, 6))


def hadamard(block: Column) -> Column:
    """The transform of luma DC coefficients, without scaling."""
    return _both(block, _hadamard_line)


def vp8_inverse_transform(block: Column) -> Column:
    """Residual of 16 VP8 coefficients: columns, then rows, rounded by eighths. 35468 and 20091 stand for sqrt(2) times
    sine and cosine of pi/8, the latter less one, in 65536ths."""

    def line(a: Column, b: Column, c: Column, d: Column) -> list[Column]:
        sine, cosine = lambda v: F.shiftright(v * 35468, 16), lambda v: v + F.shiftright(v * 20091, 16)
        low, high = sine(b) - cosine(d), cosine(b) + sine(d)
        return [a + c + high, a - c + low, a - c - low, a + c - high]

    return _both(block, line, lambda v: F.shiftright(v + 4, 3), rows_first=False)


def vp8_inverse_walsh(block: Column) -> Column:
    """The DC values of a macroblock's 16 blocks."""

    def line(a: Column, b: Column, c: Column, d: Column) -> list[Column]:
        return [a + d + b + c, b - c + a - d, a + d - b - c, a - d - b + c]

    return _both(block, line, lambda v: F.shiftright(v + 3, 3), rows_first=False)


def six_tap(line: list[Column]) -> Column:
    """Half-sample value between the third and fourth of six neighbours."""
    a, b, c, d, e, f = line
    return F.least(F.greatest(F.shiftright(a - b * 5 + c * 20 + d * 20 - e * 5 + f + 16, 5), F.lit(0)), F.lit(255))


def edge_strength(intra: Column, at_mb_edge: Column, coded: Column, same_ref: Column, dx: Column, dy: Column) -> Column:
    """Deblocking strength between two blocks: 4 and 3 for intra, 2 for coefficients, 1 for unlike motion."""
    return F.when(intra & at_mb_edge, 4).when(intra, 3).when(coded, 2).when(~same_ref | (F.abs(dx) >= 4) | (F.abs(dy) >= 4), 1).otherwise(0)


def _byte(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0)), F.lit(255))


def normal_filter(p1: Column, p0: Column, q0: Column, q1: Column, alpha: int, beta: int, clip: int) -> list[Column]:
    """p0 and q0 after the edge filter for strengths below 4."""
    on = (F.abs(p0 - q0) < alpha) & (F.abs(p1 - p0) < beta) & (F.abs(q1 - q0) < beta)
    d = F.least(F.greatest(F.shiftright((q0 - p0) * 4 + (p1 - q1) + 4, 3), F.lit(-clip)), F.lit(clip))
    return [F.when(on, _byte(p0 + d)).otherwise(p0).alias("p0"), F.when(on, _byte(q0 - d)).otherwise(q0).alias("q0")]


def vp8_simple_filter(p1: Column, p0: Column, q0: Column, q1: Column, limit: int) -> list[Column]:
    """p0 and q0 after VP8's simple filter, in signed arithmetic."""
    sat = lambda v: F.least(F.greatest(v, F.lit(-128)), F.lit(127))
    a, b, c, d = (x - 128 for x in (p1, p0, q0, q1))
    on = F.abs(b - c) * 2 + F.shiftright(F.abs(a - d), 1) <= limit
    change = sat(sat(a - d) + (c - b) * 3)
    down, up = F.shiftright(sat(change + 4), 3), F.shiftright(sat(change + 3), 3)
    return [(F.when(on, sat(b + up)).otherwise(b) + 128).alias("p0"), (F.when(on, sat(c - down)).otherwise(c) + 128).alias("q0")]


def weighted(v: Column, weight: Column, offset: Column, bits: int) -> Column:
    """Explicit weighted prediction from one reference."""
    scaled = F.shiftright(v * weight + (1 << (bits - 1)), bits) if bits else v * weight
    return _byte(scaled + offset)
