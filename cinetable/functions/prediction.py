"""Intra prediction and edge filters of H.264 and VP8 blocks as Column expressions.

A 4x4 block is predicted from a border of 13 samples: the left column from the bottom up, the corner, eight above.
Nearly every mode is then a two- or three-tap average at a place of the border that depends on the sample.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Place of the corner in the border: left samples stand before it, those above behind it.
CORNER = 4
H264_MODES = ("vertical", "horizontal", "dc", "down_left", "down_right", "vertical_right", "horizontal_down", "vertical_left", "horizontal_up")
VP8_MODES = ("dc", "true_motion", "vertical", "horizontal", "down_left", "down_right", "vertical_right", "vertical_left", "horizontal_down", "horizontal_up")


def byte(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0)), F.lit(255))


def _taps(border: Column, at: int, n: int) -> Column:
    """The average of `n` border samples: of `at` and the next one, or of three around `at`. The ends repeat."""
    get = lambda k: F.get(border, min(max(k, 0), 12))
    if n == 2:
        return F.shiftright(get(at) + get(at + 1) + 1, 1)
    return F.shiftright(get(at - 1) + get(at) * 2 + get(at + 1) + 2, 2)


def _directional(mode: str, x: int, y: int) -> tuple[int, int]:
    """(place, taps) in the border for the modes that both formats share."""
    if mode == "down_left":
        return CORNER + 2 + x + y, 3
    if mode == "down_right":
        return CORNER + x - y, 3
    if mode == "vertical_right":
        z = 2 * x - y
        return (CORNER + x - y // 2, 2) if z >= 0 and z % 2 == 0 else (CORNER + x - y // 2, 3) if z > 0 else (CORNER + 1 - y if z < -1 else CORNER, 3)
    if mode == "horizontal_down":
        z = 2 * y - x
        return (CORNER - 1 - (y - x // 2), 2) if z >= 0 and z % 2 == 0 else (CORNER - (y - x // 2), 3) if z > 0 else (CORNER - 1 + x if z < -1 else CORNER, 3)
    if mode == "vertical_left":
        return (CORNER + 1 + x + y // 2, 2) if y % 2 == 0 else (CORNER + 2 + x + y // 2, 3)
    z = x + 2 * y  # horizontal_up; beyond the last left sample that one repeats
    k = CORNER - 1 - (y + x // 2)
    return (k - 1, 2) if z % 2 == 0 else (k - 1, 3)


def _shared(border: Column, mode: str) -> Column:
    def sample(x: int, y: int) -> Column:
        if mode == "horizontal_up" and x + 2 * y > 5:
            return F.get(border, 0)
        return _taps(border, *_directional(mode, x, y))

    return F.array(*[sample(x, y) for y in range(4) for x in range(4)])


def _dc(border: Column) -> Column:
    total = sum((F.get(border, k) for k in (0, 1, 2, 3, 5, 6, 7, 8)), F.lit(4))
    return F.array_repeat(F.shiftright(total, 3), 16)


def h264_intra_4x4(border: Column, mode: str) -> Column:
    """Sixteen samples in raster order."""
    if mode == "vertical":
        return F.array(*[F.get(border, CORNER + 1 + x) for _ in range(4) for x in range(4)])
    if mode == "horizontal":
        return F.array(*[F.get(border, CORNER - 1 - y) for y in range(4) for _ in range(4)])
    return _dc(border) if mode == "dc" else _shared(border, mode)


def vp8_intra_4x4(border: Column, mode: str) -> Column:
    """As above; vertical and horizontal are smoothed, and the last two samples of vertical_left lie further right."""
    if mode == "true_motion":
        return F.array(*[byte(F.get(border, CORNER - 1 - y) + F.get(border, CORNER + 1 + x) - F.get(border, CORNER)) for y in range(4) for x in range(4)])
    if mode == "vertical":
        return F.array(*[_taps(border, CORNER + 1 + x, 3) for _ in range(4) for x in range(4)])
    if mode == "horizontal":
        return F.array(*[_taps(border, CORNER - 1 - y, 3) for y in range(4) for _ in range(4)])
    if mode == "vertical_left":
        place = lambda x, y: (CORNER + 4 + y, 3) if x == 3 and y > 1 else _directional(mode, x, y)
        return F.array(*[_taps(border, *place(x, y)) for y in range(4) for x in range(4)])
    return _dc(border) if mode == "dc" else _shared(border, mode)


def intra_16x16(corner: Column, above: Column, left: Column, mode: str) -> Column:
    """256 samples in raster order: vertical, horizontal, dc, plane (H.264) or true_motion (VP8)."""
    places = F.sequence(F.lit(0), F.lit(255))
    x, y = lambda i: F.pmod(i, F.lit(16)), lambda i: F.shiftright(i, 4)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, v: s + v)
    if mode == "vertical":
        return F.transform(places, lambda i: F.get(above, x(i)))
    if mode == "horizontal":
        return F.transform(places, lambda i: F.get(left, y(i)))
    if mode == "dc":
        return F.array_repeat(F.shiftright(total(above) + total(left) + 16, 5), 256)
    if mode == "true_motion":
        return F.transform(places, lambda i: byte(F.get(left, y(i)) + F.get(above, x(i)) - corner))
    slope = lambda side: sum(((F.get(side, 8 + k) - (F.get(side, 6 - k) if k < 7 else corner)) * (k + 1) for k in range(8)), F.lit(0).cast("long"))
    b, c = (F.shiftright(slope(side) * 5 + 32, 6) for side in (above, left))
    base = (F.get(above, 15) + F.get(left, 15)) * 16 + 16
    plane = F.struct(base.alias("a"), b.alias("b"), c.alias("c"))
    return F.get(F.transform(F.array(plane), lambda p: F.transform(places, lambda i: byte(F.shiftright(p["a"] + p["b"] * (x(i) - 7) + p["c"] * (y(i) - 7), 5)))), 0)


# -- edge filters -------------------------------------------------------------------------------------------------

#: Fixed values of the standard, by index 16 to 51; below 16 the filter is off.
ALPHA = [4, 4, 5, 6, 7, 8, 9, 10, 12, 13, 15, 17, 20, 22, 25, 28, 32, 36, 40, 45, 50, 56, 63, 71, 80, 90, 101, 113, 127, 144, 162, 182, 203, 226, 255, 255]
BETA = [2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 6, 6, 7, 7, 8, 8, 9, 9, 10, 10, 11, 11, 12, 12, 13, 13, 14, 14, 15, 15, 16, 16, 17, 17, 18, 18]
#: Fixed values of the standard: clip for strengths 1, 2 and 3, by index 17 to 51; 0 below.
CLIP = [
    (0, 0, 1), (0, 0, 1), (0, 0, 1), (0, 0, 1), (0, 1, 1), (0, 1, 1), (1, 1, 1), (1, 1, 1), (1, 1, 1), (1, 1, 1), (1, 1, 2), (1, 1, 2), (1, 1, 2), (1, 1, 2), (1, 2, 3), (1, 2, 3), (2, 2, 3), (2, 2, 4),
    (2, 3, 4), (2, 3, 4), (3, 3, 5), (3, 4, 6), (3, 4, 6), (4, 5, 7), (4, 5, 8), (4, 6, 9), (5, 7, 10), (6, 8, 11), (6, 8, 13), (7, 10, 14), (8, 11, 16), (9, 12, 18), (10, 13, 20), (11, 15, 23), (13, 17, 25),
]


def thresholds(index_a: Column, index_b: Column, strength: Column) -> tuple[Column, Column, Column]:
    """alpha, beta and the clip of an edge."""
    literal = lambda values: F.array(*map(F.lit, values))
    alpha = F.when(index_a < 16, 0).otherwise(F.get(literal(ALPHA), (index_a - 16).cast("int")))
    beta = F.when(index_b < 16, 0).otherwise(F.get(literal(BETA), (index_b - 16).cast("int")))
    clip = F.when((index_a < 17) | ~strength.between(1, 3), 0).otherwise(F.get(literal([v for row in CLIP for v in row]), ((index_a - 17) * 3 + strength - 1).cast("int")))
    return alpha, beta, clip


def luma_edge(p: list[Column], q: list[Column], strength: Column, alpha: Column, beta: Column, clip: Column) -> list[Column]:
    """p2, p1, p0, q0, q1, q2 after the H.264 luma filter; `p` and `q` hold four samples each, nearest first."""
    on = (strength > 0) & (F.abs(p[0] - q[0]) < alpha) & (F.abs(p[1] - p[0]) < beta) & (F.abs(q[1] - q[0]) < beta)
    flat = F.abs(p[0] - q[0]) < F.shiftright(alpha, 2) + 2
    limit = lambda v, most: F.least(F.greatest(v, -most), most)

    def side(a: list[Column], b: list[Column]) -> tuple[list[Column], Column, Column]:
        """Strong results of a0, a1, a2; the normal result of a1; whether a2 is near a0."""
        near = F.abs(a[2] - a[0]) < beta
        strong = near & flat
        s0 = F.when(strong, F.shiftright(a[2] + a[1] * 2 + a[0] * 2 + b[0] * 2 + b[1] + 4, 3)).otherwise(F.shiftright(a[1] * 2 + a[0] + b[1] + 2, 2))
        s1 = F.when(strong, F.shiftright(a[2] + a[1] + a[0] + b[0] + 2, 2)).otherwise(a[1])
        s2 = F.when(strong, F.shiftright(a[3] * 2 + a[2] * 3 + a[1] + a[0] + b[0] + 4, 3)).otherwise(a[2])
        normal = F.when(near, a[1] + limit(F.shiftright(a[2] + F.shiftright(a[0] + b[0] + 1, 1) - a[1] * 2, 1), clip)).otherwise(a[1])
        return [s0, s1, s2], normal, near

    (ps, p1, p_near), (qs, q1, q_near) = side(p, q), side(q, p)
    tc = clip + p_near.cast("int") + q_near.cast("int")
    delta = limit(F.shiftright((q[0] - p[0]) * 4 + (p[1] - q[1]) + 4, 3), tc)
    pick = lambda strong, normal, old: F.when(~on, old).when(strength == 4, strong).otherwise(normal)
    return [
        pick(ps[2], p[2], p[2]).alias("p2"), pick(ps[1], p1, p[1]).alias("p1"), pick(ps[0], byte(p[0] + delta), p[0]).alias("p0"),
        pick(qs[0], byte(q[0] - delta), q[0]).alias("q0"), pick(qs[1], q1, q[1]).alias("q1"), pick(qs[2], q[2], q[2]).alias("q2"),
    ]


def chroma_edge(p: list[Column], q: list[Column], strength: Column, alpha: Column, beta: Column, clip: Column) -> list[Column]:
    """p0 and q0 after the H.264 chroma filter."""
    on = (strength > 0) & (F.abs(p[0] - q[0]) < alpha) & (F.abs(p[1] - p[0]) < beta) & (F.abs(q[1] - q[0]) < beta)
    delta = F.least(F.greatest(F.shiftright((q[0] - p[0]) * 4 + (p[1] - q[1]) + 4, 3), -(clip + 1)), clip + 1)
    pick = lambda strong, normal, old: F.when(~on, old).when(strength == 4, F.shiftright(strong + 2, 2)).otherwise(byte(normal))
    return [pick(p[1] * 2 + p[0] + q[1], p[0] + delta, p[0]).alias("c_p0"), pick(q[1] * 2 + q[0] + p[1], q[0] - delta, q[0]).alias("c_q0")]


def vp8_normal_edge(p: list[Column], q: list[Column], edge: Column, interior: Column, high: Column, at_macroblock: bool) -> list[Column]:
    """p2, p1, p0, q0, q1, q2 after VP8's normal filter, within a macroblock or at its edge."""
    sat = lambda v: F.least(F.greatest(v, F.lit(-128)), F.lit(127))
    on = F.abs(p[0] - q[0]) * 2 + F.shiftright(F.abs(p[1] - q[1]), 1) <= edge
    for a, b in [(p[3], p[2]), (p[2], p[1]), (p[1], p[0]), (q[3], q[2]), (q[2], q[1]), (q[1], q[0])]:
        on = on & (F.abs(a - b) <= interior)
    varied = (F.abs(p[1] - p[0]) > high) | (F.abs(q[1] - q[0]) > high)
    (p2, p1, p0), (q2, q1, q0) = ([v - 128 for v in side[2::-1]] for side in (p, q))
    outer, inner = sat(p1 - q1), (q0 - p0) * 3
    common = sat(outer + inner)
    f, g = F.shiftright(sat(common + 4), 3), F.shiftright(sat(common + 3), 3)
    if at_macroblock:  # three weights reach three samples on either side
        a = [F.shiftright(common * w + 63, 7) for w in (27, 18, 9)]
        new = [F.when(varied, p2).otherwise(sat(p2 + a[2])), F.when(varied, p1).otherwise(sat(p1 + a[1])), F.when(varied, sat(p0 + g)).otherwise(sat(p0 + a[0]))]
        new += [F.when(varied, sat(q0 - f)).otherwise(sat(q0 - a[0])), F.when(varied, q1).otherwise(sat(q1 - a[1])), F.when(varied, q2).otherwise(sat(q2 - a[2]))]
    else:
        bare = sat(inner)
        f, g = F.when(varied, f).otherwise(F.shiftright(sat(bare + 4), 3)), F.when(varied, g).otherwise(F.shiftright(sat(bare + 3), 3))
        half = F.shiftright(f + 1, 1)
        new = [p2, F.when(varied, p1).otherwise(sat(p1 + half)), sat(p0 + g), sat(q0 - f), F.when(varied, q1).otherwise(sat(q1 - half)), q2]
    old = [p[2], p[1], p[0], q[0], q[1], q[2]]
    return [F.when(on, v + 128).otherwise(o).alias(n) for v, o, n in zip(new, old, ("p2", "p1", "p0", "q0", "q1", "q2"), strict=True)]
