"""Arithmetic on samples and coefficients: colour, quantisation, transforms, scan orders."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .integers import clamp, tdiv

#: 16.16 factors of limited-range conversion to RGB.
Y_SCALE, R_CR, G_CB, G_CR, B_CB = 65793, 91881, -22554, -46802, 116130
MAX_QP, DCT_BITS = 63, 13


def rgba(y: Column, cb: Column, cr: Column) -> list[Column]:
    """Red, green, blue and alpha of a sample."""
    base, u, v = y.cast("long") * Y_SCALE, cb - 128, cr - 128
    mixed = {"r": base + v * R_CR, "g": base + u * G_CB + v * G_CR, "b": base + u * B_CB}
    return [F.shiftright(clamp(c, 0, 0xFF0000), 16).cast("int").alias(k) for k, c in mixed.items()] + [F.lit(255).alias("a")]


def scaled(v: Column, by: int) -> Column:
    """v times a whole number in v's own precision: Spark alone would widen a float to double, and a product near a
    whole number then has another floor."""
    return v * F.lit(by).cast("float")


def psnr(sse: Column, n: Column, when_exact: float = float("inf")) -> Column:
    """Peak signal-to-noise ratio in dB; equal planes give `when_exact`."""
    return F.when(sse == 0, F.lit(when_exact)).otherwise(F.log10(F.lit(65025.0) * n / sse) * 10)


def steps(qp: int) -> tuple[int, int]:
    """Quantiser steps (dc, ac); the first coefficient is an octave finer where there is one."""
    step = lambda q: max(1, math.floor(2 ** (q / 6) + 0.5))
    qp = min(max(qp, 0), MAX_QP)
    return step(qp - 6 if qp >= 6 else qp), step(qp)


def quantise(c: Column, step: Column) -> Column:
    """Level of a coefficient, with a dead zone: the rounding bias is 3/8 of a step."""
    size = tdiv(F.abs(c) * 8 + step * 3, step * 8)
    return F.when(c < 0, -size).otherwise(size)


def dct_matrix(n: int) -> list[list[int]]:
    """Orthonormal cosine matrix, scaled by 2^DCT_BITS."""
    rows = []
    for k in range(n):
        scale = math.sqrt((1 if k == 0 else 2) / n) * (1 << DCT_BITS)
        rows.append([int(math.copysign(math.floor(abs(x) + 0.5), x)) for x in (scale * math.cos((2 * i + 1) * k * math.pi / (2 * n)) for i in range(n))])
    return rows


def hadamard(n: int) -> list[list[int]]:
    """Signs of the Walsh-Hadamard matrix: parity of the common bits of row and column."""
    return [[-1 if (i & j).bit_count() % 2 else 1 for j in range(n)] for i in range(n)]


def zigzag(n: int) -> list[int]:
    """Places of an n x n block by diagonals; even ones run up, odd ones down."""
    return sorted(range(n * n), key=lambda p: ((d := p // n + p % n), p % n if d % 2 == 0 else p // n))
