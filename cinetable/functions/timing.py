"""Frame numbers, times in nanoseconds and frame rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .integers import tdiv

SECOND = 1_000_000_000
#: Rates that are recognised by themselves and in their 1000/1001 form.
KNOWN_RATES = [24, 25, 30, 48, 50, 60, 120]


def frame_time(n: Column, num: Column, den: Column) -> Column:
    """Start of frame n. Multiplied first, so rates like 30000/1001 stay exact."""
    return tdiv(n * den * F.lit(SECOND), num)


def frame_at(t: Column, num: Column, den: Column) -> Column:
    """The last frame that starts at or before t, at least 0: an estimate is off by one frame at most."""
    guess = tdiv(t * num, den * F.lit(SECOND))
    up = F.when(frame_time(guess + 1, num, den) <= t, guess + 1).otherwise(guess)
    return F.when(t <= 0, F.lit(0)).otherwise(F.when((up > 0) & (frame_time(up, num, den) > t), up - 1).otherwise(up))


def rational_rate(fps: Column) -> Column:
    """A struct num, den for a rate in floating point."""
    rate = lambda a, b: F.struct(a.cast("long").alias("num"), F.lit(b).cast("long").alias("den"))
    out = rate(F.round(fps * 1000), 1000)
    for n in reversed(KNOWN_RATES):
        out = F.when(F.abs(fps - n) < 1e-6, rate(F.lit(n), 1)).when(F.abs(fps - n * 1000 / 1001) < 1e-3, rate(F.lit(n * 1000), 1001)).otherwise(out)
    bad = fps.isNull() | F.isnan(fps) | (fps <= 0) | (fps == float("inf"))
    return F.when(bad, rate(F.lit(30), 1)).otherwise(out)
