"""Rate and quality points of encodes: summaries and interpolation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def summary(ratios: DataFrame, keys: list[str], ratio: str = "ratio") -> DataFrame:
    """Exact median, least and greatest ratio."""
    return ratios.groupBy(*keys).agg(F.round(F.percentile(ratio, 0.5), 9).alias("median"), F.min(ratio).alias("least"), F.max(ratio).alias("most"), F.count("*").alias("clips"))


def size_at(points: DataFrame, target: float, keys: list[str], quality: str = "psnr", size: str = "size") -> DataFrame:
    """Size at a target quality, log-linear between the two points around it; groups that don't straddle it are absent."""
    w = Window.partitionBy(*keys).orderBy(quality)
    pairs = points.select(*keys, F.col(quality).alias("q1"), F.col(size).alias("s1"), F.lead(quality).over(w).alias("q2"), F.lead(size).over(w).alias("s2"))
    hit = pairs.where((F.col("q1") <= target) & (F.col("q2") > target))
    share = (F.lit(target) - F.col("q1")) / (F.col("q2") - F.col("q1"))
    return hit.select(*keys, F.round(F.exp(F.log("s1") + share * (F.log("s2") - F.log("s1"))), 4).alias("size"))
