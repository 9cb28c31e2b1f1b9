"""Streams without Python state: arrival windows, generation fences and late rows by watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def throughput(packets: DataFrame, time: str, lateness: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Packets, key packets and bytes of each clip and window; rows later than the watermark are dropped."""
    return (
        packets.withWatermark(time, lateness)
        .groupBy(F.window(time, window).alias("w"), "clip_id")
        .agg(F.count("*").alias("packets"), F.sum(F.col("is_key").cast("long")).alias("keys"), F.sum(F.octet_length("data")).alias("bytes"))
        .select("clip_id", F.col("w.start").alias("start"), "packets", "keys", "bytes")
    )


def newest_per_batch(frames: DataFrame) -> DataFrame:
    """The newest frame of each session so far: those that a late viewer skips leave no row (update mode)."""
    return frames.groupBy("session").agg(F.max_by("n", "pts_ns").alias("shown"), F.max("pts_ns").alias("pts_ns"))
