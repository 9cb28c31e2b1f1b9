"""Fixed-layout bytes, read with SQL functions alone: planar frames, and the uncompressed parts of headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def byte_at(data: Column, at: int) -> Column:
    """The byte at a zero-based place, as a number."""
    return F.conv(F.hex(F.substring(data, at + 1, 1)), 16, 10).cast("long")


def little_endian(data: Column, at: int, size: int) -> Column:
    out = byte_at(data, at)
    for k in range(1, size):
        out = out + byte_at(data, at + k) * (1 << (8 * k))
    return out


def planar_frames(files: DataFrame, width: int, height: int) -> DataFrame:
    """(clip_id, n, y, cb, cr) of raw 4:2:0 files. Chroma rounds up; a short tail is the end."""
    luma, chroma = width * height, ((width + 1) // 2) * ((height + 1) // 2)
    size = luma + 2 * chroma
    count = F.floor(F.octet_length("content") / size)
    frames = files.where(count > 0).select("clip_id", "content", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("n"))
    part = lambda start, n: F.expr(f"substring(content, cast(n * {size} + {start} + 1 AS INT), {n})")
    return frames.select("clip_id", "n", part(0, luma).alias("y"), part(luma, chroma).alias("cb"), part(luma + chroma, chroma).alias("cr"))


def vp8_tag(data: Column) -> Column:
    """Struct of a VP8 frame's uncompressed header; dimensions and scales are null in inter frames."""
    tag = little_endian(data, 0, 3)
    key = tag % 2 == 0
    good = F.hex(F.substring(data, 4, 3)) == "9D012A"
    wide, high = little_endian(data, 6, 2), little_endian(data, 8, 2)
    only = lambda c: F.when(key, c)
    return F.struct(
        key.alias("is_key"), (F.shiftright(tag, 1) % 8).alias("version"), (F.shiftright(tag, 4) % 2 == 1).alias("shown"), F.shiftright(tag, 5).alias("first_part"), only(good).alias("start_code"),
        only(wide % 16384).alias("width"), only(F.shiftright(wide, 14)).alias("scale_x"), only(high % 16384).alias("height"), only(F.shiftright(high, 14)).alias("scale_y"),
    )


def gop_packet_header(data: Column) -> Column:
    """Struct of the fixed part of a packet of the indexed container."""
    first = byte_at(data, 0)
    key = first % 4 == 0
    return F.struct(
        (first % 4).alias("type"), (F.shiftright(first, 2) % 8).alias("coding"), (F.shiftright(first, 5) % 2 == 1).alias("override"), F.when(key, little_endian(data, 1, 2)).alias("width"), F.when(key, little_endian(data, 3, 2)).alias("height")
    )


def gop_file_header(data: Column) -> Column:
    """Struct of the 48-byte file header of the indexed container."""
    u = lambda at, n: little_endian(data, at, n)
    return F.struct(F.decode(F.substring(data, 1, 4), "UTF-8").alias("magic"), u(4, 2).alias("version"), u(6, 2).alias("size"), u(8, 4).alias("width"), u(12, 4).alias("height"), u(16, 4).alias("num"), u(20, 4).alias("den"), u(32, 2).alias("tile_cols"), u(34, 2).alias("tile_rows"))
