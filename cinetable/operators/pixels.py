"""Planes as rows (clip or n, y, x, v): comparison, differences, block statistics, prediction, transforms."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.integers import tdiv
from ..functions.samples import dct_matrix, hadamard, psnr

BLOCK, CUT_PER_PIXEL, ALIKE_PER_PIXEL = 16, 28, 6


def synthetic(spark: SparkSession, frames: int, width: int, height: int, pan: bool = False) -> DataFrame:
    """Luma of a test clip as rows n, y, x, v: a textured diagonal split, or a texture that moves two pixels a frame."""
    at = spark.range(frames * height * width).select(F.expr(f"id div {width * height}").alias("n"), F.expr(f"(id div {width}) % {height}").alias("y"), F.expr(f"id % {width}").alias("x"))
    if pan:
        moved = at.select("*", (F.col("x") + F.col("n") * 2).alias("u"), (F.col("y") + F.col("n") * 2).alias("w"))
        base = F.expr("(3 * u + 2 * w) & 255")
        return moved.select("n", "y", "x", F.when(F.expr("(u div 6 + w div 6) % 2 = 0"), base.bitwiseXOR(F.lit(64))).otherwise(base).alias("v"))
    base = F.expr("(3 * x + 5 * y + 7 * n) & 255")
    split = F.when(F.col("x") + F.col("y") > (width + height) // 2, 255 - base).otherwise(base)
    return at.select("n", "y", "x", F.when(F.expr("(x div 4 + y div 4) % 2 = 0"), split.bitwiseXOR(F.lit(51))).otherwise(split).alias("v"))


def compare(got: DataFrame, want: DataFrame, when_exact: float = 99.0) -> DataFrame:
    """One row a frame: wrong samples, greatest error, the first wrong place in raster order, SSE and PSNR."""
    both = got.alias("a").join(want.alias("b"), ["n", "y", "x"]).select("n", "y", "x", (F.col("a.v") - F.col("b.v")).alias("e"))
    wrong = F.col("e") != 0
    first = F.min(F.when(wrong, F.struct("y", "x")))
    out = both.groupBy("n").agg(F.sum(wrong.cast("long")).alias("wrong"), F.max(F.abs("e")).alias("max_error"), first.alias("_f"), F.sum(F.col("e") * F.col("e")).alias("sse"), F.count("*").alias("_n"))
    return out.select("n", "wrong", "max_error", F.col("_f.y").alias("first_y"), F.col("_f.x").alias("first_x"), "sse", F.round(psnr(F.col("sse"), F.col("_n"), when_exact), 6).alias("psnr"))


def scene_cuts(luma: DataFrame, per_pixel: int = CUT_PER_PIXEL) -> DataFrame:
    """SAD of each frame to the one before, and whether it is a cut; the first never is."""
    before = F.lag("v").over(Window.partitionBy("y", "x").orderBy("n"))
    out = luma.withColumn("_d", F.abs(F.col("v") - before)).groupBy("n").agg(F.sum("_d").alias("sad"), F.count("*").alias("_n"))
    return out.select("n", "sad", F.coalesce(F.col("sad") > F.col("_n") * per_pixel, F.lit(False)).alias("cut"))


def denoised(luma: DataFrame, block: int = BLOCK, per_pixel: int = ALIKE_PER_PIXEL) -> DataFrame:
    """Frame 0 averaged with the blocks of later frames that are alike; rounded half up."""
    at = [tdiv(F.col("y"), block).alias("by"), tdiv(F.col("x"), block).alias("bx")]
    first = luma.where("n = 0").select("y", "x", F.col("v").alias("v0"))
    rows = luma.join(first, ["y", "x"]).select("*", *at)
    alike = rows.groupBy("n", "by", "bx").agg(F.sum(F.abs(F.col("v") - F.col("v0"))).alias("sad"), F.count("*").alias("area")).where(F.col("sad") <= F.col("area") * per_pixel)
    kept = rows.join(alike.select("n", "by", "bx"), ["n", "by", "bx"], "left_semi")
    return kept.groupBy("y", "x").agg(F.sum("v").alias("s"), F.count("*").alias("c")).select("y", "x", F.col("c").alias("frames"), tdiv(F.col("s") + tdiv(F.col("c"), 2), F.col("c")).alias("v"))


def _transformed(blocks: DataFrame, n: int, matrix: Sequence[Sequence[int]], shift: int) -> DataFrame:
    """Keys and t: the n x n values of each block (keys.., i, j, v), multiplied by a small matrix along i, then j, each
    rounded by `shift` bits, in raster order. Keys are all other columns. One shuffle makes the blocks; a batch of them
    is one product. Places without a row count as zero."""
    keys = [c for c in blocks.columns if c not in ("i", "j", "v")]
    place = F.struct((F.col("i") * n + F.col("j")).cast("int").alias("at"), F.col("v").cast("long").alias("v"))
    packed = blocks.groupBy(*keys).agg(F.collect_list(place).alias("_b"))
    kinds = {f.name: f.dataType.simpleString() for f in packed.schema.fields}
    m, half = np.array(matrix, np.int64), (1 << (shift - 1)) if shift else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_b")
            values = lists.flatten()
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            dense = np.zeros((len(lists), n * n), np.int64)
            dense[row, values.field("at").to_numpy(zero_copy_only=False)] = values.field("v").to_numpy(zero_copy_only=False)
            columns = (m @ dense.reshape(-1, n, n) + half) >> shift
            both = (columns @ m.T + half) >> shift
            out = pa.ListArray.from_arrays(pa.array(np.arange(0, both.size + 1, n * n, dtype=np.int32)), pa.array(both.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), out], names=[*keys, "t"])

    return packed.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", t array<bigint>")


def _exploded(done: DataFrame, n: int) -> DataFrame:
    keys = [c for c in done.columns if c != "t"]
    rows = done.select(*keys, F.posexplode("t").alias("_at", "v"))
    return rows.select(*keys, tdiv(F.col("_at").cast("long"), n).alias("i"), (F.col("_at") % n).cast("long").alias("j"), "v")


def forward_dct(blocks: DataFrame, n: int = 8) -> DataFrame:
    """Integer cosine transform of n x n blocks: columns, then rows, each rounded."""
    return _exploded(_transformed(blocks, n, dct_matrix(n), 13), n)


def inverse_dct(blocks: DataFrame, n: int = 8) -> DataFrame:
    return _exploded(_transformed(blocks, n, [list(row) for row in zip(*dct_matrix(n), strict=True)], 13), n)


def satd(blocks: DataFrame, n: int = 4) -> DataFrame:
    """Sum of absolute Hadamard coefficients of each block."""
    done = _transformed(blocks, n, hadamard(n), 0)
    return done.select(*[c for c in done.columns if c != "t"], F.aggregate("t", F.lit(0).cast("long"), lambda total, v: total + F.abs(v)).alias("satd"))


def blocks_of(luma: DataFrame, size: int) -> DataFrame:
    """Rows n, by, bx, i, j, v."""
    return luma.select("n", tdiv(F.col("y"), size).alias("by"), tdiv(F.col("x"), size).alias("bx"), (F.col("y") % size).alias("i"), (F.col("x") % size).alias("j"), "v")


def dc_predicted(luma: DataFrame, size: int) -> DataFrame:
    """The rounded mean of the samples above and left of each block; 128 where there are none."""
    places = luma.select("n", "y", "x", "v")
    above = places.where((F.col("y") + 1) % size == 0).select("n", (tdiv(F.col("y"), size) + 1).alias("by"), tdiv(F.col("x"), size).alias("bx"), "v")
    left = places.where((F.col("x") + 1) % size == 0).select("n", tdiv(F.col("y"), size).alias("by"), (tdiv(F.col("x"), size) + 1).alias("bx"), "v")
    border = above.unionByName(left).groupBy("n", "by", "bx").agg(F.sum("v").alias("s"), F.count("*").alias("c"))
    blocks = luma.select("n", tdiv(F.col("y"), size).alias("by"), tdiv(F.col("x"), size).alias("bx")).distinct()
    return blocks.join(border, ["n", "by", "bx"], "left").select("n", "by", "bx", F.coalesce(tdiv(F.col("s") + tdiv(F.col("c"), 2), F.col("c")), F.lit(128)).alias("dc"))


def motion_search(current: DataFrame, reference: DataFrame, size: int, reach: int) -> DataFrame:
    """Full search: for each block the offset of least SAD; ties go to the shorter, then the earlier offset.

    Sample pairs are made by an equi-join on the place that an offset leads to; offsets are few by their bound.
    """
    span = F.sequence(F.lit(-reach), F.lit(reach))
    moved = current.select("n", "y", "x", F.col("v").alias("cv"), F.explode(span).alias("dy")).select("*", F.explode(span).alias("dx"))
    pairs = moved.join(reference.select("n", F.col("y").alias("_y"), F.col("x").alias("_x"), F.col("v").alias("rv")), (F.col("_y") == F.col("y") + F.col("dy")) & (F.col("_x") == F.col("x") + F.col("dx")) & moved["n"].eqNullSafe(reference["n"]))
    pairs = pairs.select(moved["n"], tdiv(F.col("y"), size).alias("by"), tdiv(F.col("x"), size).alias("bx"), "dy", "dx", F.abs(F.col("cv") - F.col("rv")).alias("d"))
    costs = pairs.groupBy("n", "by", "bx", "dy", "dx").agg(F.sum("d").alias("sad"), F.count("*").alias("area")).where(F.col("area") == size * size)
    best = costs.groupBy("n", "by", "bx").agg(F.min(F.struct("sad", (F.abs("dy") + F.abs("dx")).alias("l"), "dy", "dx")).alias("b"))
    return best.select("n", "by", "bx", F.col("b.dy").alias("dy"), F.col("b.dx").alias("dx"), F.col("b.sad").alias("sad"))
