"""Ordered streams: groups of pictures, seeks, as-of lookups, display order, generations.

A stream is a table with a clip, an order within it and times in nanoseconds. Everything here is a window over the
clip. Equal times are ordered by the sequence number, so results don't depend on how rows lie.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import fold


def _so_far(clip: str, *order: str | Column) -> Window:
    return Window.partitionBy(clip).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def with_groups(packets: DataFrame, clip: str = "clip_id", seq: str = "seq", key: str = "is_key") -> DataFrame:
    """Adds gop_id (0 before the first key) and key_seq, the last key packet at or before each packet."""
    w = _so_far(clip, seq)
    return packets.withColumn("gop_id", F.sum(F.col(key).cast("long")).over(w)).withColumn("key_seq", F.last(F.when(F.col(key), F.col(seq)), ignorenulls=True).over(w))


def as_of(left: DataFrame, right: DataFrame, clip: str, left_time: str, right_time: str, columns: Sequence[str]) -> DataFrame:
    """For each row of `left` the `columns` of the last row of `right` with right_time <= left_time, else nulls.

    A union and one window: linear in both sides, one shuffle on the clip, and no pairs are made. Of right rows with
    equal times the one with the greatest `columns` counts.
    """
    names = left.columns
    ours = left.select(F.col(clip).alias("_c"), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*names).alias("_row"), F.lit(None).cast(right.select(F.struct(*columns).alias("x")).schema["x"].dataType).alias("_hit"))
    theirs = right.select(F.col(clip).alias("_c"), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(ours.schema["_row"].dataType).alias("_row"), F.struct(*columns).alias("_hit"))
    found = ours.unionByName(theirs).withColumn("_found", F.last("_hit", ignorenulls=True).over(_so_far("_c", "_t", "_side", "_hit")))
    return found.where("_side = 1").select("_row.*", *[F.col(f"_found.{c}").alias(c) for c in columns])


def seek(packets: DataFrame, targets: DataFrame, clip: str = "clip_id", seq: str = "seq", pts: str = "pts_ns", key: str = "is_key", at: str = "t_ns") -> DataFrame:
    """For each target the key packet to start from: the last one at or before it, else the clip's first packet."""
    first = packets.groupBy(clip).agg(F.min(F.struct(seq, pts)).alias("_first"))
    keys = packets.where(key).select(clip, F.col(seq).alias("to_seq"), F.col(pts).alias("to_pts"))
    hit = as_of(targets.where(F.col(at).isNotNull()), keys, clip, at, "to_pts", ["to_seq", "to_pts"])
    return hit.join(first, clip, "left").select(*targets.columns, F.coalesce("to_seq", F.col(f"_first.{seq}")).alias("to_seq"), F.coalesce("to_pts", F.col(f"_first.{pts}")).alias("to_pts"))


def shown_at(frames: DataFrame, clock: DataFrame, clip: str = "clip_id", pts: str = "pts_ns", n: str = "n", at: str = "t_ns", loop: str | None = None) -> DataFrame:
    """The frame on screen at each tick, and whether it changed since the tick before.

    The first frame is shown before its time too. With `loop`, the column of a clip's duration, time starts again.
    """
    ticks = clock if loop is None else clock.withColumn("_at", F.pmod(F.col(at), F.col(loop)))
    first = frames.groupBy(clip).agg(F.min(F.struct(pts, n)).alias("_first"))
    found = as_of(ticks, frames.select(clip, F.col(pts).alias("_pts"), F.col(n).alias("_n")), clip, at if loop is None else "_at", "_pts", ["_n"])
    found = found.join(first, clip).withColumn("shown", F.coalesce("_n", F.col(f"_first.{n}")))
    before = F.lag("shown").over(Window.partitionBy(clip).orderBy(at))
    return found.withColumn("changed", F.coalesce(before != F.col("shown"), F.lit(True))).select(*clock.columns, "shown", "changed")


def display_order(pictures: DataFrame, clip: str = "clip_id", epoch: str = "epoch", poc: str = "poc", seq: str = "seq") -> DataFrame:
    """Adds display_n: place by (epoch, signed picture order count)."""
    return pictures.withColumn("display_n", F.row_number().over(Window.partitionBy(clip).orderBy(epoch, poc, seq)) - 1)


def reorder_delay(ordered: DataFrame, clip: str = "clip_id", seq: str = "seq") -> DataFrame:
    """Adds emitted_at: the decode step by which a picture and all before it in display order are there."""
    return ordered.withColumn("emitted_at", F.max(seq).over(_so_far(clip, "display_n")))


def unwrapped_counts(slices: DataFrame, bits: int, clip: str = "clip_id", gop: str = "gop_id", seq: str = "seq", lsb: str = "lsb", is_ref: str = "is_ref") -> DataFrame:
    """Adds poc: the full picture order count from its low bits (type 0), within each group of pictures.

    A fold over the rows of one group, which a reset (IDR) starts.
    """
    full, half = 1 << bits, 1 << (bits - 1)

    def step(state: tuple[int, int], low: int, kept: bool) -> tuple[tuple[int, int], tuple]:
        high, before = state
        if low < before and before - low >= half:
            high += full
        elif low > before and low - before > half:
            high -= full
        return ((high, low) if kept else state), (high + low,)

    return fold(slices, [clip, gop], seq, [lsb, is_ref], lambda: (0, 0), step, "poc long")


def frame_number_counts(slices: DataFrame, bits: int, clip: str = "clip_id", gop: str = "gop_id", seq: str = "seq", frame_num: str = "frame_num", is_ref: str = "is_ref") -> DataFrame:
    """Adds poc of type 2: twice the unwrapped frame number, one less for pictures that nothing refers to."""
    w = Window.partitionBy(clip, gop).orderBy(seq)
    wraps = F.sum((F.lag(frame_num).over(w) > F.col(frame_num)).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return slices.withColumn("_wraps", F.coalesce(wraps, F.lit(0))).withColumn("poc", (F.col("_wraps") * (1 << bits) + F.col(frame_num)) * 2 - F.when(F.col(is_ref), 0).otherwise(1)).drop("_wraps")


def fenced(results: DataFrame, delay: int, clip: str = "clip_id", seq: str = "seq", is_seek: str = "is_seek") -> DataFrame:
    """Results that survive seeks: each is delivered `delay` steps later, and dropped if the generation moved on."""
    w = _so_far(clip, seq)
    gen = results.withColumn("gen", F.sum(F.col(is_seek).cast("long")).over(w))
    ahead = F.last("gen").over(Window.partitionBy(clip).orderBy(seq).rowsBetween(Window.currentRow, delay))
    return gen.withColumn("gen_on_delivery", ahead).where("gen = gen_on_delivery")


def bound(uses: DataFrame, sets: DataFrame, clip: str, seq: str, set_id: str, columns: Sequence[str]) -> DataFrame:
    """Binds each use to the latest parameter set of its id sent before it; nulls where there is none."""
    key = F.struct(clip, set_id)
    return as_of(uses.withColumn("_k", key), sets.withColumn("_k", key).select("_k", F.col(seq).alias("_s"), *columns), "_k", seq, "_s", columns).drop("_k")


def planned_groups(cuts: DataFrame, gop: int, least: int = 8, clip: str = "clip_id", n: str = "n", cut: str = "cut") -> DataFrame:
    """Adds gop_id: a group closes after `gop` frames, or before a cut if it has at least `least`.

    Where a group closes depends on where it began, so a clip is walked in order, over its narrow rows alone.
    """
    kinds = {f.name: f.dataType.simpleString() for f in cuts.schema.fields}

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(n)
        group, held, out = 0, 0, []
        for is_cut in rows[cut].to_pylist():
            if held >= gop or (is_cut and held >= least):
                group, held = group + 1, 0
            held += 1
            out.append(group)
        return rows.append_column("gop_id", pa.array(out, pa.int64()))

    return cuts.select(clip, n, cut).groupBy(clip).applyInArrow(run, f"`{clip}` {kinds[clip]}, `{n}` {kinds[n]}, `{cut}` {kinds[cut]}, gop_id long")
