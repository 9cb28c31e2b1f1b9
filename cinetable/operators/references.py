"""Reference pictures as data: lists, marking, promotion.

Marking is a fold over a group's pictures in decode order; its state is the few pictures that are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import fold


def initial_lists(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Places of reference candidates in the initial lists of a picture.

    `candidates`: keys, cur_poc, is_b, pic_num, poc, long_term (null or number). P pictures: short-term by falling
    picture number, then long-term by number. B pictures: list 0 has past pictures, nearest first, then future ones;
    list 1 the reverse; long-term ones follow. Where both lists of more than one entry are equal, the first two of
    list 1 are swapped.
    """
    term = F.col("long_term").isNotNull()
    past = F.col("poc") < F.col("cur_poc")
    gap = F.abs(F.col("poc") - F.col("cur_poc"))
    place = lambda *order: F.row_number().over(Window.partitionBy(*keys).orderBy(term.cast("int"), *order, "pic_num")) - 1
    p = place(F.when(~term, -F.col("pic_num")), "long_term")
    b0 = place(F.when(~term, F.when(past, 0).otherwise(1)), F.when(~term, gap), "long_term")
    b1 = place(F.when(~term, F.when(past, 1).otherwise(0)), F.when(~term, gap), "long_term")
    out = candidates.withColumn("l0", F.when(F.col("is_b"), b0).otherwise(p)).withColumn("_l1", F.when(F.col("is_b"), b1))
    whole = Window.partitionBy(*keys)
    same = (F.max((F.col("l0") != F.col("_l1")).cast("int")).over(whole) == 0) & (F.count("*").over(whole) > 1)
    return out.withColumn("l1", F.when(same & (F.col("_l1") < 2), F.lit(1) - F.col("_l1")).otherwise(F.col("_l1"))).drop("_l1")


def modified(lst: Column, ops: Column) -> Column:
    """A reference list after moves to its front places: op k puts the picture it names at place k.

    `ops` is an array of picture numbers. The list keeps its length; the moved picture leaves its old place.
    """

    def move(acc: Column, op: Column) -> Column:
        k, now = acc["k"], acc["l"]
        head, tail = F.slice(now, F.lit(1), k), F.filter(F.slice(now, k + 1, F.size(now)), lambda x: x != op)
        return F.struct((k + 1).alias("k"), F.slice(F.concat(head, F.array(op), tail), F.lit(1), F.size(now)).alias("l"))

    return F.aggregate(ops, F.struct(F.lit(0).alias("k"), lst.alias("l")), move, lambda acc: acc["l"])


def sliding_window(pictures: DataFrame, most: int, clip: str = "clip_id", gop: str = "gop_id", seq: str = "seq", is_ref: str = "is_ref", drops: str | None = None) -> DataFrame:
    """Adds kept: the reference pictures (their seq) after each picture.

    A reference picture first removes what `drops` names (an array of seq), then enters; beyond `most` the oldest leaves.
    """
    if drops is None:
        pictures, drops = pictures.withColumn("_drops", F.array().cast("array<bigint>")), "_drops"

    def step(kept: list[int], picture: int, refers: bool, gone: list[int] | None) -> tuple[list[int], tuple]:
        if refers:
            kept = [*(k for k in kept if k not in (gone or ())), picture][-most:]
        return kept, (kept,)

    rows = pictures.withColumn("_picture", F.col(seq).cast("long"))
    return fold(rows, [clip, gop], seq, ["_picture", is_ref, drops], list, step, "kept array<bigint>")


def adaptive_marking(pictures: DataFrame, most: int, clip: str = "clip_id", gop: str = "gop_id", seq: str = "seq", is_ref: str = "is_ref", frame_num: str = "frame_num", ops: str = "ops", bits: int = 16) -> DataFrame:
    """Adds short and long after each picture: the seq of short-term references, oldest first, and those of long-term
    ones by their index, null where one is free.

    `ops`: an array of (op, arg, index) by the standard's numbers, or null for the sliding window: 1 drops the
    short-term picture whose number is `arg` + 1 less than the current one; 2 drops the long-term one at `arg`; 3 makes
    the short-term picture `arg` + 1 less long-term at `index`; 4 allows `arg` long-term indices; 5 drops all; 6 makes
    the current picture long-term at `index`. Numbers wrap at 2 to the `bits`.
    """
    wrap = 1 << bits

    def step(state: tuple[list, dict], picture: int, number: int, refers: bool, todo: list | None) -> tuple[tuple[list, dict], tuple]:
        short, long = list(state[0]), dict(state[1])
        if refers:
            own: int | None = None
            for op in todo or ():
                wanted = (number - (op["arg"] or 0) - 1) % wrap
                if op["op"] == 1:
                    short = [s for s in short if s[1] != wanted]
                elif op["op"] == 2:
                    long.pop(op["arg"], None)
                elif op["op"] == 3:
                    for s in [s for s in short if s[1] == wanted]:
                        short.remove(s)
                        long[op["index"]] = s[0]
                elif op["op"] == 4:
                    long = {k: v for k, v in long.items() if k < op["arg"]}
                elif op["op"] == 5:
                    short, long = [], {}
                elif op["op"] == 6:
                    own = op["index"]
            if own is not None:
                long[own] = picture
            else:
                if not todo and len(short) + len(long) >= most and short:
                    short.pop(0)
                short.append((picture, number))
        spread = [long.get(k) for k in range(max(long) + 1)] if long else []
        return (short, long), ([s for s, _ in short], spread)

    rows = pictures.withColumn("_picture", F.col(seq).cast("long"))
    return fold(rows, [clip, gop], seq, ["_picture", frame_num, is_ref, ops], lambda: ([], {}), step, "short array<bigint>, long array<bigint>")


def buffers(frames: DataFrame, clip: str = "clip_id", seq: str = "seq", key: str = "is_key", raw: str = "is_raw") -> DataFrame:
    """Adds last_ref and golden_ref of each frame of the indexed container: the latest coded frame before it, and the
    key frame of its group. Raw frames refresh neither. A key frame refers to nothing."""
    before = Window.partitionBy(clip).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    coded = F.last(F.when(~F.col(raw), F.col(seq)), ignorenulls=True).over(before)
    golden = F.last(F.when(F.col(key) & ~F.col(raw), F.col(seq)), ignorenulls=True).over(before)
    return frames.withColumn("last_ref", F.when(~F.col(key), coded)).withColumn("golden_ref", F.when(~F.col(key), golden))


def vp8_buffers(frames: DataFrame, clip: str = "clip_id", seq: str = "seq") -> DataFrame:
    """Adds last, golden and altref after each frame, from key, refresh_last, copy_golden and copy_altref.

    A copy code (0 none, 1 from last, 2 from the other) reads the buffers as they were; alternate first, and golden
    then sees it; 3 stands for a refresh from the frame itself. A fold over a group of pictures.
    """
    def step(state: tuple, frame: int, key: bool, refresh: bool, to_golden: int, to_alt: int) -> tuple[tuple, tuple]:
        last, golden, alt = state
        if key:
            state = (frame, frame, frame)
        else:
            alt = (alt, last, golden, frame)[to_alt]
            # a copy to golden sees the alternate as just copied, but not as refreshed
            seen = state[2] if to_alt == 3 else alt
            golden = (golden, last, seen, frame)[to_golden]
            state = (frame if refresh else last, golden, alt)
        return state, state

    rows = frames.withColumn("_frame", F.col(seq).cast("long"))
    codes = [F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c) for c in ("copy_golden", "copy_altref")]
    rows = rows.select(clip, "gop_id", seq, "_frame", "is_key", "refresh_last", *codes)
    return fold(rows, [clip, "gop_id"], seq, ["_frame", "is_key", "refresh_last", "copy_golden", "copy_altref"], lambda: (None, None, None), step, "last long, golden long, altref long")


def slot_pool(frames: DataFrame, slots: int = 8, clip: str = "clip_id", seq: str = "seq", flags: str = "refresh_flags") -> DataFrame:
    """Adds slot_0 and so on: the frame that each slot holds after each frame. Bit k of `flags` writes the frame to
    slot k; a slot that nothing has written yet is null."""
    so_far = Window.partitionBy(clip).orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    written = lambda k: F.when(F.shiftright(F.col(flags).cast("int"), k).bitwiseAND(F.lit(1)) == 1, F.col(seq))
    return frames.withColumns({f"slot_{k}": F.last(written(k), ignorenulls=True).over(so_far) for k in range(slots)})
