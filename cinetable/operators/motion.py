"""Motion vectors predicted from neighbours in space and from co-located blocks in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def temporal_direct(mv: Column, current: Column, first: Column, second: Column, long_term: Column) -> tuple[Column, Column]:
    """A component of both vectors of a direct block, from that of the co-located one and three picture order counts.

    The vector is scaled by the ratio of distances in 256ths. A long-term first reference, or no distance, takes it as
    it is, and the second vector is zero.
    """
    near = lambda v: F.least(F.greatest(v, F.lit(-128)), F.lit(127))
    part, whole = near(current - first), near(second - first)
    towards_zero = lambda a, b: F.call_function("div", a, b)
    inverse = towards_zero(F.lit(16384) + F.abs(towards_zero(whole, F.lit(2))), whole)
    scale = F.least(F.greatest(F.shiftright(part * inverse + 32, 6), F.lit(-1024)), F.lit(1023))
    scaled = F.when(~long_term & (whole != 0), F.shiftright(scale * mv + 128, 8))
    return F.coalesce(scaled, mv), F.coalesce(scaled - mv, F.lit(0))


def predicted(blocks: DataFrame, columns: int, clip: Sequence[str] | str = "clip_id", y: str = "y", x: str = "x", mv: str = "mv", ref: str = "ref") -> DataFrame:
    """Adds pred: the motion that the neighbours of a block predict (a grid of `columns` blocks a row, one row a block).

    Neighbours are the block left, the one above, and the one above right or, outside the grid, above left. A block
    with a null `ref` is there but predicts zero. If only the left one is there, it predicts; if one alone has the
    block's reference, that one; else the median. One window over the grid in raster order reaches all of them.
    """
    keys = [clip] if isinstance(clip, str) else list(clip)
    place = F.col(y) * columns + F.col(x)
    rows = blocks.withColumn("_at", place)
    w = Window.partitionBy(*keys).orderBy("_at")
    told = F.struct(F.col("_at").alias("at"), F.when(F.col(ref).isNotNull(), F.col(mv)).otherwise(0).alias("mv"), F.col(ref).alias("ref"))
    # the grid may have gaps, so a neighbour is looked for among the rows within its distance
    before = F.collect_list(told).over(w.rangeBetween(-columns - 1, -1))
    rows = rows.withColumn("_before", before)

    def at(distance: int, inside: Column) -> Column:
        return F.when(inside, F.get(F.filter("_before", lambda b: b["at"] == F.col("_at") - distance), 0))

    left, above = at(1, F.col(x) > 0), at(columns, F.lit(True))
    right = F.coalesce(at(columns - 1, F.col(x) < columns - 1), at(columns + 1, F.col(x) > 0))
    rows = rows.select("*", left.alias("_a"), above.alias("_b"), right.alias("_c"))
    a, b, c = (F.coalesce(F.col(n)["mv"], F.lit(0)) for n in ("_a", "_b", "_c"))
    same = [F.coalesce(F.col(n)["ref"] == F.col(ref), F.lit(False)) for n in ("_a", "_b", "_c")]
    alone = sum((s.cast("int") for s in same), F.lit(0)) == 1
    median = a + b + c - F.least(a, b, c) - F.greatest(a, b, c)
    pred = F.when(F.col("_b").isNull() & F.col("_c").isNull() & F.col("_a").isNotNull(), a).when(alone & same[0], a).when(alone & same[1], b).when(alone, c).otherwise(median)
    return rows.withColumn("pred", pred).drop("_at", "_before", "_a", "_b", "_c")
