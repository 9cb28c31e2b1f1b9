"""Entropy-coded symbols as rows (keys.., ctx, sym): counts, model frequencies, cost."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, UNSEEN_BITS = 4096, 20.0


def histogram(tokens: DataFrame, keys: Sequence[str] = (), ctx: str = "ctx", sym: str = "sym") -> DataFrame:
    """count of each symbol in each context; partial sums are made before the exchange."""
    return tokens.groupBy(*keys, ctx, sym).agg(F.count("*").alias("count"))


def repaired(counts: list[int], scale: int = SCALE) -> list[int]:
    """Counts scaled to a sum of `scale`, none below one; by symbol order, the first of equals counts as the largest."""
    total = sum(counts)
    freq = [max(1, c * scale // total) if c else 0 for c in counts]
    largest = freq.index(max(freq))
    while (over := sum(freq) - scale) > 0:
        most = max(range(len(freq)), key=lambda s: (freq[s] > 1, freq[s], -s))
        second = max((f for s, f in enumerate(freq) if s != most), default=0)
        freq[most] -= max(1, min(over, freq[most] - max(second, 1)))  # as long as it stays the largest
    freq[largest] += scale - sum(freq)
    return freq


def normalised(counts: DataFrame, keys: Sequence[str], sym: str = "sym") -> DataFrame:
    """Adds freq to each present symbol. A group holds one context's alphabet, a few hundred symbols at most."""
    names = [*keys, sym, "count"]
    schema = counts.select(*names).schema

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(sym)
        return rows.append_column("freq", pa.array(repaired(rows["count"].to_pylist()), pa.int64()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return counts.select(*names).groupBy(*keys).applyInArrow(run, f"{kinds}, freq long")


def cost_bits(counts: DataFrame, table: DataFrame, keys: Sequence[str], sym: str = "sym", table_keys: Sequence[str] = ()) -> DataFrame:
    """Bits that the counted symbols cost under a frequency table, summed by `keys`; symbols it lacks cost a fixed amount.

    `table_keys` are the keys that the table has: none for one table for all.
    """
    both = counts.join(table.select(*table_keys, sym, "freq"), [*table_keys, sym], "left")
    bits = F.when(F.coalesce("freq", F.lit(0)) == 0, F.lit(UNSEEN_BITS)).otherwise(F.log2(F.lit(float(SCALE)) / F.col("freq")))
    return both.groupBy(*keys).agg(F.sum("count").alias("tokens"), F.round(F.sum(F.col("count") * bits), 3).alias("bits"))
