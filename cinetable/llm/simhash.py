"""SimHash near-duplicates by segment popcounts: a grid range join under Manhattan distance, then an exact check.

A 64-bit fingerprint is embedded as the bit counts of SEGMENTS segments. The Manhattan distance of two embeddings is a
lower bound of the Hamming distance of the fingerprints, so a range join under Manhattan distance `max_bits` loses no
link. The grid of that join is the embedding cut into groups of segments: within distance d, one of p groups differs by
d div p at most. So each distinct fingerprint stands in one home cell of each group's grid and probes the cells within
d div p of it. Which segments and groups are best depends on the number of fingerprints: coarse cells need no probes
but hold more rows. `plan_grid` weighs rows moved against pairs compared; every choice finds every link.

A cell compares its rows in numpy blocks: Manhattan bound first, then exact Hamming distance. It returns a spanning
forest of its links, at most one link a row, never its pairs. A cell with many rows (a large group of near copies) is
cut into chunks, and each pair of chunks is a task of its own; the forests' union still spans every link.

Equal fingerprints collapse before all this. Texts without words have fingerprint zero and are linked like others.
Null texts count as empty. Rows with one doc_id and different texts are linked by the smallest id as any others; null
ids take part, but name no component unless it has no other id. Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise
from math import ceil, comb, prod

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import slices
from .common import BLANKS, staged
from .components import connected_components

SHINGLE, SEED, MAX_BITS = 3, 42, 3
#: (segments of the embedding, groups of them that form grids) to choose from.
GRIDS = [(32, 4), (32, 2), (64, 2)]
#: The same for distances of more than a few bits, where narrow segments tell more apart.
WIDE_GRIDS = [(segments, parts) for segments in (32, 64) for parts in (3, 4, 5, 6)]
#: Rows of a cell that one task compares with each other; a cell with more is cut into chunks of so many.
CHUNK_ROWS = 600
#: Microseconds to move a row through the exchange, and to compare a pair.
ROW_COST, PAIR_COST = 2.0, 0.06
_BLANKS = BLANKS.encode()
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SPLIT = bytes.maketrans(_BLANKS, b" " * len(_BLANKS))


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit b is set if it is set in over half the XXH64 hashes of the shingles, repeats included."""
    return majority(shingle_hashes(words_of(text), shingle, seed))


def words_of(text: str) -> list[bytes]:
    """The lower-cased words."""
    return [w for w in text.encode().translate(_LOWER).translate(_SPLIT).split(b" ") if w]


def shingle_hashes(words: list[bytes], shingle: int, seed: int = SEED) -> np.ndarray:
    """The hashes of the shingles, repeats included; fewer words are one shingle, none have none."""
    if len(words) <= shingle:
        grams = [b" ".join(words)] if words else []
    else:
        grams = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(g, seed) for g in grams], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        counts += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp (the fingerprint as a signed long) of every row."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            found = np.array([fingerprint(t, shingle, seed) for t in batch.column("_text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=[id_col, "fp"])

    return rows.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp long")


# -- the grid -----------------------------------------------------------------------------------------------------


def plan_grid(n: int, max_bits: int, chunk: int = CHUNK_ROWS, grids: list[tuple[int, int]] = GRIDS) -> tuple[int, int]:
    """The cheapest of `grids` for n fingerprints with random bits."""

    def cost(segments: int, parts: int) -> float:
        size, width = 64 // segments, segments / parts
        alike = (comb(2 * size, size) / 4.0**size) ** width  # the chance of two to share a cell
        inside = [sum(comb(size, x) for x in range(size + 1 - c)) / 2.0**size for c in range(size + 1)]  # the chance that a change by c stays in range
        probes = 1 + sum(prod(inside[abs(c)] for _, c in step) for step in _steps(ceil(width), max_bits // parts, size))
        rows = n * parts * probes * max(1.0, n * probes * 0.5 ** (size * width) * comb(size, size // 2) ** width / chunk)
        return ROW_COST * rows + PAIR_COST * n * n / 2 * parts * probes * alike

    return min(grids, key=lambda grid: cost(*grid))


def embed(fps: np.ndarray, segments: int) -> np.ndarray:
    """Bit counts of the segments, one row for each fingerprint."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.reshape(len(fps), segments, -1).sum(axis=2, dtype=np.uint8)


def _cells(group: np.ndarray, part: int, top: int) -> np.ndarray:
    """A 64-bit name of each cell. Two cells with one name only cause vain comparisons."""
    weight = np.array([pow(top + 1, i, 1 << 64) for i in range(group.shape[1])], np.uint64)
    with np.errstate(over="ignore"):
        x = group.astype(np.uint64) @ weight + np.uint64(part) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(31)
        return (x * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def _steps(width: int, reach: int, top: int) -> list[tuple[tuple[int, int], ...]]:
    """All moves of Manhattan length 1..reach over `width` coordinates, none by more than top, as ((coordinate, change), ...)."""
    out: list[tuple[tuple[int, int], ...]] = []

    def grow(at: int, left: int, move: tuple[tuple[int, int], ...]) -> None:
        if move:
            out.append(move)
        for i in range(at, width):
            for change in [c for c in range(-min(left, top), min(left, top) + 1) if c]:
                grow(i + 1, left - abs(change), (*move, (i, change)))

    grow(0, reach, ())
    return out


def grid_rows(distinct: DataFrame, max_bits: int, segments: int, parts: int) -> DataFrame:
    """(cell, fp, home): each fingerprint in its home cells and in the cells within max_bits div parts of them."""
    top, reach = 64 // segments, max_bits // parts
    bounds = [segments * part // parts for part in range(parts + 1)]
    steps = {width: _steps(width, reach, top) for width in {b - a for a, b in pairwise(bounds)}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fps = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False).view(np.uint64)
                places = embed(fps, segments)
                for part in range(parts):
                    group = places[:, bounds[part] : bounds[part + 1]].astype(np.int16)
                    found = [(_cells(group, part, top), fps, True)]
                    for step in steps[group.shape[1]]:
                        near = group.copy()
                        for i, change in step:
                            near[:, i] += change
                        inside = ((near >= 0) & (near <= top)).all(axis=1)
                        found.append((_cells(near[inside], part, top), fps[inside], False))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([c for c, _, _ in found])), pa.array(np.concatenate([f for _, f, _ in found]).view(np.int64)), pa.array(np.concatenate([np.full(len(c), h) for c, _, h in found]))],
                        names=["cell", "fp", "home"],
                    )

    return distinct.select("fp").mapInArrow(run, "cell long, fp long, home boolean")


# -- comparing ----------------------------------------------------------------------------------------------------


class Forest:
    """Union-find that remembers the links that joined two trees."""

    def __init__(self, n: int) -> None:
        self.root = list(range(n))
        self.links: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.root[max(a, b)] = min(a, b)
            self.links.append((i, j))


def compare(left: np.ndarray, right: np.ndarray, max_bits: int, segments: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between `left` and `right`, as fingerprints."""
    both = np.unique(np.concatenate([left, right]))
    at_left, at_right = np.searchsorted(both, left), np.searchsorted(both, right)
    forest = Forest(len(both))
    places = embed(both, segments).astype(np.int8)
    sums = places.sum(axis=1, dtype=np.int16)
    at_right = at_right[np.argsort(sums[at_right], kind="stable")]
    right_sums = sums[at_right]
    for i in at_left.tolist():
        # the sum of the coordinates is a first bound, by sorting; then all coordinates; then the bits
        a, b = np.searchsorted(right_sums, (sums[i] - max_bits, sums[i] + max_bits + 1))
        near = at_right[a:b]
        if not len(near):
            continue
        near = near[np.abs(places[near] - places[i]).sum(axis=1, dtype=np.int16) <= max_bits]
        near = near[np.bitwise_count(both[near] ^ both[i]) <= max_bits]
        for j in near.tolist() if len(near) > 1 or (len(near) and near[0] != i) else ():
            forest.join(i, j)
    return [(int(both[i]), int(both[j])) for i, j in forest.links]


def compare_small(ends: np.ndarray, fps: np.ndarray, home: np.ndarray, own: np.ndarray, apart: np.ndarray, max_bits: int, segments: int) -> list[tuple[int, int]]:
    """The same for many small tasks at once. ends: where each task's rows end; apart: tasks that compare two chunks."""
    sizes = np.diff(ends, prepend=0)
    task = np.repeat(np.arange(len(sizes)), sizes)
    rows = np.flatnonzero(home)
    width = sizes[task[rows]]
    left = np.repeat(rows, width)
    right = np.arange(len(left)) - np.repeat(np.cumsum(width) - width, width) + np.repeat((ends - sizes)[task[rows]], width)
    keep = ((left < right) | (home[right] == False)) & ((own[left] != own[right]) | ~apart[task[left]])  # noqa: E712
    left, right = left[keep], right[keep]
    places = embed(fps, segments).astype(np.int8)
    links: set[tuple[int, int]] = set()
    for at in range(0, len(left), 100_000):
        a, b = left[at : at + 100_000], right[at : at + 100_000]
        near = np.abs(places[a] - places[b]).sum(axis=1, dtype=np.int16) <= max_bits
        a, b = fps[a[near]], fps[b[near]]
        near = (np.bitwise_count(a ^ b) <= max_bits) & (a != b)
        links.update(zip(a[near].tolist(), b[near].tolist(), strict=True))
    number = {fp: k for k, fp in enumerate(sorted({x for pair in links for x in pair}))}
    names, forest = list(number), Forest(len(number))
    for x, y in sorted(links):
        forest.join(number[x], number[y])
    return [(names[i], names[j]) for i, j in forest.links]


#: Tasks of at most so many rows are compared many at a time.
SMALL_ROWS, BLOCK_ROWS = 32, 40_000


def compare_sorted(batches: Iterator[pa.RecordBatch], max_bits: int, segments: int) -> Iterator[pa.RecordBatch]:
    """Links of rows that come sorted by task (cell, i, j)."""
    names = ("cell", "i", "j", "home", "own", "fp")
    held: list[np.ndarray] = []

    def links(rows: list[np.ndarray]) -> pa.RecordBatch:
        cell, i, j, home, own, fp = rows
        fps = fp.view(np.uint64)
        ends = np.append(np.flatnonzero((cell[1:] != cell[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1, len(cell))
        sizes = np.diff(ends, prepend=0)
        found: list[tuple[int, int]] = []
        for end, size in zip(ends[sizes > SMALL_ROWS].tolist(), sizes[sizes > SMALL_ROWS].tolist(), strict=True):
            at = slice(end - size, end)
            f, h, o = fps[at], home[at], own[at]
            if i[end - 1] == j[end - 1]:
                found += compare(f[h], f, max_bits, segments)
            else:
                a = o == i[end - 1]
                found += compare(f[a & h], f[~a], max_bits, segments) + compare(f[~a & h], f[a & ~h], max_bits, segments)
        few = np.repeat(sizes <= SMALL_ROWS, sizes)
        if few.any():
            kept = ends[sizes <= SMALL_ROWS] - 1
            found += compare_small(np.cumsum(sizes[sizes <= SMALL_ROWS]), fps[few], home[few], own[few], i[kept] != j[kept], max_bits, segments)
        out = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])

    for batch in batches:
        got = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        held = [np.concatenate(x) for x in zip(held, got, strict=True)] if held else got
        if len(held[0]) >= BLOCK_ROWS:
            last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]) | (held[2] != held[2][-1]))
            if len(last):  # the last task may go on in the next batch
                cut = int(last[-1]) + 1
                yield links([x[:cut] for x in held])
                held = [x[cut:] for x in held]
    if held and len(held[0]):
        yield links(held)


def fingerprint_links(distinct: DataFrame, max_bits: int = MAX_BITS, grid: tuple[int, int] | None = None, chunk: int = CHUNK_ROWS, grids: list[tuple[int, int]] = GRIDS) -> DataFrame:
    """Links (a, b as signed longs) whose components are those of all links within `max_bits`.

    `distinct`: column fp, without repeats. Cells where nobody is at home or that hold one row are dropped at once.
    """
    segments, parts = grid or plan_grid(distinct.count(), max_bits, chunk, grids)
    rows = grid_rows(distinct, max_bits, segments, parts)
    sizes = rows.groupBy("cell").agg(F.sum(F.col("home").cast("long")).alias("homes"), F.count("*").alias("rows")).where("homes > 0 and rows > 1")
    sizes = staged(sizes.select("cell", F.ceil(F.col("rows") / chunk).cast("int").alias("chunks")), "cells")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    task = F.transform(every, lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j")))
    tasks = rows.join(sizes, "cell").withColumn("own", own).select("cell", "fp", "home", "own", F.explode(task).alias("t")).select("cell", "t.i", "t.j", "home", "own", "fp")
    dealt = tasks.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "fp")
    return dealt.mapInArrow(lambda batches: compare_sorted(batches, max_bits, segments), "a long, b long")


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp and component_id (the smallest id reachable over links) of every row."""
    found = staged(fingerprints(docs, shingle, seed, id_col, text_col), "fingerprints")
    ids = staged(found.groupBy("fp").agg(F.min(id_col).alias("least")), "fingerprint-ids")
    parts = staged(connected_components(fingerprint_links(ids.select("fp"), max_bits)).withColumnRenamed("node", "fp"), "fingerprint-parts")
    linked = staged(ids.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "fingerprint-linked")
    least = staged(linked.groupBy("component").agg(F.min("least").alias("component_id")), "component-ids")
    named = staged(linked.join(least, "component").select("fp", "component_id"), "component-named")
    return found.join(named, "fp").select(id_col, "fp", "component_id")


def keep_one_each(docs: DataFrame, classes: Callable[[DataFrame, str, str], DataFrame] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: that of the smallest id.

    `classes` gives id and component_id of every row of a table with the named columns of ids and texts; unless given,
    `near_duplicates` does. Of several rows with the smallest id one stays, that of the least text hash; equal ones are one row.
    """
    least = -(1 << 63)
    key = [F.coalesce(F.col(id_col).cast("long"), F.lit(least)).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_hash")]
    named = docs.select(*key, F.col(text_col).alias("_text")).select(F.struct("_id", "_hash").alias("_who"), "_text")
    found = classes(named, "_who", "_text") if classes else near_duplicates(named, id_col="_who", text_col="_text")
    found = staged(found, "near-duplicates")
    stay = found.where("_who = component_id").groupBy("_who").agg(F.count("*").alias("_copies"))
    stay = staged(stay.select(F.col("_who._id").alias("_id"), F.col("_who._hash").alias("_hash"), "_copies"), "near-duplicates-kept")
    rows = docs.select(*key, F.struct("*").alias("_keep")).join(stay, ["_id", "_hash"])
    if stay.where("_copies > 1").isEmpty():
        return rows.select("_keep.*")
    twins = rows.where("_copies > 1").groupBy("_id", "_hash").agg(F.first("_keep").alias("_keep"))
    return rows.where("_copies = 1").select("_keep.*").unionAll(twins.select("_keep.*"))
