"""Near copies against all pairs in plain Python."""

from __future__ import annotations

import random
import re
from collections.abc import Callable

import numpy as np
import pytest
import xxhash
from pyspark.sql import SparkSession

from cinetable.llm import components, near_copies, simhash

from .fixtures import documents, texts
from .test_texts import cluster


def shingles(text: str | None, n: int) -> list[str]:
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall("[^ \t\n\x0b\x0c\r]+", low)
    return [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []


def bits(text: str | None) -> int:
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in shingles(text, 2)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def alike(a: frozenset[str], b: frozenset[str]) -> bool:
    return a == b or len(a & b) >= 0.8 * len(a | b)


def reachable(n: int, linked: Callable[[int, int], bool]) -> list[int]:
    """The least row reachable over links, with one pass over all pairs."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_classes(found: list[str | None], max_bits: int = 9) -> list[int]:
    sets, fps = [frozenset(shingles(t, 5)) for t in found], [bits(t) for t in found]
    near = reachable(len(found), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= max_bits)
    return reachable(len(found), lambda i, j: sets[i] == sets[j] or (near[i] == near[j] and alike(sets[i], sets[j])))


def copies(n: int, seed: int) -> list[str]:
    """Edited copies of a few texts, each of the one before it or of the first, and texts of their own."""
    rng = random.Random(seed)
    new = lambda: [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(40, 160))]
    out = []
    for _ in range(5):
        base = last = new()
        for _ in range(n):
            last = list(last if rng.random() < 0.5 else base)
            for _ in range(rng.randint(0, 3)):
                last[rng.randrange(len(last))] = f"w{rng.randint(0, 400)}"
            out.append(" ".join(last))
    return out + [" ".join(new()) for _ in range(n)]


@pytest.mark.parametrize("rows", [600, 3])
def test_classes_of_edited_copies(spark: SparkSession, rows: int, monkeypatch: pytest.MonkeyPatch) -> None:
    monkeypatch.setattr(near_copies, "CHUNK_ROWS", rows)
    found = copies(14, 5)
    frame = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(frame).collect()}
    want = plain_classes(found)
    assert got == dict(enumerate(want)) and 14 < len(set(want)) < 60
    kept = simhash.keep_one_each(frame, near_copies.near_copies)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_odd_texts(spark: SparkSession) -> None:
    found = [*texts(), "ONE  two\nthree", "a b c d e " * 31]  # equal sets of shingles, other fingerprints
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(documents(spark, list(enumerate(found)))).collect()}
    assert got == dict(enumerate(plain_classes(found)))


def test_null_ids_repeats_and_nothing(spark: SparkSession) -> None:
    frame = documents(spark)
    rows = near_copies.near_copies(frame).collect()
    assert len(rows) == frame.count() and len({r.component_id for r in rows if r.doc_id == 3}) == 1
    kept = [r.doc_id for r in simhash.keep_one_each(frame, near_copies.near_copies).collect()]
    assert kept.count(3) == 1 and kept.count(None) == 2  # two unlike texts with null ids
    assert near_copies.near_copies(documents(spark, [])).count() == 0


def test_rows_of_one_id_with_unlike_texts(spark: SparkSession) -> None:
    a, b = "some words that make a text of their own here", "quite another text without any of the same words at all"
    rows = [(1, a), (1, b), (2, a + " x y"), (2, b), (None, a), (None, a)]
    got = sorted(near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=str)
    assert len(got) == 6 and {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 2), (2, 1), (None, 1)}


def test_long_texts(spark: SparkSession) -> None:
    rng = random.Random(3)
    long = [f"w{rng.randint(0, 10**6)}" for _ in range(300_000)]
    near = [w if rng.random() > 0.01 else "other" for w in long]
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(long[:150_000]))]
    got = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 1), (3, 3)]


@pytest.mark.parametrize("cross", [False, True])
def test_forest_spans_all_links(cross: bool) -> None:
    sets = [near_copies.shingle_set(simhash.words_of(t)) for t in copies(12, 8)]
    every = np.arange(len(sets))
    left, right = (every[::3], np.setdiff1d(every, every[::3])) if cross else (every, every)
    pairs = [(a, b) for a in left for b in right if a != b and len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))]
    links = near_copies.similar_links(sets, left, right, 0.8)
    assert {frozenset(x) for x in links} <= {frozenset(map(int, x)) for x in pairs} and len(links) < len(sets)
    tree = {int(i): int(i) for i in every}

    def find(i: int) -> int:
        while tree[i] != i:
            i = tree[i]
        return i

    for a, b in links:
        tree[find(a)] = find(b)
    assert pairs and all(find(int(a)) == find(int(b)) for a, b in pairs)


@pytest.mark.parametrize("grid", simhash.WIDE_GRIDS)
def test_wide_grids_find_every_component(spark: SparkSession, grid: tuple[int, int]) -> None:
    fps = cluster(60, 4)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"), 9, grid).collect()
    part = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links or [(0, 0)], "a long, b long")).collect()}
    near = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 9]
    assert near and all(part[a] == part[b] for a, b in near)
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 9 for a, b in links)
