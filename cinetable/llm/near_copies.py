"""Near copies by five-word shingles: SimHash candidates over a wide radius, then exact Jaccard similarity.

Texts whose SimHash fingerprints (of two-word shingles, repeats included) differ in `max_bits` bits at most are
candidates, found by the grid range join of `simhash`; texts that chains of candidates connect are a candidate class.
Two texts of one class link if their sets of lower-cased five-word shingles have Jaccard similarity 0.8 or more. Fewer
words than a shingle are one shingle. Nine bits held 0.97 of the pairs of 0.8 or more that a wider
search of fingerprints found; a group of copies needs one chain only. What is lost are pairs that no chain connects.

A class is cut into chunks by rows and by bytes, and each pair of chunks is a task of its own that compares sets
exactly. Rows that are in one tree already aren't compared again, and a task returns a spanning forest, so a large
group of copies costs neither a large task nor all its pairs.

Texts with one set of shingles are one node from the start, whatever their fingerprints: exact copies, and those that
differ in case, blanks or repeats. Null and empty texts have no shingles and are one node. Null ids take part, but name
no component unless it has no other id. Repeated rows and rows with one id are in the classes of their texts. An empty
table gives no rows. A text of any length is whole in one task. Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import slices
from .common import staged
from .components import connected_components
from .simhash import SEED, WIDE_GRIDS, fingerprint_links, majority, shingle_hashes, words_of

SHINGLE, SIMILARITY = 5, 0.8
#: Words of a shingle of the fingerprints, and the bits that two candidates may differ in.
CANDIDATE_SHINGLE, MAX_BITS = 2, 9
#: A chunk of a class holds about so many texts and bytes of hashes at most; one larger text is a chunk.
CHUNK_ROWS, CHUNK_BYTES = 600, 16 << 20


def shingle_set(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the shingles, in order."""
    return np.unique(shingle_hashes(words, shingle))


def signatures(docs: DataFrame, candidate_shingle: int, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """id, fp, node (a 128-bit name of the set of shingles) and size (its bytes) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            fps, nodes, sizes = [], [], []
            for text in batch.column("_text").to_pylist():
                words = words_of(text)
                found = shingle_set(words, shingle)
                fps.append(majority(shingle_hashes(words, candidate_shingle)))
                nodes.append(xxhash.xxh3_128_hexdigest(found.tobytes(), SEED))
                sizes.append(found.nbytes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(nodes, pa.string()), pa.array(sizes, pa.int64())], names=["id", "fp", "node", "size"])

    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, fp long, node string, size long")


def similar_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the links between rows of `left` and rows of `right` (numbers of `sets`, in order; one array if all are compared with each other)."""
    sizes = np.array([len(s) for s in sets])
    _, terms = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    tree, marked = np.arange(len(sets)), np.zeros(len(terms) + 1, np.int64)
    links: list[tuple[int, int]] = []
    for r in left.tolist():
        later = right[right > r] if left is right else right
        others = later[(tree[later] != tree[r]) & (np.minimum(sizes[later], sizes[r]) >= similarity * np.maximum(sizes[later], sizes[r]) - 1e-9)]
        if not len(others):
            continue
        own = terms[starts[r] : starts[r] + sizes[r]]
        marked[own] = 1
        widths = sizes[others]
        ends = np.cumsum(widths)
        at = np.arange(ends[-1]) + np.repeat(starts[others] - ends + widths, widths)
        shared = np.diff(np.concatenate([[0], np.cumsum(marked[terms[at]])])[np.concatenate([[0], ends])])
        marked[own] = 0
        others = others[shared >= similarity * (widths + sizes[r] - shared) - 1e-9]
        if len(others):
            trees, first = np.unique(tree[others], return_index=True)
            links += [(r, int(o)) for o in others[first]]
            tree[np.isin(tree, trees)] = tree[r]
    return links


def compare_tasks(batches: Iterator[pa.RecordBatch], shingle: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Links (a, b: nodes) of rows (class, i, j, own, node, _text) that come sorted by task (class, i, j)."""
    task: tuple[int, int, int] | None = None
    held: dict[str, tuple[int, np.ndarray]] = {}

    def links() -> pa.RecordBatch:
        names, rows = list(held), list(held.values())
        own, sets = np.array([o for o, _ in rows], np.int64), [s for _, s in rows]
        found: list[tuple[int, int]] = []
        if len(rows) > 1 and task is not None:
            every = np.arange(len(rows))
            left, right = (every, every) if task[1] == task[2] else (every[own == task[1]], every[own != task[1]])
            if len(left) and len(right):
                found = similar_links(sets, left, right, similarity)
        return pa.RecordBatch.from_arrays([pa.array([names[a] for a, _ in found], pa.string()), pa.array([names[b] for _, b in found], pa.string())], names=["a", "b"])

    for batch in batches:
        for piece in slices([batch], "_text"):
            for *key, own, node, text in zip(*(piece.column(c).to_pylist() for c in ("class", "i", "j", "own", "node", "_text")), strict=True):
                if tuple(key) != task:
                    if len(held) > 1:
                        yield links()
                    task, held = tuple(key), {}
                if node not in held:
                    held[node] = (own, shingle_set(words_of(text), shingle))
    if len(held) > 1:
        yield links()


def similarity_links(docs: DataFrame, classes: DataFrame, shingle: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b: nodes) whose components are those of all links within candidate classes.

    `classes`: class, node, size and a row's id for each node of a class, without repeats.
    """
    sizes = classes.groupBy("class").agg(F.count("*").alias("nodes"), F.sum("size").alias("bytes")).where("nodes > 1")
    chunks = F.greatest(F.ceil(F.col("nodes") / CHUNK_ROWS), F.ceil(F.col("bytes") / CHUNK_BYTES)).cast("int")
    wanted = staged(classes.join(sizes.select("class", chunks.alias("chunks")), "class").select("class", "node", "id", "chunks"), "candidates")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    task = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j")))
    rows = texts.join(wanted, "id").select("class", "node", "chunks", "_text").withColumn("own", own)
    tasks = rows.select("class", "own", "node", "_text", F.explode(task).alias("t")).select("class", "t.i", "t.j", "own", "node", "_text")
    dealt = tasks.repartition("class", "i", "j").sortWithinPartitions("class", "i", "j")
    return dealt.mapInArrow(lambda batches: compare_tasks(batches, shingle, similarity), "a string, b string")


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE, max_bits: int = MAX_BITS, candidate_shingle: int = CANDIDATE_SHINGLE
) -> DataFrame:
    """id and component_id (the smallest id reachable over links) of every row."""
    # rows get a key of their id and text: rows of one id can have different texts
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash")).alias("key"), F.col(text_col).alias("_text"))
    found = staged(signatures(keyed, candidate_shingle, shingle, "key", "_text"), "near-copy-signatures")
    fps = staged(found.select("fp").distinct(), "near-copy-fingerprints")
    parts = connected_components(fingerprint_links(fps, max_bits, grids=WIDE_GRIDS))
    nodes = staged(found.groupBy("node", "fp").agg(F.min("id").alias("id"), F.min("id.id").alias("least"), F.first("size").alias("size")), "near-copy-nodes")
    placed = nodes.join(parts, nodes["fp"] == parts["node"], "left").select(nodes["node"], F.coalesce(parts["component"], nodes["fp"]).alias("class"), "size", "id")
    classes = staged(placed.groupBy("class", "node").agg(F.first("size").alias("size"), F.min("id").alias("id")), "near-copy-classes")
    linked = staged(connected_components(similarity_links(keyed, classes, shingle, similarity, "key", "_text")), "near-copy-parts")
    grouped = nodes.select("node", "least").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    grouped = staged(grouped.groupBy("node", "component").agg(F.min("least").alias("least")), "near-copy-linked")
    least = staged(grouped.groupBy("component").agg(F.min("least").alias("component_id")), "near-copy-least")
    named = staged(grouped.join(least, "component").select("node", "component_id"), "near-copy-named")
    return found.join(named, "node").select(F.col("id.id").alias(id_col), "component_id")
