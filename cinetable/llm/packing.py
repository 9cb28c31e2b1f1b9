"""Packing token sequences by best-two-fit.

Documents are tokenised where they lie; only a narrow row for each piece travels on. Pieces are dealt by hash into
shards of about `SHARD_PIECES` rows. Within a shard a bin is filled greedily, largest fitting piece first; then its
smallest piece is given back if two unpacked pieces fit the expanded gap more tightly. At most one bin of a shard
stays badly filled, so the loss against a global packing is at most one sequence in SHARD_PIECES pieces.

Null and empty texts hold the end token alone. Texts over `limit` tokens, and only they, are cut into pieces of
`limit`, the first being the shorter one. Repeated rows are packed one by one; a null id is kept. Extra columns are
dropped. An empty table gives an empty result. Shards and bins depend on the rows alone, so a retried task repeats
its answer.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import batch_of, model, slices
from .bpe_trie import PRETOKENS, TrieBpe, byte_of_char
from .common import spread

LIMIT, END_ID = 1024, 2
SHARD_PIECES = 8000


@functools.lru_cache(2)
def merges_to_itself(blob: bytes) -> bool:
    """Whether each vocabulary entry is what merging its own bytes gives. Then looking pre-tokens up in the vocabulary
    before merging, as the fast coder does, changes nothing."""
    bpe = TrieBpe(blob)
    return all(bpe.merged(entry) == [entry] for entry in bpe.id_of)


def byte_level_encoder(blob: bytes, proven: bool) -> Callable[[str], np.ndarray]:
    """ids of a text under a byte-level BPE file of tokenizers, special strings in the text included. Without a proof
    (see `merges_to_itself`), and where the fast coder refuses a text, the named library encodes."""
    import tiktoken
    import tokenizers

    spec = json.loads(blob)
    if (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec.get("normalizer"):
        raise ValueError("only byte-level BPE without normaliser and prefix space is supported")
    stand_in = byte_of_char()
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
    ranks = {bytes(map(stand_in.__getitem__, t)): i for t, i in vocab.items()}
    merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
    if any(b <= a for a, b in zip(merged, merged[1:], strict=False)):
        raise ValueError("ids do not rise with the order of merges")
    lib = tiktoken.Encoding("file", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens=special)
    named = functools.lru_cache(1)(lambda: tokenizers.Tokenizer.from_buffer(blob))

    def encode(text: str) -> np.ndarray:
        if not proven:
            return np.array(named().encode(text, add_special_tokens=False).ids, np.uint32)
        try:
            return lib.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # its pattern can't take runs of about a million blanks; tokenizers has no such bound
            return np.array(named().encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def pieces(docs: DataFrame, vocab_path: str, limit: int = LIMIT, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32 and, if asked for, ids (binary: little-endian 32-bit) of every piece."""
    with open(vocab_path, "rb") as f:
        blob = docs.sparkSession.sparkContext.broadcast(f.read())
    proven = merges_to_itself(blob.value)
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    out = pa.schema([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * keep_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = model(("bpe", len(blob.value), hash(blob.value)), lambda: byte_level_encoder(blob.value, proven))
        for batch in slices(batches, "_text"):
            owner: list[int] = []
            found: list[tuple[Any, ...]] = []
            for row, text in enumerate(batch.column("_text").to_pylist()):
                ids = np.append(encode(text), end_id).astype("<u4")
                first = len(ids) % limit or min(limit, len(ids))
                edges = [0, *range(first, len(ids) + 1, limit)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    data = ids[a:b].tobytes()
                    owner.append(row)
                    found.append((k, a, b - a, zlib.crc32(data), data))
            columns = list(zip(*found, strict=True))[: len(out)]
            yield batch_of(out.insert(0, batch.schema.field(0)), [batch.column(0).take(pa.array(owner)), *columns])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def best_two_fit(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece. Pieces of one length are interchangeable, so the pool is a count for each length."""
    order = np.argsort(lengths, kind="stable")
    count = np.bincount(lengths, minlength=limit + 1)
    taken = np.concatenate([[0], np.cumsum(count)])[: limit + 1]  # next piece of each length, in `order`
    sizes = np.arange(limit + 1)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    below = np.maximum.accumulate(np.where(count > 0, sizes, 0))  # the largest length in the pool up to each size

    def less(size: int, by: int = 1) -> None:
        nonlocal below
        was = count[size] > 0
        count[size] -= by
        if was != (count[size] > 0):
            below = np.maximum.accumulate(np.where(count > 0, sizes, 0))

    left, number = len(lengths), 0
    while left:
        inside: list[int] = []
        gap = limit
        while size := int(below[gap]):
            inside.append(size)
            less(size)
            gap -= size
        if gap and len(inside) > 1:
            room = gap + inside[-1]  # pieces went in by falling size
            firsts = np.flatnonzero(count[: room // 2 + 1])
            partners = below[room - firsts]
            both = firsts + partners
            # a length that stands once in the pool cannot be its own partner
            both[(partners < firsts) | ((partners == firsts) & (count[firsts] < 2))] = 0
            if len(both) and both.max() > inside[-1]:
                at = int(both.argmax())
                less(inside.pop(), -1)
                for size in (int(partners[at]), int(firsts[at])):
                    inside.append(size)
                    less(size)
        at = 0
        for size in inside:
            piece = order[taken[size]]
            taken[size] += 1
            bins[piece], offsets[piece] = number, at
            at += size
        left -= len(inside)
        number += 1
    return bins, offsets


def pack(found: DataFrame, n_rows: int, limit: int = LIMIT, id_col: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to the rows of `pieces`; `n_rows` sets the number of shards."""
    shards = spread(n_rows, SHARD_PIECES)
    columns = [f for f in found.schema.fields]
    shard = F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(shards)).alias("_shard")

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in (id_col, "piece", "start", "ids_crc32", "length")])
        bins, offsets = best_two_fit(rows["length"].to_numpy().astype(np.int64), limit)
        base = rows["_shard"][0].as_py() << 32
        return rows.drop_columns("_shard").append_column("sequence_id", pa.array(base + bins)).append_column("offset", pa.array(offsets))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
    return found.select("*", shard).groupBy("_shard").applyInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocab_path: str, limit: int = LIMIT, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row for each piece of each document, with the sequence it lies in and its place there."""
    return pack(pieces(docs, vocab_path, limit, end_id, id_col, text_col, keep_ids), docs.count(), limit, id_col)
