"""Dropping lines that many documents share, through a sharded minimal perfect hash.

1. Each document emits its distinct line keys as 128-bit hashes, once each.
2. The hashes are grouped (with partial sums, so a very common line is no hot key) and dealt into shards by their
   first bits. Each shard builds a minimal perfect hash over its distinct hashes: a few bits a line that map every
   hash to a slot of its own, with arrays of a 32-bit fingerprint, the number of documents and the last document.
3. Probes (document, hash) travel to their shard and read the arrays; lines are never joined to lines. Shards with
   many probes are replicated over salts of the document, in proportion to the probes counted in step 2.
4. The few hashes to drop return to their documents, whose lines are filtered.

A key is a line without blanks at both ends and with A-Z lower-cased. Null and empty texts are one empty line. Rows
that repeat a doc_id count as one document; a null doc_id counts as a document of its own, the smallest one, and all
rows with it as one. Extra columns are dropped. Without rows there is no shard and no result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import batch_of, slices
from .common import BLANKS, spread, staged

MIN_CHARS, MIN_DOCS = 20, 3
SHARD_LINES = 16_000
#: Probes of one task; a shard with more is replicated.
SHARD_PROBES = 32_000
#: Slots a key in the first levels of the hash, and bits of a fingerprint.
GAMMA, LEVELS = 1.5, 48
#: Salted shards that are broadcast at most; their number is at most probes / SHARD_PROBES.
BROADCAST_ROWS = 200_000
#: Parts over which the rows without an id are dealt.
NULL_SALTS = 64
_BLANKS = BLANKS.encode()


# -- the minimal perfect hash -------------------------------------------------------------------------------------


def _slots(hi: np.ndarray, lo: np.ndarray, level: int, width: int) -> np.ndarray:
    """The slot of each hash at a level: a multiply-mix of both halves, scaled to `width`."""
    with np.errstate(over="ignore"):
        x = lo + hi * np.uint64(2 * level + 1)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return ((x >> np.uint64(32)) * np.uint64(width) >> np.uint64(32)).astype(np.int64)


class PerfectHash:
    """Cascade of bit arrays: a key sits in the first level where no other key shares its slot.

    The rank of that bit among all set bits is the key's index, so n keys have the indices 0..n-1. Keys that collide
    in every level (none in practice) are kept in a list after the others.
    """

    def __init__(self, levels: list[np.ndarray], rest: list[tuple[int, int]]) -> None:
        self.levels, self.rest = levels, rest
        self.before = [np.concatenate([[0], np.cumsum(bits)]) for bits in levels]
        self.base = np.concatenate([[0], np.cumsum([b[-1] for b in self.before])]).astype(np.int64)

    @classmethod
    def build(cls, hi: np.ndarray, lo: np.ndarray) -> PerfectHash:
        levels = []
        for level in range(LEVELS):
            if not len(lo):
                break
            width = max(8, int(GAMMA * len(lo)))
            at = _slots(hi, lo, level, width)
            alone = np.bincount(at, minlength=width) == 1
            levels.append(alone)
            hi, lo = hi[~alone[at]], lo[~alone[at]]
        return cls(levels, list(zip(hi.tolist(), lo.tolist(), strict=True)))

    def index(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The index of each key; of a key that isn't in the set any index, or -1."""
        out = np.full(len(lo), -1, np.int64)
        open_ = np.arange(len(lo))
        for level, bits in enumerate(self.levels):
            at = _slots(hi[open_], lo[open_], level, len(bits))
            hit = bits[at]
            out[open_[hit]] = self.base[level] + self.before[level][at[hit]]
            open_ = open_[~hit]
        if self.rest:
            place = {key: self.base[-1] + k for k, key in enumerate(self.rest)}
            for i in open_.tolist():
                out[i] = place.get((int(hi[i]), int(lo[i])), -1)
        return out

    def to_bytes(self) -> bytes:
        parts = [struct.pack("<I", len(self.levels))]
        for bits in self.levels:
            parts += [struct.pack("<I", len(bits)), np.packbits(bits).tobytes()]
        return b"".join([*parts, np.array(self.rest, np.uint64).tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        (n,), at, levels = struct.unpack_from("<I", data), 4, []
        for _ in range(n):
            (width,) = struct.unpack_from("<I", data, at)
            size = -(-width // 8)
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, size, at + 4), count=width).astype(bool))
            at += 4 + size
        return cls(levels, list(map(tuple, np.frombuffer(data, np.uint64, offset=at).reshape(-1, 2).tolist())))


# -- lines of a text ----------------------------------------------------------------------------------------------


def keyed_lines(text: str, min_chars: int = MIN_CHARS) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a text, and the 128-bit hash of each key of at least `min_chars` code points, else None."""
    lines = text.encode().split(b"\n")
    hashes: list[bytes | None] = []
    for line in lines:
        key = line.strip(_BLANKS).lower()  # of bytes: A-Z alone
        long = len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars)
        hashes.append(xxhash.xxh3_128_digest(key) if long else None)
    return lines, hashes


def _halves(digests: list[bytes]) -> list[pa.Array]:
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return [pa.array(both[:, 0]), pa.array(both[:, 1])]


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(_doc, hi, lo) of each distinct key of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            owner: list[int] = []
            found: list[bytes] = []
            for row, text in enumerate(batch.column("_text").to_pylist()):
                own = {h for h in keyed_lines(text, min_chars)[1] if h}
                owner += [row] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *_halves(found)], names=["_doc", "hi", "lo"])

    return docs.select("_doc", "_text").mapInArrow(run, "_doc long, hi long, lo long")


# -- shards -------------------------------------------------------------------------------------------------------


def _shard(n_shards: int) -> Column:
    return F.pmod(F.shiftright("hi", 20), F.lit(n_shards))


def build_shards(hashes: DataFrame, n_shards: int) -> DataFrame:
    """One row for each shard: its perfect hash, the fingerprint, count and last-document arrays, and its probes."""

    def build(rows: pa.Table) -> pa.Table:
        hi, lo = (rows[c].to_numpy().view(np.uint64) for c in ("hi", "lo"))
        perfect = PerfectHash.build(hi, lo)
        at = perfect.index(hi, lo)
        marks, counts, last = np.empty(len(at), np.uint32), np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        marks[at], counts[at], last[at] = (lo >> np.uint64(32)).astype(np.uint32), rows["n"].to_numpy(), rows["last"].to_numpy()
        columns = [rows["_shard"][:1].combine_chunks(), [perfect.to_bytes()], [marks.tobytes()], [np.minimum(counts, 255).astype(np.uint8).tobytes()], [last.tobytes()], [int(counts.sum())]]
        return pa.table(dict(zip(("_shard", "perfect", "marks", "counts", "last", "probes"), columns, strict=True)))

    return hashes.withColumn("_shard", _shard(n_shards)).groupBy("_shard").applyInArrow(build, "_shard long, perfect binary, marks binary, counts binary, last binary, probes long")


def _probe(arrays: pa.Table, probes: pa.Table, min_docs: int) -> Iterator[pa.Table]:
    if not len(probes):
        return
    perfect = PerfectHash.from_bytes(arrays["perfect"][0].as_py())
    marks, counts, last = (np.frombuffer(arrays[c][0].as_py(), t) for c, t in (("marks", np.uint32), ("counts", np.uint8), ("last", np.int64)))
    doc, hi, lo = (probes[c].to_numpy() for c in ("_doc", "hi", "lo"))
    uhi, ulo = hi.view(np.uint64), lo.view(np.uint64)
    at = perfect.index(uhi, ulo)
    drop = (at >= 0) & (marks[at] == (ulo >> np.uint64(32)).astype(np.uint32)) & (counts[at] >= min_docs) & (last[at] != doc)
    yield pa.table({"_doc": doc[drop], "hi": hi[drop], "lo": lo[drop]})


def shared_lines(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(_doc, hi, lo): keys of at least `min_docs` documents, in each document but the last that holds them."""
    if not 1 <= min_docs <= 255:
        raise ValueError("min_docs must lie within 1 and 255")
    probes = staged(line_hashes(docs, min_chars), "line-probes")
    counted = probes.distinct().groupBy("hi", "lo").agg(F.count("*").alias("n"), F.max("_doc").alias("last"))
    n_shards = spread(probes.count(), SHARD_LINES)
    shards = staged(build_shards(counted, n_shards), "line-shards")
    copies = F.greatest(F.lit(1), F.ceil(F.col("probes") / SHARD_PROBES)).cast("int")
    hot = shards.select("_shard", copies.alias("_copies")).where("_copies > 1")
    if hot.count() <= BROADCAST_ROWS:
        hot = F.broadcast(hot)
    salt = F.pmod(F.xxhash64("_doc"), F.coalesce("_copies", F.lit(1))).cast("int")
    dealt = probes.withColumn("_shard", _shard(n_shards)).join(hot, "_shard", "left").select("_doc", "hi", "lo", "_shard", salt.alias("_salt"))
    spread_out = shards.withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1)))

    def probe(arrays: pa.Table, own: pa.Table) -> pa.Table:
        found = list(_probe(arrays, own, min_docs))
        return pa.concat_tables(found) if found else pa.table({c: pa.array([], pa.int64()) for c in ("_doc", "hi", "lo")})

    return spread_out.groupBy("_shard", "_salt").cogroup(dealt.groupBy("_shard", "_salt")).applyInArrow(probe, "_doc long, hi long, lo long")


def _deduped(docs: DataFrame, min_chars: int, min_docs: int, id_col: str, text_col: str, keep: Sequence[str]) -> DataFrame:
    """_keep (a struct of the columns `keep`), text (the kept lines), n_lines (before dropping) and n_dropped."""
    least = -(1 << 63)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(least)).alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.struct(*keep).alias("_keep"))
    drops = shared_lines(rows, min_chars, min_docs).groupBy("_doc").agg(F.collect_set(F.struct("hi", "lo")).alias("_drops"))
    out = pa.schema([("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            texts, totals, dropped = [], [], []
            for text, drop in zip(batch.column("_text").to_pylist(), batch.column("_drops").to_pylist(), strict=True):
                if not drop:
                    texts.append(text)
                    totals.append(text.count("\n") + 1)
                    dropped.append(0)
                    continue
                gone = {struct.pack("<qq", d["hi"], d["lo"]) for d in drop}
                lines, hashes = keyed_lines(text, min_chars)
                kept = [x for x, h in zip(lines, hashes, strict=True) if h not in gone]
                texts.append(b"\n".join(kept).decode())
                totals.append(len(lines))
                dropped.append(len(lines) - len(kept))
            yield batch_of(out.insert(0, batch.schema.field("_keep")), [batch.column("_keep"), texts, totals, dropped])

    kind = rows.schema["_keep"].dataType.simpleString()
    # A null id is the smallest document. Its rows, however many, share one entry of `drops`: they are dealt over salts.
    salt = F.when(F.col("_doc") == least, F.pmod(F.xxhash64("_text"), F.lit(NULL_SALTS))).otherwise(0).cast("int")
    rows = rows.withColumn("_salt", salt)
    every = F.when(F.col("_doc") == least, F.sequence(F.lit(0), F.lit(NULL_SALTS - 1))).otherwise(F.array(F.lit(0)))
    drops = drops.withColumn("_salt", F.explode(every))
    return rows.join(drops, ["_doc", "_salt"], "left").select("_keep", "_text", "_drops").mapInArrow(run, f"_keep {kind}, text string, n_lines long, n_dropped long")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text (the kept lines), n_lines (before dropping) and n_dropped of every row. The id must be integral."""
    return _deduped(docs, min_chars, min_docs, id_col, text_col, [id_col]).select("_keep.*", "text", "n_lines", "n_dropped")


def drop_shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of `docs`, the text without the shared lines."""
    rest = [c for c in docs.columns if c != text_col]
    done = _deduped(docs, min_chars, min_docs, id_col, text_col, rest)
    return done.select(*[F.col("text").alias(c) if c == text_col else F.col("_keep")[c].alias(c) for c in docs.columns])
