"""Document fingerprints by consistent weighted sampling (Ioffe, ICDM 2010).

The weight of a term is its count in the text; terms are maximal runs of non-blank characters. For each of SAMPLES
hashes every (term, hash) has r, c ~ Gamma(2, 1) and b ~ U(0, 1), derived from the term's hash alone. With
t = floor(ln w / r + b), the term of the least ln a = ln c - r (t - b + 1) is sampled together with t. Two texts have
the same sample with a chance that equals their generalised Jaccard similarity, sum of minima over sum of maxima.

Terms are never made into strings: their hashes come from running sums over the bytes of many texts, are counted by
sorting, and scores of (term, weight) pairs met before are kept in a table of bounded size.

A sample is kept as 16 bits, so a chance match adds 2^-16. Null and empty texts, and texts of blanks, have no terms:
their fingerprint is the empty string, whose likeness is 1 to another empty one and 0 to all others. Equal texts have
equal fingerprints. Of terms with equal scores the one of the least hash is sampled. Texts of any length are signed
whole: their words are hashed block by block, and their terms scored by parts. Repeated rows get a result each; an
empty table gives an empty one. Extra columns are dropped.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import batch_of, model, slices
from .common import BLANKS, spread

SAMPLES = 128
#: Rows of SAMPLES floats that a worker keeps for pairs of term and weight met before.
CACHED_TERMS = 250_000
#: Bytes of text that are hashed and counted at once; a single longer text is taken by itself.
GROUP_BYTES = 1 << 18
#: Bytes of text of a range that is read in order; ranges for each core at least; ranges at most (above 3 TB they get longer: a
#: job can't have many more tasks, and a range is read as a stream).
RANGE_BYTES, RANGES_A_CORE, MOST_RANGES = 16 << 20, 1, 200_000
_WEIGHT, _LENGTH = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


def _mix(x: np.ndarray, spare: np.ndarray | None = None) -> np.ndarray:
    """SplitMix64's finaliser, in place."""
    spare = np.empty_like(x) if spare is None else spare
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= np.right_shift(x, np.uint64(shift), out=spare)
        x *= np.uint64(factor)
    x ^= np.right_shift(x, np.uint64(31), out=spare)
    return x


# -- terms --------------------------------------------------------------------------------------------------------

_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS.encode())] = True
#: A number for each byte; a word's hash is the sum of its bytes' numbers times powers of BASE by place, mod 2^64.
_OF_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = 0x2545F4914F6CDD1D


class WordHasher:
    """64-bit hashes of the words of a text, by running sums over its bytes."""

    def __init__(self) -> None:
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, GROUP_BYTES + 1)
            ones = np.ones(n, np.uint64)
            ones[1:] = BASE
            self.powers = np.multiply.accumulate(ones)
            ones[1:] = pow(BASE, -1, 1 << 64)
            self.inverses = np.multiply.accumulate(ones)

    def __call__(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(hash, start) of each word. Blocks end at a blank, so a longer word makes a longer block."""
        hashes, starts, at = [], [], 0
        while at < len(data):
            end = min(len(data), at + GROUP_BYTES)
            if end < len(data):
                cuts = [k for b in BLANKS.encode() if (k := data.rfind(b, at, end)) >= 0] or [k for b in BLANKS.encode() if (k := data.find(b, end)) >= 0]
                end = (max(cuts) if cuts[0] < end else min(cuts)) + 1 if cuts else len(data)
            block = np.frombuffer(data, np.uint8, end - at, at)
            self._grow(len(block) + 1)
            edges = np.diff(~_BLANK[block], prepend=False, append=False).nonzero()[0].reshape(-1, 2)
            sums = np.empty(len(block) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(_OF_BYTE[block] * self.powers[: len(block)], out=sums[1:])
            lo, hi = edges[:, 0], edges[:, 1]
            hashes.append(_mix((sums[hi] - sums[lo]) * self.inverses[lo] + (hi - lo).astype(np.uint64) * np.uint64(_LENGTH)))
            starts.append(lo + at)
            at = end
        return (np.concatenate(hashes), np.concatenate(starts)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


# -- samples ------------------------------------------------------------------------------------------------------


def _unit(bits: np.ndarray) -> np.ndarray:
    """Each number's two halves, low one first, as floats strictly between 0 and 1: their upper 23 bits plus a half."""
    halves = bits.view(np.uint32)
    halves >>= np.uint32(9)
    halves |= np.uint32(0x3F800000)
    floats = halves.view(np.float32)
    floats -= np.float32(1 - 2.0**-24)
    return floats.reshape(*bits.shape, 2)


def _uniforms(hashes: np.ndarray, streams: np.ndarray, bits: np.ndarray | None = None, spare: np.ndarray | None = None) -> np.ndarray:
    """Two uniforms for each pair of hash and stream."""
    return _unit(_mix(np.bitwise_xor(hashes, streams, out=bits), spare))


def _gamma(*pairs: Any) -> np.ndarray:
    """Gamma(2, 1): minus the logarithm of the product of two uniforms."""
    both = _uniforms(*pairs)
    product = both[..., 0] * both[..., 1]
    return np.negative(np.log(product, out=product), out=product)


def _steps(weights: np.ndarray, r: np.ndarray, b: np.ndarray) -> np.ndarray:
    """t = floor(ln w / r + b)."""
    return np.floor(np.log(weights.astype(np.float32)) / r + b)


class Sampler:
    """Signs texts. What it keeps of terms met before changes no signature."""

    #: Terms that are scored at once: their arrays stay in the processor's cache.
    BLOCK = 64

    def __init__(self, samples: int = SAMPLES, cached: int = CACHED_TERMS) -> None:
        self.samples, self.cached = samples, cached
        # streams 0..2 give the uniforms, stream 3 names a sample
        self.streams = _mix((np.arange(4, dtype=np.uint64)[:, None] << np.uint64(32)) + np.arange(samples, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        self.scores = np.empty((cached, samples), np.float32)
        self.rows: dict[int, int] = {}
        self.used = 0
        self.hash_words = WordHasher()
        self.bits, self.spare = (np.empty((self.BLOCK, samples), np.uint64) for _ in range(2))
        self.gathered = np.empty((4096, samples), np.float32)
        self.every = np.arange(samples)

    def _learn(self, hashes: np.ndarray, weights: np.ndarray) -> None:
        for lo in range(0, len(hashes), self.BLOCK):
            h, w = hashes[lo : lo + self.BLOCK, None], weights[lo : lo + self.BLOCK]
            bits, spare = self.bits[: len(h)], self.spare[: len(h)]
            r = _gamma(h, self.streams[0], bits, spare)
            reach = 1 - _uniforms(h, self.streams[2], bits, spare)[..., 1]  # t - b + 1; a weight of one has t = 0, whatever r is
            more = np.flatnonzero(w > 1)
            if len(more):
                reach[more] += _steps(w[more, None], r[more], 1 - reach[more])
            reach *= r
            np.subtract(np.log(_gamma(h, self.streams[1], bits, spare)), reach, out=self.scores[self.used + lo : self.used + lo + len(h)])

    def _rows(self, keys: np.ndarray, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The rows of scores of distinct pairs of term and weight, at most `cached` of them; new ones are learned."""
        names = keys.tolist()
        found = list(map(self.rows.get, names))
        fresh = [i for i, at in enumerate(found) if at is None]
        if fresh:
            if self.used + len(fresh) > self.cached:
                self.rows.clear()
                self.used, fresh = 0, list(range(len(names)))
            self._learn(hashes[fresh], weights[fresh])
            for at, i in enumerate(fresh, self.used):
                self.rows[names[i]] = found[i] = at
            self.used += len(fresh)
        return np.array(found)

    def _least(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each sample the least score in `rows` and its place there."""
        least = place = None
        for lo in range(0, len(rows), len(self.gathered)):
            some = rows[lo : lo + len(self.gathered)]
            scores = np.take(self.scores, some, axis=0, out=self.gathered[: len(some)], mode="clip")
            best = scores.argmin(axis=0)
            score = scores[best, self.every]
            if least is None:
                least, place = score, best
            else:
                better = score < least
                least, place = np.where(better, score, least), np.where(better, best + lo, place)
        return least, place

    def sign_all(self, texts: Sequence[str]) -> list[np.ndarray | None]:
        """For each text SAMPLES numbers of 16 bits; None without terms."""
        out: list[np.ndarray | None] = []
        group: list[bytes] = []
        held = 0
        for data in map(str.encode, texts):
            if held + len(data) > GROUP_BYTES and group:
                out += self._sign_group(group)
                group, held = [], 0
            group.append(data)
            held += len(data)
        return out + (self._sign_group(group) if group else [])

    def _sign_group(self, group: list[bytes]) -> list[np.ndarray | None]:
        hashes, starts = self.hash_words(b"\n".join(group))
        ends = np.cumsum([len(d) + 1 for d in group])
        terms, term = np.unique(hashes, return_inverse=True)
        pairs = np.sort(np.searchsorted(ends, starts, "right") * len(terms) + term)
        first = np.flatnonzero(np.diff(pairs, prepend=-1))
        weights = np.diff(first, append=len(pairs))
        doc, term = np.divmod(pairs[first], max(1, len(terms)))
        hashes = terms[term]
        keys = np.where(weights == 1, hashes, _mix(hashes + weights.astype(np.uint64) * np.uint64(_WEIGHT)))
        bounds = np.searchsorted(doc, np.arange(len(group) + 1))
        most = self.cached // 2
        rows = None
        if len(keys) <= most:
            _, index, back = np.unique(keys, return_index=True, return_inverse=True)
            rows = self._rows(keys[index], hashes[index], weights[index])[back]
        filled = np.flatnonzero(np.diff(bounds))
        places = np.empty((len(filled), self.samples), np.int64)
        for at, k in enumerate(filled.tolist()):
            lo, hi = int(bounds[k]), int(bounds[k + 1])
            if rows is not None:
                places[at] = lo + self._least(rows[lo:hi])[1]
                continue
            least = np.full(self.samples, np.inf, np.float32)
            for part in range(lo, hi, most):
                some = slice(part, min(hi, part + most))
                score, place = self._least(self._rows(keys[some], hashes[some], weights[some]))
                places[at] = np.where(score < least, part + place, places[at])
                least = np.minimum(score, least)
        names = iter(self._names(hashes[places], weights[places]))
        return [next(names) if bounds[k] < bounds[k + 1] else None for k in range(len(group))]

    def _names(self, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """16 bits that name each sampled term and its t."""
        t = np.zeros(hashes.shape, np.uint64)
        more = np.nonzero(weights > 1)
        if len(more[0]):
            h, s = hashes[more], more[1]
            r, b = _gamma(h, self.streams[0, s]), _uniforms(h, self.streams[2, s])[..., 1]
            t[more] = _steps(weights[more], r, b).astype(np.uint64)
        return (_mix(_mix(hashes ^ self.streams[3]) + t) >> np.uint64(48)).astype(np.uint16)

    def sign(self, text: str) -> np.ndarray | None:
        return self.sign_all([text])[0]


def text_form(signature: np.ndarray | None) -> str:
    return "" if signature is None else base64.b64encode(signature.astype("<u2").tobytes()).decode()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    if a is None or b is None:
        return float(a is b)
    return float((a == b).mean())


def fingerprint_documents(docs: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fingerprint of every row."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    out = pa.schema([("fingerprint", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = model(("cws", samples), lambda: Sampler(samples))
        for batch in slices(batches, "_text"):
            yield batch_of(out.insert(0, batch.schema.field(0)), [batch.column(0), list(map(text_form, sampler.sign_all(batch.column("_text").to_pylist())))])

    return rows.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fingerprint string")


# -- each document against the next one ---------------------------------------------------------------------------


def _rank(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most `key`: a descent through a tree of arrays, 64 entries a step."""
    levels = [bounds]
    while len(levels[-1]) > 64:
        levels.append(levels[-1][::64])
    rank = F.lit(0)
    for level in reversed(levels):
        # one literal, folded once, however many bounds there are
        values = F.split(F.lit(",".join(map(str, level))), ",").cast("array<bigint>") if level else F.array().cast("array<bigint>")
        start = F.greatest(F.lit(0), (rank - 1) * 64)  # below the last entry that is at most `key`
        rank = start + F.size(F.filter(F.slice(values, start + 1, 64), lambda x: x <= key))
    return rank


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_range, _guest, _id, _text): each range's rows and, as guests, the first of the following range.

    Ranges are cut at quantiles of the id so that each holds about RANGE_BYTES of text;
    the last one has the first row of all as its guest. Rows of one id stay in one range, however many they are, ordered
    by the hash of their text. A partition holds one range, sorted, and is read as a stream. The text is shuffled once. The driver sees two
    numbers a range.
    """
    least = -(1 << 63)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(least)).alias("_key"), F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    n = max(RANGES_A_CORE * docs.sparkSession.sparkContext.defaultParallelism, min(MOST_RANGES, spread(size, RANGE_BYTES)))
    bounds = rows.agg(F.percentile_approx("_key", [i / n for i in range(1, n)], max(10_000, 4 * n))).first()[0]
    rows = rows.withColumn("_range", _rank(F.col("_key"), sorted(set(bounds or []))))
    firsts = dict(rows.groupBy("_range").agg(F.min("_key")).collect())
    filled = sorted(firsts)
    to = {r: filled[i - 1] for i, r in enumerate(filled)}
    longs = lambda of: F.split(F.lit(",".join(str(of.get(r, 0)) for r in range(n))), ",").cast("array<bigint>")
    guest = F.when(F.col("_key") == F.get(longs(firsts), F.col("_range")), F.get(longs(to), F.col("_range")))
    places = F.array(F.struct(F.col("_range").cast("long").alias("r"), F.lit(False).alias("g")), F.struct(guest.alias("r"), F.lit(True).alias("g")))
    dealt = rows.select(F.explode(F.filter(places, lambda p: p["r"].isNotNull())).alias("_p"), "_key", "_id", "_text").select(F.col("_p.r").cast("int").alias("_range"), F.col("_p.g").alias("_guest"), "_key", "_id", "_text")
    return dealt.repartitionById(n, F.col("_range")).withColumn("_tie", F.xxhash64("_text")).sortWithinPartitions("_range", "_guest", "_key", "_tie").drop("_tie", "_key")


def edited(text: str, after: str) -> str:
    """`text` with its last half replaced by as many characters from the start of `after`."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def fingerprint_against_next(docs: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row."""
    out = pa.schema([("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = model(("cws", samples), lambda: Sampler(samples))
        held: tuple[Any, str, np.ndarray | None] | None = None  # the row whose next one hasn't come yet
        for batch in slices(batches, "_text"):
            guests, ids, texts = (batch.column(c).to_pylist() for c in ("_guest", "_id", "_text"))
            # of the guests, rows of one id, only the first counts
            used = [i for i, guest in enumerate(guests) if not guest or (held is not None if i == 0 else not guests[i - 1])]
            own = sampler.sign_all([texts[i] for i in used])
            rows = [held] * (held is not None) + [(ids[i], texts[i], mark) for i, mark in zip(used, own, strict=True)]
            pairs = list(zip(rows, rows[1:], strict=False))
            changed = [edited(a[1], b[1]) for a, b in pairs]
            marks = sampler.sign_all(changed)
            found = [
                (a[0], len(a[1]), hashlib.sha256(text.encode()).hexdigest(), text_form(a[2]), text_form(mark), likeness(a[2], mark), likeness(a[2], b[2]))
                for (a, b), text, mark in zip(pairs, changed, marks, strict=True)
            ]
            held = rows[-1] if rows and not guests[-1] else None
            columns = list(zip(*found, strict=True)) or [()] * 7
            yield batch_of(out.insert(0, batch.schema.field("_id")), list(map(list, columns)))

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(docs, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("_id", id_col)
