"""Byte-level BPE encoding and decoding by prefix-sharing trie traversal.

The state of a prefix is its last token. A prefix ends with token t exactly if t is a suffix of it and t may follow
the last token of what stands before; for each prefix there is one such t. Hence the encoding of a word is found by
walking from state to state, and words with a common prefix share the states of it.

The distinct pre-tokens of a batch form a trie: sorted by bytes, they are visited depth first, the common prefix with
the word before being the path that is already on the stack. Which token may follow which is decided by merging
their joint bytes once; the answer is kept. Pre-tokens met before come from a cache of bounded size.

Null and empty texts have no tokens. Rows are independent; repeats and extra columns do not matter.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import batch_of, model, slices

#: Fixed value: the pre-token pattern of byte-level BPE.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Entries kept by a worker: encoded pre-tokens in each of two generations, and token pairs.
CACHED_WORDS, CACHED_PAIRS = 250_000, 400_000
#: Longer pre-tokens aren't kept, so that a cache of them has a bounded size.
CACHED_CHARS = 64


def byte_of_char() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself, or the next free one above 255."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieBpe:
    def __init__(self, blob: bytes) -> None:
        spec = json.loads(blob)
        if spec["model"]["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only byte-level BPE without normaliser and prefix space is supported")
        stand_in = byte_of_char()
        raw = lambda token: bytes(map(stand_in.__getitem__, token))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.id_of = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.bytes_of = {i: b for b, i in self.id_of.items()} | {i: t.encode() for t, i in self.special.items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank = {(raw(a), raw(b)): r for r, (a, b) in enumerate(pairs)}
        self.longest = max(map(len, self.id_of))
        self.find = regex.compile(PRETOKENS).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """The plain rule: again and again merge the adjacent pair of lowest rank, leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranks = [self.rank.get(p, 1 << 60) for p in zip(parts, parts[1:])]  # noqa: B905
            best = min(ranks)
            if best == 1 << 60:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, a: bytes, b: bytes) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return known

    def visit(self, fresh: Iterable[str]) -> dict[str, bytes]:
        """Encodes distinct words, as little-endian 32-bit ids."""
        id_of, longest, pairs, decide = self.id_of, self.longest, self.pairs, self.follows
        last: list[bytes] = [b""]  # last[i]: last token of the first i bytes on the path
        out, before = {}, b""
        for data, word in sorted((w.encode(), w) for w in fresh):
            shared, most = 0, min(len(before), len(data))
            while shared < most and before[shared] == data[shared]:
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(data) + 1):
                start = end - longest if end > longest else 0
                while True:  # the longest token first
                    token = data[start:end]
                    if token in id_of:
                        if not start or (known := pairs.get((last[start], token))):
                            break
                        if known is None and decide(last[start], token):
                            break
                    start += 1
                    if start == end:
                        raise ValueError(f"no token ends {data[:end]!r}")
                last.append(token)
            ids, end = [], len(data)
            while end:
                ids.append(id_of[last[end]])
                end -= len(last[end])
            out[word] = array("I", reversed(ids)).tobytes()
            before = data
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        parts = []  # for each text a list of pre-tokens, or of one special string
        for text in texts:
            if self.cut and any(s in text for s in self.special):
                found = []
                for piece in self.cut.split(text):
                    found += [piece] if piece in self.special else self.find(piece)
                parts.append(found)
            else:
                parts.append(self.find(text))
        if len(self.words) > CACHED_WORDS:  # what is still in use comes back from the older generation
            self.words, self.older = {}, self.words
        known = self.words
        if not known:
            known.update((s, array("I", [i]).tobytes()) for s, i in self.special.items())
        fresh = set().union(*parts).difference(known) if parts else set()
        kept = fresh.intersection(self.older)
        known.update(zip(kept, map(self.older.__getitem__, kept), strict=True))
        known.update(self.visit(fresh.difference(kept)))
        out = [b"".join(map(known.__getitem__, p)) for p in parts]
        for word in fresh:
            if len(word) > CACHED_CHARS:
                del known[word]
        return out

    def decode(self, ids: bytes) -> str:
        """As the library does: bytes that aren't UTF-8 become replacement characters."""
        numbers = array("I")
        numbers.frombytes(ids)
        return b"".join(map(self.bytes_of.__getitem__, numbers)).decode("utf-8", "replace")


def encode_decode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (binary: little-endian 32-bit) and decoded (string) of every row."""
    with open(vocab_path, "rb") as f:
        blob = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    out = pa.schema([("ids", pa.binary()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(("trie", len(blob.value), hash(blob.value)), lambda: TrieBpe(blob.value))
        for batch in slices(batches, "_text"):
            ids = bpe.encode_batch(batch.column("_text").to_pylist())
            yield batch_of(out.insert(0, batch.schema.field(0)), [batch.column(0), ids, [bpe.decode(x) for x in ids]])

    return rows.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids binary, decoded string")
