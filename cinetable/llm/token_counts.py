"""Token counts of whole texts, with overlap resynchronisation for huge documents.

A text of more than `chunk` code points is encoded in chunks that overlap. Each chunk comes back with the offsets of
its tokens. Two neighbours are spliced at a place in their overlap where both have a token boundary and which is
proven stable: no token of the vocabulary can span it, whatever stands around it. So the tokens left of it in one
chunk and right of it in the other are those of the whole text. If an overlap has no such place, it is widened
(doubled) and encoded again, up to the end of the text.

Null and empty texts have no tokens. Texts of any length are counted whole. Rows are independent: repeats are counted
one by one, an empty table gives an empty one, and extra columns are dropped.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import batch_of, model, slices

CHUNK, OVERLAP = 16_384, 512


#: Categories of characters that normalisation neither drops nor joins with others: letters and numbers.
_STEADY = ("Lu", "Ll", "Lo", "Nd")


class Encoder(Protocol):
    def count(self, texts: list[str]) -> list[int]: ...
    def starts(self, text: str, first: bool) -> np.ndarray:
        """Code point offsets at which tokens start, ascending; `first`: the text stands at its document's start."""
    def stable(self, text: str, at: int) -> bool:
        """Whether, in any text that holds these characters, a token starts at `at`."""


class PieceEncoder:
    """sentencepiece. A place between two characters is stable if no piece holds the two side by side: merges then never
    cross it, and what happens on one side of it doesn't depend on the other. That is so of most spaces, of most pairs of
    Chinese characters, and of some pairs of letters. Characters that the model's normalisation may change, alone or
    together, and runs of spaces are left out."""

    def __init__(self, blob: bytes) -> None:
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_proto=blob)
        pieces = [self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size())]
        self.beside = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        # unknown characters must fall back to bytes, or neighbouring ones become one token; spaces must be kept
        self.proven = "<0x00>" in pieces and len(self.lib.encode("a")) == len(self.lib.encode(" a")) - 1

    def count(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.lib.encode(texts, return_type="numpy", num_threads=1)]

    def starts(self, text: str, first: bool) -> np.ndarray:
        # The library puts a space before every text. Inside a document it stands for the space that the chunk starts
        # with; a chunk that starts within a word has a wrong beginning, which lies before any splice.
        # A chunk that starts at a stable place within a word is given the character before it.
        lead = 0 if first else int(text[:1] == " ")
        begins = np.array([p.begin for p in self.lib.encode(text[lead:], return_type="proto").pieces], np.int64)
        data = np.frombuffer(text[lead:].encode(), np.uint8)
        points = np.cumsum((data & 0xC0) != 0x80)  # code points up to and with each byte
        found = np.where(begins < len(data), points[np.minimum(begins, len(data) - 1)] - 1, points[-1]) + lead if len(data) else begins
        if lead and len(found):
            found[0] = 0
        return found

    def stable(self, text: str, at: int) -> bool:
        if not (self.proven and 0 < at < len(text) - 1):
            return False
        pair = text[at - 1 : at + 1]
        if pair[0] in " ▁" or (pair[1] in " ▁" and text[at + 1] in " ▁"):
            return False
        if pair.replace(" ", "▁") in self.beside:
            return False
        return pair.isascii() and pair.isprintable() or all(unicodedata.category(c) in _STEADY or c == " " for c in pair) and unicodedata.normalize("NFKC", pair) == pair


class ByteLevelEncoder:
    """tokenizers with byte-level pre-tokens: a space between two other characters always starts a pre-token."""

    def __init__(self, blob: bytes) -> None:
        import tokenizers

        self.lib = tokenizers.Tokenizer.from_str(blob.decode())
        self.lib.no_truncation()
        self.lib.no_padding()
        kind = self.lib.pre_tokenizer
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.proven = type(kind).__name__ == "ByteLevel" and not kind.add_prefix_space and self.lib.normalizer is None and not any(" " in t for t in self.special)

    def count(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def starts(self, text: str, first: bool) -> np.ndarray:
        return np.array([a for a, _ in self.lib.encode(text, add_special_tokens=False).offsets], np.int64)

    def stable(self, text: str, at: int) -> bool:
        return self.proven and 0 < at < len(text) - 1 and text[at] == " " and not text[at - 1].isspace() and not text[at + 1].isspace()


ENCODERS: dict[str, Callable[[bytes], Encoder]] = {"model": PieceEncoder, "json": ByteLevelEncoder}


def count_huge(text: str, encoder: Encoder, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """The number of tokens of `text`, from overlapping chunks."""
    total, start, n = 0, 0, len(text)

    def starts(lo: int, hi: int) -> np.ndarray:
        """Where tokens of text[lo:hi] start. `lo` is 0 or stable: what the character before it does stays there."""
        back = int(lo > 0 and text[lo] != " ")
        found = encoder.starts(text[lo - back : hi], lo == 0) + lo - back
        return found[found >= lo]

    while True:
        end = start + chunk
        if end >= n:
            return total + len(starts(start, n))
        left = starts(start, min(n, end + overlap))
        width = overlap
        while True:
            stop = min(n, end + width)
            if stop > end + overlap:
                left = starts(start, stop)
            right = set((encoder.starts(text[end:stop], False) + end).tolist()) if end < stop else set()
            cut = next((p for p in left[(left > end) & (left < stop - 1)].tolist() if p in right and encoder.stable(text[p - 1 : p + 2], 1)), None)
            if cut is not None:
                break
            if stop == n:
                return total + len(left)
            width *= 2
        total += int(np.searchsorted(left, cut))
        start = cut


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit of every row. `model_path`: a .model or .json file, read on the driver."""
    with open(model_path, "rb") as f:
        blob = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = model_path.rpartition(".")[2]
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    out = pa.schema([("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = model(("count", kind, len(blob.value), hash(blob.value)), lambda: ENCODERS[kind](blob.value))
        for batch in slices(batches, "_text"):
            texts = batch.column("_text").to_pylist()
            counts = [0] * len(texts)
            short = [i for i, t in enumerate(texts) if len(t) <= chunk]
            for i, n in zip(short, encoder.count([texts[i] for i in short]), strict=True):
                counts[i] = n
            for i, t in enumerate(texts):
                if len(t) > chunk:
                    counts[i] = count_huge(t, encoder, chunk, overlap)
            yield batch_of(out.insert(0, batch.schema.field(0)), [batch.column(0), pa.compute.binary_length(batch.column("_text")).cast(pa.int64()), counts])

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long"
    return rows.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
