from __future__ import annotations

import hashlib
import random
import zlib
from array import array
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cinetable.llm import bpe_trie, packing, token_counts
from cinetable.llm.queries import tokenizer_file

from .fixtures import documents, texts

PIECES, BYTES = tokenizer_file("piece_bpe_32k.model"), tokenizer_file("byte_bpe_50k.json")


def library():  # noqa: ANN201
    import tokenizers

    return tokenizers.Tokenizer.from_file(BYTES)


LIB = library()
TRIE = bpe_trie.TrieBpe(open(BYTES, "rb").read())
FAST = packing.byte_level_encoder(open(BYTES, "rb").read(), packing.merges_to_itself(open(BYTES, "rb").read()))
ENCODERS = {name: token_counts.ENCODERS[name.rpartition(".")[2]](open(name, "rb").read()) for name in (PIECES, BYTES)}
ids_of = lambda text: LIB.encode(text, add_special_tokens=False).ids

some_text = st.text(st.one_of(st.sampled_from(list("ab \n\té😀'sldtA1½.,-<|>▁")), st.characters(exclude_categories=["Cs"])), max_size=80)


@settings(max_examples=300, deadline=None)
@given(some_text)
def test_ids_are_the_librarys(text: str) -> None:
    (own,) = TRIE.encode_batch([text])
    assert array("I", own).tolist() == ids_of(text) == FAST(text).tolist()
    assert TRIE.decode(own) == LIB.decode(ids_of(text), skip_special_tokens=False)


def test_tokens_follow_by_merging_and_special_strings() -> None:
    (own,) = TRIE.encode_batch(["a<|endoftext|>b<|endoftext|>"])
    assert array("I", own).tolist() == ids_of("a<|endoftext|>b<|endoftext|>") and 50256 in array("I", own).tolist()
    assert all(TRIE.merged(t) == [t] for t in random.Random(1).sample(sorted(TRIE.id_of), 3000))


def test_without_a_proof_the_library_encodes() -> None:
    slow = packing.byte_level_encoder(open(BYTES, "rb").read(), False)
    assert packing.merges_to_itself(open(BYTES, "rb").read()) and slow("a b<|endoftext|>").tolist() == FAST("a b<|endoftext|>").tolist()


@pytest.mark.parametrize("blank", [" ", "\n", "\t", "\u00a0", " \n"])
def test_packing_takes_very_long_blank_runs(blank: str) -> None:
    text = "a<|endoftext|>" + blank * (1_000_500 // len(blank)) + "b"
    assert FAST(text).tolist() == ids_of(text)


def test_a_very_long_blank_run_is_packed(spark: SparkSession) -> None:
    text = "a" + " " * 1_000_500
    docs = spark.createDataFrame([(1, text), (2, "b")], "doc_id long, text string")
    rows = packing.pack_documents(docs, BYTES, keep_ids=True).collect()
    own = [i for r in sorted((r for r in rows if r.doc_id == 1), key=lambda r: r.piece) for i in array("I", bytes(r.ids))]
    assert own == ids_of(text) + [2] and sum(r.doc_id == 2 for r in rows) == 1


@settings(max_examples=150, deadline=None)
@given(st.lists(some_text, min_size=1, max_size=6), st.integers(4, 40), st.integers(1, 6))
def test_huge_counts(parts: list[str], chunk: int, overlap: int) -> None:
    text = " ".join(parts)
    for encoder in ENCODERS.values():
        assert token_counts.count_huge(text, encoder, chunk, overlap) == encoder.count([text])[0]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(list("的一是不了人我在有他这中大来上国ab1Zq. ▁\u0301カﾞﬁ①กำé\n😀")), min_size=10, max_size=200), st.integers(4, 40), st.integers(1, 6))
def test_huge_counts_without_spaces(text: str, chunk: int, overlap: int) -> None:
    for encoder in ENCODERS.values():
        assert token_counts.count_huge(text, encoder, chunk, overlap) == encoder.count([text])[0]


def test_texts_without_spaces_are_spliced() -> None:
    """Chinese and base64 texts aren't widened to their ends."""
    rng, encoder = random.Random(4), ENCODERS[PIECES]
    longest = 0

    class Watched:
        def __getattr__(self, name: str):  # noqa: ANN204
            return getattr(encoder, name)

        def starts(self, text: str, first: bool) -> np.ndarray:
            nonlocal longest
            longest = max(longest, len(text))
            return encoder.starts(text, first)

    letters = [chr(c) for c in range(0x4E00, 0x5E00)]
    for alphabet in (letters, list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")):
        text = "".join(rng.choice(alphabet) for _ in range(60_000))
        assert token_counts.count_huge(text, Watched(), 4096, 256) == encoder.count([text])[0]
    assert longest < 10_000


@pytest.mark.parametrize("path", [PIECES, BYTES])
@pytest.mark.parametrize("chunk", [16_384, 64])
def test_counts(spark: SparkSession, path: str, chunk: int) -> None:
    rows = documents(spark).collect()
    encoder = ENCODERS[path]
    want = Counter((r.doc_id, len((r.text or "").encode()), encoder.count([r.text or ""])[0]) for r in rows)
    got = token_counts.count_tokens(documents(spark), path, limit=50, chunk=chunk, overlap=8).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 50) for r in got)
    assert token_counts.count_tokens(documents(spark, []), path).count() == 0


def test_codec(spark: SparkSession) -> None:
    got = bpe_trie.encode_decode(documents(spark), BYTES).collect()
    want = Counter((r.doc_id, tuple(ids_of(r.text or "")), r.text or "") for r in documents(spark).collect())
    assert Counter((r.doc_id, tuple(array("I", bytes(r.ids))), r.decoded) for r in got) == want
    assert bpe_trie.encode_decode(documents(spark, []), BYTES).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_best_two_fit(sizes: list[int]) -> None:
    lengths = np.array(sizes, np.int64)
    bins, offsets = packing.best_two_fit(lengths, 64)
    for b in set(bins.tolist()):
        at = sorted((int(o), int(n)) for o, n in zip(offsets[bins == b], lengths[bins == b], strict=True))
        assert [o for o, _ in at] == [sum(n for _, n in at[:k]) for k in range(len(at))] and sum(n for _, n in at) <= 64
    full = np.bincount(bins, weights=lengths) if len(bins) else np.zeros(0)
    assert (np.sort(full)[:2].sum() > 64) or len(full) < 2  # no two bins could be one


def test_two_replace_the_smallest() -> None:
    bins, _ = packing.best_two_fit(np.array([60, 30, 25, 14]), 100)  # 60+30, gap 10: 30 gives way to 25+14
    assert bins.tolist() == [0, 1, 0, 0]


@pytest.mark.parametrize("limit", [1024, 50])
def test_packing(spark: SparkSession, limit: int) -> None:
    rows = packing.pack_documents(documents(spark), BYTES, limit=limit, keep_ids=True).collect()
    docs = documents(spark).collect()
    whole = Counter((d.doc_id, tuple(ids_of(d.text or "") + [2])) for d in docs)
    by_sequence: dict[int, list] = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        ids = array("I", bytes(r.ids))
        assert len(ids) == r.length <= limit and zlib.crc32(bytes(r.ids)) == r.ids_crc32
    for found in by_sequence.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limit
    unique = {d.doc_id: d for d in docs if d.doc_id is not None and sum(x.doc_id == d.doc_id for x in docs) == 1}
    for doc_id, d in unique.items():
        own = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.piece)
        joined = [i for r in own for i in array("I", bytes(r.ids))]
        assert (doc_id, tuple(joined)) in whole and [r.piece for r in own] == list(range(len(own)))
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))] and all(r.length == limit for r in own[1:])
        assert len(own) == -(-len(joined) // limit)
    assert sum(r.length for r in rows) == sum(n * len(ids) for (_, ids), n in whole.items())
    assert len(by_sequence) <= sum(r.length for r in rows) / limit * 1.1 + 1
    assert packing.pack_documents(documents(spark, []), BYTES).count() == 0


def test_digests_of_the_query(spark: SparkSession) -> None:
    frame = bpe_trie.encode_decode(documents(spark), BYTES).select("doc_id", F.sha2("ids", 256).alias("a"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("b"))
    text = texts()[20]
    row = frame.where("doc_id = 20").first()
    assert row.a == hashlib.sha256(array("I", ids_of(text)).tobytes()).hexdigest() and row.b == hashlib.sha256(text.encode()).hexdigest()
