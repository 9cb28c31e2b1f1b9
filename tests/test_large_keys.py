"""Queries against their SQL on hand-made rows: keys and values that the small tables don't reach."""

from __future__ import annotations

from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import SparkSession

from cinetable.functions import rans
from cinetable.functions.bool_coder import BoolReader, BoolWriter
from cinetable.plans import catalogue
from cinetable.sources.batches import slices
from cinetable.sources.bits import Bits, BitWriter, read_leb128


def differs(spark: SparkSession, folder: Path, table: str, data: pa.Table, name: str) -> tuple[list, list]:
    """Rows of the query and of its SQL, where `table` holds `data`."""
    path = f"{folder}/{table}.parquet"
    pq.write_table(data, path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    got = catalogue.QUERIES[name](spark, str(folder))
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({catalogue.ORACLE_SQL[name]})").fetchall()
    return sorted(map(repr, map(tuple, got.collect()))), sorted(map(repr, want))


def test_vp8_sizes_beyond_19_bits(spark: SparkSession, tmp_path: Path) -> None:
    keys = [74_896, 74_898, 74_899, 74_900, 1_199_996, 1_199_999, 7_200_000, 1 << 40]
    got, want = differs(spark, tmp_path, "part", pa.table({"p_partkey": keys, "p_size": pa.array([50] * len(keys), pa.int32())}), "vp8_headers")
    assert got == want and len(got) == len(keys)


@pytest.mark.parametrize("name", ["h264_intra_4x4", "vp8_intra_4x4", "intra_16x16", "vector_sse"])
def test_products_keep_the_precision_of_floats(spark: SparkSession, tmp_path: Path, name: str) -> None:
    """Values next to a hundredth or two-hundredth, whose products are whole as floats but not as doubles."""
    near = [np.nextafter(np.float32(n / by), np.float32(to)) for by in (100, 200) for n in range(-60, 61) for to in (-9, 9)]
    near = [v for v in near if any(np.floor(v * np.float32(by)) != np.floor(float(v) * by) for by in (100, 200))]
    assert near
    vectors = [[near[(3 * i + k) % len(near)] for k in range(64)] for i in range(5)] + [[np.float32(0.1)] * 64]
    data = pa.table({"vec_id": list(range(6)), "embedding": pa.array(vectors, pa.list_(pa.float32()))})
    got, want = differs(spark, tmp_path, "embeddings", data, name)
    assert got == want and got


@pytest.mark.parametrize("name", ["nal_split", "start_code_split", "obu_split"])
def test_lines_keep_zeros_and_guards(spark: SparkSession, tmp_path: Path, name: str) -> None:
    texts = ["one\0\ntwo\0\0\n\0\n\0\0\0\0\n\nlast", "a\0\0\1b\0\0\3\n\3\0\0\3", "\x80\n\0\x80", "", None]
    got, want = differs(spark, tmp_path, "documents", pa.table({"doc_id": list(range(len(texts))), "text": texts}), name)
    assert got == want and len(got) == 9


@pytest.mark.parametrize("name", ["rans_roundtrip", "bool_coder_roundtrip"])
def test_coders_take_documents_without_a_language(spark: SparkSession, tmp_path: Path, name: str) -> None:
    texts = ["a bb  ccc", "", None, "x" * 40, " ", "a b", "one two three"]
    data = pa.table({"doc_id": [1, 2, 3, 4, 5, 1, 7], "lang": ["en", "en", "de", None, None, "en", "fr"], "source": ["s"] * 7, "text": texts})
    got, want = differs(spark, tmp_path, "documents", data, name)
    assert got == want and got


def test_a_language_is_not_one_task(spark: SparkSession) -> None:
    """Tables of a language go to its documents, whatever may be broadcast otherwise: no document goes through an exchange."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalogue.QUERIES["rans_roundtrip"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "collect_list(sym" not in plan


def test_the_boolean_coder_keeps_little_and_carries() -> None:
    rng = np.random.default_rng(5)
    for chance in (0.02, 0.5, 0.98):
        bits, probs = (rng.random(20_000) < chance).astype(int).tolist(), [1, 254, 128, 255]
        one, many = BoolWriter(), BoolWriter()
        for i, b in enumerate(bits):
            one.bit(b, probs[i % 4])
        many.run(bits, probs)
        assert one.low.bit_length() < 600 and one.bytes() == many.bytes()
        reader = BoolReader(one.bytes())
        assert BoolReader(one.bytes()).run(len(bits), probs) == bits == [reader.bit(probs[i % 4]) for i in range(len(bits))]


@given(st.lists(st.integers(0, 3), max_size=300))
def test_one_context_codes_as_many_do(symbols: list[int]) -> None:
    table = rans.Table([4000, 90, 5, 1])
    data = rans.encode([(0, s) for s in symbols], [table])
    assert rans.encode_all(symbols, table) == data and rans.decode_all(data, table, len(symbols)) == symbols


def test_units_leave_in_small_batches() -> None:
    """A batch of many packets is cut before objects are made of it, and a large packet stays whole."""
    data = [bytes(300_000), None, b"", bytes(900_000), bytes(5_000_000), b"x"] + [b"y"] * 2500
    batch = pa.record_batch({"seq": list(range(len(data))), "data": pa.array(data, pa.binary())})
    cut = list(slices(iter([batch, batch.slice(0, 0)]), 1))
    assert pa.Table.from_batches(cut).equals(pa.Table.from_batches([batch]))
    assert [b.num_rows for b in cut] == [3, 1, 1, 1000, 1000, 501]


@pytest.mark.parametrize("name", ["scaling_lists", "vp8_headers", "packet_headers", "h264_parameter_sets", "av1_bit_codes", "av1_sequence_headers"])
def test_parts_are_dealt_out(spark: SparkSession, name: str) -> None:
    """Headers are made and parsed in as many tasks as there are cores, however few files `part` has."""
    assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


@given(st.binary(max_size=12), st.lists(st.integers(0, 1 << 20), max_size=5))
def test_golomb_codes_end_or_are_refused(data: bytes, values: list[int]) -> None:
    w = BitWriter()
    for v in values:
        w.ue(v)
    read = Bits(w.bytes(stop=True) + data)
    assert [read.ue() for _ in values] == values
    with pytest.raises((EOFError, ValueError)):
        read = Bits(data)
        while True:
            read.ue()


def test_base_128_codes_of_five_bytes(spark: SparkSession, tmp_path: Path) -> None:
    """Codes of 2^28 and more read back as what was coded; the SQL of the query ends at four bytes, within a code."""
    ids = [0, 1, 64, 4_329_604, 4_329_606, 5_999_998, 5_999_999, 1 << 40]
    pq.write_table(pa.table({"event_id": ids}), f"{tmp_path}/events.parquet")
    for r in catalogue.QUERIES["integer_codes"](spark, str(tmp_path)).collect():
        data = bytes.fromhex(r["leb128"])
        assert read_leb128(data, 0) == (r["zigzag"], len(data)) and r["back"] == (r["event_id"] * 31 if r["event_id"] % 2 == 0 else -r["event_id"] * 17)
