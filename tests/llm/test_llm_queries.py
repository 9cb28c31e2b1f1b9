"""The queries opN_<name> themselves: against their SQL where they have one, against plain Python where they don't."""

from __future__ import annotations

import base64
import hashlib
import math
import os
import zlib
from array import array
from collections import Counter

import duckdb
import pytest
from pyspark.sql import SparkSession

from cinetable.llm import queries

from .fixtures import texts
from .pii_cases import CASES
from .test_texts import plain_components, plain_fingerprint, plain_patterns, plain_signature
from .test_tokens import ENCODERS, PIECES, ids_of

SF = "/root/testdata/sf0.001"
DOCS = [(100 + i, t) for i, t in enumerate(texts())] + [(1000 + i, t) for i, (t, _) in enumerate(CASES)]


@pytest.fixture(scope="module")
def made(spark: SparkSession, tmp_path_factory: pytest.TempPathFactory) -> str:
    """A folder with a table of documents that has the odd cases."""
    folder = str(tmp_path_factory.mktemp("made"))
    frame = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in DOCS], "doc_id long, text string, lang string, source string, n_chars long")
    frame.coalesce(1).write.parquet(folder + "/documents.parquet")
    return folder


def plain(v):  # noqa: ANN001, ANN201
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="the small tables are not here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_and_sql(spark: SparkSession, name: str) -> None:
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    columns = sorted(want.columns)
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    key = lambda row: tuple(map(plain, row))
    assert Counter(map(key, got.select(*columns).collect())) == Counter(map(key, want.select(*columns).fetchall()))


def test_op4(spark: SparkSession, made: str) -> None:
    rows = {r.doc_id: r for r in queries.op4_pii(spark, made).collect()}
    assert sorted(rows) == [i for i, _ in DOCS]
    added = 0
    for i, text in DOCS:
        base = plain_patterns(text or "")
        counts = Counter(k for k, _, _ in base)
        r = rows[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in ("email", "ip", "card", "phone"))
        joined = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        every = r.spans.split(",") if r.spans else []
        assert set(joined) <= set(every)
        order = [("email ip card phone".split().index(s.split(":")[0]), int(s.split(":")[1])) for s in every]
        assert order == sorted(order)
        added += len(every) - len(joined)
    assert added >= 30  # by the field


def test_op5(spark: SparkSession, made: str) -> None:
    rows = queries.op5_best_fit_packing(spark, made).collect()
    whole = {i: ids_of(t or "") + [2] for i, t in DOCS}
    for r in rows:
        own = whole[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length <= 1024 and r.ids_crc32 == zlib.crc32(array("I", own).tobytes())
    for i, ids in whole.items():
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids) and len(own) == -(-len(ids) // 1024)
    by_sequence: dict[int, list] = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 1024


def test_op6(spark: SparkSession, made: str) -> None:
    rows = {r.doc_id: r for r in queries.op6_fingerprints(spark, made).collect()}
    order = sorted(DOCS)
    same = total = 0
    for k, (i, t) in enumerate(order):
        text, after, r = t or "", order[(k + 1) % len(order)][1] or "", rows[i]
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        if k % 9 == 0 and len(text) < 3000:
            for mark, of in ((r.fingerprint, text), (r.edited_fingerprint, changed)):
                want = plain_signature(of, 128)
                own = list(array("H", base64.b64decode(mark))) or None
                assert (own is None) == (want is None)
                same, total = same + sum(a == b for a, b in zip(own or [], want or [], strict=True)), total + len(want or [])
        a, b = (base64.b64decode(rows[j].fingerprint) for j in (i, order[(k + 1) % len(order)][0]))
        near = float(a == b) if not a or not b else sum(x == y for x, y in zip(array("H", a), array("H", b), strict=True)) / 128
        assert math.isclose(r.near_next, near)
    assert total > 1000 and same / total > 0.995


def test_op8(spark: SparkSession, made: str) -> None:
    rows = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op8_token_counts(spark, made).collect()}
    counts = ENCODERS[PIECES].count([t or "" for _, t in DOCS])
    assert rows == {i: (len((t or "").encode()), n, n > 4096) for (i, t), n in zip(DOCS, counts, strict=True)}


def test_op9(spark: SparkSession, made: str) -> None:
    rows = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op9_simhash_near_dedup(spark, made).collect()}
    marks = [plain_fingerprint(t) for _, t in DOCS]
    groups = plain_components(marks)
    assert rows == {i: (f"{m:016x}", DOCS[g][0]) for (i, _), m, g in zip(DOCS, marks, groups, strict=True)}


def test_op10(spark: SparkSession, made: str) -> None:
    rows = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op10_bpe_codec(spark, made).collect()}
    sha = lambda data: hashlib.sha256(data).hexdigest()
    assert rows == {i: (len(ids), sha(array("I", ids).tobytes()), sha((t or "").encode())) for i, t in DOCS for ids in [ids_of(t or "")]}
