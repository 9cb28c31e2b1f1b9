"""Every query of the library against its SQL twin, on the small tables."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

import __spark_entry__
from cinetable.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the small tables are not here")


@pytest.fixture(scope="module")
def con() -> duckdb.DuckDBPyConnection:
    out = duckdb.connect()
    for t in TABLES:
        out.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return out


def plain(v):  # noqa: ANN001, ANN201
    return round(v, 6) if isinstance(v, float) else bytes(v) if isinstance(v, (bytes, bytearray)) else v


def rows(found) -> list:  # noqa: ANN001
    return sorted((tuple(map(plain, r)) for r in found), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_against_sql(spark: SparkSession, con: duckdb.DuckDBPyConnection, name: str) -> None:
    got = catalogue.QUERIES[name](spark, SF)
    want = con.sql(catalogue.ORACLE_SQL[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert rows(got.select(*names).collect()) == rows(con.sql(f"SELECT {', '.join(names)} FROM ({catalogue.ORACLE_SQL[name]})").fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark: SparkSession, name: str) -> None:
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark: SparkSession) -> None:
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_and_columns_reach_the_scan(spark: SparkSession) -> None:
    plan = catalogue.QUERIES["gop_segment"](spark, SF)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string>" in plan


def test_the_rest_imports_without_a_library_of_the_training_data_operators() -> None:
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; names = set(e.queries()); assert 'flagship' in names and 'pipeline' not in names and not any(n.startswith('op') and n[2].isdigit() for n in names); assert set(e.oracle_sql()) <= names"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, check=True, timeout=120)
