"""Shared pieces: reading tables, writing intermediate tables, small column helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blank characters of the word and line rules: space, tab, newline, vertical tab, form feed, return.
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def widened(df: DataFrame) -> DataFrame:
    """A table in fewer partitions than there are cores is dealt out evenly; a larger one stays as it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """This application's part of the folder that driver and executors share, spark.checkpoint.dir.

    Where that is unset and driver and executors are one process, as in tests, it is set to a temporary folder, which
    goes when the process ends. On a cluster it must be set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="cinetable-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{spark.sparkContext.applicationId}"


#: Tables staged within the open scopes, innermost last.
_SCOPES: list[list[DataFrame]] = []


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` once to the shared folder and reads it back: cuts lineage, and survives lost executors.

    The files go by `discard`, with the scope of `settled` they were written in, or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path  # type: ignore[attr-defined]
    place, files = _place(out)
    files.deleteOnExit(place)
    if _SCOPES:
        _SCOPES[-1].append(out)
    return out


def _place(df: DataFrame) -> tuple[Any, Any]:
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_path)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def discard(df: DataFrame) -> None:
    """Removes the files of a staged table that nothing reads any more."""
    place, files = _place(df)
    files.delete(place, True)
    files.cancelDeleteOnExit(place)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Stages the table that `make` returns, then discards what was staged on the way to it."""
    _SCOPES.append([])
    try:
        df = make()
        inner = _SCOPES.pop()
    except BaseException:
        _SCOPES.pop()
        raise
    out = staged(df, name)
    for table in inner:
        discard(table)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates `value` once and hands it to `body`; Catalyst never duplicates a lambda variable."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)  # of one parameter: body may have more


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Maximal runs of characters outside BLANKS; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), "")


def spread(n_rows: int, per_part: int, least: int = 1) -> int:
    """A number of partitions or shards that grows with the rows."""
    return max(least, -(-n_rows // per_part))


#: Bytes of a lookup table that is broadcast at most.
BROADCAST_BYTES = 32 << 20
SALTS = 64


def size_in_bytes(df: DataFrame, *texts: str, per_row: int = 64) -> int:
    """An upper bound of the size of a table of short rows whose only long columns are `texts`."""
    texts_bytes = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(per_row).cast("long"))
    return df.agg(F.sum(texts_bytes)).first()[0] or 0


def salted_left_join(rows: DataFrame, small: DataFrame, key: str, n_bytes: int) -> DataFrame:
    """Left join on `key`: by broadcast if `small` has at most BROADCAST_BYTES, else shuffled, with the rows of a key
    spread over salts (of the column _row) and `small` repeated for each salt."""
    if n_bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(small), key, "left")
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int")).join(salted, [key, "_salt"], "left").drop("_salt")
