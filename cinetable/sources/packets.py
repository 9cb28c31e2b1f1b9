"""Common ground of the containers: files as rows, packets as rows, errors as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKETS = "clip_id string, codec string, width int, height int, track int, seq long, pts_ns long, is_key boolean, data binary, _error string"
_ARROW = pa.schema([("clip_id", pa.string()), ("codec", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("track", pa.int32()), ("seq", pa.int64()), ("pts_ns", pa.int64()), ("is_key", pa.bool_()), ("data", pa.binary()), ("_error", pa.string())])
#: Bytes of payload in one batch to the JVM.
BATCH_BYTES = 8 << 20


@dataclass
class Packet:
    seq: int
    pts_ns: int
    is_key: bool
    data: bytes


@dataclass
class Clip:
    codec: str
    width: int
    height: int
    packets: Iterator[Packet] | list[Packet] = field(default_factory=list)
    track: int = 1
    num: int = 0
    den: int = 1


def files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(clip_id, content): files from any store that Spark reads, one row each; a file has to fit in memory."""
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select(F.regexp_extract("path", "([^/]*)$", 1).alias("clip_id"), "content")


def scan(found: DataFrame, parse: Callable[[bytes], Clip], strict: bool = False) -> DataFrame:
    """Packets of each file. A file that can't be parsed gives one row with _error after the packets before it, or,
    if `strict`, fails the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                held = 0
                clip = Clip("", 0, 0)
                try:
                    clip = parse(content or b"")
                    for p in clip.packets:
                        rows.append((name, clip.codec, clip.width, clip.height, clip.track, p.seq, p.pts_ns, p.is_key, p.data, None))
                        held += len(p.data)
                        if held > BATCH_BYTES:
                            yield _batch(rows)
                            rows, held = [], 0
                except (ValueError, EOFError, IndexError) as e:
                    if strict:
                        raise
                    rows.append((name, clip.codec or None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
                if rows:
                    yield _batch(rows)

    return found.select("clip_id", "content").mapInArrow(run, PACKETS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def muxed(packets: DataFrame, write: Callable[[list[Packet]], bytes]) -> DataFrame:
    """(clip_id, content): one file of each clip's packets, in order. A file is built in the memory of one task."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("seq")
        found = [Packet(*r) for r in zip(*(rows[c].to_pylist() for c in ("seq", "pts_ns", "is_key", "data")), strict=True)]
        return pa.table({"clip_id": rows["clip_id"][:1].combine_chunks(), "content": pa.array([write(found)], pa.binary())})

    return packets.select(F.col("clip_id").cast("string").alias("clip_id"), "seq", "pts_ns", "is_key", "data").groupBy("clip_id").applyInArrow(run, "clip_id string, content binary")
