"""AV1 open bitstream units: splitting, and the sequence header. Pictures are not decoded."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import slices
from .bits import Bits, leb128, read_leb128

#: Names of the unit types.
NAMES = {1: "sequence_header", 2: "temporal_delimiter", 3: "frame_header", 4: "tile_group", 5: "metadata", 6: "frame", 7: "redundant_frame_header", 8: "tile_list", 15: "padding"}


@dataclass(frozen=True)
class Obu:
    kind: int
    temporal: int
    spatial: int
    payload: bytes


def split(data: bytes) -> Iterator[Obu]:
    at = 0
    while at < len(data):
        head = data[at]
        if head & 128:
            raise ValueError("forbidden bit is set")
        kind, extended, sized = head >> 3 & 15, head >> 2 & 1, head >> 1 & 1
        at += 1
        temporal = spatial = 0
        if extended:
            if at >= len(data):
                raise ValueError("extension cut off")
            temporal, spatial = data[at] >> 5, data[at] >> 3 & 3
            at += 1
        end = len(data)
        if sized:
            n, at = read_leb128(data, at)
            end = at + n
            if end > len(data):
                raise ValueError(f"unit of {n} bytes runs past the end")
        yield Obu(kind, temporal, spatial, data[at:end])
        at = end


def build(kind: int, payload: bytes, temporal: int = 0, spatial: int = 0, sized: bool = True) -> bytes:
    extended = bool(temporal or spatial)
    return bytes([kind << 3 | extended << 2 | sized << 1]) + (bytes([temporal << 5 | spatial << 3]) if extended else b"") + (leb128(len(payload)) if sized else b"") + payload


def sequence_header(payload: bytes) -> dict:
    b = Bits(payload)
    s: dict = {"profile": b.u(3), "still": b.flag(), "reduced": b.flag()}
    if s["reduced"]:
        s["points"] = [(0, b.u(5), 0)]
    else:
        timing = model = False
        delay = 0
        if b.flag():
            timing = True
            b.u(32), b.u(32)
            if b.flag():
                b.uvlc()
            if b.flag():
                model = True
                delay = b.u(5) + 1
                b.u(32), b.u(5), b.u(5)
        s["timing"] = timing
        shown = b.flag()
        s["points"] = []
        for _ in range(b.u(5) + 1):
            idc, level = b.u(12), b.u(5)
            tier = b.u(1) if level > 7 else 0
            if model and b.flag():
                b.u(delay), b.u(delay), b.u(1)
            if shown and b.flag():
                b.u(4)
            s["points"].append((idc, level, tier))
    wide, high = b.u(4) + 1, b.u(4) + 1
    s["width"], s["height"] = b.u(wide) + 1, b.u(high) + 1
    s["frame_ids"] = False if s["reduced"] else b.flag()
    if s["frame_ids"]:
        s["id_bits"] = (b.u(4) + 2, b.u(3))
    s["superblock_128"], s["filter_intra"], s["intra_edge"] = b.flag(), b.flag(), b.flag()
    s["order_bits"] = 0
    s["screen_tools"] = s["integer_mv"] = 2
    if not s["reduced"]:
        s["interintra"], s["masked"], s["warped"], s["dual_filter"] = b.flag(), b.flag(), b.flag(), b.flag()
        order = b.flag()
        if order:
            s["joint_compound"], s["ref_mvs"] = b.flag(), b.flag()
        s["screen_tools"] = 2 if b.flag() else b.u(1)
        if s["screen_tools"]:
            s["integer_mv"] = 2 if b.flag() else b.u(1)
        if order:
            s["order_bits"] = b.u(3) + 1
    s["superres"], s["cdef"], s["restoration"] = b.flag(), b.flag(), b.flag()
    deep = b.flag()
    s["depth"] = (12 if b.flag() else 10) if s["profile"] == 2 and deep else 10 if deep else 8
    s["mono"] = False if s["profile"] == 1 else b.flag()
    primaries, transfer, matrix = (b.u(8), b.u(8), b.u(8)) if b.flag() else (2, 2, 2)
    s["color"] = (primaries, transfer, matrix)
    if s["mono"]:
        s["full_range"], s["subsampling"] = b.flag(), (1, 1)
    elif (primaries, transfer, matrix) == (1, 13, 0):
        s["full_range"], s["subsampling"] = True, (0, 0)
    else:
        s["full_range"] = b.flag()
        s["subsampling"] = (1, 1) if s["profile"] == 0 else (0, 0) if s["profile"] == 1 else (1, 0)
        if s["profile"] == 2 and s["depth"] == 12:
            across = b.u(1)
            s["subsampling"] = (across, b.u(1) if across else 0)
        if s["subsampling"] == (1, 1):
            b.u(2)
    if not s["mono"]:
        b.u(1)
    s["film_grain"] = b.flag()
    return s


def obus(packets: DataFrame) -> DataFrame:
    """Rows clip_id, seq, i, type, temporal_id, spatial_id, payload, _error of the units in each packet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            rows: list[tuple] = []
            for clip, seq, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                i = 0
                try:
                    for o in split(data or b""):
                        rows.append((clip, seq, i, o.kind, o.temporal, o.spatial, o.payload, None))
                        i += 1
                except (ValueError, EOFError, IndexError) as e:
                    rows.append((clip, seq, i, None, None, None, None, str(e)))
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string())
            columns = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["clip_id", "seq", "i", "type", "temporal_id", "spatial_id", "payload", "_error"])

    return packets.select(packets["clip_id"].cast("string"), "seq", "data").mapInArrow(run, "clip_id string, seq long, i int, type int, temporal_id int, spatial_id int, payload binary, _error string")
