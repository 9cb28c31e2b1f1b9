"""Decoding and encoding as kernels over groups of pictures.

A codec is a function from the packets of one closed group, in order, to its frames; it never sees another group, so
groups are independent tasks. Frames are tight planes, chroma rounded up. Codecs are looked up by name in CODECS.

Implemented: the uncompressed and the transform-coded modes of the indexed container. H.264, VP8, AV1 and MPEG-1
pictures are not decoded; their packets give error rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.gop_container import packet_header, parse_packet_header
from ..functions.samples import MAX_QP
from .streams import with_groups
from .transform_codec import State, cropped, decode_coded, encode_group

FRAMES = "clip_id string, n long, pts_ns long, width int, height int, y binary, cb binary, cr binary, _error string"
_ARROW = pa.schema([("clip_id", pa.string()), ("n", pa.int64()), ("pts_ns", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("y", pa.binary()), ("cb", pa.binary()), ("cr", pa.binary()), ("_error", pa.string())])
#: Coding modes of the indexed container.
RAW, INTRA, INTER = 0, 1, 2
MOST_WIDTH, MOST_HEIGHT = 8192, 4320


@dataclass
class Frame:
    n: int
    pts_ns: int
    width: int
    height: int
    planes: tuple[bytes, bytes, bytes]


def plane_sizes(width: int, height: int) -> tuple[int, int]:
    return width * height, ((width + 1) // 2) * ((height + 1) // 2)


def encode_raw(width: int, height: int, planes: tuple[bytes, bytes, bytes], key: bool) -> bytes:
    luma, chroma = plane_sizes(width, height)
    if [len(p) for p in planes] != [luma, chroma, chroma]:
        raise ValueError("planes don't fit the picture")
    return packet_header(key, RAW, width, height) + b"".join(planes)


def decode_gop(packets: list[tuple[int, int, bytes]]) -> Iterator[Frame]:
    """Frames of (seq, pts_ns, data) packets of one group. The first must be a key packet."""
    size: tuple[int, int] | None = None
    state = State()
    for n, pts, data in packets:
        h = parse_packet_header(data)
        if h["type"] == 0:
            if h["width"] > MOST_WIDTH or h["height"] > MOST_HEIGHT:
                raise ValueError(f"picture of {h['width']}x{h['height']}")
            size = h["width"], h["height"]
        if size is None:
            raise ValueError("a group starts with no key packet")
        if h["coding"] in (INTRA, INTER):
            key, inter = h["type"] == 0, h["coding"] == INTER
            if key and inter:
                raise ValueError("a key packet can't be inter-coded")
            rec = decode_coded(state, size, data[h["body_at"] :], key, inter, h["override"])
            yield Frame(n, pts, *size, cropped(rec, *size))
            continue
        if h["coding"] != RAW:
            raise ValueError(f"coding mode {h['coding']}")
        luma, chroma = plane_sizes(*size)
        body = data[h["body_at"] :]
        if len(body) != luma + 2 * chroma:
            raise ValueError(f"{len(body)} bytes of samples")
        yield Frame(n, pts, *size, (body[:luma], body[luma : luma + chroma], body[luma + chroma :]))


CODECS: dict[str, Callable[[list[tuple[int, int, bytes]]], Iterator[Frame]]] = {"gop": decode_gop}


def decode(packets: DataFrame, strict: bool = False) -> DataFrame:
    """Frames of packets with clip_id, codec, seq, pts_ns, is_key and data. What follows an error in its group is
    skipped; the error is a row with the number of the packet."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("seq")
        clip, codec = rows["clip_id"][0].as_py(), rows["codec"][0].as_py()
        found: list[tuple] = []
        work = list(zip(*(rows[c].to_pylist() for c in ("seq", "pts_ns", "data")), strict=True))
        try:
            if codec not in CODECS:
                raise ValueError(f"codec {codec} is not supported")
            for f in CODECS[codec](work):
                found.append((clip, f.n, f.pts_ns, f.width, f.height, *f.planes, None))
        except (ValueError, IndexError, EOFError) as e:
            if strict:
                raise
            found.append((clip, work[len(found)][0], work[len(found)][1], None, None, None, None, None, str(e)))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), _ARROW, strict=True)], schema=_ARROW)

    grouped = with_groups(packets.select("clip_id", "codec", "seq", "pts_ns", "is_key", "data"))
    return grouped.groupBy("clip_id", "gop_id").applyInArrow(run, FRAMES)


def encode_coded(frames: DataFrame, gop: int, qp: int, cols: int = 1, rows: int = 1, window: int = 0, fast: bool = False) -> DataFrame:
    """Packets of frames in the transform-coded modes. Every `gop` frames form a closed group and a task of their own.

    `fast` leaves out the second pass, which prices levels by the first one's symbols."""
    if not 0 <= qp <= MAX_QP or gop < 1:
        raise ValueError(f"quantiser {qp}, groups of {gop}")

    def run(rows_: pa.Table) -> pa.Table:
        rows_ = rows_.sort_by("n")
        planes = list(zip(*(rows_[c].to_pylist() for c in ("y", "cb", "cr")), strict=True))
        width, height = rows_["width"][0].as_py(), rows_["height"][0].as_py()
        coded = encode_group(planes, width, height, qp, cols, rows, window, 1 if fast else 2)
        data = [packet_header(i == 0, INTER if i else INTRA, width, height, hidden) + body for i, (body, _, hidden) in enumerate(coded)]
        return pa.table({"clip_id": rows_["clip_id"], "seq": rows_["n"], "pts_ns": rows_["pts_ns"], "is_key": [i == 0 for i in range(len(data))], "data": pa.array(data, pa.binary())})

    grouped = frames.where(F.col("y").isNotNull()).select("clip_id", "n", "pts_ns", "width", "height", "y", "cb", "cr", F.expr(f"n div {gop}").alias("_gop"))
    return grouped.groupBy("clip_id", "_gop").applyInArrow(run, "clip_id string, seq long, pts_ns long, is_key boolean, data binary")


def encode(frames: DataFrame, gop: int) -> DataFrame:
    """Packets (clip_id, seq, pts_ns, is_key, data) of frames in the uncompressed mode, a key every `gop` frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = {c: b.column(i).to_pylist() for i, c in enumerate(b.schema.names)}
            keys = [n % gop == 0 for n in columns["n"]]
            data = [encode_raw(w, h, (y, cb, cr), k) for w, h, y, cb, cr, k in zip(*(columns[c] for c in ("width", "height", "y", "cb", "cr")), keys, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(keys), pa.array(data, pa.binary())], names=["clip_id", "seq", "pts_ns", "is_key", "data"])

    rows = frames.where(F.col("y").isNotNull()).select("clip_id", "n", "pts_ns", "width", "height", "y", "cb", "cr")
    return rows.mapInArrow(run, "clip_id string, seq long, pts_ns long, is_key boolean, data binary")


def transcode(packets: DataFrame, gop: int, limit: int | None = None) -> DataFrame:
    """Decode, renumber by display time, stop after `limit` frames of a clip, encode."""
    frames = decode(packets).where("_error IS NULL").selectExpr("clip_id", "row_number() OVER (PARTITION BY clip_id ORDER BY pts_ns, n) - 1 AS n", "pts_ns", "width", "height", "y", "cb", "cr")
    frames = frames.withColumn("n", F.col("n").cast("long"))
    return encode(frames if limit is None else frames.where(F.col("n") < limit), gop)


def checksum(frames: DataFrame) -> DataFrame:
    """Adds crc, the CRC-32 of a frame's planes one after another."""
    return frames.withColumn("crc", F.crc32(F.concat("y", "cb", "cr")))


def crc_of(planes: tuple[bytes, bytes, bytes]) -> int:
    return zlib.crc32(b"".join(planes))
