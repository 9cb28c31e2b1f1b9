"""The indexed container of closed groups of pictures: header, self-delimiting records, index and footer.

Two ways in: `parse` on file contents from any store, and the Python data source "gop". The driver lists files only
and plans splits by ranges of bytes; each task reads the index of its file and takes the groups of pictures that start
within its range and reach into the wanted range of seq. A file without a whole index is walked through by its tasks.
"""

from __future__ import annotations

import glob
import io
import itertools
import os
import shutil
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import BinaryIO

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from .packets import PACKETS, Clip, Packet

#: Fixed values of the format.
MAGIC, FOOTER_MAGIC, VERSION = b"EBIV", b"EBIX", 4
HEADER, RECORD, ENTRY, FOOTER = 48, 8, 16, 20
SYNC, KEY_FLAG, MOST_BYTES = 0xEB17, 1, 256 << 20
CODEC = "gop"
SECOND = 1_000_000_000


@dataclass(frozen=True)
class Header:
    width: int
    height: int
    num: int
    den: int
    tile_cols: int = 0
    tile_rows: int = 0
    flags: int = 0

    def __post_init__(self) -> None:
        if not (1 <= self.width <= 65535 and 1 <= self.height <= 65535):
            raise ValueError(f"dimensions {self.width}x{self.height} out of range")
        if not self.num or not self.den:
            raise ValueError(f"frame rate {self.num}/{self.den}")

    def pack(self) -> bytes:
        return struct.pack("<4sHH5I4B2HIQ", MAGIC, VERSION, HEADER, self.width, self.height, self.num, self.den, 0, 0, 0, 0, 0, self.tile_cols, self.tile_rows, self.flags, 0)

    @classmethod
    def unpack(cls, data: bytes) -> Header:
        if len(data) < HEADER:
            raise ValueError("file header cut off")
        magic, version, size, width, height, num, den, _, chroma, depth, _, _, cols, rows, flags, _ = struct.unpack_from("<4sHH5I4B2HIQ", data)
        if magic != MAGIC:
            raise ValueError("not such a file")
        if version != VERSION or size != HEADER:
            raise ValueError(f"version {version}, header of {size} bytes")
        if chroma or depth:
            raise ValueError("only 8-bit 4:2:0 is supported")
        return cls(width, height, num, den, cols, rows, flags)

    def time_of(self, n: int) -> int:
        return n * self.den * SECOND // self.num


#: (offset of the record, bytes of payload, key)
Entry = tuple[int, int, bool]


class ContainerWriter:
    """Writes one file record by record; only the index, 16 bytes a record, is held."""

    def __init__(self, out: BinaryIO, header: Header) -> None:
        self.out, self.at, self.index = out, HEADER, []
        out.write(header.pack())

    def add(self, data: bytes, is_key: bool) -> None:
        if not data or len(data) > MOST_BYTES:
            raise ValueError(f"payload of {len(data)} bytes")
        if not self.index and not is_key:
            raise ValueError("the first frame is no key frame")
        self.out.write(struct.pack("<HHI", SYNC, KEY_FLAG * is_key, len(data)))
        self.out.write(data)
        self.index.append(struct.pack("<QII", self.at, len(data), KEY_FLAG * is_key))
        self.at += RECORD + len(data)

    def finish(self) -> None:
        table = b"".join(self.index)
        self.out.write(table)
        self.out.write(struct.pack("<QII4s", self.at, len(self.index), zlib.crc32(table), FOOTER_MAGIC))


def build(header: Header, packets: Sequence[Packet]) -> bytes:
    out = io.BytesIO()
    writer = ContainerWriter(out, header)
    for p in packets:
        writer.add(p.data, p.is_key)
    writer.finish()
    return out.getvalue()


def footer_bounds(tail: bytes, size: int) -> tuple[int, int, int]:
    """(offset, count, checksum) of the index, from the last bytes of a file of `size`."""
    if size < HEADER + FOOTER or len(tail) < FOOTER:
        raise ValueError("too short for a footer")
    offset, count, crc, magic = struct.unpack("<QII4s", tail[-FOOTER:])
    if magic != FOOTER_MAGIC or offset < HEADER or offset + count * ENTRY != size - FOOTER:
        raise ValueError("no index")
    return offset, count, crc


def checked_index(table: bytes, crc: int, end: int) -> list[Entry]:
    if zlib.crc32(table) != crc:
        raise ValueError("index checksum differs")
    out = []
    for offset, size, flags in struct.iter_unpack("<QII", table):
        if offset < HEADER or not 0 < size <= MOST_BYTES or offset + RECORD + size > end:
            raise ValueError(f"entry at {offset} of {size} bytes")
        out.append((offset, size, bool(flags & KEY_FLAG)))
    if out and not out[0][2]:
        raise ValueError("the first frame is no key frame")
    return out


def rebuilt_index(data: bytes) -> list[Entry]:
    """By walking the records; a partial or implausible one ends the walk."""
    out, at = [], HEADER
    while at + RECORD <= len(data):
        sync, flags, size = struct.unpack_from("<HHI", data, at)
        if sync != SYNC or not 0 < size <= MOST_BYTES or at + RECORD + size > len(data):
            break
        out.append((at, size, bool(flags & KEY_FLAG)))
        at += RECORD + size
    if not out or not out[0][2]:
        raise ValueError("no frames" if not out else "the first frame is no key frame")
    return out


def index_of(data: bytes) -> list[Entry]:
    try:
        offset, count, crc = footer_bounds(data, len(data))
        return checked_index(data[offset : offset + count * ENTRY], crc, offset)
    except ValueError:
        return rebuilt_index(data)


def parse(data: bytes) -> Clip:
    header = Header.unpack(data)
    index = index_of(data)

    def packets() -> Iterator[Packet]:
        for n, (at, size, key) in enumerate(index):
            yield Packet(n, header.time_of(n), key, data[at + RECORD : at + RECORD + size])

    return Clip(CODEC, header.width, header.height, packets(), 1, header.num, header.den)


# -- packet headers -----------------------------------------------------------------------------------------------


def packet_header(key: bool, coding: int, width: int = 0, height: int = 0, override: bool = False) -> bytes:
    first = (0 if key else 1) | coding << 2 | override << 5
    return bytes([first]) + (struct.pack("<HHB", width, height, 0) if key else b"")


def parse_packet_header(data: bytes) -> dict:
    """type (0 key, 1 inter), coding, override, width, height (0 in inter packets) and body_at."""
    if not data:
        raise ValueError("empty packet")
    kind, coding, override = data[0] & 3, data[0] >> 2 & 7, bool(data[0] & 32)
    if kind > 1 or (override and kind):
        raise ValueError(f"frame type {kind}, override {override}")
    if kind:
        return {"type": kind, "coding": coding, "override": False, "width": 0, "height": 0, "body_at": 1}
    if len(data) < 6:
        raise ValueError("key packet cut off")
    width, height, sample = struct.unpack_from("<HHB", data, 1)
    if not width or not height or sample:
        raise ValueError(f"key packet of {width}x{height}, samples {sample}")
    return {"type": kind, "coding": coding, "override": override, "width": width, "height": height, "body_at": 6}


# -- data source --------------------------------------------------------------------------------------------------


#: Bytes of a file that one task reads.
SPLIT_BYTES = 64 << 20


def local_path(path: str) -> str:
    """The data source opens files itself, so it takes local or mounted paths only; others go through binaryFile."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return path
    if scheme != "file":
        raise ValueError(f"{path}: the source gop opens local and mounted paths only; read others as binaryFile and parse them")
    return "/" + rest.lstrip("/")


def file_index(f: BinaryIO, size: int) -> list[Entry]:
    """The index of an open file, from its footer if that is whole, else by walking the records' headers."""
    try:
        f.seek(max(0, size - FOOTER))
        offset, count, crc = footer_bounds(f.read(), size)
        f.seek(offset)
        return checked_index(f.read(count * ENTRY), crc, offset)
    except ValueError:
        f.seek(0)
        return rebuilt_index(f.read())


@dataclass
class Split(InputPartition):
    path: str
    low: int
    high: int


class GopReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.split = local_path(options["path"]), int(options.get("splitbytes", SPLIT_BYTES))
        self.low, self.high = 0, 1 << 62

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Ranges of seq choose groups; rows are filtered again by Spark."""
        for f in filters:
            if getattr(f, "attribute", None) == ("seq",):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.low = max(self.low, int(f.value) + isinstance(f, GreaterThan))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.high = min(self.high, int(f.value) - isinstance(f, LessThan))
            yield f

    def partitions(self) -> Sequence[InputPartition]:
        paths = sorted(glob.glob(os.path.join(glob.escape(self.path), "*")) if os.path.isdir(self.path) else glob.glob(self.path))
        files = [p for p in paths if not os.path.basename(p).startswith(("_", "."))]
        return [Split(p, at, at + self.split) for p in files for at in range(0, max(1, os.path.getsize(p)), self.split)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not isinstance(partition, Split):
            return
        with open(partition.path, "rb") as f:
            h = Header.unpack(f.read(HEADER))
            index = file_index(f, os.path.getsize(partition.path))
            starts = [n for n, entry in enumerate(index) if entry[2]]
            for a, b in zip(starts, [*starts[1:], len(index)], strict=True):
                if not partition.low <= index[a][0] < partition.high or b <= self.low or a > self.high:
                    continue
                for n in range(a, b):
                    at, size, key = index[n]
                    f.seek(at + RECORD)
                    yield os.path.basename(partition.path), CODEC, h.width, h.height, 1, n, h.time_of(n), key, f.read(size), None


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class GopWriter(DataSourceWriter):
    """One file for each clip. Rows must come sorted by clip and seq, the rows of a clip in one partition; they are
    written as they come. Tasks write to a folder aside; files are moved into place when the whole job is done, so a
    failed job leaves nothing and a retried task leaves one file."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.options, self.overwrite = options, overwrite
        self.path = local_path(options["path"])
        self.aside = os.path.join(self.path, f"_temporary-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        o = self.options
        header = Header(int(o["width"]), int(o["height"]), int(o.get("num", "30")), int(o.get("den", "1")))
        mine = os.path.join(self.aside, uuid.uuid4().hex)
        os.makedirs(mine, exist_ok=True)
        done: dict[str, str] = {}
        for clip, rows in itertools.groupby(iterator, key=lambda r: str(r["clip_id"])):
            if clip in done or not clip or "/" in clip or clip.startswith(("_", ".")):
                raise ValueError(f"clip {clip!r} comes twice, or is no file name")
            done[clip] = os.path.join(mine, clip)
            with open(done[clip], "wb") as f:
                writer, last = ContainerWriter(f, header), None
                for r in rows:
                    if last is not None and r["seq"] < last:
                        raise ValueError(f"clip {clip!r} isn't sorted by seq")
                    last = r["seq"]
                    writer.add(bytes(r["data"]), r["is_key"])
                writer.finish()
        return Written([(made, os.path.join(self.path, clip)) for clip, made in done.items()])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files = [pair for m in messages if isinstance(m, Written) for pair in m.files]
        if len({to for _, to in files}) < len(files):
            self.abort(messages)
            raise ValueError("a clip lies in several partitions")
        if self.overwrite:
            kept = {to for _, to in files}
            for old in glob.glob(os.path.join(glob.escape(self.path), "*")):
                if os.path.isfile(old) and old not in kept:
                    os.remove(old)
        for made, to in files:
            os.replace(made, to)
        shutil.rmtree(self.aside, ignore_errors=True)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self.aside, ignore_errors=True)


class GopSource(DataSource):
    """Options: path, splitBytes; for writing also width, height, num, den. See GopWriter for the order of rows."""

    @classmethod
    def name(cls) -> str:
        return "gop"

    def schema(self) -> str:
        return PACKETS

    def reader(self, schema: StructType) -> DataSourceReader:
        return GopReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return GopWriter(self.options, overwrite)
