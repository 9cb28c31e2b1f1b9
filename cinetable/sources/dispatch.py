"""One entry for all containers, by the lower-cased extension of a file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import gop_container, mp4, mpeg_ps, webm
from .packets import Clip, files, scan

#: Container parsers by extension.
PARSERS: dict[str, Callable[[bytes], Clip]] = {"mp4": mp4.parse, "m4v": mp4.parse, "mov": mp4.parse, "webm": webm.parse, "mkv": webm.parse, "gop": gop_container.parse, "mpg": mpeg_ps.parse, "mpeg": mpeg_ps.parse}
_MARKS = [(b"\x1aE\xdf\xa3", 0, webm.parse), (gop_container.MAGIC, 0, gop_container.parse), (b"ftyp", 4, mp4.parse), (b"\0\0\1\xba", 0, mpeg_ps.parse)]


def parse_any(data: bytes) -> Clip:
    """By what the first bytes say."""
    for mark, at, parse in _MARKS:
        if data[at : at + len(mark)] == mark:
            return parse(data)
    raise ValueError("unknown container")


def read_video(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Packets of all files of a path with a known extension, in any letter case."""
    found = files(spark, path)
    known = found.filter(f"lower(regexp_extract(clip_id, '[.]([^.]*)$', 1)) IN ({', '.join(repr(e) for e in PARSERS)})")
    return scan(known, parse_any, strict)
