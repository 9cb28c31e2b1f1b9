"""H.264 network units and headers: splitting, sequence and picture parameter sets, slice headers."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import slices
from .bits import Bits

#: Fixed values of the standard: profiles with chroma syntax, and default scaling lists in scan order.
HIGH_PROFILES = {100, 110, 122, 244, 44, 83, 86, 118, 128, 138, 139, 134, 135}
DEFAULT_4 = [[6, 13, 13, 20, 20, 20, 28, 28, 28, 28, 32, 32, 32, 37, 37, 42], [10, 14, 14, 20, 20, 20, 24, 24, 24, 24, 27, 27, 27, 30, 30, 34]]
DEFAULT_8 = [
    [6, 10, 10, 13, 11, 13, 16, 16, 16, 16, 18, 18, 18, 18, 18, 23, 23, 23, 23, 23, 23, 25, 25, 25, 25, 25, 25, 25, 27, 27, 27, 27, 27, 27, 27, 27, 29, 29, 29, 29, 29, 29, 29, 31, 31, 31, 31, 31, 31, 33, 33, 33, 33, 33, 36, 36, 36, 36, 38, 38, 38, 40, 40, 42],
    [9, 13, 13, 15, 13, 15, 17, 17, 17, 17, 19, 19, 19, 19, 19, 21, 21, 21, 21, 21, 21, 22, 22, 22, 22, 22, 22, 22, 24, 24, 24, 24, 24, 24, 24, 24, 25, 25, 25, 25, 25, 25, 25, 27, 27, 27, 27, 27, 27, 28, 28, 28, 28, 28, 30, 30, 30, 30, 32, 32, 32, 33, 33, 35],
]


@dataclass(frozen=True)
class Nal:
    ref_idc: int
    kind: int
    rbsp: bytes


def unescape(data: bytes) -> bytes:
    """Without the 03 that guards 00 00 sequences."""
    return re.sub(b"\x00\x00\x03", b"\x00\x00", data)


def escape(data: bytes) -> bytes:
    """With an 03 between 00 00 and what would read as a start code or a guard."""
    return re.sub(b"\x00\x00(?=[\x00-\x03])", b"\x00\x00\x03", data)


def unit(raw: bytes) -> Nal:
    if raw[0] & 128:
        raise ValueError("forbidden bit is set")
    return Nal(raw[0] >> 5 & 3, raw[0] & 31, unescape(raw[1:]))


def split_lengths(data: bytes, size: int = 4) -> Iterator[Nal]:
    """Units with length fields of 1, 2 or 4 bytes; empty ones are skipped."""
    if size not in (1, 2, 4):
        raise ValueError(f"length field of {size} bytes")
    at = 0
    while at < len(data):
        if at + size > len(data):
            raise ValueError("length field cut off")
        n = int.from_bytes(data[at : at + size], "big")
        at += size
        if at + n > len(data):
            raise ValueError(f"unit of {n} bytes runs past the end")
        if n:
            yield unit(data[at : at + n])
        at += n


def split_start_codes(data: bytes) -> Iterator[bytes]:
    """Raw units between start codes, without trailing zeros. No bytes, or zeros alone, hold no unit."""
    marks = [(m.start(), m.end()) for m in re.finditer(b"\x00\x00\x01", data)]
    if not marks:
        if data.strip(b"\0"):
            raise ValueError("no start code")
        return
    for (_, a), (b, _) in zip(marks, [*marks[1:], (len(data), 0)], strict=True):
        raw = data[a:b].rstrip(b"\0")
        if raw:
            yield raw


def access_units(data: bytes) -> Iterator[list[bytes]]:
    """Raw units by packet: every unit of a coded slice (types 1 to 5) ends one."""
    held: list[bytes] = []
    for raw in split_start_codes(data):
        held.append(raw)
        if 1 <= raw[0] & 31 <= 5:
            yield held
            held = []
    if held:
        yield held


def _list(b: Bits, n: int) -> list[int] | None:
    """A scaling list; None stands for the default."""
    last = ahead = 8
    out: list[int] = []
    for i in range(n):
        if ahead:
            ahead = (last + b.se()) % 256
            if i == 0 and not ahead:
                return None
        last = ahead or last
        out.append(last)
    return out


def _lists(b: Bits, n: int) -> list[tuple[bool, list[int] | None]]:
    """(sent, list) of each of n lists."""
    return [(True, _list(b, 16 if i < 6 else 64)) if b.flag() else (False, None) for i in range(n)]


def resolved_lists(sent: Sequence[tuple[bool, list[int] | None]], fallback: Sequence[list[int]] | None = None) -> list[list[int]]:
    """Twelve lists: what was sent, else the list before of its kind, else the fallback (defaults, or another set's)."""
    default = [DEFAULT_4[i // 3] if i < 6 else DEFAULT_8[i % 2] for i in range(12)]
    out: list[list[int]] = []
    for i in range(12):
        first = i in (0, 3, 6, 7)
        was, values = sent[i] if i < len(sent) else (False, None)
        if was:
            out.append(values or default[i])
        elif first:
            out.append(list((fallback or default)[i]))
        else:
            out.append(out[i - 1 if i < 6 else i - 2])
    return out


def parse_sps(rbsp: bytes) -> dict:
    b = Bits(rbsp)
    s: dict = {"profile": b.u(8), "constraints": b.u(8), "level": b.u(8), "sps_id": b.ue(), "chroma": 1, "depth": 8, "lists": None, "reorder": -1}
    if s["profile"] in HIGH_PROFILES:
        s["chroma"] = b.ue()
        if s["chroma"] == 3:
            b.u(1)
        s["depth"] = 8 + b.ue()
        b.ue()
        s["lossless"] = b.flag()
        if b.flag():
            s["lists"] = _lists(b, 8 if s["chroma"] != 3 else 12)
    s["frame_num_bits"] = b.ue() + 4
    s["poc_type"] = b.ue()
    s["poc_bits"] = 0
    if s["poc_type"] == 0:
        s["poc_bits"] = b.ue() + 4
    elif s["poc_type"] == 1:
        s["delta_always_zero"] = b.flag()
        b.se(), b.se()
        for _ in range(b.ue()):
            b.se()
    s["ref_frames"] = b.ue()
    s["gaps"] = b.flag()
    across, down = b.ue() + 1, b.ue() + 1
    s["frames_only"] = b.flag()
    if not s["frames_only"]:
        b.u(1)
        down *= 2
    b.u(1)
    left = right = top = bottom = 0
    if b.flag():
        left, right, top, bottom = b.ue(), b.ue(), b.ue(), b.ue()
    unit_y = 2 if s["frames_only"] else 4
    s["width"], s["height"] = across * 16 - 2 * (left + right), down * 16 - unit_y * (top + bottom)
    if b.flag():
        s["reorder"] = _reorder_frames(b)
    if not 0 < s["width"] or not 0 < s["height"]:
        raise ValueError(f"picture of {s['width']}x{s['height']}")
    return s


def _reorder_frames(b: Bits) -> int:
    """max_num_reorder_frames of the usability information, -1 if it isn't there."""
    if b.flag() and b.u(8) == 255:
        b.u(32)
    if b.flag():
        b.u(1)
    if b.flag():
        b.u(4)
        if b.flag():
            b.u(24)
    if b.flag():
        b.ue(), b.ue()
    if b.flag():
        b.u(32), b.u(32), b.u(1)
    timed = False
    for _ in range(2):
        if b.flag():
            timed = True
            n = b.ue() + 1
            b.u(8)
            for _ in range(n):
                b.ue(), b.ue(), b.u(1)
            b.u(20)
    if timed:
        b.u(1)
    b.u(1)
    if not b.flag():
        return -1
    b.u(1)
    b.ue(), b.ue(), b.ue(), b.ue()
    return b.ue()


def parse_pps(rbsp: bytes) -> dict:
    b = Bits(rbsp)
    p: dict = {"pps_id": b.ue(), "sps_id": b.ue(), "cabac": b.flag(), "field_order": b.flag()}
    if b.ue():
        raise ValueError("slice groups are not supported")
    p["refs"] = [b.ue() + 1, b.ue() + 1]
    p["weighted"], p["bi_weight"] = b.flag(), b.u(2)
    p["qp"] = 26 + b.se()
    b.se()
    p["chroma_qp"] = [b.se()] * 2
    p["filter_control"], p["constrained_intra"], p["redundant"] = b.flag(), b.flag(), b.flag()
    p["transform_8x8"], p["lists"] = False, None
    if b.more_rbsp():
        p["transform_8x8"] = b.flag()
        if b.flag():
            p["lists"] = _lists(b, 6 + 2 * p["transform_8x8"])
        p["chroma_qp"] = [p["chroma_qp"][0], b.se()]
    return p


def parse_slice(nal: Nal, sps: dict, pps: dict) -> dict:
    """The header of a progressive slice; interlaced streams and other chroma formats are refused."""
    if not sps["frames_only"] or sps["chroma"] != 1 or sps["poc_type"] == 1:
        raise ValueError("only progressive 4:2:0 with picture order counts of type 0 or 2 is supported")
    b = Bits(nal.rbsp)
    h: dict = {"first_mb": b.ue(), "type": b.ue() % 5, "pps_id": b.ue(), "frame_num": b.u(sps["frame_num_bits"]), "idr": nal.kind == 5, "poc_lsb": 0, "direct_spatial": False}
    kind = h["type"]  # 0 P, 1 B, 2 I
    if kind > 2:
        raise ValueError("switching slices are not supported")
    if h["idr"]:
        h["idr_id"] = b.ue()
    if sps["poc_type"] == 0:
        h["poc_lsb"] = b.u(sps["poc_bits"])
        if pps["field_order"]:
            b.se()
    if pps["redundant"]:
        b.ue()
    if kind == 1:
        h["direct_spatial"] = b.flag()
    h["refs"] = list(pps["refs"])
    if kind < 2 and b.flag():
        h["refs"] = [b.ue() + 1, b.ue() + 1 if kind == 1 else pps["refs"][1]]
    h["list_ops"] = [_list_ops(b) for _ in range({0: 1, 1: 2, 2: 0}[kind])]
    if (pps["weighted"] and kind == 0) or (pps["bi_weight"] == 1 and kind == 1):
        h["weights"] = _weights(b, h["refs"][: kind + 1])
    h["marking"] = []
    if nal.ref_idc:
        if h["idr"]:
            b.u(1)
            h["long_term"] = b.flag()
        elif b.flag():
            while op := b.ue():
                h["marking"].append((op, *[b.ue() for _ in range({1: 1, 2: 1, 3: 2, 4: 1, 5: 0, 6: 1}[op])]))
    if pps["cabac"] and kind != 2:
        h["cabac_init"] = b.ue()
    h["qp"] = pps["qp"] + b.se()
    if pps["filter_control"]:
        h["filter_off"] = b.ue()
        if h["filter_off"] != 1:
            h["filter"] = [b.se() * 2, b.se() * 2]
    h["data_at"] = b.at
    return h


def _list_ops(b: Bits) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    if b.flag():
        while (op := b.ue()) != 3:
            if op > 3:
                raise ValueError("reference list operation")
            out.append((op, b.ue()))
    return out


def _weights(b: Bits, refs: Sequence[int]) -> dict:
    out: dict = {"luma_bits": b.ue(), "chroma_bits": b.ue(), "lists": []}
    for n in refs:
        rows = []
        for _ in range(n):
            luma = (b.se(), b.se()) if b.flag() else (1 << out["luma_bits"], 0)
            chroma = [(b.se(), b.se()) for _ in range(2)] if b.flag() else [(1 << out["chroma_bits"], 0)] * 2
            rows.append((luma, *chroma))
        out["lists"].append(rows)
    return out


def nals(packets: DataFrame, framing: str = "length", size: int = 4) -> DataFrame:
    """Rows clip_id, seq, i, ref_idc, type, rbsp, _error of the units in each packet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            rows: list[tuple] = []
            for clip, seq, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                i = 0
                try:
                    for n in split_lengths(data or b"", size) if framing == "length" else map(unit, split_start_codes(data or b"")):
                        rows.append((clip, seq, i, n.ref_idc, n.kind, n.rbsp, None))
                        i += 1
                except (ValueError, IndexError) as e:
                    rows.append((clip, seq, i, None, None, None, str(e)))
            names, kinds = ("clip_id", "seq", "i", "ref_idc", "type", "rbsp", "_error"), (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string())
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names))

    return packets.select(packets["clip_id"].cast("string"), "seq", "data").mapInArrow(run, "clip_id string, seq long, i int, ref_idc int, type int, rbsp binary, _error string")
