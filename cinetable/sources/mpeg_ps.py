"""MPEG-1 program streams: the first video stream, one packet a picture. Pictures are not decoded.

A picture reaches from its start code, with the sequence and group headers before it, to the next one. Its time is the
stamp of the packet that its start code lies in if it is the first there, else one period after the picture before.
Only intra pictures are key packets.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator, Sequence

from .packets import Clip, Packet

#: Start codes, and frame rates by code.
PACK, SYSTEM, END, PICTURE, SEQUENCE, GROUP = 0xBA, 0xBB, 0xB9, 0x00, 0xB3, 0xB8
RATES = {1: (24000, 1001), 2: (24, 1), 3: (25, 1), 4: (30000, 1001), 5: (30, 1), 6: (50, 1), 7: (60000, 1001), 8: (60, 1)}
SECOND, CLOCK = 1_000_000_000, 90_000


def _stamp(data: bytes, at: int) -> int:
    a, b, c = data[at] >> 1 & 7, *struct.unpack_from(">HH", data, at + 1)
    return a << 30 | (b >> 1) << 15 | c >> 1


def _payloads(data: bytes) -> Iterator[tuple[int | None, bytes]]:
    """(stamp, bytes) of the packets of the first video stream."""
    at, stream = 0, None
    while at + 4 <= len(data):
        if data[at : at + 3] != b"\0\0\1":
            raise ValueError(f"no start code at {at}")
        code = data[at + 3]
        if code == END:
            return
        if code == PACK:
            at += 12
            continue
        if at + 6 > len(data):
            return
        (size,) = struct.unpack_from(">H", data, at + 4)
        start, end = at + 6, at + 6 + size
        if end > len(data):
            raise ValueError("packet runs past the end")
        if 0xE0 <= code <= 0xEF and stream in (None, code):
            stream = code
            while start < end and data[start] == 0xFF:
                start += 1
            if start < end and data[start] >> 6 == 1:
                start += 2
            stamp = None
            if start < end and data[start] >> 4 in (2, 3):
                stamp = _stamp(data, start)
                start += 5 if data[start] >> 4 == 2 else 10
            elif start < end:
                start += 1
            yield stamp, data[start:end]
        at = end


def parse(data: bytes) -> Clip:
    parts, stamps, at = [], {}, 0
    for stamp, body in _payloads(data):
        if stamp is not None:
            stamps[at] = stamp
        parts.append(body)
        at += len(body)
    video = b"".join(parts)
    codes = [(m.start(), video[m.start() + 3]) for m in re.finditer(b"\0\0\1", video) if m.start() + 3 < len(video)]
    head = next((a for a, c in codes if c == SEQUENCE), None)
    if head is None or head + 8 > len(video):
        raise ValueError("no sequence header")
    size = int.from_bytes(video[head + 4 : head + 7], "big")
    num, den = RATES.get(video[head + 7] & 15, (0, 0))
    if not num or not size >> 12 or not size & 4095:
        raise ValueError("sequence header out of range")
    starts, begin = [], None
    for a, c in codes:
        if c in (SEQUENCE, GROUP, PICTURE) and begin is None:
            begin = a
        if c == PICTURE:
            starts.append((begin, a))
            begin = None
    edges = [b for b, _ in starts] + [len(video)]

    def packets() -> Iterator[Packet]:
        left, now = sorted(stamps), 0
        for n, (begin, picture) in enumerate(starts):
            stamp = None
            while left and left[0] <= picture:
                stamp = stamps[left.pop(0)]
            now = stamp * SECOND // CLOCK if stamp is not None else now + den * SECOND // num if n else 0
            if picture + 6 > len(video):
                raise ValueError("picture header cut off")
            yield Packet(n, now, video[picture + 5] >> 3 & 7 == 1, video[begin : edges[n + 1]])

    return Clip("mpeg1", size >> 12, size & 4095, packets(), 0xE0, num, den)


def build(packets: Sequence[Packet], width: int, height: int, rate: int = 3) -> bytes:
    """A small stream with one packet a picture and an audio packet between them. Payloads follow the picture header."""
    pes = lambda code, body: struct.pack(">3sBH", b"\0\0\1", code, len(body)) + body
    out = [b"\0\0\1\xba" + bytes([0x21, 0, 1, 0, 1, 0x80, 0, 1])]
    for p in packets:
        t = -(-p.pts_ns * CLOCK // SECOND)
        stamp = bytes([0x21 | t >> 29 & 14, t >> 22 & 255, t >> 14 & 254 | 1, t >> 7 & 255, t << 1 & 254 | 1])
        head = b"\0\0\1\xb3" + (width << 12 | height).to_bytes(3, "big") + bytes([0x10 | rate, 0, 0, 0, 0]) + b"\0\0\1\xb8\0\0\0\0" if p.is_key else b""
        out += [pes(0xC0, b"\x0fsound"), pes(0xE0, b"\xff\x60\x10" + stamp + head + b"\0\0\1\0" + bytes([0, (1 if p.is_key else 2) << 3, 0, 0]) + p.data)]
    return b"".join(out) + b"\0\0\1\xb9"
