"""WebM files: the blocks of the first video track as packets.

Walks the element tree once; tracks that aren't the chosen one are skipped, not decoded. A private configuration of
AV1, without its first four bytes, goes in front of the first key packet.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

from .packets import Clip, Packet

#: Element ids.
EBML, SEGMENT, INFO, SCALE, TRACKS, ENTRY = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x2AD7B1, 0x1654AE6B, 0xAE
NUMBER, KIND, CODEC, PRIVATE, DEFAULT, VIDEO, WIDTH, HEIGHT = 0xD7, 0x83, 0x86, 0x63A2, 0x23E383, 0xE0, 0xB0, 0xBA
CLUSTER, TIMECODE, SIMPLE, GROUP, BLOCK, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
NAMES = {"V_VP8": "vp8", "V_AV1": "av1"}
DEFAULT_SCALE = 1_000_000


def _number(data: bytes, at: int, keep_marker: bool) -> tuple[int, int, bool]:
    """(value, end, unknown) of a variable-length number."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"element number at {at}")
    size = 9 - data[at].bit_length()
    if at + size > len(data):
        raise ValueError("element cut off")
    value = int.from_bytes(data[at : at + size], "big")
    ones = (1 << (7 * size)) - 1
    return (value if keep_marker else value & ones), at + size, value & ones == ones


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of the elements in a range. One of unknown size reaches to the end."""
    while at < end:
        name, at, _ = _number(data, at, True)
        size, at, unknown = _number(data, at, False)
        stop = end if unknown else at + size
        if stop > end:
            stop = end  # a file that was cut off: what is there is read
        yield name, at, stop
        at = stop


def _uint(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def parse(data: bytes) -> Clip:
    scale, track = DEFAULT_SCALE, None
    segments = [(a, b) for name, a, b in elements(data, 0, len(data)) if name == SEGMENT]
    if not segments:
        raise ValueError("no segment")
    for name, a, b in elements(data, *segments[0]):
        if name == INFO:
            scale = next((_uint(data, x, y) for n, x, y in elements(data, a, b) if n == SCALE), DEFAULT_SCALE)
        elif name == TRACKS and track is None:
            for n, x, y in elements(data, a, b):
                own = {m: (p, q) for m, p, q in elements(data, x, y)} if n == ENTRY else {}
                if own and _uint(data, *own[KIND]) == 1:
                    track = own
                    break
        elif name == CLUSTER:
            break
    if track is None:
        raise ValueError("no video track")
    codec = NAMES.get(data[slice(*track[CODEC])].decode("ascii", "replace").rstrip("\0"))
    if codec is None:
        raise ValueError("unsupported codec")
    number = _uint(data, *track[NUMBER])
    picture = {m: _uint(data, p, q) for m, p, q in elements(data, *track[VIDEO])} if VIDEO in track else {}
    front = data[slice(*track[PRIVATE])][4:] if codec == "av1" and PRIVATE in track else b""
    period = _uint(data, *track[DEFAULT]) if DEFAULT in track else 0

    def packets() -> Iterator[Packet]:
        seq, ahead = 0, front
        for name, a, b in elements(data, *segments[0]):
            if name != CLUSTER:
                continue
            base = 0
            for n, x, y in elements(data, a, b):
                if n == TIMECODE:
                    base = _uint(data, x, y)
                    continue
                key = None
                if n == GROUP:
                    inner = list(elements(data, x, y))
                    key = not any(m == REFERENCE for m, _, _ in inner)
                    x, y = next(((p, q) for m, p, q in inner if m == BLOCK), (x, x))
                elif n != SIMPLE:
                    continue
                if x == y:
                    continue
                owner, at, _ = _number(data, x, False)
                if owner != number:
                    continue
                (offset,) = struct.unpack_from(">h", data, at)
                flags = data[at + 2]
                if flags & 6:
                    raise ValueError("laced video block")
                is_key = bool(flags & 128) if key is None else key
                body = data[at + 3 : y]
                if is_key and ahead:
                    body, ahead = ahead + body, b""
                yield Packet(seq, (base + offset) * scale, is_key, body)
                seq += 1

    return Clip(codec, picture.get(WIDTH, 0), picture.get(HEIGHT, 0), packets(), number, 1_000_000_000 if period else 0, period or 1)


def element(name: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + (len(body) | 1 << 56).to_bytes(8, "big") + body


def uint(name: int, v: int) -> bytes:
    return element(name, v.to_bytes(max(1, (v.bit_length() + 7) // 8), "big"))


def build(packets: Sequence[Packet], width: int, height: int, scale: int = DEFAULT_SCALE, codec: str = "V_VP8", other: bytes = b"sound") -> bytes:
    """A small file with a second, non-video track. A cluster starts at each key packet, or where offsets run out."""
    video = element(VIDEO, uint(WIDTH, width), uint(HEIGHT, height))
    tracks = element(TRACKS, element(ENTRY, uint(NUMBER, 2), uint(KIND, 2), element(CODEC, b"A_OPUS")), element(ENTRY, uint(NUMBER, 1), uint(KIND, 1), element(CODEC, codec.encode()), video))
    clusters: list[list[bytes]] = []
    base = 0
    for p in packets:
        t = p.pts_ns // scale
        if p.is_key or not clusters or not -32768 <= t - base <= 32767:
            base = t
            clusters.append([uint(TIMECODE, t), element(SIMPLE, b"\x82", struct.pack(">hB", 0, 128), other)])
        clusters[-1].append(element(SIMPLE, b"\x81", struct.pack(">hB", t - base, 128 * p.is_key), p.data))
    return element(EBML, uint(0x4286, 1)) + element(SEGMENT, element(INFO, uint(SCALE, scale)), tracks, *[element(CLUSTER, *c) for c in clusters])
