"""ISO base media files: the first video track's samples as packets.

Handles avc1 and av01. Sample times are decode time plus composition offset. Parameter sets (all of them) or the
configuration units go in front of key samples, with a length field of the size that the configuration states.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

from .packets import Clip, Packet

SECOND = 1_000_000_000
_PARENTS = {b"moov", b"trak", b"mdia", b"minf", b"stbl"}


def boxes(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start, end) of the payloads of the boxes in a range."""
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, at + 8)
            head = 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError(f"box {kind!r} of {size} bytes at {at}")
        yield kind, at + head, at + size
        at += size


def _tree(data: bytes, at: int, end: int) -> dict[bytes, list[tuple[int, int]]]:
    out: dict[bytes, list[tuple[int, int]]] = {}
    for kind, a, b in boxes(data, at, end):
        out.setdefault(kind, []).append((a, b))
        if kind in _PARENTS and kind != b"trak":
            for k, v in _tree(data, a, b).items():
                out.setdefault(k, []).extend(v)
    return out


def _runs(data: bytes, span: tuple[int, int] | None, code: str) -> list[tuple[int, ...]]:
    """The entries of a table with a version, flags and a count."""
    if span is None:
        return []
    (n,) = struct.unpack_from(">I", data, span[0] + 4)
    if span[0] + 8 + n * struct.calcsize(code) > span[1]:
        raise ValueError("sample table cut off")
    return [struct.unpack_from(code, data, span[0] + 8 + i * struct.calcsize(code)) for i in range(n)]


def _config(data: bytes, a: int, b: int) -> tuple[str, int, int, int, bytes]:
    """(codec, width, height, bytes of a length field, what goes in front of key samples)."""
    for kind, x, y in boxes(data, a + 8, b):
        if kind not in (b"avc1", b"av01"):
            continue
        width, height = struct.unpack_from(">HH", data, x + 24)
        inner = {k: data[p:q] for k, p, q in boxes(data, x + 78, y)}
        if kind == b"av01":
            return "av1", width, height, 0, inner.get(b"av1C", b"")[4:]
        c = inner.get(b"avcC", b"")
        if len(c) < 7:
            raise ValueError("no decoder configuration")
        size, at, sets = (c[4] & 3) + 1, 6, []
        for n in (c[5] & 31, None):
            if n is None:
                n, at = c[at], at + 1
            for _ in range(n):
                (length,) = struct.unpack_from(">H", c, at)
                sets.append(length.to_bytes(size, "big") + c[at + 2 : at + 2 + length])
                at += 2 + length
        return "h264", width, height, size, b"".join(sets)
    raise ValueError("no supported video track")


def parse(data: bytes) -> Clip:
    top = _tree(data, 0, len(data))
    for a, b in top.get(b"trak", []):
        t = _tree(data, a, b)
        one = lambda k, t=t: t[k][0] if k in t else None
        handler = one(b"hdlr")
        if handler is None or data[handler[0] + 8 : handler[0] + 12] != b"vide":
            continue
        codec, width, height, _, front = _config(data, *t[b"stsd"][0])
        head = t[b"mdhd"][0][0]
        scale, length = struct.unpack_from(">IQ", data, head + 20) if data[head] == 1 else struct.unpack_from(">II", data, head + 12)
        fixed, n = struct.unpack_from(">II", data, t[b"stsz"][0][0] + 4)
        sizes = [fixed] * n if fixed else [s for (s,) in struct.iter_unpack(">I", data[t[b"stsz"][0][0] + 12 : t[b"stsz"][0][0] + 12 + 4 * n])]
        decode, now = [], 0
        for count, delta in _runs(data, one(b"stts"), ">II"):
            for _ in range(count):
                decode.append(now)
                now += delta
        shift = [o for count, o in _runs(data, one(b"ctts"), ">Ii") for _ in range(count)] or [0] * n
        sync = None if one(b"stss") is None else {s for (s,) in _runs(data, one(b"stss"), ">I")}
        chunks = [o for (o,) in _runs(data, one(b"stco"), ">I") or _runs(data, one(b"co64"), ">Q")]
        places = _places(chunks, _runs(data, one(b"stsc"), ">III"), sizes)
        if min(len(decode), len(shift), len(places)) < n:
            raise ValueError("sample tables disagree")

        def packets() -> Iterator[Packet]:
            for i in range(n):
                key = sync is None or i + 1 in sync
                body = data[places[i] : places[i] + sizes[i]]
                if len(body) < sizes[i]:
                    raise ValueError(f"sample {i + 1} runs past the end")
                yield Packet(i, (decode[i] + shift[i]) * SECOND // scale, key, (front if key else b"") + body)

        return Clip(codec, width, height, packets(), 1, n * scale, max(1, length))
    raise ValueError("no video track")


def _places(chunks: Sequence[int], runs: Sequence[tuple[int, ...]], sizes: Sequence[int]) -> list[int]:
    out: list[int] = []
    for k, (first, per, _) in enumerate(runs):
        last = runs[k + 1][0] - 1 if k + 1 < len(runs) else len(chunks)
        for chunk in chunks[first - 1 : last]:
            at = chunk
            for _ in range(per):
                if len(out) == len(sizes):
                    return out
                out.append(at)
                at += sizes[len(out) - 1]
    return out


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def build(packets: Sequence[Packet], width: int, height: int, scale: int = 1_000_000, sps: bytes = b"\x67\x42\x00\x0a", pps: bytes = b"\x68\xce", per_chunk: int = 3) -> bytes:
    """A small avc1 file. Packets are stored in order; their times become decode times plus offsets."""
    table = lambda kind, rows, code: box(kind, struct.pack(">II", 0, len(rows)), *[struct.pack(code, *r) for r in rows])
    head = box(b"ftyp", b"isom\0\0\0\0isom")
    times = [p.pts_ns * scale // SECOND for p in packets]
    start = len(head) + 8
    chunks, at = [], start
    for i, p in enumerate(packets):
        if i % per_chunk == 0:
            chunks.append((at,))
        at += len(p.data)
    base = min(times, default=0)
    avcc = bytes([1, 66, 0, 10, 255, 225]) + struct.pack(">H", len(sps)) + sps + b"\x01" + struct.pack(">H", len(pps)) + pps
    entry = box(b"avc1", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HH", width, height), bytes(50), box(b"avcC", avcc))
    rest = len(packets) % per_chunk
    runs = [(1, per_chunk, 1)] if len(packets) >= per_chunk else []
    if rest:
        runs.append((len(chunks), rest, 1))
    stbl = box(
        b"stbl", box(b"stsd", struct.pack(">II", 0, 1), entry), table(b"stts", [(len(packets), 1)], ">II"), table(b"ctts", [(1, t - i) for i, t in enumerate(t - base for t in times)], ">Ii"),
        table(b"stss", [(i + 1,) for i, p in enumerate(packets) if p.is_key], ">I"), table(b"stsc", runs, ">III"), box(b"stsz", struct.pack(">III", 0, 0, len(packets)), *[struct.pack(">I", len(p.data)) for p in packets]), table(b"stco", chunks, ">I"),
    )
    mdia = box(b"mdia", box(b"mdhd", struct.pack(">IIIIII", 0, 0, 0, scale, len(packets), 0)), box(b"hdlr", bytes(8), b"vide", bytes(13)), box(b"minf", stbl))
    return head + struct.pack(">I4s", 8 + at - start, b"mdat") + b"".join(p.data for p in packets) + box(b"moov", box(b"trak", mdia))
