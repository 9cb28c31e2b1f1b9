"""Bit-level readers and writers of video headers."""

from __future__ import annotations


class Bits:
    """Most significant bit first. Reading past the end raises EOFError."""

    def __init__(self, data: bytes) -> None:
        self.value, self.size, self.at = int.from_bytes(data, "big"), len(data) * 8, 0

    def u(self, n: int) -> int:
        if self.at + n > self.size:
            raise EOFError("bits ran out")
        self.at += n
        return (self.value >> (self.size - self.at)) & ((1 << n) - 1)

    def flag(self) -> bool:
        return bool(self.u(1))

    def ue(self) -> int:
        left = self.size - self.at
        rest = self.value & ((1 << left) - 1)
        zeros = left - rest.bit_length()
        if zeros > 32:
            raise ValueError("exponential Golomb code too long")
        n = 2 * zeros + 1
        if n > left:
            raise EOFError("bits ran out")
        self.at += n
        return (rest >> (left - n)) - 1

    def se(self) -> int:
        k = self.ue()
        return (k + 1) // 2 if k % 2 else -(k // 2)

    def te(self, most: int) -> int:
        return self.ue() if most > 1 else 1 - self.u(1)

    def su(self, n: int) -> int:
        v = self.u(n)
        return v - (1 << n) if v >> (n - 1) else v

    def uvlc(self) -> int:
        zeros = 0
        while not self.u(1):
            zeros += 1
            if zeros >= 32:
                return (1 << 32) - 1
        return (1 << zeros) - 1 + self.u(zeros)

    def ns(self, n: int) -> int:
        """Non-symmetric code of a number below n."""
        w = n.bit_length()
        short = (1 << w) - n
        v = self.u(w - 1)
        return v if v < short else (v << 1) - short + self.u(1)

    def more_rbsp(self) -> bool:
        """Whether anything but the stop bit and its zeros is left."""
        rest = self.value & ((1 << (self.size - self.at)) - 1)
        return rest != 0 and rest & (rest - 1) != 0


class BitWriter:
    def __init__(self) -> None:
        self.value = self.size = 0

    def u(self, v: int, n: int) -> BitWriter:
        self.value, self.size = self.value << n | v, self.size + n
        return self

    def ue(self, v: int) -> BitWriter:
        n = (v + 1).bit_length()
        return self.u(v + 1, 2 * n - 1)

    def se(self, v: int) -> BitWriter:
        return self.ue(2 * v - 1 if v > 0 else -2 * v)

    def bytes(self, stop: bool = False) -> bytes:
        value, size = (self.value << 1 | 1, self.size + 1) if stop else (self.value, self.size)
        pad = -size % 8
        return (value << pad).to_bytes((size + pad) // 8, "big")


def leb128(v: int) -> bytes:
    out = bytearray()
    while v > 127:
        out.append(v & 127 | 128)
        v >>= 7
    return bytes(out + bytes([v]))


def read_leb128(data: bytes, at: int, longest: int = 8) -> tuple[int, int]:
    """The value at `at`, and where it ends."""
    value = 0
    for i in range(longest):
        if at + i >= len(data):
            raise EOFError("base-128 number cut off")
        value |= (data[at + i] & 127) << (7 * i)
        if data[at + i] < 128:
            return value, at + i + 1
    raise ValueError("base-128 number too long")
