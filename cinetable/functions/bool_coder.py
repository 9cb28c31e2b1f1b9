"""The boolean coder of VP8: bits with 8-bit probabilities of zero, both directions."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import cycle, islice


#: Shifts that bring a range of 1 to 255 to 128 or more.
_SHIFTS = [0] + [8 - r.bit_length() for r in range(1, 256)]


class BoolWriter:
    """Range coding with exact carries. `low` holds the interval's low end from the last whole byte on, `out` what lies
    before; a carry out of `low` runs up the bytes, so time is linear in the bits."""

    #: Bits of `low` that are kept before whole bytes leave it.
    KEPT = 256

    def __init__(self) -> None:
        self.low, self.range, self.shifts, self.out, self.held = 0, 255, 0, bytearray(), 0

    def bit(self, value: int, prob: int = 128) -> None:
        self.run((value,), (prob,))

    def run(self, bits: Sequence[int], probs: Sequence[int]) -> None:
        """Bits with probabilities taken in turn, from the first on."""
        low, span, held, shifts = self.low, self.range, self.held, _SHIFTS
        for value, prob in zip(bits, cycle(probs)):
            split = 1 + ((span - 1) * prob >> 8)
            if value:
                low += split
                span -= split
            else:
                span = split
            if span < 128:
                n = shifts[span]
                low <<= n
                span <<= n
                held += n
                if held >= self.KEPT:
                    low, held = self._leave(low, held)
        self.shifts += held - self.held
        self.low, self.range, self.held = low, span, held

    def _leave(self, low: int, held: int) -> tuple[int, int]:
        """Moves whole bytes out of low, which holds `held` shifted bits and eight more."""
        n = held // 8
        top = low >> (held + 8 - 8 * n)
        if top >> 8 * n:  # a carry
            top -= 1 << 8 * n
            at = len(self.out) - 1
            while self.out[at] == 255:
                self.out[at] = 0
                at -= 1
            self.out[at] += 1
        self.out += top.to_bytes(n, "big")
        self.shifts += 8 * n
        return low & ((1 << (held + 8 - 8 * n)) - 1), held - 8 * n

    def literal(self, value: int, n: int) -> None:
        for k in range(n - 1, -1, -1):
            self.bit(value >> k & 1)

    def bytes(self) -> bytes:
        """The low end of the interval, eight bits before the shifts."""
        size = self.held + 8
        pad = -size % 8
        n, value, out = (size + pad) // 8, self.low << pad, self.out
        carry = value >> 8 * n
        before = int.from_bytes(out, "big") + carry if carry else None
        return (before.to_bytes(len(out), "big") if carry else bytes(out)) + (value - (carry << 8 * n)).to_bytes(n, "big")


class BoolReader:
    """Zeros follow the end of the data."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.range, self.left = data, 2, 255, 8
        self.value = int.from_bytes(data[:2].ljust(2, b"\0"), "big")

    def bit(self, prob: int = 128) -> int:
        split = 1 + ((self.range - 1) * prob >> 8)
        out = int(self.value >= split << 8)
        if out:
            self.value, self.range = self.value - (split << 8), self.range - split
        else:
            self.range = split
        while self.range < 128:
            self.value, self.range, self.left = self.value << 1, self.range << 1, self.left - 1
            if not self.left:
                self.value |= self.data[self.at] if self.at < len(self.data) else 0
                self.at, self.left = self.at + 1, 8
        return out

    def run(self, n: int, probs: Sequence[int]) -> list[int]:
        """n bits with probabilities taken in turn, as by `bit`."""
        span, value, left, at, data, shifts = self.range, self.value, self.left, self.at, self.data, _SHIFTS
        out: list[int] = []
        put, size = out.append, len(data)
        for prob in islice(cycle(probs), n):
            split = 1 + ((span - 1) * prob >> 8)
            if value >= split << 8:
                put(1)
                value -= split << 8
                span -= split
            else:
                put(0)
                span = split
            if span < 128:
                k = shifts[span]
                span <<= k
                value <<= k
                left -= k
                if left <= 0:  # the byte's place is where the shift passed its end
                    value |= (data[at] if at < size else 0) << -left
                    at += 1
                    left += 8
        self.range, self.value, self.left, self.at = span, value, left, at
        return out

    def literal(self, n: int) -> int:
        out = 0
        for _ in range(n):
            out = out << 1 | self.bit()
        return out
