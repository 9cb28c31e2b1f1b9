"""The interleaved range coder of asymmetric numeral systems, on 12-bit frequency tables."""

from __future__ import annotations

from collections.abc import Sequence

#: States, bits of a table, lower bound of a state.
STATES, BITS, LOWER = 4, 12, 1 << 23
SLOTS = 1 << BITS


class Table:
    def __init__(self, freq: Sequence[int]) -> None:
        if any(f < 0 or f > SLOTS for f in freq) or sum(freq) != SLOTS:
            raise ValueError(f"frequencies sum to {sum(freq)}")
        self.freq, self.start = list(freq), [0] * len(freq)
        self.symbol: list[int] = []
        for s, f in enumerate(freq):
            self.start[s] = len(self.symbol)
            self.symbol += [s] * f


def encode(tokens: Sequence[tuple[int, int]], tables: Sequence[Table]) -> bytes:
    """Bytes for (context, symbol) pairs. They are folded in from the last to the first; token j is held by state j mod 4."""
    out = bytearray()
    states = [LOWER] * STATES
    for j in range(len(tokens) - 1, -1, -1):
        ctx, sym = tokens[j]
        f, x = tables[ctx].freq[sym], states[j % STATES]
        if not f:
            raise ValueError(f"symbol {sym} has no frequency in context {ctx}")
        while x >= (LOWER >> BITS << 8) * f:
            out.append(x & 255)
            x >>= 8
        states[j % STATES] = (x // f << BITS) + x % f + tables[ctx].start[sym]
    for x in states:
        out += x.to_bytes(4, "little")
    return bytes(out)


class Decoder:
    """Reads what `encode` wrote, from its end."""

    def __init__(self, data: bytes, tables: Sequence[Table]) -> None:
        if len(data) < 4 * STATES:
            raise ValueError("stream too short")
        self.data, self.at, self.tables, self.turn = data, len(data) - 4 * STATES, tables, 0
        self.states = [int.from_bytes(data[self.at + 4 * k : self.at + 4 * k + 4], "little") for k in range(STATES)]

    def next(self, ctx: int) -> int:
        table, k = self.tables[ctx], self.turn % STATES
        self.turn += 1
        x = self.states[k]
        slot = x & (SLOTS - 1)
        sym = table.symbol[slot]
        x = table.freq[sym] * (x >> BITS) + slot - table.start[sym]
        while x < LOWER:
            if not self.at:
                raise ValueError("stream ran out")
            self.at -= 1
            x = x << 8 | self.data[self.at]
        self.states[k] = x
        return sym


def encode_all(symbols: Sequence[int], table: Table) -> bytes:
    """The bytes of `encode` for symbols of one context, by the same steps without a call or a lookup of tables a symbol."""
    freq, start, limit = table.freq, table.start, [(LOWER >> BITS << 8) * f for f in table.freq]
    out, states = bytearray(), [LOWER] * STATES
    put = out.append
    k = len(symbols) % STATES
    for sym in reversed(symbols):
        k = (k or STATES) - 1
        x, f = states[k], freq[sym]
        if not f:
            raise ValueError(f"symbol {sym} has no frequency")
        while x >= limit[sym]:
            put(x & 255)
            x >>= 8
        states[k] = (x // f << BITS) + x % f + start[sym]
    for x in states:
        out += x.to_bytes(4, "little")
    return bytes(out)


def decode_all(data: bytes, table: Table, n: int) -> list[int]:
    """The first n symbols of one context, as by `Decoder.next`."""
    d = Decoder(data, [table])
    states, at, symbol = d.states, d.at, table.symbol
    freq, start, mask = table.freq, table.start, SLOTS - 1
    out, k = [], 0
    put = out.append
    for _ in range(n):
        x = states[k]
        slot = x & mask
        sym = symbol[slot]
        x = freq[sym] * (x >> BITS) + slot - start[sym]
        while x < LOWER:
            if not at:
                raise ValueError("stream ran out")
            at -= 1
            x = x << 8 | data[at]
        states[k] = x
        k = k + 1 & STATES - 1
        put(sym)
    return out
