"""The transform-coded modes of the indexed container: intra and inter pictures, decoder and encoder.

One walk over the syntax serves both directions. It talks to a channel: a `Sink` notes the symbols that the encoder
chose, a `Source` returns those of the stream; whatever follows from a symbol, reconstruction included, is the same
code. So the two sides can't drift apart.

Planes are numpy arrays, padded to whole macroblocks. A picture refers to the one before it and to the key picture of
its group ("golden"), or to what the key packet carries in its place. Tiles share frequency tables and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np

from ..functions.rans import SLOTS, Decoder, Table, encode
from ..functions.samples import DCT_BITS, dct_matrix, steps, zigzag
from ..sources.bits import leb128, read_leb128
from .tokens import repaired

#: Fixed values of the format: block sizes, contexts and their alphabets, filters and angles.
MB, SIZES, MIDDLE = 16, (4, 8, 16), 128
DC, ACROSS_DOWN, ACROSS, GRADIENT = 0, 1, 2, 3  # flat, vertical, horizontal, gradient; 4 to 9 are directions
ANGLES = {4: (32, True), 5: (13, True), 6: (-13, True), 7: (32, False), 8: (13, False), 9: (-13, False)}
INVERSE_ANGLE, MODES = -630, 10
SKIP, MOVED, INTRA_MB = 0, 1, 2
PARTS = [[(0, 0, 16, 16)], [(0, 0, 16, 8), (0, 8, 16, 8)], [(0, 0, 8, 16), (8, 0, 8, 16)], [(0, 0, 8, 8), (8, 0, 8, 8), (0, 8, 8, 8), (8, 8, 8, 8)]]
(TX, LUMA_MODE, CHROMA_MODE, MB_MODE, REF, PART, CODED, SIGN, ESCAPE_CLASS, MV_X, MV_Y, BYPASS) = range(12)
ALPHABETS = [3, MODES, MODES, 3, 2, 4, 8, 2, 16, 16, 16, 2] + [7] * 60
ESCAPE, END = 5, 6
HIDE_SPAN, MV_REACH = 4, 1 << 13
TAPS = np.array([[0, 64, 0, 0], [-6, 55, 18, -3], [-8, 40, 40, -8], [-3, 18, 55, -6]], np.int64)
UNUSED, SAME, FULL, DELTA = range(4)

_SCAN = {n: np.array(zigzag(n)) for n in SIZES}
_DCT = {n: np.array(dct_matrix(n), np.int64) for n in SIZES}
_HALF = 1 << (DCT_BITS - 1)
_BAND = [0, 1, 1, *[2] * 6, *[3] * 12]


def forward(block: np.ndarray) -> np.ndarray:
    m = _DCT[len(block)]
    return ((((m @ block + _HALF) >> DCT_BITS) @ m.T) + _HALF) >> DCT_BITS


def inverse(block: np.ndarray) -> np.ndarray:
    m = _DCT[len(block)]
    return ((((m.T @ block + _HALF) >> DCT_BITS) @ m) + _HALF) >> DCT_BITS


# -- channels -----------------------------------------------------------------------------------------------------


class Sink:
    def __init__(self) -> None:
        self.tokens: list[tuple[int, int]] = []

    def symbol(self, ctx: int, value: int) -> int:
        self.tokens.append((ctx, value))
        return value


class Source:
    def __init__(self, data: bytes, tables: Sequence[Table | None]) -> None:
        self.decoder, self.tables = Decoder(data, tables), tables  # type: ignore[arg-type]

    def symbol(self, ctx: int, value: int = 0) -> int:
        if self.tables[ctx] is None:
            raise ValueError(f"context {ctx} has no table")
        return self.decoder.next(ctx)


Channel = Sink | Source


def number(ch: Channel, ctx: int, value: int = 0) -> int:
    """A non-negative number: its bit length, then the bits after the first."""
    size = ch.symbol(ctx, value.bit_length())
    out = 1 if size else 0
    for k in range(size - 2, -1, -1):
        out = out << 1 | ch.symbol(BYPASS, value >> k & 1)
    return out


def signed(ch: Channel, ctx: int, value: int = 0) -> int:
    u = number(ch, ctx, 2 * value if value >= 0 else -2 * value - 1)
    return u >> 1 if u % 2 == 0 else -(u >> 1) - 1


def token_context(chroma: bool, tx: int, at: int, before: int) -> int:
    band = _BAND[at] if at < len(_BAND) else 4
    return 12 + (45 + band * 3 if chroma else (tx * 5 + band) * 3) + before


def residual(ch: Channel, chroma: bool, tx: int, n: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """The levels of a block. A span of at least HIDE_SPAN hides the first sign in the parity of all sizes."""
    scan = _SCAN[n]
    line = [0] * (n * n) if wanted is None else wanted.reshape(-1)[scan].tolist()
    used = [i for i, v in enumerate(line) if v]
    first, last, total, before = -1, -1, 0, 0
    for i in range(n * n):
        size = abs(line[i])
        token = ch.symbol(token_context(chroma, tx, i, before), END if wanted is not None and (not used or i > used[-1]) else min(size, ESCAPE))
        if token == END:
            break
        if token == ESCAPE:
            size = ESCAPE + number(ch, ESCAPE_CLASS, size - ESCAPE)
        elif wanted is None:
            size = token
        before = min(size, 2)
        if size:
            total, last = total + size, i
            if first < 0:
                first = i
                line[i] = size if wanted is None else line[i]
            else:
                line[i] = -size if ch.symbol(SIGN, int(line[i] < 0)) else size
    if first >= 0:
        negative = total % 2 == 1 if last - first >= HIDE_SPAN else bool(ch.symbol(SIGN, int(line[first] < 0)))
        line[first] = -abs(line[first]) if negative else abs(line[first])
    out = np.zeros(n * n, np.int64)
    out[scan] = line
    return out.reshape(n, n)


def with_hidden_sign(levels: np.ndarray) -> np.ndarray:
    """Levels whose parity tells the first sign, by a change of one where it doesn't; the span stays."""
    n = len(levels)
    line = levels.reshape(-1)[_SCAN[n]]
    used = np.flatnonzero(line)
    if not len(used) or used[-1] - used[0] < HIDE_SPAN or np.abs(line).sum() % 2 == (line[used[0]] < 0):
        return levels
    inner = line[used[0] + 1 : used[-1]]
    large = np.flatnonzero(np.abs(line) > 1)
    empty = np.flatnonzero(inner == 0)
    if len(large):
        at = int(large[-1])
        line[at] -= np.sign(line[at])
    elif len(empty):
        line[used[0] + 1 + int(empty[-1])] = 1
    else:
        line[used[-1]] += np.sign(line[used[-1]])
    out = np.zeros(n * n, np.int64)
    out[_SCAN[n]] = line
    return out.reshape(n, n)


def trimmed(levels: np.ndarray, coeffs: np.ndarray, step: np.ndarray, bits: Sequence[Sequence[float]], lam: float, chroma: bool, tx: int) -> np.ndarray:
    """Levels cut where the last ones cost more bits than they save error; costs are those of a first pass.

    One run along the scan sums the error of what is kept, the error of dropping the rest, and the bits so far.
    """
    scan = _SCAN[len(levels)]
    line, want, size = levels.reshape(-1)[scan], coeffs.reshape(-1)[scan], step.reshape(-1)[scan]
    used = np.flatnonzero(line)
    if not len(used):
        return levels
    drop = np.append(np.cumsum((want**2)[::-1])[::-1], 0)
    rate, kept, before, best = 0.0, 0.0, 0, (float(drop[0]) + lam * bits[token_context(chroma, tx, 0, 0)][END], 0)
    for i in range(int(used[-1]) + 1):
        mag = abs(int(line[i]))
        rate += bits[token_context(chroma, tx, i, before)][min(mag, ESCAPE)] + (mag > 0)
        if mag >= ESCAPE:
            c = (mag - ESCAPE).bit_length()
            rate += bits[ESCAPE_CLASS][c] + max(0, c - 1)
        kept += float((want[i] - line[i] * size[i]) ** 2)
        before = min(mag, 2)
        if mag:
            end = bits[token_context(chroma, tx, i + 1, before)][END] if i + 1 < len(line) else 0.0
            best = min(best, (kept + float(drop[i + 1]) + lam * (rate + end), i + 1))
    line[best[1] :] = 0
    out = np.zeros(len(line), np.int64)
    out[scan] = line
    return out.reshape(levels.shape)


# -- prediction ---------------------------------------------------------------------------------------------------


def intra(plane: np.ndarray, x: int, y: int, n: int, mode: int, above: bool, left: bool, above_right: bool) -> np.ndarray:
    """Prediction of an n x n block from a line of 4n + 1 neighbours: left from the bottom up, corner, above."""
    line = np.full(4 * n + 1, -1, np.int64)
    if left:
        line[n : 2 * n] = plane[y : y + n, x - 1][::-1]
    if above and left:
        line[2 * n] = plane[y - 1, x - 1]
    if above:
        reach = 2 * n if above_right else n
        line[2 * n + 1 : 2 * n + 1 + reach] = plane[y - 1, x : x + reach]
    known = np.flatnonzero(line >= 0)
    if not len(known):
        line[:] = MIDDLE
    else:  # a gap takes the sample before it, the first gap the first sample
        source = np.maximum.accumulate(np.where(line >= 0, np.arange(len(line)), -1))
        line = line[np.where(source < 0, known[0], source)]
    c = 2 * n
    top, side = line[c + 1 : c + 1 + n], line[c - 1 : c - 1 - n : -1]
    if mode == ACROSS_DOWN:
        return np.tile(top, (n, 1))
    if mode == ACROSS:
        return np.tile(side[:, None], (1, n))
    if mode == GRADIENT:
        return np.clip(top[None, :] + side[:, None] - line[c], 0, 255)
    if mode == DC:
        return np.full((n, n), (top.sum() + side.sum() + n) // (2 * n))
    angle, down = ANGLES[mode]
    main = line[c:] if down else line[c::-1]
    other = line[c::-1] if down else line[c:]
    reach = -((n * angle) >> 5) if angle < 0 else 0
    ahead = [other[(-k * INVERSE_ANGLE + 128) >> 8] for k in range(reach, 0, -1)]
    full = np.concatenate([np.array(ahead, np.int64), main, main[-1:]])
    move = (np.arange(n) + 1) * angle
    at = reach + np.arange(n)[None, :] + (move >> 5)[:, None] + 1
    part = (move & 31)[:, None]
    out = ((32 - part) * full[at] + part * full[np.minimum(at + 1, len(full) - 1)] + 16) >> 5
    return out if down else out.T


def _window(plane: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray:
    ys, xs = np.clip(np.arange(y, y + h), 0, plane.shape[0] - 1), np.clip(np.arange(x, x + w), 0, plane.shape[1] - 1)
    return plane[np.ix_(ys, xs)].astype(np.int64)


def moved_luma(plane: np.ndarray, x: int, y: int, w: int, h: int, mv: tuple[int, int]) -> np.ndarray:
    fx, fy = mv[0] & 3, mv[1] & 3
    near = _window(plane, x + (mv[0] >> 2) - 1, y + (mv[1] >> 2) - 1, w + 3, h + 3)
    rows = near[:, 1 : w + 1] * 64 if not fx else sum(TAPS[fx][k] * near[:, k : k + w] for k in range(4))
    if not fx and not fy:
        return near[1 : h + 1, 1 : w + 1]
    if not fy:
        return np.clip((rows[1 : h + 1] + 32) >> 6, 0, 255)
    if not fx:
        return np.clip((sum(TAPS[fy][k] * near[k : k + h, 1 : w + 1] for k in range(4)) + 32) >> 6, 0, 255)
    return np.clip((sum(TAPS[fy][k] * rows[k : k + h] for k in range(4)) + 2048) >> 12, 0, 255)


def moved_chroma(plane: np.ndarray, x: int, y: int, w: int, h: int, mv: tuple[int, int]) -> np.ndarray:
    fx, fy = mv[0] & 7, mv[1] & 7
    near = _window(plane, x + (mv[0] >> 3), y + (mv[1] >> 3), w + 1, h + 1)
    top = (8 - fx) * near[:-1, :-1] + fx * near[:-1, 1:]
    low = (8 - fx) * near[1:, :-1] + fx * near[1:, 1:]
    return ((8 - fy) * top + fy * low + 32) >> 6


# -- pictures -----------------------------------------------------------------------------------------------------

Planes = list[np.ndarray]


def blank(width: int, height: int) -> Planes:
    across, down = -(-width // MB), -(-height // MB)
    return [np.zeros((down * s, across * s), np.uint8) for s in (16, 8, 8)]


def padded(width: int, height: int, planes: tuple[bytes, bytes, bytes]) -> Planes:
    """Planes as arrays, edges repeated up to whole macroblocks."""
    out = blank(width, height)
    for k, data in enumerate(planes):
        w, h = (width, height) if k == 0 else ((width + 1) // 2, (height + 1) // 2)
        rows = np.frombuffer(data, np.uint8).reshape(h, w)
        out[k] = np.pad(rows, ((0, out[k].shape[0] - h), (0, out[k].shape[1] - w)), mode="edge")
    return out


def cropped(planes: Planes, width: int, height: int) -> tuple[bytes, bytes, bytes]:
    w, h = (width + 1) // 2, (height + 1) // 2
    return planes[0][:height, :width].tobytes(), planes[1][:h, :w].tobytes(), planes[2][:h, :w].tobytes()


@dataclass
class State:
    """What a group carries from picture to picture."""

    last: Planes | None = None
    golden: Planes | None = None
    shipped: dict[int, list[int]] = field(default_factory=dict)


@dataclass
class Tile:
    x0: int
    x1: int
    y0: int
    y1: int


def tiles(across: int, down: int, cols: int, rows: int) -> list[Tile]:
    cols, rows = min(cols, across), min(rows, down)
    edge = lambda n, k, count: n * k // count
    return [Tile(edge(across, c, cols), edge(across, c + 1, cols), edge(down, r, rows), edge(down, r + 1, rows)) for r in range(rows) for c in range(cols)]


class Picture:
    """The syntax walk of one picture. `want` has the source planes when encoding, None when decoding."""

    def __init__(self, size: tuple[int, int], qp: int, state: State, inter: bool, want: Planes | None = None, bits: Sequence[Sequence[float]] | None = None) -> None:
        self.rec, self.state, self.inter, self.want, self.bits = blank(*size), state, inter, want, bits
        self.down, self.across = (s // MB for s in self.rec[0].shape)
        self.dc, self.ac = steps(qp)
        self.lam = self.ac * self.ac / 6
        self.mv = np.zeros((self.down, self.across, 2), np.int64)
        self.step = {n: np.where(np.arange(n * n).reshape(n, n) == 0, self.dc, self.ac) for n in SIZES}

    def walk(self, ch: Channel, tile: Tile) -> None:
        for my in range(tile.y0, tile.y1):
            for mx in range(tile.x0, tile.x1):
                self._macroblock(ch, tile, mx, my) if self.inter else self._intra(ch, tile, mx, my)

    # levels of a block of the source, or of the stream, and its samples
    def _levels(self, n: int, k: int, x: int, y: int, base: np.ndarray) -> np.ndarray:
        assert self.want is not None
        c = forward(self.want[k][y : y + n, x : x + n].astype(np.int64) - base)
        step = self.step[n]
        levels = np.sign(c) * ((np.abs(c) * 8 + 3 * step) // (step * 8))
        if self.bits is not None:
            levels = trimmed(levels, c, step, self.bits, self.lam, k > 0, SIZES.index(n))
        return with_hidden_sign(levels)

    def _put(self, ch: Channel, k: int, tx: int, n: int, x: int, y: int, base: np.ndarray, levels: np.ndarray | None) -> None:
        levels = residual(ch, k > 0, tx, n, levels)
        self.rec[k][y : y + n, x : x + n] = np.clip(base + inverse(levels * self.step[n]), 0, 255)

    def _open(self, tile: Tile, x: int, y: int, n: int, mx: int, my: int) -> tuple[bool, bool, bool]:
        """Which neighbours of a luma block are there: above, left, above to the right."""
        above = y > tile.y0 * MB
        right = above and x + 2 * n <= tile.x1 * MB and (y == my * MB or x + 2 * n <= (mx + 1) * MB)
        return above, x > tile.x0 * MB, right

    def _best_mode(self, k: int, x: int, y: int, n: int, near: tuple[bool, bool, bool]) -> int:
        if self.want is None:
            return 0
        src = self.want[k][y : y + n, x : x + n].astype(np.int64)
        return min(range(MODES), key=lambda m: (int(np.abs(src - intra(self.rec[k], x, y, n, m, *near)).sum()) + self.ac * (m > 0), m))

    def _intra_luma(self, ch: Channel, tile: Tile, mx: int, my: int, tx: int) -> None:
        n = SIZES[tx]
        for y in range(my * MB, my * MB + MB, n):
            for x in range(mx * MB, mx * MB + MB, n):
                near = self._open(tile, x, y, n, mx, my)
                mode = ch.symbol(LUMA_MODE, self._best_mode(0, x, y, n, near))
                base = intra(self.rec[0], x, y, n, mode, *near)
                self._put(ch, 0, tx, n, x, y, base, None if self.want is None else self._levels(n, 0, x, y, base))

    def _intra(self, ch: Channel, tile: Tile, mx: int, my: int) -> None:
        tx = ch.symbol(TX, 0 if self.want is None else min(range(3), key=lambda t: self._cost(tile, mx, my, t)))
        self._intra_luma(ch, tile, mx, my, tx)
        x, y, near = mx * 8, my * 8, (my > tile.y0, mx > tile.x0, False)
        mode = ch.symbol(CHROMA_MODE, self._best_mode(1, x, y, 8, near))
        for k in (1, 2):
            base = intra(self.rec[k], x, y, 8, mode, *near)
            self._put(ch, k, 0, 8, x, y, base, None if self.want is None else self._levels(8, k, x, y, base))

    def _cost(self, tile: Tile, mx: int, my: int, tx: int) -> float:
        """Squared error plus weighted symbols of a macroblock's luma, tried and undone."""
        assert self.want is not None
        at = np.s_[my * MB : my * MB + MB, mx * MB : mx * MB + MB]
        before, trial = self.rec[0][at].copy(), Sink()
        self._intra_luma(trial, tile, mx, my, tx)
        error = ((self.rec[0][at].astype(np.int64) - self.want[0][at]) ** 2).sum()
        self.rec[0][at] = before
        return float(error) + self.lam * 2.0 * len(trial.tokens)

    def predicted(self, tile: Tile, mx: int, my: int) -> tuple[int, int]:
        """Median of the motion left, above and above to the right (to the left at the tile's edge)."""
        left = self.mv[my, mx - 1] if mx > tile.x0 else None
        up = self.mv[my - 1, mx] if my > tile.y0 else None
        corner = None if up is None else self.mv[my - 1, mx + 1] if mx + 1 < tile.x1 else self.mv[my - 1, mx - 1] if left is not None else None
        found = [v for v in (left, up, corner) if v is not None]
        if not found:
            return 0, 0
        if len(found) == 1:
            return int(found[0][0]), int(found[0][1])
        both = np.median(np.stack([v if v is not None else np.zeros(2, np.int64) for v in (left, up, corner)]), axis=0)
        return int(both[0]), int(both[1])

    def _move(self, ref: Planes, mx: int, my: int, part: int, mvs: Sequence[tuple[int, int]]) -> list[np.ndarray]:
        out = [np.zeros((s, s), np.int64) for s in (16, 8, 8)]
        for (x, y, w, h), mv in zip(PARTS[part], mvs, strict=True):
            out[0][y : y + h, x : x + w] = moved_luma(ref[0], mx * MB + x, my * MB + y, w, h, mv)
            for k in (1, 2):
                out[k][y // 2 : (y + h) // 2, x // 2 : (x + w) // 2] = moved_chroma(ref[k], mx * 8 + x // 2, my * 8 + y // 2, w // 2, h // 2, mv)
        return out

    def _store(self, mx: int, my: int, k: int, base: np.ndarray) -> None:
        s = len(base)
        self.rec[k][my * s : my * s + s, mx * s : mx * s + s] = base

    def _macroblock(self, ch: Channel, tile: Tile, mx: int, my: int) -> None:
        assert self.state.last is not None and self.state.golden is not None
        guess = self.predicted(tile, mx, my)
        mode, ref, mv = self._choose(tile, mx, my, guess) if self.want is not None else (0, 0, (0, 0))
        mode = ch.symbol(MB_MODE, mode)
        if mode == INTRA_MB:
            self._intra(ch, tile, mx, my)
            return
        if mode == SKIP:
            self.mv[my, mx] = guess
            for k, base in enumerate(self._move(self.state.last, mx, my, 0, [guess])):
                self._store(mx, my, k, base)
            return
        if mode != MOVED:
            raise ValueError(f"macroblock mode {mode}")
        ref = ch.symbol(REF, ref)
        part = ch.symbol(PART, 0)
        start = (0, 0) if ref else guess
        mvs: list[tuple[int, int]] = []
        for _ in PARTS[part]:
            base_mv = mvs[0] if mvs else start
            x, y = base_mv[0] + signed(ch, MV_X, mv[0] - base_mv[0]), base_mv[1] + signed(ch, MV_Y, mv[1] - base_mv[1])
            mvs.append((min(max(x, -MV_REACH), MV_REACH), min(max(y, -MV_REACH), MV_REACH)))
        self.mv[my, mx] = (0, 0) if ref else mvs[0]
        base = self._move(self.state.golden if ref else self.state.last, mx, my, part, mvs)
        self._moved_residual(ch, mx, my, base)

    def _moved_cost(self, mx: int, my: int, tx: int, base: np.ndarray, levels: list[np.ndarray]) -> float:
        """Squared error of a macroblock's luma with these levels, plus weighted coefficients."""
        assert self.want is not None
        n, left = SIZES[tx], self.want[0][my * MB : my * MB + MB, mx * MB : mx * MB + MB].astype(np.int64) - base
        places = [(y, x) for y in range(0, MB, n) for x in range(0, MB, n)]
        error = sum(int(((left[y : y + n, x : x + n] - inverse(b * self.step[n])) ** 2).sum()) for (y, x), b in zip(places, levels, strict=True))
        return error + self.lam * sum(np.count_nonzero(b) * 4 + 2 for b in levels)

    def _moved_residual(self, ch: Channel, mx: int, my: int, base: list[np.ndarray]) -> None:
        luma: list[np.ndarray] = []
        chroma: list[np.ndarray | None] = [None, None]
        coded = tx = 0
        if self.want is not None:
            options = {t: [self._levels(n, 0, mx * MB + x, my * MB + y, base[0][y : y + n, x : x + n]) for y in range(0, MB, n) for x in range(0, MB, n)] for t, n in enumerate(SIZES)}
            tx = min(options, key=lambda t: (self._moved_cost(mx, my, t, base[0], options[t]), t))
            luma = options[tx]
            chroma = [self._levels(8, k, mx * 8, my * 8, base[k]) for k in (1, 2)]
            coded = any(b.any() for b in luma) | bool(chroma[0].any()) << 1 | bool(chroma[1].any()) << 2  # type: ignore[union-attr]
        coded = ch.symbol(CODED, coded)
        if coded & 1:
            tx = ch.symbol(TX, tx)
            n = SIZES[tx]
            for i, (y, x) in enumerate((y, x) for y in range(0, MB, n) for x in range(0, MB, n)):
                self._put(ch, 0, tx, n, mx * MB + x, my * MB + y, base[0][y : y + n, x : x + n], luma[i] if luma else None)
        else:
            self._store(mx, my, 0, base[0])
        for k in (1, 2):
            if coded >> k & 1:
                self._put(ch, k, 0, 8, mx * 8, my * 8, base[k], chroma[k - 1])
            else:
                self._store(mx, my, k, base[k])

    def _choose(self, tile: Tile, mx: int, my: int, guess: tuple[int, int]) -> tuple[int, int, tuple[int, int]]:
        """Mode, reference and motion of a macroblock: skip if the guess is close enough, else the least SAD."""
        assert self.want is not None and self.state.last is not None and self.state.golden is not None
        src = self.want[0][my * MB : my * MB + MB, mx * MB : mx * MB + MB].astype(np.int64)
        still = self._move(self.state.last, mx, my, 0, [guess])
        error = sum(int(((self.want[k][my * len(b) : (my + 1) * len(b), mx * len(b) : (mx + 1) * len(b)] - b) ** 2).sum()) for k, b in enumerate(still))
        if error <= 8 * self.lam:
            return SKIP, 0, guess
        sad = lambda ref, mv: int(np.abs(src - moved_luma(ref, mx * MB, my * MB, MB, MB, mv)).sum())

        def search(ref: np.ndarray, start: tuple[int, int]) -> tuple[int, tuple[int, int]]:
            best = min((sad(ref, mv), mv) for mv in {(0, 0), start})
            for size in (16, 8, 4, 2, 1):  # quarter samples: the diamond shrinks when its centre is best
                while True:
                    x, y = best[1]
                    found = min((sad(ref, mv), mv) for mv in ((x + size, y), (x - size, y), (x, y + size), (x, y - size)) if max(map(abs, mv)) <= MV_REACH)
                    if found[0] >= best[0]:
                        break
                    best = found
            return best

        last, gold = search(self.state.last[0], guess), search(self.state.golden[0], (0, 0))
        ref = int(gold[0] < last[0])
        cost, mv = gold if ref else last
        flat = int(np.abs(src - src.mean().round().astype(np.int64)).sum())
        return (INTRA_MB, 0, (0, 0)) if flat < cost else (MOVED, ref, mv)


# -- packets ------------------------------------------------------------------------------------------------------


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value, at = read_leb128(data, at, 10)
    return value, at


def write_tables(freqs: dict[int, list[int]], shipped: dict[int, list[int]]) -> bytes:
    """Each context's frequencies: as before, as differences if shorter, or in full. `shipped` follows."""
    out = bytearray()
    for ctx in range(len(ALPHABETS)):
        new, old = freqs.get(ctx), shipped.get(ctx)
        if new is None or ctx == BYPASS:
            out.append(UNUSED)
            continue
        full = b"".join(map(leb128, new))
        diff = b"".join(leb128(2 * d if d >= 0 else -2 * d - 1) for d in (a - b for a, b in zip(new, old, strict=True))) if old else None
        out += bytes([SAME]) if new == old else bytes([DELTA]) + diff if diff is not None and len(diff) < len(full) else bytes([FULL]) + full
        shipped[ctx] = new
    return bytes(out)


def read_tables(data: bytes, shipped: dict[int, list[int]]) -> list[Table | None]:
    at, out = 0, []
    for ctx, size in enumerate(ALPHABETS):
        if at >= len(data):
            raise ValueError("tables cut off")
        mode, at = data[at], at + 1
        if ctx == BYPASS:
            if mode != UNUSED:
                raise ValueError("the bypass context ships no table")
            out.append(Table([SLOTS // 2] * 2))
            continue
        if mode == UNUSED:
            out.append(None)
            continue
        if mode not in (SAME, FULL, DELTA) or (mode != FULL and ctx not in shipped):
            raise ValueError(f"table mode {mode} of context {ctx}")
        if mode != SAME:
            freq = []
            for s in range(size):
                v, at = _varint(data, at)
                freq.append(v if mode == FULL else shipped[ctx][s] + (v >> 1 if v % 2 == 0 else -(v >> 1) - 1))
            shipped[ctx] = freq
        out.append(Table(shipped[ctx]))
    return out


def decode_body(body: bytes, size: tuple[int, int], state: State, key: bool, inter: bool) -> Planes:
    if not body or body[0] > 63:
        raise ValueError("quantiser out of range")
    if key:
        state.shipped.clear()
    qp = body[0]
    cols, at = _varint(body, 1)
    rows, at = _varint(body, at)
    n, at = _varint(body, at)
    if not cols or not rows or cols > 65535 or rows > 65535 or n > len(body) - at:
        raise ValueError("tile grid or tables out of range")
    tables = read_tables(body[at : at + n], state.shipped)
    at += n
    picture = Picture(size, qp, state, inter)
    for tile in tiles(picture.across, picture.down, cols, rows):
        n, at = _varint(body, at)
        if n > len(body) - at:
            raise ValueError("tile runs past the end")
        picture.walk(Source(body[at : at + n], tables), tile)
        at += n
    if at != len(body):
        raise ValueError("bytes after the last tile")
    return picture.rec


UNSEEN_BITS = 20.0


def costs(freqs: dict[int, list[int]]) -> list[list[float]]:
    """Bits of each symbol of each context under frequency tables."""
    return [[UNSEEN_BITS if ctx not in freqs or not f else float(np.log2(SLOTS / f)) for f in freqs.get(ctx, [0] * size)] for ctx, size in enumerate(ALPHABETS)]


def encode_body(want: Planes, size: tuple[int, int], state: State, qp: int, inter: bool, cols: int = 1, rows: int = 1, passes: int = 2) -> tuple[bytes, Planes]:
    """The body of a packet and the picture that a decoder will have.

    The second pass prices levels by what the first one measured.
    """
    if not inter:
        state.shipped.clear()
    bits: list[list[float]] | None = None
    for _ in range(passes):
        picture = Picture(size, qp, state, inter, want, bits)
        parts = tiles(picture.across, picture.down, cols, rows)
        sinks = [Sink() for _ in parts]
        for sink, tile in zip(sinks, parts, strict=True):
            picture.walk(sink, tile)
        counts: dict[int, list[int]] = {}
        for sink in sinks:
            for ctx, sym in sink.tokens:
                counts.setdefault(ctx, [0] * ALPHABETS[ctx])[sym] += 1
        freqs = {ctx: repaired(c) for ctx, c in counts.items()}
        bits = costs(freqs)
    table = write_tables(freqs, state.shipped)
    lookup = [Table(freqs[c]) if c in freqs and c != BYPASS else Table([SLOTS // 2] * 2) for c in range(len(ALPHABETS))]
    grid_cols, grid_rows = min(cols, picture.across), min(rows, picture.down)
    streams = [encode(sink.tokens, lookup) for sink in sinks]
    body = bytes([qp]) + leb128(grid_cols) + leb128(grid_rows) + leb128(len(table)) + table + b"".join(leb128(len(s)) + s for s in streams)
    return body, picture.rec


def decode_coded(state: State, size: tuple[int, int], body: bytes, key: bool, inter: bool, override: bool) -> Planes:
    """Decodes a coded packet's body and moves the references on."""
    if not key and (state.last is None or state.golden is None):
        raise ValueError("nothing to refer to")
    hidden = None
    if override:
        n, at = _varint(body, 0)
        if n > len(body) - at:
            raise ValueError("key body runs past the end")
        body, hidden = body[at : at + n], body[at + n :]
    rec = decode_body(body, size, state, key, inter)
    if key:
        state.golden = rec
        if hidden is not None:
            state.last = rec
            state.golden = decode_body(hidden, size, state, False, True)
    state.last = rec
    return rec


ALIKE = 6


def denoised(frames: Sequence[Planes]) -> Planes | None:
    """The first picture averaged with the blocks of the others that are alike; None if there are few or none."""
    if len(frames) < 3:
        return None
    sums, counts, taken = [p.astype(np.int64) for p in frames[0]], [np.ones(p.shape, np.int64) for p in frames[0]], 0
    for other in frames[1:]:
        far = np.abs(other[0].astype(np.int64) - frames[0][0])
        down, across = (d // MB for d in far.shape)
        alike = far.reshape(down, MB, across, MB).sum(axis=(1, 3)) <= MB * MB * ALIKE
        taken += int(alike.sum())
        for k, size in enumerate((16, 8, 8)):
            mask = np.repeat(np.repeat(alike, size, axis=0), size, axis=1)
            sums[k] += np.where(mask, other[k], 0)
            counts[k] += mask
    return [((s + c // 2) // c).astype(np.uint8) for s, c in zip(sums, counts, strict=True)] if taken else None


def encode_group(frames: Sequence[tuple[bytes, bytes, bytes]], width: int, height: int, qp: int, cols: int = 1, rows: int = 1, window: int = 0, passes: int = 2) -> Iterator[tuple[bytes, Planes, bool]]:
    """(body, reconstruction, override) of each frame of a closed group, the first being the key frame.

    With a `window`, the key packet also carries a denoised reference of so many frames, never shown.
    """
    state, size = State(), (width, height)
    pictures = [padded(width, height, f) for f in frames]
    for i, want in enumerate(pictures):
        body, rec = encode_body(want, size, state, qp, i > 0, cols, rows, passes)
        state.last, hidden = rec, None
        if i == 0:
            state.golden = rec
            if window and (clean := denoised(pictures[:window])) is not None:
                extra, hidden = encode_body(clean, size, state, qp, True, cols, rows, passes)
                state.golden = hidden
                body = leb128(len(body)) + body + extra
        yield body, rec, hidden is not None
