from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import SparkSession

from cinetable.operators import codec, streams
from cinetable.operators import transform_codec as tc
from cinetable.plans import codec_queries
from cinetable.sources.gop_container import packet_header


def still(w: int, h: int, seed: int) -> tuple[bytes, bytes, bytes]:
    x, y = np.meshgrid(np.arange(w), np.arange(h))
    v = (3 * x + 5 * y + 7 * seed) & 255
    v = np.where(x + y > (w + h) // 2, 255 - v, v)
    v = np.where((x // 4 + y // 4) % 2 == 0, v ^ 0x33, v)
    u, t = np.meshgrid(np.arange((w + 1) // 2), np.arange((h + 1) // 2))
    return tuple(p.astype(np.uint8).tobytes() for p in (v, (11 * u + 2 * t + 3 * seed) & 255, (255 - 2 * u - 13 * t - 5 * seed) & 255))  # type: ignore[return-value]


def pan(w: int, h: int, i: int) -> tuple[bytes, bytes, bytes]:
    x, y = np.meshgrid(np.arange(w) + 2 * i, np.arange(h) + 2 * i)
    v = (3 * x + 2 * y) & 255
    v = np.where((x // 6 + y // 6) % 2 == 0, v ^ 0x40, v)
    u, t = np.meshgrid(np.arange((w + 1) // 2) + i, np.arange((h + 1) // 2) + i)
    return tuple(p.astype(np.uint8).tobytes() for p in (v, (5 * u + 3 * t) & 255, (200 - 2 * u - 4 * t) & 255))  # type: ignore[return-value]


def quality(a: bytes, b: bytes) -> float:
    e = np.frombuffer(a, np.uint8).astype(int) - np.frombuffer(b, np.uint8)
    return float(10 * np.log10(65025 / max((e * e).mean(), 1e-9)))


def packets(frames: list, w: int, h: int, qp: int, cols: int = 1, rows: int = 1, window: int = 0) -> list[tuple[int, int, bytes]]:
    return [(i, i, packet_header(i == 0, 2 if i else 1, w, h, hidden) + body) for i, (body, _, hidden) in enumerate(tc.encode_group(frames, w, h, qp, cols, rows, window))]


@pytest.mark.parametrize(("qp", "floor", "most"), [(8, 40, 42_000), (20, 30, 28_000), (32, 24, 14_000)])
def test_quality_and_size(qp: int, floor: float, most: int) -> None:
    frames = [still(256, 192, 1)]
    coded = packets(frames, 256, 192, qp)
    assert all(len(d) <= most for _, _, d in coded)
    assert all(quality(f.planes[0], w[0]) >= floor for f, w in zip(codec.decode_gop(coded), frames, strict=True))


@pytest.mark.parametrize(("w", "h"), [(64, 48), (50, 37), (16, 16), (1, 1)])
@pytest.mark.parametrize("source", [still, pan])
def test_decoder_follows_encoder(w: int, h: int, source) -> None:  # noqa: ANN001
    frames = [source(w, h, i) for i in range(3)]
    for cols, rows, window in ((1, 1, 0), (2, 2, 0), (9, 9, 4)):
        done = list(tc.encode_group(frames, w, h, 16, cols, rows, window))
        coded = packets(frames, w, h, 16, cols, rows, window)
        got = list(codec.decode_gop(coded))
        assert [f.planes for f in got] == [tc.cropped(rec, w, h) for _, rec, _ in done]


def test_inter_pictures_cost_less_and_a_hidden_reference_is_carried() -> None:
    frames = [pan(64, 48, i) for i in range(6)]
    sizes = [len(d) for _, _, d in packets(frames, 64, 48, 20)]
    assert max(sizes[1:]) < 0.7 * sizes[0]
    rng = np.random.default_rng(1)
    noisy = []
    for _ in range(5):
        y = np.clip(np.frombuffer(frames[0][0], np.uint8).astype(int) + rng.integers(-3, 4, 64 * 48), 0, 255).astype(np.uint8).tobytes()
        noisy.append((y, *frames[0][1:]))
    coded = packets(noisy, 64, 48, 8, window=4)
    assert coded[0][2][0] & 32 and len(list(codec.decode_gop(coded))) == 5
    assert tc.denoised([tc.padded(64, 48, f) for f in frames[:2]]) is None


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**32))
def test_damage_gives_frames_or_a_value_error(seed: int) -> None:
    rng = random.Random(seed)
    i = rng.randrange(len(CODED))
    data = bytearray(CODED[i][2])
    for _ in range(rng.randint(1, 4)):
        data[rng.randrange(len(data))] = rng.randrange(256)
    broken = [*CODED[:i], (i, i, bytes(data[: rng.randint(1, len(data))])), *CODED[i + 1 :]]
    try:
        assert all(len(f.planes[0]) == f.width * f.height for f in codec.decode_gop(broken))
    except (ValueError, IndexError, EOFError):
        pass


CODED = packets([pan(32, 32, i) for i in range(3)], 32, 32, 20, 2, 1, 3)


def test_refusals() -> None:
    key, inter = CODED[0], CODED[1]
    for bad in ([inter], [key, (1, 1, b"\x01" + inter[2][1:])], [(0, 0, packet_header(True, 2, 32, 32) + key[2][6:])], [(0, 0, packet_header(True, 3, 32, 32) + b"x")], [(0, 0, packet_header(True, 1, 9000, 32) + b"x")]):
        with pytest.raises((ValueError, IndexError, EOFError)):
            list(codec.decode_gop(bad))


def test_signs_hide_in_parity() -> None:
    rng = np.random.default_rng(3)
    for n in tc.SIZES:
        for _ in range(200):
            levels = tc.with_hidden_sign(np.where(rng.random((n, n)) < 0.3, rng.integers(-9, 10, (n, n)), 0))
            sink = tc.Sink()
            tc.residual(sink, False, tc.SIZES.index(n), n, levels)

            class Replay:
                def __init__(self, tokens: list) -> None:
                    self.tokens = iter(tokens)

                def symbol(self, ctx: int, value: int = 0) -> int:
                    want, sym = next(self.tokens)
                    assert want == ctx
                    return sym

            assert (tc.residual(Replay(sink.tokens), False, tc.SIZES.index(n), n) == levels).all()  # type: ignore[arg-type]


def test_groups_decode_alike_alone_and_together(spark: SparkSession) -> None:
    frames = codec_queries.synthetic_frames(spark)
    coded = codec.encode_coded(frames, 4, 24).selectExpr("*", "'gop' AS codec").cache()
    whole = {r.n: bytes(r.y) for r in codec.decode(coded, strict=True).collect()}
    one = {r.n: bytes(r.y) for r in codec.decode(coded.where("seq >= 4 AND seq < 8"), strict=True).collect()}
    assert len(whole) == 12 and one == {n: y for n, y in whole.items() if 4 <= n < 8}


def test_group_planning(spark: SparkSession) -> None:
    cuts = [False] * 9 + [True] + [False] * 3 + [True] + [False] * 20
    rows = spark.createDataFrame([(1, i, c) for i, c in enumerate(cuts)], "clip_id int, n long, cut boolean")
    got = [r.gop_id for r in streams.planned_groups(rows, 12).orderBy("n").collect()]
    assert got == [0] * 9 + [1] * 12 + [2] * 12 + [3]
