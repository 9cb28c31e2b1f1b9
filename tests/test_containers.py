from __future__ import annotations

import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import SparkSession

from cinetable.functions import rans
from cinetable.functions.bool_coder import BoolReader, BoolWriter
from cinetable.operators import codec
from cinetable.operators.tokens import repaired
from cinetable.sources import dispatch, gop_container, mp4, mpeg_ps, nal, obu, webm
from cinetable.sources.bits import Bits, BitWriter, leb128, read_leb128
from cinetable.sources.gop_container import Header
from cinetable.sources.packets import Packet, scan

PACKETS = [Packet(i, i * 40_000_000, i % 4 == 0, bytes([i]) * (i + 1)) for i in range(11)]
HEAD = Header(64, 48, 25, 1)
FILE = gop_container.build(HEAD, PACKETS)
listed = lambda clip: [(p.seq, p.pts_ns, p.is_key, p.data) for p in clip.packets]
WANT = [(p.seq, p.pts_ns, p.is_key, p.data) for p in PACKETS]


def test_round_trips() -> None:
    assert listed(gop_container.parse(FILE)) == WANT and Header.unpack(FILE) == HEAD
    assert listed(webm.parse(webm.build(PACKETS, 64, 48))) == WANT
    pictures = mpeg_ps.parse(mpeg_ps.build(PACKETS, 64, 48))
    assert (pictures.width, pictures.height, pictures.num) == (64, 48, 25)
    assert [(s, t, k, d[28 if k else 8 :]) for s, t, k, d in listed(pictures)] == WANT
    front = b"\0\0\0\4\x67\x42\0\x0a" + b"\0\0\0\2\x68\xce"
    got = mp4.parse(mp4.build(PACKETS, 64, 48))
    assert (got.codec, got.width, got.height) == ("h264", 64, 48)
    assert listed(got) == [(s, t, k, (front if k else b"") + d) for s, t, k, d in WANT]


@pytest.mark.parametrize(
    ("damage", "message"),
    [
        (lambda b: b"XXXX" + b[4:], "not such a file"), (lambda b: b[:4] + b"\5\0" + b[6:], "version"), (lambda b: b[:6] + b"\x31\0" + b[8:], "version"), (lambda b: b[:8] + bytes(4) + b[12:], "dimensions"),
        (lambda b: b[:16] + bytes(4) + b[20:], "frame rate"), (lambda b: b[:28] + b"\1" + b[29:], "8-bit"), (lambda b: b[:29] + b"\1" + b[30:], "8-bit"), (lambda b: b[:20], "cut off"), (lambda b: b[:48], "no frames"), (lambda b: b[:50] + b"\0\0" + b[52:-4] + b"????", "key frame"),
    ],
)
def test_damage_is_refused(damage, message: str) -> None:  # noqa: ANN001
    with pytest.raises(ValueError, match=message):
        listed(gop_container.parse(damage(FILE)))


@pytest.mark.parametrize("damage", [lambda b: b[:-1], lambda b: b[:-20], lambda b: b[:-30] + b"\xff" + b[-29:], lambda b: b + b"tail"])
def test_a_lost_index_is_rebuilt(damage) -> None:  # noqa: ANN001
    assert listed(gop_container.parse(damage(FILE))) == WANT


def test_a_cut_record_ends_the_rebuild() -> None:
    assert listed(gop_container.parse(FILE[: 48 + 8 + 1 + 8 + 2 + 5])) == WANT[:2]


@pytest.mark.parametrize("packets", [[], [Packet(0, 0, False, b"x")], [Packet(0, 0, True, b"")]])
def test_writer_refuses(packets: list[Packet]) -> None:
    if packets:
        with pytest.raises(ValueError):
            gop_container.build(HEAD, packets)
    else:
        with pytest.raises(ValueError):
            listed(gop_container.parse(gop_container.build(HEAD, packets)[:48]))


@settings(max_examples=300, deadline=None)
@given(st.integers(0, len(FILE) - 1), st.integers(0, 255), st.integers(0, len(FILE)))
def test_any_damage_gives_packets_or_a_value_error(at: int, value: int, keep: int) -> None:
    for parse, data in ((gop_container.parse, FILE), (mp4.parse, mp4.build(PACKETS, 64, 48)), (webm.parse, webm.build(PACKETS, 64, 48)), (mpeg_ps.parse, mpeg_ps.build(PACKETS, 64, 48))):
        broken = bytearray(data)
        broken[at % len(data)] = value
        try:
            listed(parse(bytes(broken[: max(keep, 1)])))
        except (ValueError, IndexError, EOFError, KeyError, struct.error, UnicodeDecodeError):
            pass


def test_scan_gives_error_rows(spark: SparkSession) -> None:
    files = spark.createDataFrame([("a.gop", FILE), ("b.webm", webm.build(PACKETS, 64, 48)), ("c.mp4", mp4.build(PACKETS, 64, 48)), ("d", b"junk"), ("e", None), ("f.gop", FILE[:20])], "clip_id string, content binary")
    rows = scan(files, dispatch.parse_any).collect()
    assert {r.clip_id for r in rows if r._error} == {"d", "e", "f.gop"} and sum(r._error is None for r in rows) == 33
    with pytest.raises(Exception, match="unknown container"):
        scan(files, dispatch.parse_any, strict=True).collect()


def test_read_video(spark: SparkSession, tmp_path) -> None:  # noqa: ANN001
    (tmp_path / "one.GOP").write_bytes(FILE)
    (tmp_path / "two.webm").write_bytes(webm.build(PACKETS, 64, 48))
    (tmp_path / "three.txt").write_bytes(b"not a video")
    rows = dispatch.read_video(spark, str(tmp_path)).collect()
    assert {r.clip_id for r in rows} == {"one.GOP", "two.webm"} and len(rows) == 22


def test_data_source_splits_by_bytes(spark: SparkSession, tmp_path) -> None:  # noqa: ANN001
    (tmp_path / "one.gop").write_bytes(FILE)
    (tmp_path / "two.gop").write_bytes(FILE[:-5])
    (tmp_path / "_temporary-x").write_bytes(b"not yet")
    spark.dataSource.register(gop_container.GopSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for size in (20, 100, 1 << 20):  # every group is read once, by the split that it starts in
        frame = spark.read.format("gop").option("splitBytes", size).load(str(tmp_path))
        assert frame.rdd.getNumPartitions() == -(-len(FILE) // size) + -(-(len(FILE) - 5) // size) and frame.count() == 22
    some = spark.read.format("gop").load(str(tmp_path)).where("seq >= 5 AND seq < 8")
    assert sorted((r.clip_id, r.seq) for r in some.collect()) == [(c, s) for c in ("one.gop", "two.gop") for s in (5, 6, 7)]
    with pytest.raises(Exception, match="local and mounted"):
        spark.read.format("gop").load("hdfs://host/clips").count()


def test_data_sink_commits_whole_jobs(spark: SparkSession, tmp_path) -> None:  # noqa: ANN001
    spark.dataSource.register(gop_container.GopSource)
    path = tmp_path / "out"

    def rows(clips: str, n: int = 5, break_at: int = -1):  # noqa: ANN202
        data = [(c, "gop", 8, 8, 1, s, s, s == 0, None if s == break_at else bytes([s + 1]), None) for c in clips for s in range(n)]
        frame = spark.createDataFrame(data, "clip_id string, codec string, width int, height int, track int, seq long, pts_ns long, is_key boolean, data binary, _error string")
        return frame.repartition("clip_id").sortWithinPartitions("clip_id", "seq").write.format("gop").options(path=str(path), width=8, height=8)

    rows("abc").mode("append").save()
    assert sorted(f.name for f in path.iterdir()) == ["a", "b", "c"] and gop_container.index_of((path / "b").read_bytes())[4][1] == 1
    with pytest.raises(Exception):  # noqa: B017
        rows("de", break_at=3).mode("append").save()
    assert sorted(f.name for f in path.iterdir()) == ["a", "b", "c"]
    rows("cd", 3).mode("overwrite").save()
    assert sorted(f.name for f in path.iterdir()) == ["c", "d"] and len(gop_container.index_of((path / "c").read_bytes())) == 3


def test_units() -> None:
    raw = b"\0\0\0\0\0\1\0\0\2\0\0\3ab\0\0"
    assert nal.unescape(nal.escape(raw)) == raw and b"\0\0\1" not in nal.escape(raw)
    assert [(n.ref_idc, n.kind, n.rbsp) for n in nal.split_lengths(b"\0\0\0\2\x67A\0\0\0\0\0\0\0\1\x41")] == [(3, 7, b"A"), (2, 1, b"")]
    for bad in (b"\0\0", b"\0\0\0\5ab", b"\0\0\0\1\x80"):
        with pytest.raises(ValueError):
            list(nal.split_lengths(bad))
    stream = b"\0\0\0\1\x67a\0\0\1\x68b\0\0\1\x65c\0\0\0\1\x41d"
    assert [[u[0] & 31 for u in au] for au in nal.access_units(stream)] == [[7, 8, 5], [1]]
    units = list(obu.split(obu.build(2, b"") + obu.build(6, b"x" * 200, 1, 2) + obu.build(3, b"rest", sized=False)))
    assert [(u.kind, u.temporal, u.spatial, len(u.payload)) for u in units] == [(2, 0, 0, 0), (6, 1, 2, 200), (3, 0, 0, 4)]
    for bad in (b"\x80", obu.build(6, b"abc")[:-1]):
        with pytest.raises(ValueError):
            list(obu.split(bad))


@given(st.lists(st.integers(0, 2**31), max_size=20))
def test_codes(values: list[int]) -> None:
    w = BitWriter()
    for v in values:
        w.ue(v).se(v // 2).se(-(v // 3)).u(v & 31, 5)
    b = Bits(w.bytes(stop=True))
    for v in values:
        assert (b.ue(), b.se(), b.se(), b.u(5)) == (v, v // 2, -(v // 3), v & 31)
        assert read_leb128(leb128(v) + b"x", 0) == (v, len(leb128(v)))
    assert not b.more_rbsp()


def test_slices_refuse_what_is_not_supported() -> None:
    interlaced = BitWriter().u(66, 8).u(0, 8).u(30, 8).ue(0).ue(0).ue(2).ue(1).u(0, 1).ue(3).ue(3).u(0, 1).u(0, 1).u(1, 1).u(0, 1).u(0, 1).bytes(stop=True)
    sps = nal.parse_sps(interlaced)
    assert sps["height"] == 128
    with pytest.raises(ValueError, match="progressive"):
        nal.parse_slice(nal.Nal(1, 1, b"\xff"), sps, {"field_order": False, "redundant": False, "refs": [1, 1], "weighted": False, "bi_weight": 0, "cabac": False, "qp": 26, "filter_control": False})
    with pytest.raises(ValueError, match="slice groups"):
        nal.parse_pps(BitWriter().ue(0).ue(0).u(0, 2).ue(1).bytes(stop=True))


def test_scaling_lists_fall_back() -> None:
    own, other = [9] * 16, [7] * 64
    sent = [(True, own), (False, None), (True, None), (False, None), (False, None), (False, None), (True, other), (False, None)]
    lists = nal.resolved_lists(sent)
    assert lists[1] == own and lists[2] == nal.DEFAULT_4[0] and lists[3] == lists[5] == nal.DEFAULT_4[1] and lists[6] == other and lists[7] == nal.DEFAULT_8[1] and lists[8] == other
    assert nal.resolved_lists([], lists) == [lists[0]] * 3 + [lists[3]] * 3 + [lists[6], lists[7]] * 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5000), min_size=2, max_size=40), min_size=1, max_size=3), st.integers(0, 2**32))
def test_coder(counts: list[list[int]], seed: int) -> None:
    counts = [c if sum(c) else [1, *c[1:]] for c in counts]
    tables = [rans.Table(repaired(c)) for c in counts]
    rng = random.Random(seed)
    tokens = [(k, rng.choice([s for s, c in enumerate(counts[k]) if c])) for k in (rng.randrange(len(counts)) for _ in range(300))]
    decoder = rans.Decoder(rans.encode(tokens, tables), tables)
    assert [(k, decoder.next(k)) for k, _ in tokens] == tokens


def test_frequencies_are_repaired_one_by_one() -> None:
    def slowly(counts: list[int]) -> list[int]:
        freq = [max(1, c * 4096 // sum(counts)) if c else 0 for c in counts]
        largest = freq.index(max(freq))
        while sum(freq) > 4096:
            freq[max((f, -s) for s, f in enumerate(freq) if f > 1)[1] * -1] -= 1
        freq[largest] += 4096 - sum(freq)
        return freq

    rng = random.Random(5)
    for _ in range(300):
        n = rng.choice([3, 40, 400])
        counts = [rng.choice([0, 1, 1, 1, 2, rng.randrange(1, 90_000)]) for _ in range(n)] + [1]
        got = repaired(counts)
        assert got == slowly(counts) and sum(got) == 4096 and all((f > 0) == (c > 0) for f, c in zip(got, counts, strict=True))


def test_tables_and_streams_are_checked() -> None:
    for bad in ([4095], [4096 + (1 << 32)], [-1, 4097]):
        with pytest.raises(ValueError):
            rans.Table(bad)
    with pytest.raises(ValueError):
        rans.Decoder(b"short", [])


def test_groups_decode_alone_and_errors_are_rows(spark: SparkSession) -> None:
    planes = (bytes(range(16)) * 4, bytes(16), bytes([9]) * 16)
    good = [(n, n * 10, n % 2 == 0, codec.encode_raw(8, 8, planes, n % 2 == 0)) for n in range(6)]
    rows = [("a", "gop", *r) for r in good] + [("b", "gop", 0, 0, False, good[1][3]), ("c", "vp8", 0, 0, True, b"x"), ("d", "gop", 0, 0, True, good[0][3][:-1]), ("e", "gop", 0, 0, True, good[0][3]), ("e", "gop", 1, 10, False, b"\x05")]
    frames = codec.decode(spark.createDataFrame(rows, "clip_id string, codec string, seq long, pts_ns long, is_key boolean, data binary")).collect()
    by = {c: [f for f in frames if f.clip_id == c] for c in "abcde"}
    assert [(f.n, bytes(f.y), bytes(f.cr)) for f in sorted(by["a"])] == [(n, planes[0], planes[2]) for n in range(6)]
    assert all(len(by[c]) == 1 and by[c][0]._error for c in "bcd") and [f._error is None for f in sorted(by["e"], key=lambda f: f.n)] == [True, False]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(1, 255)), max_size=400), st.integers(0, 2**20 - 1))
def test_bool_coder(bits: list[tuple[int, int]], number: int) -> None:
    w = BoolWriter()
    for b, p in bits:
        w.bit(b, p)
    w.literal(number, 20)
    r = BoolReader(w.bytes())
    assert [r.bit(p) for _, p in bits] == [b for b, _ in bits] and r.literal(20) == number
