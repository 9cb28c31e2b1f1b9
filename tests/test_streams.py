from __future__ import annotations

import random

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from cinetable.functions import integers, samples, timing
from cinetable.operators import codec, pixels, references, streams
from cinetable.operators.folds import fold
from cinetable.plans import codec_queries
from cinetable.streaming import live, player

FEW = "/root/testdata/sf0.001"


def feed(rows: list[tuple]) -> list[tuple]:
    one = player.Player()
    return [x for r in rows if (x := one.feed(*r))]


def packets(n: int, gen: int = 0) -> list[tuple]:
    return [("packet", i * 40, i, gen) for i in range(n)]


def test_the_first_frame_shows_before_play_and_the_clock_drops_frames() -> None:
    out = feed([*packets(5), ("tick", 5, 0, 0), ("play", 10, 0, 0), ("tick", 60, 0, 0), ("tick", 60, 0, 0), ("tick", 140, 0, 0), ("tick", 180, 0, 0)])
    assert [(o[1], o[2], o[4]) for o in out] == [(0, True, 0), (1, True, 0), (1, False, 0), (3, True, 1), (4, True, 0)]


def test_pause_holds_the_clock() -> None:
    out = feed([*packets(5), ("play", 0, 0, 0), ("tick", 50, 0, 0), ("pause", 50, 0, 0), ("tick", 900, 0, 0), ("play", 1000, 0, 0), ("tick", 1040, 0, 0)])
    assert [o[1] for o in out] == [1, 1, 2] and [o[3] for o in out] == ["playing", "paused", "playing"]


def test_the_end_stops_even_when_it_comes_late_or_the_clip_has_one_frame() -> None:
    for n in (1, 4):
        out = feed([*packets(n), ("play", 0, 0, 0), ("tick", 500, 0, 0), ("end", 0, 0, 0), ("tick", 600, 0, 0), ("play", 600, 0, 0), ("tick", 700, 0, 0)])
        assert [o[3] for o in out] == ["playing", "stopped", "stopped"] and out[-1][1] == n - 1


def test_a_seek_drops_what_is_stale() -> None:
    out = feed([*packets(3), ("play", 0, 0, 0), ("seek", 400, 0, 1), ("packet", 80, 2, 0), ("packet", 400, 10, 1), ("packet", 440, 11, 1), ("end", 0, 0, 0), ("tick", 1, 0, 0), ("tick", 41, 0, 0)])
    assert [o[1] for o in out] == [10, 11] and out[-1][3] == "playing"


def test_state_survives_being_saved() -> None:
    rng, rows = random.Random(2), []
    for i in range(400):
        kind = rng.choice(["packet", "packet", "tick", "tick", "play", "pause", "seek"])
        rows.append((kind, i * 7 if kind != "seek" else i * 3, i, sum(r[0] == "seek" for r in rows) + (kind == "seek")))
    one, out = player.Player(), []
    for r in rows:
        one = player.Player(one.saved())
        if x := one.feed(*r):
            out.append(x)
    assert [o[:4] for o in out] == [o[:4] for o in feed(rows)]


def test_streaming_player_equals_batch(spark: SparkSession, tmp_path) -> None:  # noqa: ANN001
    rows = codec_queries.player_input(spark, FEW).where("session < 5")
    for k in range(3):  # three micro-batches, in order
        rows.where(F.col("at") % 1000 >= 0).where(f"at div 3 = {k}" if k < 2 else "at div 3 >= 2").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/b{k}"))
    src = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = player.play(src).writeStream.format("memory").queryName("player_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.table("player_out").collect()))
    want = sorted(map(tuple, codec_queries.playback(spark, FEW).where("session < 5").collect()))
    assert [g[:6] for g in got] == [w[:6] for w in want] and len(got) > 5


def test_live_windows(spark: SparkSession, tmp_path) -> None:  # noqa: ANN001
    rows = spark.range(100).selectExpr("cast(id % 3 AS string) AS clip_id", "timestamp_seconds(id * 120) AS ts", "id % 5 = 0 AS is_key", "encode(cast(id AS string), 'UTF-8') AS data")
    rows.write.parquet(str(tmp_path / "in"))
    q = live.throughput(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "ts").writeStream.format("memory").queryName("live_out").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("live_out").agg(F.sum("packets"), F.sum("keys")).first() == Row(100, 20)


def test_as_of_ties_nulls_and_empties(spark: SparkSession) -> None:
    left = spark.createDataFrame([(1, 5, "a"), (1, 4, "b"), (2, 9, "c"), (None, 1, "d"), (1, 5, "a")], "c long, t long, tag string")
    right = spark.createDataFrame([(1, 5, 10), (1, 5, 11), (1, 1, 1), (3, 0, 7)], "c long, u long, v long")
    got = sorted((r.tag, r.v) for r in streams.as_of(left, right, "c", "t", "u", ["v"]).collect() if r.v is not None)
    assert got == [("a", 11), ("a", 11), ("b", 1)]
    assert streams.as_of(left.limit(0), right, "c", "t", "u", ["v"]).count() == 0 and streams.as_of(left, right.limit(0), "c", "t", "u", ["v"]).count() == 5


def test_list_moves(spark: SparkSession) -> None:
    frame = spark.createDataFrame([([5, 4, 3, 2], [3]), ([5, 4, 3, 2], [2, 5]), ([5, 4], [9]), ([5], [])], "l array<long>, o array<long>")
    assert [r[0] for r in frame.select(references.modified(F.col("l"), F.col("o"))).collect()] == [[3, 5, 4, 2], [2, 5, 4, 3], [9, 5], [5]]


def test_window_marking_with_drops(spark: SparkSession) -> None:
    rows = [(0, 0, 0, True, []), (0, 0, 1, True, []), (0, 0, 2, False, []), (0, 0, 3, True, [0]), (0, 0, 4, True, []), (0, 0, 5, True, [])]
    got = references.sliding_window(spark.createDataFrame(rows, "clip_id int, gop_id int, seq long, is_ref boolean, d array<long>"), 3, drops="d")
    assert [r.kept for r in got.orderBy("seq").collect()] == [[0], [0, 1], [0, 1], [1, 3], [1, 3, 4], [3, 4, 5]]


def test_adaptive_marking(spark: SparkSession) -> None:
    none: list = []
    rows = [
        (0, True, none, [0], none), (1, True, none, [0, 1], none), (2, True, none, [0, 1, 2], none),
        (3, True, none, [1, 2, 3], none),  # the window slides at three
        (4, False, [(1, 0, None)], [1, 2, 3], none),  # no reference: nothing is marked
        (5, True, [(1, 1, None)], [1, 2, 5], none),  # drops 5 - 2 = 3
        (6, True, [(3, 3, 1)], [1, 5, 6], [None, 2]),  # 6 - 4 = 2 becomes long-term 1
        (7, True, none, [5, 6, 7], [None, 2]),
        (8, True, [(6, None, 0)], [5, 6, 7], [8, 2]), (9, True, [(2, 1, None)], [5, 6, 7, 9], [8]), (10, True, [(4, 0, None)], [5, 6, 7, 9, 10], none), (11, True, [(5, None, None)], [11], none),
    ]
    frame = spark.createDataFrame([(1, 1, n, n % 16, ref, ops or None) for n, ref, ops, _, _ in rows], "clip_id int, gop_id int, seq long, frame_num int, is_ref boolean, ops array<struct<op:int,arg:int,index:int>>")
    got = {r.seq: (r.short, r.long) for r in references.adaptive_marking(frame, 3, bits=4).collect()}
    assert got == {n: (short, long) for n, _, _, short, long in rows}


def test_folds_carry_state_over_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.range(1000).selectExpr("id % 3 AS k", "id AS n", "1 AS v")
        got = fold(rows, ["k"], "n", ["v"], lambda: 0, lambda s, v: (s + v, (s + v,)), "total long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(r.total == r.n // 3 + 1 for r in got) and len(got) == 1000
    assert fold(rows.limit(0), ["k"], "n", ["v"], lambda: 0, lambda s, v: (s, (0,)), "total long").count() == 0


def test_vp8_buffers(spark: SparkSession) -> None:
    rows = [(0, 0, 0, True, True, 0, 0), (0, 0, 1, False, True, 0, 0), (0, 0, 2, False, False, 1, 2), (0, 0, 3, False, True, 2, 1), (0, 0, 4, False, False, 3, 3)]
    got = references.vp8_buffers(spark.createDataFrame(rows, "clip_id int, gop_id int, seq long, is_key boolean, refresh_last boolean, copy_golden int, copy_altref int"))
    assert [(r["last"], r.golden, r.altref) for r in got.orderBy("seq").collect()] == [(0, 0, 0), (1, 0, 0), (1, 1, 0), (3, 1, 1), (3, 4, 4)]


def test_transform_is_nearly_lossless(spark: SparkSession) -> None:
    for n in (4, 8, 16):
        blocks = pixels.blocks_of(pixels.synthetic(spark, 1, 16, 16), n).withColumn("v", F.col("v") - 128)
        back = pixels.inverse_dct(pixels.forward_dct(blocks, n), n).withColumnRenamed("v", "r")
        assert blocks.join(back, ["n", "by", "bx", "i", "j"]).agg(F.max(F.abs(F.col("v") - F.col("r")))).first()[0] <= 2


def test_steps_and_matrices() -> None:
    assert [samples.steps(q) for q in (-3, 0, 5, 6, 20, 63, 99)] == [(1, 1), (1, 1), (2, 2), (1, 2), (5, 10), (724, 1448), (724, 1448)]
    assert samples.dct_matrix(4)[0] == [4096] * 4 and samples.zigzag(4)[:6] == [0, 1, 4, 8, 5, 2]


def test_integers(spark: SparkSession) -> None:
    v = F.col("v")
    rows = spark.createDataFrame([(x,) for x in (-7, -1, 0, 1, 7, 127, 128, 300)], "v long").select("v", integers.tdiv(v, 2).alias("d"), integers.clamp(v, -2, 100).alias("c"), integers.zigzag_decode(integers.zigzag_encode(v)).alias("z"), integers.zigzag_encode(v).alias("e")).collect()
    assert all((r.d, r.c, r.z) == (int(r.v / 2), min(max(r.v, -2), 100), r.v) for r in rows) and [r.e for r in rows] == [13, 1, 0, 2, 14, 254, 256, 600]


def test_times_go_there_and_back(spark: SparkSession) -> None:
    rows = spark.range(500).selectExpr("id AS n", "cast(30000 AS BIGINT) AS num", "cast(1001 AS BIGINT) AS den")
    t = timing.frame_time(F.col("n"), F.col("num"), F.col("den"))
    wrong = rows.select("n", *[timing.frame_at(t + k, F.col("num"), F.col("den")).alias(f"k{k + 1}") for k in (-1, 0, 1)]).where("k1 <> n OR k2 <> n OR (n > 0 AND k0 <> n - 1)")
    assert wrong.count() == 0


def test_transcode_keeps_pictures(spark: SparkSession) -> None:
    frames = codec_queries.synthetic_frames(spark)
    again = codec.decode(codec.transcode(codec.encode(frames, 4).withColumn("codec", F.lit("gop")), 5).withColumn("codec", F.lit("gop")), strict=True)
    sums = lambda f: sorted((r.n, r.crc) for r in codec.checksum(f).collect())
    assert sums(again) == sums(frames)
