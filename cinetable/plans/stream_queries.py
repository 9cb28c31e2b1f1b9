"""Queries over ordered streams. `events` carries them: a user is a clip, a signup a key packet, props the payload."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import integers, timing
from ..operators import streams
from .registry import query, table

#: events as packets, in SQL.
PACKETS = """p AS (SELECT user_id AS clip_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
  CAST(epoch_us(ts) * 1000 AS BIGINT) AS pts_ns, event_type = 'signup' AS is_key, event_type, event_id, props, value FROM events)"""
TICK = 21_600_000_000_000


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    since = "(ts - TIMESTAMP_NTZ '1970-01-01 00:00:00')"
    micros = f"cast(extract(DAY FROM {since}) AS BIGINT) * 86400000000 + cast(extract(HOUR FROM {since}) AS BIGINT) * 3600000000 + cast(extract(MINUTE FROM {since}) AS BIGINT) * 60000000 + cast(extract(SECOND FROM {since}) * 1000000 AS BIGINT)"
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS clip_id", "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq", f"({micros}) * 1000 AS pts_ns", "event_type = 'signup' AS is_key", "event_type", "event_id", "props", "value"
    )


def ticks(frames: DataFrame) -> DataFrame:
    """A clock of six-hour ticks from the tick at or before a clip's first packet to the one after its last."""
    span = frames.groupBy("clip_id").agg(F.min("pts_ns").alias("a"), F.max("pts_ns").alias("b"))
    lo, hi = integers.tdiv(F.col("a"), TICK), integers.tdiv(F.col("b"), TICK) + 1
    return span.select("clip_id", F.explode(F.sequence(lo, hi)).alias("k")).select("clip_id", (F.col("k") * TICK).alias("t_ns"))


TICKS = f"k AS (SELECT clip_id, unnest(range(min(pts_ns) // {TICK}, max(pts_ns) // {TICK} + 2)) * {TICK} AS t_ns FROM p GROUP BY clip_id)"


@query("gop_segment", "W2", f"WITH {PACKETS} SELECT clip_id, seq, CAST(sum(CAST(is_key AS INT)) OVER (PARTITION BY clip_id ORDER BY seq) AS BIGINT) AS gop_id FROM p")
def gop_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.with_groups(packets(spark, sf_dir)).select("clip_id", "seq", "gop_id")


@query("governing_key", "W3 S12", f"WITH {PACKETS} SELECT clip_id, seq, last_value(CASE WHEN is_key THEN seq END IGNORE NULLS) OVER (PARTITION BY clip_id ORDER BY seq) AS key_seq FROM p")
def governing_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.with_groups(packets(spark, sf_dir)).select("clip_id", "seq", "key_seq")


@query("keyframe_seek", "S3 S6 S12", f"""WITH {PACKETS}, {TICKS}, f AS (SELECT clip_id, min(pts_ns) AS p0 FROM p GROUP BY 1)
SELECT k.clip_id, t_ns, coalesce(q.seq, 0) AS to_seq, coalesce(q.pts_ns, p0) AS to_pts FROM k JOIN f USING (clip_id)
LEFT JOIN (SELECT * FROM (SELECT k.clip_id, k.t_ns, p.seq, p.pts_ns, row_number() OVER (PARTITION BY k.clip_id, k.t_ns ORDER BY p.pts_ns DESC, p.seq DESC) AS r
  FROM k JOIN p ON p.clip_id = k.clip_id AND p.is_key AND p.pts_ns <= k.t_ns) WHERE r = 1) q USING (clip_id, t_ns)""")
def keyframe_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packets(spark, sf_dir)
    return streams.seek(rows, ticks(rows))


_SHOWN = """s AS (SELECT k.clip_id, k.t_ns, coalesce((SELECT max(seq) FROM p WHERE p.clip_id = k.clip_id AND p.pts_ns <= k.at_ns), 0) AS shown FROM k)
SELECT clip_id, t_ns, shown, coalesce(lag(shown) OVER (PARTITION BY clip_id ORDER BY t_ns) <> shown, TRUE) AS changed FROM s"""


@query("clock_asof", "J3 T5", f"WITH {PACKETS}, {TICKS.replace('AS t_ns FROM', 'AS t_ns, unnest(range(min(pts_ns) // TICK, max(pts_ns) // TICK + 2)) * TICK AS at_ns FROM').replace('TICK', str(TICK))}, {_SHOWN}")
def clock_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packets(spark, sf_dir)
    return streams.shown_at(rows, ticks(rows), n="seq")


@query("loop_playback", "T6", """WITH p AS (SELECT user_id AS clip_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
  CAST(epoch_us(ts) * 1000 AS BIGINT) - 1704067200000000000 AS pts_ns FROM events),
d AS (SELECT clip_id, max(pts_ns) + 1 AS dur FROM p GROUP BY 1), k AS (SELECT clip_id, t * 86400000000000 AS t_ns, (t * 86400000000000) % dur AS at_ns FROM d, range(60) r(t)),
""" + _SHOWN)
def loop_playback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packets(spark, sf_dir).withColumn("pts_ns", F.col("pts_ns") - 1_704_067_200_000_000_000)
    clips = rows.groupBy("clip_id").agg((F.max("pts_ns") + 1).alias("duration"))
    clock = clips.select("clip_id", "duration", F.explode(F.sequence(F.lit(0), F.lit(59))).alias("t")).select("clip_id", "duration", (F.col("t").cast("long") * 86_400_000_000_000).alias("t_ns"))
    return streams.shown_at(rows, clock, n="seq", loop="duration").drop("duration")


_POC = f"WITH {PACKETS}, g AS (SELECT *, CAST(sum(CAST(is_key AS INT)) OVER (PARTITION BY clip_id ORDER BY seq) AS BIGINT) AS gop_id FROM p)"


@query("display_reorder", "W5 O1", _POC + """, o AS (SELECT clip_id, seq, row_number() OVER (PARTITION BY clip_id ORDER BY gop_id, CAST(event_id * 7 % 13 - 6 AS BIGINT), seq) - 1 AS display_n FROM g)
SELECT *, max(seq) OVER (PARTITION BY clip_id ORDER BY display_n) AS emitted_at FROM o""")
def display_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streams.with_groups(packets(spark, sf_dir)).withColumn("poc", F.col("event_id") * 7 % 13 - 6)
    return streams.reorder_delay(streams.display_order(rows, epoch="gop_id")).select("clip_id", "seq", "display_n", "emitted_at")


@query("poc_unwrap", "W4", """WITH RECURSIVE p AS (SELECT user_id AS clip_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, event_type = 'signup' AS is_key, event_type <> 'error' AS r FROM events),
g AS (SELECT *, CAST(sum(CAST(is_key AS INT)) OVER (PARTITION BY clip_id ORDER BY seq) AS BIGINT) AS gop_id FROM p),
s AS (SELECT *, row_number() OVER (PARTITION BY clip_id, gop_id ORDER BY seq) AS i, CAST((seq * 3) % 16 AS BIGINT) AS l FROM g),
w AS (SELECT clip_id, gop_id, seq, i, CASE WHEN l > 8 THEN -16 ELSE 0 END AS msb, CASE WHEN l > 8 THEN -16 ELSE 0 END + l AS poc,
    CASE WHEN r THEN CASE WHEN l > 8 THEN -16 ELSE 0 END ELSE 0 END AS pm, CASE WHEN r THEN l ELSE 0 END AS pl FROM s WHERE i = 1
  UNION ALL SELECT clip_id, gop_id, seq, i, msb, msb + l, CASE WHEN r THEN msb ELSE pm END, CASE WHEN r THEN l ELSE pl END FROM
   (SELECT s.*, pm, pl, pm + CASE WHEN l < pl AND pl - l >= 8 THEN 16 WHEN l > pl AND l - pl > 8 THEN -16 ELSE 0 END AS msb FROM w JOIN s ON s.clip_id = w.clip_id AND s.gop_id = w.gop_id AND s.i = w.i + 1))
SELECT clip_id, gop_id, seq, CAST(poc AS BIGINT) AS poc FROM w""")
def poc_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streams.with_groups(packets(spark, sf_dir)).withColumn("lsb", F.col("seq") * 3 % 16).withColumn("is_ref", F.col("event_type") != "error")
    return streams.unwrapped_counts(rows, 4)


@query("frame_num_poc", "W4", _POC + """, w AS (SELECT clip_id, gop_id, seq, (seq * 5) % 16 AS fn, event_type <> 'error' AS r, lag((seq * 5) % 16) OVER (PARTITION BY clip_id, gop_id ORDER BY seq) > (seq * 5) % 16 AS wrap FROM g)
SELECT clip_id, gop_id, seq, CAST((coalesce(sum(CAST(wrap AS INT)) OVER (PARTITION BY clip_id, gop_id ORDER BY seq), 0) * 16 + fn) * 2 - CASE WHEN r THEN 0 ELSE 1 END AS BIGINT) AS poc FROM w""")
def frame_num_poc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streams.with_groups(packets(spark, sf_dir)).withColumn("frame_num", F.col("seq") * 5 % 16).withColumn("is_ref", F.col("event_type") != "error")
    return streams.frame_number_counts(rows, 4).select("clip_id", "gop_id", "seq", "poc")


@query("seek_fence", "T4 T7", f"WITH {PACKETS}, g AS (SELECT clip_id, seq, CAST(sum(CAST(is_key AS INT)) OVER (PARTITION BY clip_id ORDER BY seq) AS BIGINT) AS gen FROM p), "
    "d AS (SELECT *, last_value(gen) OVER (PARTITION BY clip_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS later FROM g) SELECT clip_id, seq, gen FROM d WHERE gen = later")
def seek_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.fenced(packets(spark, sf_dir), 2, is_seek="is_key").select("clip_id", "seq", "gen")


@query("parameter_sets", "J1", f"""WITH {PACKETS}, s AS (SELECT clip_id, seq, event_id % 4 AS set_id, event_id * 7 AS setting FROM p WHERE is_key), u AS (SELECT clip_id, seq, event_id % 4 AS set_id FROM p WHERE NOT is_key)
SELECT u.*, b.sent, b.setting FROM u ASOF LEFT JOIN (SELECT clip_id, set_id, seq AS sent, seq AS at, setting FROM s) b ON u.clip_id = b.clip_id AND u.set_id = b.set_id AND u.seq >= b.at""")
def parameter_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packets(spark, sf_dir).withColumn("set_id", F.col("event_id") % 4)
    sets = rows.where("is_key").select("clip_id", "seq", "set_id", F.col("seq").alias("sent"), (F.col("event_id") * 7).alias("setting"))
    return streams.bound(rows.where("NOT is_key").select("clip_id", "seq", "set_id"), sets, "clip_id", "seq", "set_id", ["sent", "setting"])


@query("visible_frames", "P13 O8", f"WITH {PACKETS} SELECT clip_id, seq, pts_ns FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY seq) AS r FROM p WHERE event_type <> 'error') WHERE r <= 20")
def visible_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 packets of each clip that show a picture: the limit is the feature."""
    shown = packets(spark, sf_dir).where("event_type <> 'error'")
    return shown.selectExpr("clip_id", "seq", "pts_ns", "row_number() OVER (PARTITION BY clip_id ORDER BY seq) AS r").where("r <= 20").drop("r")


@query("median_motion", "F4", f"""WITH {PACKETS}, m AS (SELECT clip_id, seq, event_id * 37 % 61 - 30 AS v FROM p), n AS (SELECT *, coalesce(lag(v, 1) OVER w, 0) AS a, coalesce(lag(v, 2) OVER w, 0) AS b, coalesce(lag(v, 3) OVER w, 0) AS c FROM m WINDOW w AS (PARTITION BY clip_id ORDER BY seq))
SELECT clip_id, seq, greatest(least(a, b), least(greatest(a, b), c)) AS predicted, v - greatest(least(a, b), least(greatest(a, b), c)) AS residual FROM n""")
def median_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packets(spark, sf_dir).selectExpr("clip_id", "seq", "event_id * 37 % 61 - 30 AS v")
    rows = rows.selectExpr("*", *[f"coalesce(lag(v, {k}) OVER (PARTITION BY clip_id ORDER BY seq), 0) AS {n}" for k, n in ((1, "a"), (2, "b"), (3, "c"))])
    rows = rows.withColumn("predicted", integers.median3(F.col("a"), F.col("b"), F.col("c")))
    return rows.select("clip_id", "seq", "predicted", (F.col("v") - F.col("predicted")).alias("residual"))


@query("frame_times", "P6", "WITH r(num, den) AS (VALUES (30, 1), (25, 1), (24000, 1001), (30000, 1001), (60000, 1001), (15500, 1000)) SELECT CAST(num AS BIGINT) AS num, CAST(den AS BIGINT) AS den, i AS n, CAST(i AS BIGINT) * den * 1000000000 // num AS t_ns, i AS back FROM r, range(2000) t(i)")
def frame_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = spark.createDataFrame([(30, 1), (25, 1), (24000, 1001), (30000, 1001), (60000, 1001), (15500, 1000)], "num long, den long")
    rows = rates.select("num", "den", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1999).cast("long"))).alias("n")).withColumn("t_ns", timing.frame_time(F.col("n"), F.col("num"), F.col("den")))
    return rows.withColumn("back", timing.frame_at(F.col("t_ns"), F.col("num"), F.col("den")))


@query("rational_rates", "P7", """WITH f AS (SELECT i, CASE WHEN i % 3 = 0 THEN i / 8.0 WHEN i % 3 = 1 THEN i * 1000 / 1001.0 ELSE i + 0.0004 END AS fps FROM range(-3, 130) t(i)),
k(n) AS (VALUES (24), (25), (30), (48), (50), (60), (120)), m AS (SELECT i, min(n) FILTER (abs(fps - n) < 1e-6) AS a, min(n) FILTER (abs(fps - n * 1000 / 1001.0) < 1e-3) AS b FROM f, k GROUP BY 1)
SELECT i, CAST(CASE WHEN fps <= 0 THEN 30 WHEN a IS NOT NULL AND (b IS NULL OR a <= b) THEN a WHEN b IS NOT NULL THEN b * 1000 ELSE round(fps * 1000) END AS BIGINT) AS num,
  CAST(CASE WHEN fps <= 0 THEN 1 WHEN a IS NOT NULL AND (b IS NULL OR a <= b) THEN 1 WHEN b IS NOT NULL THEN 1001 ELSE 1000 END AS BIGINT) AS den FROM f JOIN m USING (i)""")
def rational_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.range(-3, 130).select(F.col("id").alias("i"), F.expr("CASE WHEN id % 3 = 0 THEN id / 8.0D WHEN id % 3 = 1 THEN id * 1000 / 1001.0D ELSE id + 0.0004D END").alias("fps"))
    return rows.withColumn("r", timing.rational_rate(F.col("fps"))).select("i", "r.num", "r.den")


@query("integer_codes", "F2 F3", """WITH e AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id * 31 ELSE -event_id * 17 END AS v FROM events), z AS (SELECT *, CASE WHEN v >= 0 THEN 2 * v ELSE -2 * v - 1 END AS u FROM e)
SELECT event_id, CAST(u AS BIGINT) AS zigzag, v AS back, CASE WHEN u = 0 THEN 0 ELSE length(bin(u)) END AS class, 2 * (length(bin(u + 1)) - 1) + 1 AS golomb_bits,
  CASE WHEN u < 128 THEN printf('%02X', u) WHEN u < 16384 THEN printf('%02X%02X', u % 128 + 128, u // 128) WHEN u < 2097152 THEN printf('%02X%02X%02X', u % 128 + 128, u // 128 % 128 + 128, u // 16384)
    ELSE printf('%02X%02X%02X%02X', u % 128 + 128, u // 128 % 128 + 128, u // 16384 % 128 + 128, u // 2097152) END AS leb128 FROM z""")
def integer_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "CASE WHEN event_id % 2 = 0 THEN event_id * 31 ELSE -event_id * 17 END AS v").withColumn("zigzag", integers.zigzag_encode(F.col("v")))
    u = F.col("zigzag")
    return rows.select("event_id", "zigzag", integers.zigzag_decode(u).alias("back"), integers.bit_class(u).alias("class"), integers.exp_golomb_bits(u).alias("golomb_bits"), integers.leb128_hex(u).alias("leb128"))


@query("implicit_weights", "F4 F21", """WITH c AS (SELECT event_id, event_id % 97 - 48 AS cur, event_id * 5 % 89 - 44 AS past, event_id * 11 % 83 - 41 AS fut FROM events), d AS (SELECT *, least(greatest(cur - past, -128), 127) AS tb, least(greatest(fut - past, -128), 127) AS td FROM c),
s AS (SELECT *, CASE WHEN td <> 0 THEN (tb * CASE WHEN td > 0 THEN (16384 + (abs(td) >> 1)) // td ELSE -((16384 + (abs(td) >> 1)) // abs(td)) END + 32) >> 8 END AS k FROM d), w AS (SELECT *, CASE WHEN k BETWEEN -64 AND 128 THEN 64 - k ELSE 32 END AS w0 FROM s)
SELECT event_id, w0, least(greatest((event_id % 256 * w0 + event_id * 3 % 256 * (64 - w0) + 32) >> 6, 0), 255) AS mixed FROM w""")
def implicit_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "event_id % 97 - 48 AS cur", "event_id * 5 % 89 - 44 AS past", "event_id * 11 % 83 - 41 AS fut")
    rows = rows.withColumn("w0", integers.implicit_weight(F.col("cur"), F.col("past"), F.col("fut")))
    mixed = F.shiftright(F.col("event_id") % 256 * F.col("w0") + F.col("event_id") * 3 % 256 * (F.lit(64) - F.col("w0")) + 32, 6)
    return rows.select("event_id", "w0", integers.clamp(mixed, 0, 255).alias("mixed"))
