"""Queries over reference pictures, codecs and playback."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import samples, timing
from ..operators import codec, references, streams
from ..sources import gop_container, obu
from ..sources.bits import BitWriter
from ..sources.packets import muxed, scan
from ..streaming import player
from . import pixel_queries, stream_queries
from .registry import parts, query, table

_G = "WITH " + stream_queries.PACKETS + ", g AS (SELECT *, CAST(sum(CAST(is_key AS INT)) OVER (PARTITION BY clip_id ORDER BY seq) AS BIGINT) AS gop_id FROM p)"


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.with_groups(stream_queries.packets(spark, sf_dir))


@query("ref_lists", "O2", _G + """, c AS (SELECT a.clip_id, a.seq, a.event_id * 7 % 31 AS cur_poc, a.event_id % 3 = 0 AS is_b, b.seq AS pic_num, b.event_id * 7 % 31 AS poc, CASE WHEN b.event_id % 5 = 0 THEN b.event_id % 4 END AS lt FROM g a JOIN g b ON a.clip_id = b.clip_id AND a.gop_id = b.gop_id AND b.seq BETWEEN a.seq - 4 AND a.seq - 1),
o AS (SELECT *, row_number() OVER (PARTITION BY clip_id, seq ORDER BY lt IS NOT NULL, CASE WHEN lt IS NULL THEN -pic_num END, lt, pic_num) - 1 AS p,
  row_number() OVER (PARTITION BY clip_id, seq ORDER BY lt IS NOT NULL, CASE WHEN lt IS NULL THEN poc >= cur_poc END, CASE WHEN lt IS NULL THEN abs(poc - cur_poc) END, lt, pic_num) - 1 AS b0,
  row_number() OVER (PARTITION BY clip_id, seq ORDER BY lt IS NOT NULL, CASE WHEN lt IS NULL THEN poc < cur_poc END, CASE WHEN lt IS NULL THEN abs(poc - cur_poc) END, lt, pic_num) - 1 AS b1 FROM c),
s AS (SELECT *, max(CASE WHEN b0 <> b1 THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id, seq) = 0 AND count(*) OVER (PARTITION BY clip_id, seq) > 1 AS same FROM o)
SELECT clip_id, seq, pic_num, CASE WHEN is_b THEN b0 ELSE p END AS l0, CASE WHEN is_b THEN CASE WHEN same AND b1 < 2 THEN 1 - b1 ELSE b1 END END AS l1 FROM s""")
def ref_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grouped(spark, sf_dir).selectExpr("clip_id", "gop_id", "seq", "event_id")
    near = rows.select("clip_id", "gop_id", "seq", F.col("event_id").alias("e"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("d")).withColumn("pic_num", F.col("seq") - F.col("d"))
    found = near.join(rows.withColumnRenamed("seq", "pic_num"), ["clip_id", "gop_id", "pic_num"])
    found = found.selectExpr("clip_id", "seq", "e * 7 % 31 AS cur_poc", "e % 3 = 0 AS is_b", "pic_num", "event_id * 7 % 31 AS poc", "CASE WHEN event_id % 5 = 0 THEN event_id % 4 END AS long_term")
    return references.initial_lists(found, ["clip_id", "seq"]).select("clip_id", "seq", "pic_num", "l0", "l1")


_KEPT = _G + ", k AS (SELECT clip_id, seq, event_id, list(seq) FILTER (event_type <> 'error') OVER (PARTITION BY clip_id, gop_id ORDER BY seq) AS refs FROM g)"


@query("dpb_sliding_window", "U1", _KEPT + " SELECT clip_id, seq, coalesce(array_to_string(refs[greatest(1, len(refs) - 2):], ','), '') AS kept FROM k")
def dpb_sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grouped(spark, sf_dir).withColumn("is_ref", F.col("event_type") != "error")
    return references.sliding_window(rows, 3).select("clip_id", "seq", F.array_join("kept", ",").alias("kept"))


@query("adaptive_marking", "U1")
def adaptive_marking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marking commands of all six kinds among pictures that slide."""
    op = "named_struct('op', cast(event_id % 7 AS int), 'arg', cast(event_id div 7 % 3 AS int), 'index', cast(event_id div 21 % 3 AS int))"
    rows = grouped(spark, sf_dir).selectExpr("clip_id", "gop_id", "seq", "event_type <> 'error' AS is_ref", "cast(seq % 16 AS int) AS frame_num", f"CASE WHEN event_id % 5 = 0 AND event_id % 7 > 0 THEN array({op}) END AS ops")
    return references.adaptive_marking(rows, 4, bits=4).select("clip_id", "gop_id", "seq", F.array_join("short", ",").alias("short"), F.array_join("long", ",", "-").alias("long"))


@query("reference_lookup", "J2", _KEPT + " SELECT clip_id, seq, refs[greatest(1, len(refs) - 2):][CAST(event_id % 3 + 1 AS INT)] AS ref FROM k")
def reference_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The picture that an index names among those kept; null where there is none."""
    rows = grouped(spark, sf_dir).withColumn("is_ref", F.col("event_type") != "error")
    kept = references.sliding_window(rows, 3).select("clip_id", "seq", "kept")
    return rows.select("clip_id", "seq", "event_id").join(kept, ["clip_id", "seq"]).select("clip_id", "seq", F.get("kept", (F.col("event_id") % 3).cast("int")).alias("ref"))


@query("last_and_golden", "U4", _G + """, f AS (SELECT clip_id, seq, is_key, event_type = 'error' AS raw FROM g), w AS (SELECT *, last_value(CASE WHEN NOT raw THEN seq END IGNORE NULLS) OVER v AS l, last_value(CASE WHEN is_key AND NOT raw THEN seq END IGNORE NULLS) OVER v AS gd FROM f WINDOW v AS (PARTITION BY clip_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT clip_id, seq, CASE WHEN NOT is_key THEN l END AS last_ref, CASE WHEN NOT is_key THEN gd END AS golden_ref FROM w""")
def last_and_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grouped(spark, sf_dir).withColumn("is_raw", F.col("event_type") == "error")
    return references.buffers(rows).select("clip_id", "seq", "last_ref", "golden_ref")


@query("vp8_reference_update", "U2", _G.replace("WITH ", "WITH RECURSIVE ", 1) + """, s AS (SELECT clip_id, gop_id, seq, is_key, event_id % 3 <> 0 AS rl, event_id % 4 AS cg, event_id // 4 % 4 AS ca, row_number() OVER (PARTITION BY clip_id, gop_id ORDER BY seq) AS i FROM g),
w AS (SELECT clip_id, gop_id, seq, i, CASE WHEN is_key OR rl THEN seq END AS l, CASE WHEN is_key OR cg = 3 THEN seq END AS gd, CASE WHEN is_key OR ca = 3 THEN seq END AS a FROM s WHERE i = 1
  UNION ALL SELECT clip_id, gop_id, seq, i, CASE WHEN is_key OR rl THEN seq ELSE l END, CASE WHEN cg = 3 OR is_key THEN seq WHEN cg = 1 THEN l WHEN cg = 2 THEN na ELSE gd END, CASE WHEN ca = 3 THEN seq ELSE na END FROM
   (SELECT s.*, l, gd, a, CASE WHEN is_key THEN s.seq WHEN ca = 1 THEN l WHEN ca = 2 THEN gd ELSE a END AS na FROM w JOIN s ON s.clip_id = w.clip_id AND s.gop_id = w.gop_id AND s.i = w.i + 1))
SELECT clip_id, gop_id, seq, l AS last, gd AS golden, a AS altref FROM w""")
def vp8_reference_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grouped(spark, sf_dir).selectExpr("clip_id", "gop_id", "seq", "is_key", "event_id % 3 <> 0 AS refresh_last", "event_id % 4 AS copy_golden", "event_id div 4 % 4 AS copy_altref")
    return references.vp8_buffers(rows)


@query("colocated_motion", "", _G + """, m AS (SELECT clip_id, seq, gop_id, event_id * 37 % 61 - 30 AS mv, event_id * 7 % 31 AS poc FROM g)
SELECT a.clip_id, a.seq, a.mv - b.mv AS delta, abs(b.mv) <= 1 AS still FROM m a LEFT JOIN m b ON b.clip_id = a.clip_id AND b.gop_id = a.gop_id AND b.seq = a.seq - 2""")
def colocated_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motion against that of the same place two pictures ago, within the group."""
    rows = grouped(spark, sf_dir).selectExpr("clip_id", "gop_id", "seq", "event_id * 37 % 61 - 30 AS mv")
    other = rows.select("clip_id", "gop_id", (F.col("seq") + 2).alias("seq"), F.col("mv").alias("col"))
    return rows.join(other, ["clip_id", "gop_id", "seq"], "left").select("clip_id", "seq", (F.col("mv") - F.col("col")).alias("delta"), (F.abs("col") <= 1).alias("still"))


def synthetic_frames(spark: SparkSession) -> DataFrame:
    """The moving test clip as frames with flat chroma."""
    w, h = pixel_queries.W, pixel_queries.H
    flat = bytes([128]) * (w * h // 4)

    def build(rows: pa.Table) -> pa.Table:
        luma = bytes(rows.sort_by([("y", "ascending"), ("x", "ascending")])["v"].to_pylist())
        n = rows["n"][0].as_py()
        return pa.table({"clip_id": ["pan"], "n": [n], "width": pa.array([w], pa.int32()), "height": pa.array([h], pa.int32()), "y": [luma], "cb": [flat], "cr": [flat]})

    frames = pixel_queries.pan(spark).groupBy("n").applyInArrow(build, "clip_id string, n long, width int, height int, y binary, cb binary, cr binary")
    return frames.withColumn("pts_ns", timing.frame_time(F.col("n"), F.lit(30).cast("long"), F.lit(1).cast("long")))


def _luma_totals(frames: DataFrame) -> DataFrame:
    values = F.transform(F.sequence(F.lit(1), F.length("y")), lambda i: F.conv(F.hex(F.substring("y", i, F.lit(1))), 16, 10).cast("long"))
    return frames.withColumn("total", F.aggregate(values, F.lit(0).cast("long"), lambda acc, v: acc + v))


@query("raw_codec", "X2 T2 F27 F28", f"WITH {pixel_queries.PAN} SELECT n, CAST(n * 1000000000 // 30 AS BIGINT) AS pts_ns, count(*) AS samples, CAST(sum(v) AS BIGINT) AS total FROM px GROUP BY n")
def raw_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames to packets, to a file, to packets, to frames, in the uncompressed mode."""
    header = gop_container.Header(pixel_queries.W, pixel_queries.H, 30, 1)
    made = muxed(codec.encode(synthetic_frames(spark), 5), lambda packets: gop_container.build(header, packets))
    frames = codec.decode(scan(made, gop_container.parse, strict=True), strict=True)
    return _luma_totals(frames).select("n", "pts_ns", F.octet_length("y").cast("long").alias("samples"), "total")


@query("transcode", "S20 O8", f"SELECT CAST(n AS BIGINT) AS seq, n % 3 = 0 AS is_key, CASE WHEN n % 3 = 0 THEN 6 ELSE 1 END + {pixel_queries.W * pixel_queries.H * 3 // 2} AS bytes FROM range(7) t(n)")
def transcode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first seven frames, with a key frame every three: the limit is the feature."""
    packets = codec.encode(synthetic_frames(spark), 5).withColumn("codec", F.lit("gop"))
    return codec.transcode(packets, 3, 7).select("seq", "is_key", F.octet_length("data").alias("bytes"))


@query("av1_sequence_headers", "P9", "SELECT p_partkey, 0 AS profile, p_size * 31 AS width, p_size * 17 + 1 AS height, p_partkey % 24 AS level, p_partkey % 2 = 0 AS superblock_128, 7 AS order_bits FROM part")
def av1_sequence_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = BitWriter().u(0, 3).u(0, 1).u(0, 1).u(0, 1).u(0, 1).u(0, 5).u(0, 12).u(k % 24, 5)
                if k % 24 > 7:
                    w.u(0, 1)
                w.u(10, 4).u(9, 4).u(s * 31 - 1, 11).u(s * 17, 10).u(0, 1).u(k % 2 == 0, 1).u(3, 2).u(15, 4).u(1, 1).u(3, 2).u(1, 1).u(1, 1).u(6, 3).u(0, 3).u(0, 1).u(0, 1).u(0, 1).u(0, 1).u(0, 2).u(0, 1).u(0, 1)
                (unit,) = obu.split(obu.build(1, w.bytes(stop=True)))
                h = obu.sequence_header(unit.payload)
                out.append((k, h["profile"], h["width"], h["height"], h["points"][0][1], h["superblock_128"], h["order_bits"]))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["p_partkey", "profile", "width", "height", "level", "superblock_128", "order_bits"])

    return parts(spark, sf_dir, "p_partkey", "p_size").mapInArrow(run, "p_partkey long, profile long, width long, height long, level long, superblock_128 boolean, order_bits long")


@query("packet_throughput", "A12", "SELECT user_id AS clip_id, date_trunc('hour', ts) AS start, count(*) AS packets, CAST(sum(CAST(event_type = 'signup' AS INT)) AS BIGINT) AS keys, CAST(sum(octet_length(encode(props))) AS BIGINT) AS bytes FROM events GROUP BY 1, 2")
def packet_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("user_id AS clip_id", "date_trunc('hour', ts) AS start", "event_type = 'signup' AS is_key", "props")
    return rows.groupBy("clip_id", F.col("start").cast("timestamp_ntz").alias("start")).agg(F.count("*").alias("packets"), F.sum(F.col("is_key").cast("long")).alias("keys"), F.sum(F.octet_length("props")).cast("long").alias("bytes"))


def player_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as a player's input: views are packets, clicks ticks, signups play, errors pause, purchases seek."""
    rows = stream_queries.packets(spark, sf_dir).withColumn("t_ns", F.col("pts_ns") - 1_704_067_200_000_000_000)
    kind = F.create_map(*[F.lit(x) for pair in (("view", "packet"), ("click", "tick"), ("signup", "play"), ("error", "pause"), ("purchase", "seek")) for x in pair])[F.col("event_type")]
    gen = F.expr("sum(cast(event_type = 'purchase' AS BIGINT)) OVER (PARTITION BY clip_id ORDER BY seq)")
    rows = rows.select(F.col("clip_id").alias("session"), F.col("seq").cast("long").alias("at"), kind.alias("kind"), "t_ns", F.col("event_id").alias("n"), gen.alias("gen"))
    return rows.withColumn("t_ns", F.when(F.col("kind") == "packet", F.expr("t_ns div 4")).when(F.col("kind") == "seek", F.expr("t_ns div 8")).otherwise(F.col("t_ns")))


@query("playback", "T1 T4 T5 T7")
def playback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The player over whole sessions; the streaming form gives the same rows."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        one, out = player.Player(), []
        for r in rows.sort_values("at").itertuples():
            found = one.feed(r.kind, int(r.t_ns), int(r.n), int(r.gen))
            if found:
                out.append((r.session, r.at, *found))
        return pd.DataFrame(out, columns=["session", "at", "t_ns", "shown", "changed", "status", "dropped"])

    return player_input(spark, sf_dir).groupBy("session").applyInPandas(run, player.OUTPUT)


@query("coded_quality", "F10 F11 F12 F13 F19 F20 F27 F28 O4 O5 O7 A8 U4 X3")
def coded_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The moving test clip through the transform-coded modes (qp 20, groups of six, two by two tiles, a denoised
    reference), a file, and back: bytes and luma error of each frame."""
    frames = synthetic_frames(spark)
    header = gop_container.Header(pixel_queries.W, pixel_queries.H, 30, 1)
    made = muxed(codec.encode_coded(frames, 6, 20, 2, 2, 4), lambda packets: gop_container.build(header, packets))
    packets = scan(made, gop_container.parse, strict=True)
    back = codec.decode(packets, strict=True).select("n", F.col("y").alias("r"))
    at = F.sequence(F.lit(1), F.length("y"))
    byte = lambda c, i: F.conv(F.hex(F.substring(c, i, F.lit(1))), 16, 10).cast("long")
    error = F.aggregate(F.transform(at, lambda i: (byte("y", i) - byte("r", i)) * (byte("y", i) - byte("r", i))), F.lit(0).cast("long"), lambda acc, v: acc + v)
    rows = frames.select("n", "y").join(back, "n").withColumn("sse", error).join(packets.select(F.col("seq").alias("n"), F.octet_length("data").alias("bytes")), "n")
    return rows.select("n", "bytes", "sse", F.round(samples.psnr(F.col("sse"), F.length("y"), 99.0), 6).alias("psnr"))


@query("group_planning", "W1 W2", "WITH RECURSIVE " + stream_queries.PACKETS + """, w AS (SELECT clip_id, seq, event_type = 'error' AS cut, CAST(0 AS BIGINT) AS gop_id, 1 AS held FROM p WHERE seq = 0
  UNION ALL SELECT p.clip_id, p.seq, p.event_type = 'error', gop_id + CASE WHEN held >= 12 OR (p.event_type = 'error' AND held >= 8) THEN 1 ELSE 0 END, CASE WHEN held >= 12 OR (p.event_type = 'error' AND held >= 8) THEN 1 ELSE held + 1 END
  FROM w JOIN p ON p.clip_id = w.clip_id AND p.seq = w.seq + 1)
SELECT clip_id, seq AS n, cut, gop_id FROM w""")
def group_planning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of at most 12 packets that close before an error, once they have eight."""
    rows = stream_queries.packets(spark, sf_dir).select("clip_id", F.col("seq").cast("long").alias("n"), (F.col("event_type") == "error").alias("cut"))
    return streams.planned_groups(rows, 12)
