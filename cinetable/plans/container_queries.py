"""Queries over containers and bitstreams. The files are built from the driver's tables, then read."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rans, timing
from ..functions.bool_coder import BoolReader, BoolWriter
from ..operators import tokens
from ..sources import dispatch, gop_container, mp4, mpeg_ps, nal, obu, raw, webm
from ..sources.batches import slices
from ..sources.bits import Bits, BitWriter
from ..sources.packets import muxed, scan
from . import pixel_queries, stream_queries, token_queries
from .registry import parts, query, table

WIDTH, HEIGHT, NUM, DEN, GOP = 64, 48, 30000, 1001, 10
#: Documents of a clip at most: a clip is a language and a range of ids, so clips stay small however large the table is.
CLIP_IDS = 256
_CLIP = f"lang || '-' || (doc_id // {CLIP_IDS})"
_DOCS = f"p AS (SELECT {_CLIP} AS clip_id, row_number() OVER (PARTITION BY {_CLIP} ORDER BY doc_id) - 1 AS seq, encode(lang || text) AS data FROM documents)"
_READ = f"SELECT clip_id, seq, CAST(seq * {DEN} * 1000000000 // {NUM} AS BIGINT) AS pts_ns, seq % {GOP} = 0 AS is_key, octet_length(data) AS bytes, md5(data) AS digest FROM p"


def document_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as packets: a language and CLIP_IDS ids are a clip, every tenth document a key packet."""
    docs = table(spark, sf_dir, "documents").selectExpr(f"concat(lang, '-', doc_id div {CLIP_IDS}) AS clip_id", "doc_id", "lang", "text")
    rows = docs.selectExpr("clip_id", "row_number() OVER (PARTITION BY clip_id ORDER BY doc_id) - 1 AS seq", "encode(concat(lang, text), 'UTF-8') AS data")
    return rows.select("clip_id", F.col("seq").cast("long").alias("seq"), timing.frame_time(F.col("seq"), F.lit(NUM).cast("long"), F.lit(DEN).cast("long")).alias("pts_ns"), (F.col("seq") % GOP == 0).alias("is_key"), "data")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where both are one process and none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="cinetable-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def digest(packets: DataFrame) -> DataFrame:
    return packets.select("clip_id", "seq", "pts_ns", "is_key", F.octet_length("data").alias("bytes"), F.md5("data").alias("digest"))


def gop_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = gop_container.Header(WIDTH, HEIGHT, NUM, DEN)
    return muxed(document_packets(spark, sf_dir), lambda packets: gop_container.build(header, packets))


@query("packet_scan", "S8 S9 S11 S13 X1", f"WITH {_DOCS} {_READ}")
def packet_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(gop_files(spark, sf_dir), gop_container.parse, strict=True))


@query("container_rebuild", "S10", f"WITH {_DOCS} {_READ}")
def container_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files lost their last bytes, so the index is rebuilt from the records."""
    cut = gop_files(spark, sf_dir).withColumn("content", F.expr("substring(content, 1, octet_length(content) - 7)"))
    return digest(scan(cut, gop_container.parse, strict=True))


def written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document packets, written and read through the data source."""
    spark.dataSource.register(gop_container.GopSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    path = f"{shared_folder(spark)}/gop-{uuid.uuid4().hex}"
    rows = document_packets(spark, sf_dir).selectExpr("clip_id", "'gop' AS codec", f"{WIDTH} AS width", f"{HEIGHT} AS height", "1 AS track", "seq", "pts_ns", "is_key", "data", "cast(null AS string) AS _error")
    rows.repartition("clip_id").sortWithinPartitions("clip_id", "seq").write.format("gop").mode("append").options(path=path, width=WIDTH, height=HEIGHT, num=NUM, den=DEN).save()
    return spark.read.format("gop").load(path)


@query("split_scan", "S9 S12 S13 X1 X3", f"WITH {_DOCS} SELECT * FROM ({_READ}) WHERE seq BETWEEN 25 AND 47")
def split_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of seq, for which each file's index leads to the groups of pictures that hold it: pruning is the feature."""
    return digest(written(spark, sf_dir).where("seq BETWEEN 25 AND 47"))


@query("split_scan_full", "S9 S11 S13 X1", f"WITH {_DOCS} {_READ}")
def split_scan_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that was written."""
    return digest(written(spark, sf_dir))


@query("file_headers", "S8", f"SELECT DISTINCT {_CLIP} AS clip_id, TRUE AS known, 4 AS version, 48 AS size, {WIDTH} AS width, {HEIGHT} AS height, {NUM} AS num, {DEN} AS den, 0 AS tile_cols, 0 AS tile_rows FROM documents")
def file_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header fields by SQL functions on the file's first bytes."""
    heads = gop_files(spark, sf_dir).select("clip_id", raw.gop_file_header(F.col("content")).alias("h")).select("clip_id", "h.*")
    return heads.withColumn("known", F.col("magic") == gop_container.MAGIC.decode()).drop("magic")


@query("packet_headers", "P12", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END AS type, p_partkey % 8 AS coding, p_partkey % 3 = 0 AND p_partkey % 2 = 0 AS override,
  CASE WHEN p_partkey % 3 = 0 THEN p_size * 16 END AS width, CASE WHEN p_partkey % 3 = 0 THEN p_size * 8 + 1 END AS height FROM part""")
def packet_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [gop_container.packet_header(k % 3 == 0, k % 8, s * 16, s * 8 + 1, k % 6 == 0) for k, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], names=["p_partkey", "data"])

    made = parts(spark, sf_dir, "p_partkey", "p_size").mapInArrow(build, "p_partkey long, data binary")
    return made.select("p_partkey", raw.gop_packet_header(F.col("data")).alias("h")).select("p_partkey", "h.*")


_EVENTS = "WITH " + stream_queries.PACKETS + ", f AS (SELECT *, is_key OR seq = 0 AS key FROM p)"


def event_packets(spark: SparkSession, sf_dir: str, unit: int) -> DataFrame:
    """`events` as packets with times since 2024 in whole `unit` nanoseconds; the first of a clip is a key packet."""
    rows = stream_queries.packets(spark, sf_dir)
    return rows.select("clip_id", "seq", F.expr(f"(pts_ns - 1704067200000000000) div {unit} * {unit}").alias("pts_ns"), (F.col("is_key") | (F.col("seq") == 0)).alias("is_key"), F.encode("props", "UTF-8").alias("data"))


@query("mp4_scan", "S1 S2 S18", _EVENTS + """, q AS (SELECT *, (pts_ns - 1704067200000000000) // 10000000 * 10000000 AS t FROM f)
SELECT CAST(clip_id AS VARCHAR) AS clip_id, seq, CAST(t - min(t) OVER (PARTITION BY clip_id) AS BIGINT) AS pts_ns, key AS is_key, octet_length(encode(props)) + CASE WHEN key THEN 14 ELSE 0 END AS bytes FROM q""")
def mp4_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times are composition times from the first sample on; key samples carry the parameter sets."""
    made = muxed(event_packets(spark, sf_dir, 10_000_000), lambda packets: mp4.build(packets, 160, 120, scale=100))
    return scan(made, dispatch.parse_any, strict=True).select("clip_id", "seq", "pts_ns", "is_key", F.octet_length("data").alias("bytes"))


@query("webm_scan", "S4 S5 S6", _EVENTS + " SELECT CAST(clip_id AS VARCHAR) AS clip_id, seq, CAST((pts_ns - 1704067200000000000) // 1000000 * 1000000 AS BIGINT) AS pts_ns, key AS is_key, octet_length(encode(props)) AS bytes, md5(encode(props)) AS digest FROM f")
def webm_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = muxed(event_packets(spark, sf_dir, 1_000_000), lambda packets: webm.build(packets, 160, 120))
    return digest(scan(made, webm.parse, strict=True))


@query("mpeg_scan", "S7", _EVENTS + " SELECT CAST(clip_id AS VARCHAR) AS clip_id, seq, CAST((pts_ns - 1704067200000000000) // 1000000000 * 1000000000 % 86400000000000 AS BIGINT) AS pts_ns, key AS is_key, octet_length(encode(props)) + CASE WHEN key THEN 28 ELSE 8 END AS bytes FROM f")
def mpeg_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Program streams with an audio stream in between; key packets carry sequence and group headers. Stamps have 33
    bits, so times are taken within a day."""
    rows = event_packets(spark, sf_dir, 1_000_000_000).withColumn("pts_ns", F.col("pts_ns") % 86_400_000_000_000)
    made = muxed(rows, lambda packets: mpeg_ps.build(packets, 160, 120))
    return scan(made, mpeg_ps.parse, strict=True).select("clip_id", "seq", "pts_ns", "is_key", F.octet_length("data").alias("bytes"))


def _unit_packets(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Each document's lines as the units of one packet; a network unit's payload ends in a stop bit, so zeros that end a
    line aren't taken for padding."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            rows = []
            for text in b.column(1).to_pylist():
                lines = [line.encode() for line in text.split("\n") if line]
                if kind == "obu":
                    rows.append(b"".join(obu.build(6, line, temporal=i % 8, spatial=i % 4) for i, line in enumerate(lines)))
                    continue
                units = [bytes([0x41]) + nal.escape(b"\0\0\1" + line + b"\x80") for line in lines]
                rows.append(b"".join(len(u).to_bytes(4, "big") + u for u in units) if kind == "length" else b"".join(b"\0\0\0\1" + u for u in units))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([0] * len(rows), pa.int64()), pa.array(rows, pa.binary())], names=["clip_id", "seq", "data"])

    return table(spark, sf_dir, "documents").selectExpr("cast(doc_id AS string) AS clip_id", "coalesce(text, '') AS text").mapInArrow(build, "clip_id string, seq long, data binary")


def _unit_digests(units: DataFrame) -> DataFrame:
    return units.select("clip_id", "i", "ref_idc", "type", F.md5(F.expr("substring(rbsp, 1, octet_length(rbsp) - 1)")).alias("digest"))


_LINES = "WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS clip_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS ls FROM documents), l AS (SELECT clip_id, unnest(ls) AS line, CAST(unnest(range(len(ls))) AS INT) AS i FROM d)"


@query("nal_split", "S14 F1", _LINES + " SELECT clip_id, i, 2 AS ref_idc, 1 AS type, md5('\\x00\\x00\\x01'::BLOB || encode(line)) AS digest FROM l")
def nal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unit_digests(nal.nals(_unit_packets(spark, sf_dir, "length")))


@query("start_code_split", "S15", _LINES + " SELECT clip_id, i, 2 AS ref_idc, 1 AS type, md5('\\x00\\x00\\x01'::BLOB || encode(line)) AS digest FROM l")
def start_code_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unit_digests(nal.nals(_unit_packets(spark, sf_dir, "annexb"), "annexb"))


@query("obu_split", "S16", _LINES + " SELECT clip_id, i, 6 AS type, i % 8 AS temporal_id, i % 4 AS spatial_id, md5(encode(line)) AS digest FROM l")
def obu_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obu.obus(_unit_packets(spark, sf_dir, "obu")).select("clip_id", "i", "type", "temporal_id", "spatial_id", F.md5("payload").alias("digest"))


@query("vp8_headers", "P11", """SELECT p_partkey, p_partkey % 4 = 0 AS is_key, p_partkey % 3 AS version, p_partkey % 5 <> 0 AS shown, p_partkey * 7 AS first_part, CASE WHEN p_partkey % 4 = 0 THEN TRUE END AS start_code,
  CASE WHEN p_partkey % 4 = 0 THEN p_size * 16 END AS width, CASE WHEN p_partkey % 4 = 0 THEN p_partkey % 4 END AS scale_x, CASE WHEN p_partkey % 4 = 0 THEN p_size * 9 END AS height, CASE WHEN p_partkey % 4 = 0 THEN p_size % 4 END AS scale_y FROM part""")
def vp8_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tag's size has 19 bits; what a made-up size has beyond them goes beside the header."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tag = (k % 4 != 0) | (k % 3) << 1 | (k % 5 != 0) << 4 | k * 7 % (1 << 19) << 5
                rows.append(tag.to_bytes(3, "little") + (b"\x9d\x01\x2a" + (s * 16 | (k % 4) << 14).to_bytes(2, "little") + (s * 9 | (s % 4) << 14).to_bytes(2, "little") if k % 4 == 0 else b"rest"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], names=["p_partkey", "data"])

    made = parts(spark, sf_dir, "p_partkey", "p_size").mapInArrow(build, "p_partkey long, data binary")
    beyond = F.shiftright(F.col("p_partkey") * 7, 19) * (1 << 19)
    return made.select("p_partkey", raw.vp8_tag(F.col("data")).alias("h")).select("p_partkey", F.col("h").withField("first_part", F.col("h.first_part") + beyond).alias("h")).select("p_partkey", "h.*")


@query("h264_parameter_sets", "P4 P5 P8", """SELECT p_partkey, 66 AS profile, p_size * 16 - 2 * (p_partkey % 4) AS width, (p_size + 3) * 16 - 2 * (p_partkey % 3) AS height, 4 + p_partkey % 5 AS frame_num_bits, p_partkey % 16 AS ref_frames,
  20 + p_partkey % 13 AS qp, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 0 END AS slice_type, p_partkey % 16 AS frame_num, 17 + p_partkey % 13 AS slice_qp FROM part""")
def h264_parameter_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameter sets and slice headers built from `part` by a bit writer, and parsed back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                bits = 4 + k % 5
                sps = BitWriter().u(66, 8).u(0, 8).u(30, 8).ue(0).ue(bits - 4).ue(2).ue(k % 16).u(0, 1).ue(s - 1).ue(s + 2).u(1, 1).u(1, 1).u(1, 1).ue(0).ue(k % 4).ue(0).ue(k % 3).u(0, 1).bytes(stop=True)
                pps = BitWriter().ue(0).ue(0).u(0, 2).ue(0).ue(0).ue(0).u(0, 3).se(k % 13 - 6).se(0).se(0).u(0, 3).bytes(stop=True)
                intra = k % 2 == 0
                head = BitWriter().ue(0).ue(7 if intra else 5).ue(0).u(k % 16, bits)
                if not intra:
                    head.u(0, 1).u(0, 1)
                head = head.u(0, 1).se(-3)
                p, q = nal.parse_sps(nal.unescape(nal.escape(sps))), nal.parse_pps(pps)
                h = nal.parse_slice(nal.Nal(1, 1, head.bytes(stop=True)), p, q)
                out.append((k, p["profile"], p["width"], p["height"], p["frame_num_bits"], p["ref_frames"], q["qp"], h["type"], h["frame_num"], h["qp"]))
            names = ["p_partkey", "profile", "width", "height", "frame_num_bits", "ref_frames", "qp", "slice_type", "frame_num", "slice_qp"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    return parts(spark, sf_dir, "p_partkey", "p_size").mapInArrow(run, "p_partkey long, profile long, width long, height long, frame_num_bits long, ref_frames long, qp long, slice_type long, frame_num long, slice_qp long")


@query("scaling_lists", "P14", """WITH l AS (SELECT p_partkey, i, (p_partkey >> i) & 1 AS sent, (p_partkey + 7 * i) % 41 AS v, CASE WHEN i < 6 THEN 16 ELSE 64 END AS n, CASE WHEN i < 6 THEN i // 3 ELSE i END AS kind,
  CASE WHEN i < 3 THEN 416 WHEN i < 6 THEN 369 WHEN i = 6 THEN 1680 ELSE 1507 END AS standard FROM part, (SELECT unnest(range(8)) AS i)),
o AS (SELECT *, CASE WHEN sent = 1 AND v > 0 THEN v * n WHEN sent = 1 OR i IN (0, 3, 6, 7) THEN standard END AS own FROM l)
SELECT p_partkey, i AS list, last_value(own IGNORE NULLS) OVER (PARTITION BY p_partkey, kind ORDER BY i) AS total FROM o""")
def scaling_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the scaling lists of High profile parameter sets: sent, left to the standard, or taken from the list before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_pylist()
            totals = []
            for k in keys:
                sps = BitWriter().u(100, 8).u(0, 8).u(30, 8).ue(0).ue(1).ue(0).ue(0).u(0, 1).u(1, 1)
                for i in range(8):
                    sps.u(k >> i & 1, 1)
                    if k >> i & 1:
                        v = (k + 7 * i) % 41
                        sps.se(v - 8)
                        same = (16 if i < 6 else 64) - 1 if v else 0  # differences of 0, a bit each
                        sps.u((1 << same) - 1, same)
                sps.ue(0).ue(2).ue(1).u(0, 1).ue(3).ue(3).u(1, 1).u(1, 1).u(0, 1).u(0, 1)
                totals += [sum(x) for x in nal.resolved_lists(nal.parse_sps(sps.bytes(stop=True))["lists"])[:8]]
            yield pa.RecordBatch.from_arrays([pa.array([k for k in keys for _ in range(8)], pa.int64()), pa.array(list(range(8)) * len(keys), pa.int64()), pa.array(totals, pa.int64())], names=["p_partkey", "list", "total"])

    return parts(spark, sf_dir, "p_partkey").mapInArrow(run, "p_partkey long, list long, total long")


@query("av1_bit_codes", "F2", "SELECT p_partkey, CASE WHEN p_partkey % 128 < 64 THEN p_partkey % 128 ELSE p_partkey % 128 - 128 END AS su, p_partkey * 7 % 5000 AS uvlc, p_partkey % p_size AS ns FROM part")
def av1_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed, variable length and non-symmetric codes, spelt out as text of bits and read back."""
    v, below = "(p_partkey * 7 % 5000 + 1)", "length(bin(p_size))"
    short = f"(shiftleft(1L, {below}) - p_size)"
    padded = "CASE WHEN {n} = 0 THEN '' ELSE lpad(bin({v}), {n}, '0') END"
    narrow, wide = padded.format(v="p_partkey % p_size", n=f"({below} - 1)"), padded.format(v=f"p_partkey % p_size + {short}", n=below)
    bits = f"concat(lpad(bin(p_partkey % 128), 7, '0'), repeat('0', length(bin({v})) - 1), bin({v}), CASE WHEN p_partkey % p_size < {short} THEN {narrow} ELSE {wide} END)"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, size, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                read = Bits(BitWriter().u(int(text, 2), len(text)).bytes())
                out.append((k, read.su(7), read.uvlc(), read.ns(size)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], names=["p_partkey", "su", "uvlc", "ns"])

    return parts(spark, sf_dir, "p_partkey", "p_size").selectExpr("p_partkey", "p_size", f"{bits} AS bits").mapInArrow(run, "p_partkey long, su long, uvlc long, ns long")


@query("yuv_scan", "S17 P2", f"WITH {pixel_queries.SYNTH} SELECT n, count(*) AS bytes, CAST(sum(v) AS BIGINT) AS total FROM px GROUP BY n")
def yuv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planar frames from one file's bytes by SQL functions; the luma of each is summed."""
    w, h = pixel_queries.W, pixel_queries.H

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("n", "ascending"), ("y", "ascending"), ("x", "ascending")])
        luma = bytes(rows["v"].to_pylist())
        size = w * h
        content = b"".join(luma[i : i + size] + bytes(size // 2) for i in range(0, len(luma), size)) + b"tail"
        return pa.table({"clip_id": ["synthetic"], "content": pa.array([content], pa.binary())})

    one = pixel_queries.synth(spark).withColumn("k", F.lit(0)).groupBy("k").applyInArrow(build, "clip_id string, content binary")
    frames = raw.planar_frames(one, w, h)
    values = F.transform(F.sequence(F.lit(1), F.length("y")), lambda i: F.conv(F.hex(F.substring("y", i, F.lit(1))), 16, 10).cast("long"))
    return frames.select("n", F.octet_length("y").cast("long").alias("bytes"), F.aggregate(values, F.lit(0).cast("long"), lambda acc, v: acc + v).alias("total"))


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lang, syms): the symbols of a document in order, made where its row is."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("lang", F.transform(F.split("text", " ", -1), lambda w: F.least(F.length(w), F.lit(15)).cast("byte")).alias("syms"))


def _recounted(tiles: DataFrame, coded: Callable[[list[int], dict[str, Any]], list[int]]) -> DataFrame:
    """Counts by language and symbol of what `coded` gives back for each tile; rows are bounded counts, not symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: dict[str | None, np.ndarray] = {}
            columns = {c: b.column(c) for c in b.schema.names}
            for i in range(b.num_rows):
                row = {c: v[i].as_py() for c, v in columns.items() if c != "syms"}
                syms = columns["syms"][i].values.to_numpy().tolist()
                back = coded(syms, row)
                if back != syms:
                    raise ValueError("coder lost symbols")
                held = counts.setdefault(row["lang"], np.zeros(16, np.int64))
                held += np.bincount(back, minlength=16)
            found = [(lang, s, n) for lang, held in counts.items() for s, n in enumerate(held.tolist()) if n]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.string()), pa.array([r[1] for r in found], pa.int64()), pa.array([r[2] for r in found], pa.int64())], names=["lang", "sym", "count"])

    return tiles.mapInArrow(run, "lang string, sym long, count long").groupBy("lang", "sym").agg(F.sum("count").alias("count"))


@query("rans_roundtrip", "F10", f"WITH {token_queries._TOK}, {token_queries._FREQ} SELECT lang, sym, count FROM f")
def rans_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's symbols coded as a tile with its language's table, decoded, and counted."""
    counts = tokens.histogram(token_queries.symbols(spark, sf_dir), ctx="lang")
    model = tokens.normalised(counts, ["lang"]).groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("sym", "freq"))).alias("freq"))
    # a language is one row of at most 16 pairs, so the tables go to the tiles: a join by exchange would put a language in one task
    model = model.withColumnRenamed("lang", "of")
    tiles = _tiles(spark, sf_dir)
    tiles = tiles.join(F.broadcast(model), tiles["lang"].eqNullSafe(model["of"])).select("lang", "syms", "freq")
    built: dict[str | None, list[rans.Table]] = {}

    def coded(syms: list[int], row: dict[str, Any]) -> list[int]:
        lang = row["lang"]
        if lang not in built:
            known = dict(row["freq"])
            built[lang] = [rans.Table([known.get(s, 0) for s in range(max(known) + 1)])]
        return rans.decode_all(rans.encode_all(syms, built[lang][0]), built[lang][0], len(syms))

    return _recounted(tiles, coded)


@query("bool_coder_roundtrip", "F8", f"WITH {token_queries._TOK} SELECT lang, sym, count FROM h")
def bool_coder_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of four bits through the boolean coder with skewed probabilities, document by document, and counted."""
    probs = [100 + 40 * k for k in range(4)]

    def coded(syms: list[int], row: dict[str, Any]) -> list[int]:
        w = BoolWriter()
        w.run([s >> k & 1 for s in syms for k in range(4)], probs)
        bits = BoolReader(w.bytes()).run(4 * len(syms), probs)
        return [a | b << 1 | c << 2 | d << 3 for a, b, c, d in zip(bits[::4], bits[1::4], bits[2::4], bits[3::4], strict=True)]

    return _recounted(_tiles(spark, sf_dir), coded)
