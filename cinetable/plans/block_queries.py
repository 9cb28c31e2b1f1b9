"""Queries over H.264 block arithmetic; `embeddings` and `events` carry the blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import h264
from . import pixel_queries, stream_queries
from .registry import query, table

_FACTORS = [h264.LEVEL_SCALE[1][0 if r % 2 == 0 and c % 2 == 0 else 1 if r % 2 and c % 2 else 2] << 4 for r in range(4) for c in range(4)]
_LEVELS = "b AS (SELECT vec_id, blk, list_transform(range(16), lambda i: CAST(floor(embedding[blk * 16 + i + 1] * 8) AS BIGINT)) AS l FROM embeddings, range(4) t(blk))"


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four blocks of 16 small levels from each vector."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.floor(v * 8)).alias("a"))
    return rows.select("vec_id", "a", F.explode(F.array(*[F.lit(k) for k in range(4)])).alias("blk")).select("vec_id", F.col("blk").cast("long").alias("blk"), F.slice("a", F.col("blk") * 16 + 1, F.lit(16)).alias("levels"))


def _four(name: str, source: str, transposed: bool, expr: str) -> str:
    """A list of 16 from lines of four: expr uses $0..$3 for the places of a line, one output list per line."""
    at = lambda k: f"{source}[{'4 * i + ' + str(k + 1) if not transposed else 'i + ' + str(4 * k + 1)}]"
    for k in range(4):
        expr = expr.replace(f"${k}", at(k))
    return f"flatten(list_transform(range(4), lambda i: [{expr}])) AS {name}"


_INVERSE = "$0 + $2 + $1 + ($3 >> 1), $0 - $2 + ($1 >> 1) - $3, $0 - $2 - ($1 >> 1) + $3, $0 + $2 - $1 - ($3 >> 1)"
_HADAMARD = "$0 + $1 + $2 + $3, $0 + $1 - $2 - $3, $0 - $1 - $2 + $3, $0 - $1 + $2 - $3"


@query("h264_inverse_transform", "F12 F14", f"WITH {_LEVELS}, q AS (SELECT vec_id, blk, list_transform(range(16), lambda i: l[i + 1] * {_FACTORS}[i + 1]) AS d FROM b), r AS (SELECT vec_id, blk, {_four('m', 'd', False, _INVERSE)} FROM q), "
    f"c AS (SELECT vec_id, blk, {_four('t', 'm', True, _INVERSE)} FROM r) SELECT vec_id, blk, array_to_string(list_transform(range(16), lambda i: (t[(i % 4) * 4 + i // 4 + 1] + 32) >> 6), ',') AS residual FROM c")
def h264_inverse_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks(spark, sf_dir).select("vec_id", "blk", h264.dequantised(F.col("levels"), 25).alias("d"))
    return rows.select("vec_id", "blk", F.array_join(h264.inverse_transform(F.col("d")), ",").alias("residual"))


@query("h264_dc_hadamard", "F14", f"WITH {_LEVELS}, r AS (SELECT vec_id, blk, {_four('m', 'l', False, _HADAMARD)} FROM b), c AS (SELECT vec_id, blk, {_four('t', 'm', True, _HADAMARD)} FROM r) SELECT vec_id, blk, array_to_string(list_transform(range(16), lambda i: t[(i % 4) * 4 + i // 4 + 1]), ',') AS dc FROM c")
def h264_dc_hadamard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).select("vec_id", "blk", F.array_join(h264.hadamard(F.col("levels")), ",").alias("dc"))


@query("chroma_qp_lookup", "J7", f"WITH t AS (SELECT unnest(range(30, 52)) AS q, unnest({h264.CHROMA_QP}) AS c) SELECT event_id, coalesce(c, least(greatest(event_id % 60 - 4, 0), 51)) AS qp FROM events LEFT JOIN t ON q = least(greatest(event_id % 60 - 4, 0), 51)")
def chroma_qp_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", h264.chroma_qp(F.col("event_id") % 60, -4).alias("qp"))


@query("half_sample", "F20", f"WITH {pixel_queries.PAN}, j AS (SELECT a.n, a.y, a.x, k, b.v FROM px a, range(6) t(k) JOIN px b ON b.n = a.n AND b.y = a.y AND b.x = least(greatest(a.x + k - 2, 0), {pixel_queries.W - 1}))"
    ", s AS (SELECT n, y, x, CAST(sum(v * [1, -5, 20, 20, -5, 1][k + 1]) AS BIGINT) AS s FROM j GROUP BY 1, 2, 3) SELECT n, y, x, least(greatest((s + 16) >> 5, 0), 255) AS h FROM s".replace("FROM px a, range(6) t(k) JOIN", "FROM px a CROSS JOIN range(6) t(k) JOIN"))
def half_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Horizontal half-sample plane; edges repeat."""
    w = Window.partitionBy("n", "y").orderBy("x")
    first, last = F.first("v").over(w), F.last("v").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    line = [F.coalesce(F.lag("v", -d).over(w) if d < 0 else F.lead("v", d).over(w) if d else F.col("v"), first if d < 0 else last) for d in (-2, -1, 0, 1, 2, 3)]
    return pixel_queries.pan(spark).select("n", "y", "x", h264.six_tap(line).alias("h"))


@query("edge_strengths", "F23", "WITH " + stream_queries.PACKETS + """, b AS (SELECT clip_id, seq, event_type = 'signup' AS intra, event_type = 'click' AS coded, event_id % 2 AS ref, event_id * 5 % 13 AS x, event_id * 3 % 11 AS y FROM p),
w AS (SELECT *, lag(intra) OVER v AS pi, lag(coded) OVER v AS pc, lag(ref) OVER v AS pr, lag(x) OVER v AS px, lag(y) OVER v AS py FROM b WINDOW v AS (PARTITION BY clip_id ORDER BY seq))
SELECT clip_id, seq, CASE WHEN (intra OR pi) AND seq % 4 = 0 THEN 4 WHEN intra OR pi THEN 3 WHEN coded OR pc THEN 2 WHEN ref <> pr OR abs(x - px) >= 4 OR abs(y - py) >= 4 THEN 1 ELSE 0 END AS strength FROM w WHERE pr IS NOT NULL""")
def edge_strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block of a row against its left neighbour; every fourth block starts a macroblock."""
    rows = stream_queries.packets(spark, sf_dir).selectExpr("clip_id", "seq", "event_type = 'signup' AS intra", "event_type = 'click' AS coded", "event_id % 2 AS ref", "event_id * 5 % 13 AS x", "event_id * 3 % 11 AS y")
    w = Window.partitionBy("clip_id").orderBy("seq")
    rows = rows.select("*", *[F.lag(c).over(w).alias(f"_{c}") for c in ("intra", "coded", "ref", "x", "y")]).where("_ref IS NOT NULL")
    either = lambda c: F.col(c) | F.col(f"_{c}")
    strength = h264.edge_strength(either("intra"), F.col("seq") % 4 == 0, either("coded"), F.col("ref") == F.col("_ref"), F.col("x") - F.col("_x"), F.col("y") - F.col("_y"))
    return rows.select("clip_id", "seq", strength.alias("strength"))


_SIDES = "e AS (SELECT event_id, event_id * 7 % 256 AS p1, event_id * 7 % 256 + event_id % 9 - 4 AS a, event_id * 7 % 256 + event_id * 5 % 23 - 11 AS b, event_id * 7 % 256 + event_id * 3 % 31 - 15 AS c FROM events), s AS (SELECT event_id, p1, least(greatest(a, 0), 255) AS p0, least(greatest(b, 0), 255) AS q0, least(greatest(c, 0), 255) AS q1 FROM e)"


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four samples across a block edge, made from `events`."""
    base = "event_id * 7 % 256"
    made = [f"least(greatest({base} + {d}, 0), 255)" for d in ("event_id % 9 - 4", "event_id * 5 % 23 - 11", "event_id * 3 % 31 - 15")]
    return table(spark, sf_dir, "events").selectExpr("event_id", f"{base} AS p1", *[f"{m} AS {n}" for m, n in zip(made, ("p0", "q0", "q1"), strict=True)])


@query("edge_filter", "F23", f"WITH {_SIDES}, d AS (SELECT *, abs(p0 - q0) < 20 AND abs(p1 - p0) < 6 AND abs(q1 - q0) < 6 AS on_, least(greatest((((q0 - p0) << 2) + (p1 - q1) + 4) >> 3, -3), 3) AS d FROM (SELECT event_id, p1, p0, q0, q1 FROM s)) SELECT event_id, CASE WHEN on_ THEN least(greatest(p0 + d, 0), 255) ELSE p0 END AS p0, CASE WHEN on_ THEN least(greatest(q0 - d, 0), 255) ELSE q0 END AS q0 FROM d".replace("((q0 - p0) << 2)", "(q0 - p0) * 4"))
def edge_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normal H.264 edge filter at fixed thresholds (20, 6) and clip 3."""
    rows = sides(spark, sf_dir)
    return rows.select("event_id", *h264.normal_filter(*map(F.col, ("p1", "p0", "q0", "q1")), 20, 6, 3))


@query("simple_loop_filter", "F24", f"WITH {_SIDES}, t AS (SELECT event_id, p1 - 128 AS p1, p0 - 128 AS p0, q0 - 128 AS q0, q1 - 128 AS q1 FROM s), u AS (SELECT *, abs(p0 - q0) * 2 + (abs(p1 - q1) >> 1) <= 40 AS on_, least(greatest(least(greatest(p1 - q1, -128), 127) + 3 * (q0 - p0), -128), 127) AS a FROM t), "
    "v AS (SELECT *, least(a + 4, 127) >> 3 AS f, least(a + 3, 127) >> 3 AS g FROM u) SELECT event_id, CASE WHEN on_ THEN least(greatest(p0 + g, -128), 127) ELSE p0 END + 128 AS p0, CASE WHEN on_ THEN least(greatest(q0 - f, -128), 127) ELSE q0 END + 128 AS q0 FROM v")
def simple_loop_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The simple VP8 loop filter at limit 40."""
    rows = sides(spark, sf_dir)
    return rows.select("event_id", *h264.vp8_simple_filter(*map(F.col, ("p1", "p0", "q0", "q1")), 40))


@query("explicit_weights", "F21", "SELECT event_id, least(greatest(((event_id * 13 % 256 * (event_id % 127 - 40) + 16) >> 5) + event_id % 21 - 10, 0), 255) AS v FROM events")
def explicit_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-directional weighted prediction with a denominator of 2^5."""
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", h264.weighted(F.col("event_id") * 13 % 256, F.col("event_id") % 127 - 40, F.col("event_id") % 21 - 10, 5).alias("v"))
