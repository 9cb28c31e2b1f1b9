"""Queries over intra prediction, edge filters, motion of B pictures and reference pools; tables carry the blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import h264, prediction
from ..functions.samples import scaled
from ..operators import motion, references
from . import codec_queries
from .block_queries import _LEVELS, _four, blocks
from .registry import query, table

_SAMPLES = "e AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(least(greatest(floor(v * 200) + 128, 0), 255) AS BIGINT)) AS s FROM embeddings)"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id and s: 64 samples from each vector."""
    byte = F.transform("embedding", lambda v: prediction.byte(F.floor(scaled(v, 200)) + 128))
    return table(spark, sf_dir, "embeddings").select("vec_id", byte.alias("s"))


# The piecewise rules as the standard states them: t(k) above, l(k) left, m the corner; x and y are the sample's place.
_RULES = {
    "vertical": "T[x]", "horizontal": "L[y]", "dc": "(T[0] + T[1] + T[2] + T[3] + L[0] + L[1] + L[2] + L[3] + 4) >> 3",
    "down_left": "CASE WHEN x = 3 AND y = 3 THEN (T[6] + 3 * T[7] + 2) >> 2 ELSE (T[x + y] + 2 * T[x + y + 1] + T[x + y + 2] + 2) >> 2 END",
    "down_right": "CASE WHEN x > y THEN (T[x - y - 2] + 2 * T[x - y - 1] + T[x - y] + 2) >> 2 WHEN x < y THEN (L[y - x - 2] + 2 * L[y - x - 1] + L[y - x] + 2) >> 2 ELSE (T[0] + 2 * T[-1] + L[0] + 2) >> 2 END",
    "vertical_right": "CASE WHEN 2 * x - y >= 0 AND y % 2 = 0 THEN (T[x - y // 2 - 1] + T[x - y // 2] + 1) >> 1 WHEN 2 * x - y > 0 THEN (T[x - y // 2 - 2] + 2 * T[x - y // 2 - 1] + T[x - y // 2] + 2) >> 2 WHEN 2 * x - y = -1 THEN (L[0] + 2 * T[-1] + T[0] + 2) >> 2 ELSE (L[y - 1] + 2 * L[y - 2] + L[y - 3] + 2) >> 2 END",
    "horizontal_down": "CASE WHEN 2 * y - x >= 0 AND x % 2 = 0 THEN (L[y - x // 2 - 1] + L[y - x // 2] + 1) >> 1 WHEN 2 * y - x > 0 THEN (L[y - x // 2 - 2] + 2 * L[y - x // 2 - 1] + L[y - x // 2] + 2) >> 2 WHEN 2 * y - x = -1 THEN (L[0] + 2 * T[-1] + T[0] + 2) >> 2 ELSE (T[x - 1] + 2 * T[x - 2] + T[x - 3] + 2) >> 2 END",
    "vertical_left": "CASE WHEN y % 2 = 0 THEN (T[x + y // 2] + T[x + y // 2 + 1] + 1) >> 1 ELSE (T[x + y // 2] + 2 * T[x + y // 2 + 1] + T[x + y // 2 + 2] + 2) >> 2 END",
    "horizontal_up": "CASE WHEN x + 2 * y > 5 THEN L[3] WHEN x + 2 * y = 5 THEN (L[2] + 3 * L[3] + 2) >> 2 WHEN x % 2 = 0 THEN (L[y + x // 2] + L[y + x // 2 + 1] + 1) >> 1 ELSE (L[y + x // 2] + 2 * L[y + x // 2 + 1] + L[y + x // 2 + 2] + 2) >> 2 END",
}
_VP8_RULES = _RULES | {
    "true_motion": "least(greatest(L[y] + T[x] - T[-1], 0), 255)",
    "vertical": "(T[x - 1] + 2 * T[x] + T[x + 1] + 2) >> 2",
    "horizontal": "CASE WHEN y = 3 THEN (L[2] + 3 * L[3] + 2) >> 2 ELSE (L[y - 1] + 2 * L[y] + L[y + 1] + 2) >> 2 END",
    "vertical_left": "CASE WHEN x = 3 AND y = 2 THEN (T[4] + 2 * T[5] + T[6] + 2) >> 2 WHEN x = 3 AND y = 3 THEN (T[5] + 2 * T[6] + T[7] + 2) >> 2 ELSE " + _RULES["vertical_left"] + " END",
}


def _intra_sql(modes: tuple[str, ...], rules: dict[str, str]) -> str:
    # e.s holds the corner, eight samples above, four left; index -1 is the corner on either side
    place = lambda rule: rule.replace("T[", "s[2 + ").replace("L[", "l[2 + ")
    cases = " ".join(f"WHEN '{m}' THEN {place(rules[m])}" for m in modes)
    return f"WITH {_SAMPLES}, b AS (SELECT vec_id, s, list_concat([s[1]], s[10:13]) AS l FROM e), g AS (SELECT vec_id, mode, x, y, CASE mode {cases} END AS v FROM b, (SELECT unnest({list(modes)}) AS mode), range(4) tx(x), range(4) ty(y)) SELECT vec_id, mode, string_agg(v, ',' ORDER BY y, x) AS block FROM g GROUP BY 1, 2"


def _predicted(spark: SparkSession, sf_dir: str, modes: tuple[str, ...], predict) -> DataFrame:  # noqa: ANN001
    rows = samples(spark, sf_dir).select("vec_id", F.concat(F.reverse(F.slice("s", 10, 4)), F.slice("s", 1, 9)).alias("b"))
    found = F.array(*[F.struct(F.lit(m).alias("mode"), F.array_join(predict(F.col("b"), m), ",").alias("block")) for m in modes])
    return rows.select("vec_id", F.explode(found).alias("f")).select("vec_id", "f.*")


@query("h264_intra_4x4", "F16", _intra_sql(prediction.H264_MODES, _RULES))
def h264_intra_4x4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nine modes from the border that each vector gives."""
    return _predicted(spark, sf_dir, prediction.H264_MODES, prediction.h264_intra_4x4)


@query("vp8_intra_4x4", "F17", _intra_sql(prediction.VP8_MODES, _VP8_RULES))
def vp8_intra_4x4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ten modes of subblocks."""
    return _predicted(spark, sf_dir, prediction.VP8_MODES, prediction.vp8_intra_4x4)


_16 = ("vertical", "horizontal", "dc", "plane", "true_motion")


@query("intra_16x16", "F16 F17", f"""WITH {_SAMPLES}, b AS (SELECT vec_id, s[1] AS m, s[2:17] AS t, s[18:33] AS l FROM e),
h AS (SELECT *, list_sum(t) + list_sum(l) AS total, list_sum(list_transform(range(1, 9), lambda k: k * (t[8 + k] - CASE WHEN k = 8 THEN m ELSE t[8 - k] END))) AS gx, list_sum(list_transform(range(1, 9), lambda k: k * (l[8 + k] - CASE WHEN k = 8 THEN m ELSE l[8 - k] END))) AS gy FROM b),
g AS (SELECT vec_id, mode, x, y, CASE mode WHEN 'vertical' THEN t[x + 1] WHEN 'horizontal' THEN l[y + 1] WHEN 'dc' THEN CAST(total + 16 AS BIGINT) >> 5 WHEN 'true_motion' THEN least(greatest(l[y + 1] + t[x + 1] - m, 0), 255)
  ELSE least(greatest((16 * (t[16] + l[16]) + (CAST(5 * gx + 32 AS BIGINT) >> 6) * (x - 7) + (CAST(5 * gy + 32 AS BIGINT) >> 6) * (y - 7) + 16) >> 5, 0), 255) END AS v FROM h, (SELECT unnest({list(_16)}) AS mode), range(16) tx(x), range(16) ty(y))
SELECT vec_id, mode, string_agg(v, ',' ORDER BY y, x) AS block FROM g GROUP BY 1, 2""")
def intra_16x16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole-macroblock modes of both formats; plane is H.264's, true_motion VP8's."""
    rows = samples(spark, sf_dir).select("vec_id", F.get("s", 0).alias("m"), F.slice("s", 2, 16).alias("t"), F.slice("s", 18, 16).alias("l"))
    found = F.array(*[F.struct(F.lit(k).alias("mode"), F.array_join(prediction.intra_16x16(F.col("m"), F.col("t"), F.col("l"), k), ",").alias("block")) for k in _16])
    return rows.select("vec_id", F.explode(found).alias("f")).select("vec_id", "f.*")


_VP8_LINE = "$0 + $2 + ($1 + ($1 * 20091 >> 16)) + ($3 * 35468 >> 16), $0 - $2 + ($1 * 35468 >> 16) - ($3 + ($3 * 20091 >> 16)), $0 - $2 - ($1 * 35468 >> 16) + ($3 + ($3 * 20091 >> 16)), $0 + $2 - ($1 + ($1 * 20091 >> 16)) - ($3 * 35468 >> 16)"
_WALSH = "$0 + $1 + $2 + $3, $0 + $1 - $2 - $3, $0 - $1 - $2 + $3, $0 - $1 + $2 - $3"


@query("vp8_inverse_transforms", "F14", f"WITH {_LEVELS}, q AS (SELECT vec_id, blk, list_transform(l, lambda v: v * 37) AS d FROM b), i AS (SELECT vec_id, blk, d, {_four('m', 'd', True, _VP8_LINE)} FROM q), j AS (SELECT vec_id, blk, d, {_four('t', 'm', True, _VP8_LINE)} FROM i), "
    f"k AS (SELECT vec_id, blk, t, {_four('n', 'd', True, _WALSH)} FROM j), w AS (SELECT vec_id, blk, t, {_four('u', 'n', True, _WALSH)} FROM k) SELECT vec_id, blk, array_to_string(list_transform(t, lambda v: (v + 4) >> 3), ',') AS residual, array_to_string(list_transform(u, lambda v: (v + 3) >> 3), ',') AS dc FROM w")
def vp8_inverse_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks(spark, sf_dir).select("vec_id", "blk", F.transform("levels", lambda v: v * 37).alias("d"))
    return rows.select("vec_id", "blk", F.array_join(h264.vp8_inverse_transform(F.col("d")), ",").alias("residual"), F.array_join(h264.vp8_inverse_walsh(F.col("d")), ",").alias("dc"))


# -- edge filters over eight samples across an edge ---------------------------------------------------------------

_DELTAS = {"p3": "event_id % 5 - 2", "p2": "event_id % 7 - 3", "p1": "event_id % 11 - 5", "p0": "event_id * 3 % 13 - 6", "q0": "event_id * 5 % 17 - 8", "q1": "event_id * 7 % 13 - 6", "q2": "event_id * 11 % 9 - 4", "q3": "event_id * 13 % 7 - 3"}
_ACROSS = [f"least(greatest(event_id * 7 % 256 + {d}, 0), 255) AS {n}" for n, d in _DELTAS.items()]


def across(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """event_id, p3 to q3, and what else is asked for."""
    return table(spark, sf_dir, "events").selectExpr("event_id", *_ACROSS, *more)




def _sides() -> tuple[list[Column], list[Column]]:
    return [F.col(f"p{k}") for k in range(4)], [F.col(f"q{k}") for k in range(4)]


_ON = "bs > 0 AND abs(p0 - q0) < alpha AND abs(p1 - p0) < beta AND abs(q1 - q0) < beta"


@query("h264_edge_filters", "F23", f"""WITH x AS (SELECT event_id, {', '.join(_ACROSS)}, event_id % 5 AS bs, event_id * 3 % 52 AS ia, event_id * 5 % 52 AS ib FROM events),
t AS (SELECT *, CASE WHEN ia < 16 THEN 0 ELSE {prediction.ALPHA}[ia - 15] END AS alpha, CASE WHEN ib < 16 THEN 0 ELSE {prediction.BETA}[ib - 15] END AS beta, CASE WHEN ia < 17 OR bs NOT BETWEEN 1 AND 3 THEN 0 ELSE {[list(c) for c in prediction.CLIP]}[ia - 16][bs] END AS tc0 FROM x),
f AS (SELECT *, {_ON} AS on_, abs(p2 - p0) < beta AS np, abs(q2 - q0) < beta AS nq, abs(p0 - q0) < (alpha >> 2) + 2 AS flat, (4 * (q0 - p0) + p1 - q1 + 4) >> 3 AS raw FROM t),
d AS (SELECT *, greatest(least(raw, tc0 + np::INT + nq::INT), -(tc0 + np::INT + nq::INT)) AS d, greatest(least(raw, tc0 + 1), -(tc0 + 1)) AS cd FROM f)
SELECT event_id, CASE WHEN on_ AND bs = 4 AND np AND flat THEN (2 * p3 + 3 * p2 + p1 + p0 + q0 + 4) >> 3 ELSE p2 END AS p2,
 CASE WHEN NOT on_ OR NOT np THEN p1 WHEN bs < 4 THEN p1 + greatest(least((p2 + ((p0 + q0 + 1) >> 1) - 2 * p1) >> 1, tc0), -tc0) WHEN flat THEN (p2 + p1 + p0 + q0 + 2) >> 2 ELSE p1 END AS p1,
 CASE WHEN NOT on_ THEN p0 WHEN bs < 4 THEN least(greatest(p0 + d, 0), 255) WHEN np AND flat THEN (p2 + 2 * p1 + 2 * p0 + 2 * q0 + q1 + 4) >> 3 ELSE (2 * p1 + p0 + q1 + 2) >> 2 END AS p0,
 CASE WHEN NOT on_ THEN q0 WHEN bs < 4 THEN least(greatest(q0 - d, 0), 255) WHEN nq AND flat THEN (p1 + 2 * p0 + 2 * q0 + 2 * q1 + q2 + 4) >> 3 ELSE (2 * q1 + q0 + p1 + 2) >> 2 END AS q0,
 CASE WHEN NOT on_ OR NOT nq THEN q1 WHEN bs < 4 THEN q1 + greatest(least((q2 + ((p0 + q0 + 1) >> 1) - 2 * q1) >> 1, tc0), -tc0) WHEN flat THEN (p0 + q0 + q1 + q2 + 2) >> 2 ELSE q1 END AS q1,
 CASE WHEN on_ AND bs = 4 AND nq AND flat THEN (2 * q3 + 3 * q2 + q1 + q0 + p0 + 4) >> 3 ELSE q2 END AS q2,
 CASE WHEN NOT on_ THEN p0 WHEN bs = 4 THEN (2 * p1 + p0 + q1 + 2) >> 2 ELSE least(greatest(p0 + cd, 0), 255) END AS c_p0, CASE WHEN NOT on_ THEN q0 WHEN bs = 4 THEN (2 * q1 + q0 + p1 + 2) >> 2 ELSE least(greatest(q0 - cd, 0), 255) END AS c_q0 FROM d""")
def h264_edge_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Luma and chroma, strengths 0 to 4, thresholds by the standard's tables."""
    rows = across(spark, sf_dir, "event_id % 5 AS bs", "event_id * 3 % 52 AS ia", "event_id * 5 % 52 AS ib")
    alpha, beta, clip = prediction.thresholds(F.col("ia"), F.col("ib"), F.col("bs"))
    rows = rows.select("*", alpha.alias("alpha"), beta.alias("beta"), clip.alias("tc0"))
    args = (*_sides(), *map(F.col, ("bs", "alpha", "beta", "tc0")))
    return rows.select("event_id", *prediction.luma_edge(*args), *prediction.chroma_edge(*args))


def _vp8_sql(at_macroblock: bool) -> str:
    sat = lambda v: f"least(greatest({v}, -128), 127)"
    if at_macroblock:
        u = lambda w: f"((CASE WHEN hev THEN 0 ELSE w0 END * {w} + 63) >> 7)"
        new = {"p2": sat(f"p2 - 128 + {u(9)}"), "p1": sat(f"p1 - 128 + {u(18)}"), "p0": sat(f"CASE WHEN hev THEN {sat('p0 - 128 + g')} ELSE p0 - 128 + {u(27)} END")}
        new |= {"q0": sat(f"CASE WHEN hev THEN {sat('q0 - 128 - f')} ELSE q0 - 128 - {u(27)} END"), "q1": sat(f"q1 - 128 - {u(18)}"), "q2": sat(f"q2 - 128 - {u(9)}")}
    else:
        a = "(CASE WHEN hev THEN 0 ELSE (f + 1) >> 1 END)"
        new = {"p2": "p2 - 128", "p1": sat(f"p1 - 128 + {a}"), "p0": sat("p0 - 128 + g"), "q0": sat("q0 - 128 - f"), "q1": sat(f"q1 - 128 - {a}"), "q2": "q2 - 128"}
    outer = f"{sat('p1 - q1')}" if at_macroblock else f"CASE WHEN hev THEN {sat('p1 - q1')} ELSE 0 END"
    near = " AND ".join(f"abs({a} - {b}) <= interior" for a, b in (("p3", "p2"), ("p2", "p1"), ("p1", "p0"), ("q1", "q0"), ("q2", "q1"), ("q3", "q2")))
    return (f"WITH x AS (SELECT event_id, {', '.join(_ACROSS)}, event_id * 3 % 63 AS lim, event_id % 12 AS interior, event_id % 4 AS high FROM events), m AS (SELECT *, abs(p0 - q0) * 2 + (abs(p1 - q1) >> 1) <= lim AND {near} AS on_, abs(p1 - p0) > high OR abs(q1 - q0) > high AS hev FROM x), "
            f"w AS (SELECT *, {sat(f'({outer}) + 3 * (q0 - p0)')} AS w0 FROM m), f AS (SELECT *, least(w0 + 4, 127) >> 3 AS f, least(w0 + 3, 127) >> 3 AS g FROM w) SELECT event_id, " + ", ".join(f"CASE WHEN on_ THEN {v} + 128 ELSE {k} END AS {k}" for k, v in new.items()) + " FROM f")  # fmt: skip


def _vp8_edge(spark: SparkSession, sf_dir: str, at_macroblock: bool) -> DataFrame:
    rows = across(spark, sf_dir, "event_id * 3 % 63 AS lim", "event_id % 12 AS interior", "event_id % 4 AS high")
    return rows.select("event_id", *prediction.vp8_normal_edge(*_sides(), F.col("lim"), F.col("interior"), F.col("high"), at_macroblock))


@query("vp8_subblock_filter", "F24", _vp8_sql(False))
def vp8_subblock_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vp8_edge(spark, sf_dir, False)


@query("vp8_macroblock_filter", "F24", _vp8_sql(True))
def vp8_macroblock_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vp8_edge(spark, sf_dir, True)


# -- references and motion ----------------------------------------------------------------------------------------


@query("av1_reference_pool", "U3", codec_queries._G + ", f AS (SELECT clip_id, seq, CASE WHEN is_key THEN 255 ELSE event_id * 37 % 256 END AS flags FROM g) SELECT clip_id, seq, " + ", ".join(f"last_value(CASE WHEN flags >> {k} & 1 = 1 THEN seq END IGNORE NULLS) OVER (PARTITION BY clip_id ORDER BY seq) AS slot_{k}" for k in range(8)) + " FROM f")
def av1_reference_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame in each of eight slots after each frame; key frames refresh all."""
    rows = codec_queries.grouped(spark, sf_dir).selectExpr("clip_id", "seq", "CASE WHEN is_key THEN 255 ELSE event_id * 37 % 256 END AS refresh_flags")
    return references.slot_pool(rows).drop("refresh_flags")


_MOTION = "m AS (SELECT event_id, event_id * 37 % 129 - 64 AS mx, event_id * 53 % 97 - 48 AS my, event_id % 40 AS cur, event_id % 40 - 1 - event_id % 5 AS poc0, event_id % 40 + event_id % 7 - 1 AS poc1, event_id % 11 = 0 AS lt FROM events)"


@query("temporal_direct", "J6", f"""WITH {_MOTION}, d AS (SELECT *, least(greatest(cur - poc0, -128), 127) AS tb, least(greatest(poc1 - poc0, -128), 127) AS td FROM m),
s AS (SELECT *, CASE WHEN NOT lt AND td <> 0 THEN least(greatest((tb * CAST(trunc((16384 + abs(trunc(td / 2.0))) / td) AS BIGINT) + 32) >> 6, -1024), 1023) END AS f FROM d)
SELECT event_id, coalesce((f * mx + 128) >> 8, mx) AS x0, coalesce((f * my + 128) >> 8, my) AS y0, coalesce(((f * mx + 128) >> 8) - mx, 0) AS x1, coalesce(((f * my + 128) >> 8) - my, 0) AS y1 FROM s""")
def temporal_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored motion of the co-located block, scaled by distances in picture order."""
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "event_id * 37 % 129 - 64 AS mx", "event_id * 53 % 97 - 48 AS my", "event_id % 40 AS cur", "event_id % 40 - 1 - event_id % 5 AS poc0", "event_id % 40 + event_id % 7 - 1 AS poc1", "event_id % 11 = 0 AS lt")
    x, y = (motion.temporal_direct(F.col(c), F.col("cur"), F.col("poc0"), F.col("poc1"), F.col("lt")) for c in ("mx", "my"))
    return rows.select("event_id", x[0].alias("x0"), y[0].alias("y0"), x[1].alias("x1"), y[1].alias("y1"))


_GRID = "b AS (SELECT user_id AS clip_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 8 AS y, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) % 8 AS x, event_id * 37 % 61 - 30 AS mv, CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_id % 3 END AS ref FROM events)"


@query("predicted_motion", "J4 F4", f"""WITH {_GRID}, n AS (SELECT b.*, l.mv AS lm, l.ref AS lr, l.x IS NOT NULL AS la, u.mv AS um, u.ref AS ur, u.x IS NOT NULL AS ua, coalesce(r.mv, CASE WHEN r.x IS NULL THEN d.mv END) AS rm, CASE WHEN r.x IS NOT NULL THEN r.ref ELSE d.ref END AS rr, r.x IS NOT NULL OR d.x IS NOT NULL AS ra
 FROM b LEFT JOIN b l ON l.clip_id = b.clip_id AND l.y = b.y AND l.x = b.x - 1 LEFT JOIN b u ON u.clip_id = b.clip_id AND u.y = b.y - 1 AND u.x = b.x LEFT JOIN b r ON r.clip_id = b.clip_id AND r.y = b.y - 1 AND r.x = b.x + 1 LEFT JOIN b d ON d.clip_id = b.clip_id AND d.y = b.y - 1 AND d.x = b.x - 1 WHERE b.ref IS NOT NULL),
v AS (SELECT *, CASE WHEN lr IS NULL THEN 0 ELSE lm END AS a, CASE WHEN ur IS NULL THEN 0 ELSE um END AS bb, CASE WHEN rr IS NULL THEN 0 ELSE rm END AS c, coalesce(lr = ref, FALSE) AS ma, coalesce(ur = ref, FALSE) AS mb, coalesce(rr = ref, FALSE) AS mc FROM n)
SELECT clip_id, y, x, CASE WHEN NOT ua AND NOT ra AND la THEN a WHEN ma::INT + mb::INT + mc::INT = 1 THEN CASE WHEN ma THEN a WHEN mb THEN bb ELSE c END ELSE a + bb + c - least(a, bb, c) - greatest(a, bb, c) END AS pred FROM v""")
def predicted_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motion predicted from the blocks left, above and above right (or above left); intra blocks (no reference) predict nothing."""
    place = "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1"
    rows = table(spark, sf_dir, "events").selectExpr("user_id AS clip_id", f"({place}) div 8 AS y", f"({place}) % 8 AS x", "event_id * 37 % 61 - 30 AS mv", "CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_id % 3 END AS ref")
    return motion.predicted(rows, 8).where("ref IS NOT NULL").select("clip_id", "y", "x", F.col("pred"))
