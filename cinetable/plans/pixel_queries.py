"""Queries over samples of generated clips, and over `embeddings` as blocks of 8 x 8 coefficients."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import samples
from ..functions.integers import clamp
from ..operators import pixels
from .registry import query, table

W, H, N = 32, 24, 12
SYNTH = f"""b AS (SELECT n, y, x, (3 * x + 5 * y + 7 * n) & 255 AS v0 FROM range({N}) t(n), range({H}) r(y), range({W}) c(x)),
s AS (SELECT n, y, x, CASE WHEN x + y > {(W + H) // 2} THEN 255 - v0 ELSE v0 END AS v1 FROM b), px AS (SELECT n, y, x, CASE WHEN (x // 4 + y // 4) % 2 = 0 THEN xor(v1, 51) ELSE v1 END AS v FROM s)"""
PAN = f"""b AS (SELECT n, y, x, x + 2 * n AS u, y + 2 * n AS w FROM range({N}) t(n), range({H}) r(y), range({W}) c(x)),
px AS (SELECT n, y, x, CASE WHEN (u // 6 + w // 6) % 2 = 0 THEN xor((3 * u + 2 * w) & 255, 64) ELSE (3 * u + 2 * w) & 255 END AS v FROM b)"""


def synth(spark: SparkSession) -> DataFrame:
    return pixels.synthetic(spark, N, W, H)


def pan(spark: SparkSession) -> DataFrame:
    return pixels.synthetic(spark, N, W, H, pan=True)


def _named(blocks: DataFrame) -> DataFrame:
    return blocks.withColumnsRenamed({"by": "block_y", "bx": "block_x"})


@query("synth_frame_stats", "S17 P2", f"WITH {SYNTH} SELECT n, count(*) AS samples, CAST(sum(v) AS BIGINT) AS total, min(v) AS least, max(v) AS most, CAST(sum(v * (y * {W} + x)) AS BIGINT) AS weighted, {(W + 1) // 2} AS chroma_width, {(H + 1) // 2} AS chroma_height FROM px GROUP BY n")
def synth_frame_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = synth(spark).groupBy("n").agg(F.count("*").alias("samples"), F.sum("v").alias("total"), F.min("v").alias("least"), F.max("v").alias("most"), F.sum(F.col("v") * (F.col("y") * W + F.col("x"))).alias("weighted"))
    return out.select("*", F.lit((W + 1) // 2).alias("chroma_width"), F.lit((H + 1) // 2).alias("chroma_height"))


@query("frame_psnr", "J5 A1 A2", f"""WITH {SYNTH}, e AS (SELECT n, y, x, CASE WHEN n = 0 THEN 0 ELSE v - v // 7 * 7 END AS e FROM px)
SELECT n, CAST(count(*) FILTER (e <> 0) AS BIGINT) AS wrong, max(abs(e)) AS max_error, min(y * {W} + x) FILTER (e <> 0) // {W} AS first_y, min(y * {W} + x) FILTER (e <> 0) % {W} AS first_x, CAST(sum(e * e) AS BIGINT) AS sse,
  CASE WHEN sum(e * e) = 0 THEN 99.0 ELSE round(10 * log10(65025.0 * count(*) / sum(e * e)), 6) END AS psnr FROM e GROUP BY n""")
def frame_psnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = synth(spark)
    want = got.withColumn("v", F.when(F.col("n") == 0, F.col("v")).otherwise(F.expr("v div 7 * 7")))
    return pixels.compare(got, want)


@query("scene_cut", "A3 W1", f"WITH {SYNTH}, q AS (SELECT n, y, x, CASE WHEN n >= 6 THEN 255 - v ELSE v END AS v FROM px), d AS (SELECT n, abs(v - lag(v) OVER (PARTITION BY y, x ORDER BY n)) AS d FROM q) SELECT n, CAST(sum(d) AS BIGINT) AS sad, coalesce(sum(d) > 28 * count(*), FALSE) AS cut FROM d GROUP BY n")
def scene_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.scene_cuts(synth(spark).withColumn("v", F.when(F.col("n") >= 6, 255 - F.col("v")).otherwise(F.col("v"))))


@query("altref_denoise", "A8", f"""WITH {SYNTH}, q AS (SELECT n, y, x, CASE WHEN n % 4 = 3 THEN 255 - v ELSE least(255, v0 + (n * 5 + x) % 4) END AS v FROM px JOIN (SELECT y, x, v AS v0 FROM px WHERE n = 0) f USING (y, x)),
a AS (SELECT n, y // 16 AS bk, x // 16 AS bx FROM q JOIN (SELECT y, x, v AS f FROM q WHERE n = 0) USING (y, x) GROUP BY 1, 2, 3 HAVING sum(abs(v - f)) <= 6 * count(*))
SELECT y, x, count(*) AS frames, (CAST(sum(v) AS BIGINT) + count(*) // 2) // count(*) AS v FROM q JOIN a ON a.n = q.n AND bk = y // 16 AND bx = x // 16 GROUP BY y, x""")
def altref_denoise(spark: SparkSession, sf_dir: str) -> DataFrame:
    luma = synth(spark)
    first = luma.where("n = 0").select("y", "x", F.col("v").alias("v0"))
    noisy = luma.join(first, ["y", "x"]).selectExpr("n", "y", "x", "CASE WHEN n % 4 = 3 THEN 255 - v ELSE least(255, v0 + (n * 5 + x) % 4) END AS v")
    return pixels.denoised(noisy)


@query("rgba_fixed_point", "P1", f"""WITH {SYNTH}, c AS (SELECT n, y, x, v, ((11 * (x // 2) + 2 * (y // 2) + 3 * n) & 255) - 128 AS cb, ((255 - 2 * (x // 2) - 13 * (y // 2) - 5 * n) & 255) - 128 AS cr FROM px)
SELECT n, y, x, CAST(least(greatest(v * 65793 + 91881 * cr, 0), 16711680) >> 16 AS INT) AS r, CAST(least(greatest(v * 65793 - 22554 * cb - 46802 * cr, 0), 16711680) >> 16 AS INT) AS g, CAST(least(greatest(v * 65793 + 116130 * cb, 0), 16711680) >> 16 AS INT) AS b, 255 AS a FROM c""")
def rgba_fixed_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = synth(spark).selectExpr("n", "y", "x", "v", "(11 * (x div 2) + 2 * (y div 2) + 3 * n) & 255 AS cb", "(255 - 2 * (x div 2) - 13 * (y div 2) - 5 * n) & 255 AS cr")
    return rows.select("n", "y", "x", *samples.rgba(F.col("v"), F.col("cb"), F.col("cr")))


@query("cropped_planes", "P3", f"WITH {SYNTH} SELECT n, count(*) AS samples, CAST(sum(v) AS BIGINT) AS total FROM px WHERE x BETWEEN 4 AND 27 AND y BETWEEN 2 AND 20 GROUP BY n")
def cropped_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth(spark).where("x BETWEEN 4 AND 27 AND y BETWEEN 2 AND 20").groupBy("n").agg(F.count("*").alias("samples"), F.sum("v").alias("total"))


_MATRIX = ", ".join(f"({k}, {i}, {m})" for k, row in enumerate(samples.dct_matrix(8)) for i, m in enumerate(row))
_BLOCKS = "bl AS (SELECT n, y // 8 AS bk, x // 8 AS bx, y % 8 AS i, x % 8 AS j, v - 128 AS v FROM px)"
_DCT = f"""m(k, i, m) AS (VALUES {_MATRIX}), t1 AS (SELECT n, bk, bx, k, j, (CAST(sum(m * v) AS BIGINT) + 4096) >> 13 AS v FROM bl JOIN m USING (i) GROUP BY 1, 2, 3, 4, 5),
dc AS (SELECT n, bk, bx, t1.k AS i, m.k AS j, (CAST(sum(m * v) AS BIGINT) + 4096) >> 13 AS v FROM t1 JOIN m ON m.i = t1.j GROUP BY 1, 2, 3, 4, 5)"""


@query("dct_forward", "F13", f"WITH {SYNTH}, {_BLOCKS}, {_DCT} SELECT n, bk AS block_y, bx AS block_x, i, j, v FROM dc")
def dct_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(pixels.forward_dct(pixels.blocks_of(synth(spark), 8).withColumn("v", F.col("v") - 128)))


@query("dct_roundtrip", "F12 F13", f"""WITH {SYNTH}, {_BLOCKS}, {_DCT}, q AS (SELECT n, bk, bx, i, j, CASE WHEN i = 0 AND j = 0 THEN 5 ELSE 10 END AS st, v FROM dc),
l AS (SELECT n, bk, bx, i, j, st, CASE WHEN v < 0 THEN -((-v * 8 + 3 * st) // (st * 8)) ELSE (v * 8 + 3 * st) // (st * 8) END AS lv FROM q),
t2 AS (SELECT n, bk, bx, m.i AS i, l.j AS j, (CAST(sum(m * lv * st) AS BIGINT) + 4096) >> 13 AS v FROM l JOIN m ON m.k = l.i GROUP BY 1, 2, 3, 4, 5),
r AS (SELECT n, bk, bx, t2.i AS i, m.i AS j, (CAST(sum(m * v) AS BIGINT) + 4096) >> 13 AS v FROM t2 JOIN m ON m.k = t2.j GROUP BY 1, 2, 3, 4, 5)
SELECT n, CAST(sum((r.v - bl.v) * (r.v - bl.v)) AS BIGINT) AS sse, round(10 * log10(65025.0 * count(*) / sum((r.v - bl.v) * (r.v - bl.v))), 6) AS psnr FROM r JOIN bl USING (n, bk, bx, i, j) GROUP BY n""")
def dct_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transform, quantise at qp 20 (steps 5 and 10), dequantise, transform back, compare."""
    blocks = pixels.blocks_of(synth(spark), 8).withColumn("v", F.col("v") - 128)
    dc, ac = samples.steps(20)
    step = F.when((F.col("i") == 0) & (F.col("j") == 0), F.lit(dc)).otherwise(F.lit(ac))
    back = pixels.inverse_dct(pixels.forward_dct(blocks).withColumn("v", samples.quantise(F.col("v"), step) * step))
    both = blocks.join(back.withColumnRenamed("v", "r"), ["n", "by", "bx", "i", "j"]).withColumn("e", (F.col("r") - F.col("v")) * (F.col("r") - F.col("v")))
    return both.groupBy("n").agg(F.sum("e").alias("sse"), F.count("*").alias("c")).select("n", "sse", F.round(samples.psnr(F.col("sse"), F.col("c")), 6).alias("psnr"))


_SIGNS = ", ".join(f"({k}, {i}, {m})" for k, row in enumerate(samples.hadamard(4)) for i, m in enumerate(row))


@query("hadamard_satd", "A4 F14", f"""WITH {SYNTH}, bl AS (SELECT n, y // 4 AS bk, x // 4 AS bx, y % 4 AS i, x % 4 AS j, v - 128 AS v FROM px), m(k, i, m) AS (VALUES {_SIGNS}),
t AS (SELECT n, bk, bx, k, j, sum(m * v) AS v FROM bl JOIN m USING (i) GROUP BY 1, 2, 3, 4, 5), u AS (SELECT n, bk, bx, t.k AS a, m.k AS b, sum(m * v) AS v FROM t JOIN m ON m.i = t.j GROUP BY 1, 2, 3, 4, 5)
SELECT n, bk AS block_y, bx AS block_x, CAST(sum(abs(v)) AS BIGINT) AS satd FROM u GROUP BY 1, 2, 3""")
def hadamard_satd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(pixels.satd(pixels.blocks_of(synth(spark), 4).withColumn("v", F.col("v") - 128)))


@query("zigzag_order", "O3 J7", """WITH s(n) AS (VALUES (4), (8), (16)), p AS (SELECT n, i // n AS y, i % n AS x FROM s, range(256) t(i) WHERE i < n * n)
SELECT n, y, x, row_number() OVER (PARTITION BY n ORDER BY x + y, CASE WHEN (x + y) % 2 = 0 THEN x ELSE y END) - 1 AS place FROM p""")
def zigzag_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(n, p // n, p % n, k) for n in (4, 8, 16) for k, p in enumerate(samples.zigzag(n))]
    return spark.createDataFrame(rows, "n int, y long, x long, place long")


@query("dc_prediction", "A9", f"""WITH {SYNTH}, bl AS (SELECT DISTINCT n, y // 8 AS bk, x // 8 AS bx FROM px), e AS (SELECT n, y // 8 + 1 AS bk, x // 8 AS bx, v FROM px WHERE y % 8 = 7 UNION ALL SELECT n, y // 8, x // 8 + 1, v FROM px WHERE x % 8 = 7)
SELECT n, bk AS block_y, bx AS block_x, CASE WHEN count(v) = 0 THEN 128 ELSE (CAST(sum(v) AS BIGINT) + count(v) // 2) // count(v) END AS dc FROM bl LEFT JOIN e USING (n, bk, bx) GROUP BY 1, 2, 3""")
def dc_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(pixels.dc_predicted(synth(spark), 8))


@query("intra_mode_choice", "F19 O4", f"""WITH {SYNTH}, bl AS (SELECT n, y // 8 AS bk, x // 8 AS bx, y, x, v FROM px WHERE y >= 8 AND x >= 8),
p AS (SELECT bl.*, a.v AS up, l.v AS lf, c.v AS co FROM bl JOIN px a ON a.n = bl.n AND a.y = bk * 8 - 1 AND a.x = bl.x JOIN px l ON l.n = bl.n AND l.y = bl.y AND l.x = bx * 8 - 1 JOIN px c ON c.n = bl.n AND c.y = bk * 8 - 1 AND c.x = bx * 8 - 1),
e AS (SELECT n, bk, bx, unnest([1, 2, 3]) AS mode, unnest([abs(v - up), abs(v - lf), abs(v - least(greatest(up + lf - co, 0), 255))]) AS d FROM p), sm AS (SELECT n, bk, bx, mode, CAST(sum(d) AS BIGINT) AS sad FROM e GROUP BY 1, 2, 3, 4)
SELECT n, bk AS block_y, bx AS block_x, mode, sad FROM (SELECT *, row_number() OVER (PARTITION BY n, bk, bx ORDER BY sad, mode) AS r FROM sm) WHERE r = 1""")
def intra_mode_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertical (1), horizontal (2) or gradient (3) prediction, whichever leaves the least SAD."""
    luma = synth(spark)
    here = luma.where("y >= 8 AND x >= 8").selectExpr("n", "y", "x", "v", "y div 8 AS by", "x div 8 AS bx", "(y div 8) * 8 - 1 AS ey", "(x div 8) * 8 - 1 AS ex")
    edge = lambda name, y, x: luma.select("n", F.col("y").alias(y), F.col("x").alias(x), F.col("v").alias(name))
    rows = here.join(edge("up", "ey", "x"), ["n", "ey", "x"]).join(edge("lf", "y", "ex"), ["n", "y", "ex"]).join(edge("co", "ey", "ex"), ["n", "ey", "ex"])
    modes = [F.col("up"), F.col("lf"), clamp(F.col("up") + F.col("lf") - F.col("co"), 0, 255)]
    sums = rows.groupBy("n", "by", "bx").agg(*[F.sum(F.abs(F.col("v") - m)).alias(f"s{k}") for k, m in enumerate(modes, 1)])
    best = F.least(*[F.struct(F.col(f"s{k}").alias("sad"), F.lit(k).alias("mode")) for k in (1, 2, 3)])
    return _named(sums.select("n", "by", "bx", best.alias("b")).select("n", "by", "bx", "b.mode", "b.sad"))


@query("motion_search", "F20", f"""WITH {PAN}, o AS (SELECT dy, dx FROM range(-3, 4) a(dy), range(-3, 4) b(dx)),
d AS (SELECT c.n, c.y // 8 AS bk, c.x // 8 AS bx, dy, dx, abs(c.v - r.v) AS d FROM px c CROSS JOIN o JOIN px r ON r.n = c.n - 1 AND r.y = c.y + dy AND r.x = c.x + dx),
s AS (SELECT n, bk, bx, dy, dx, CAST(sum(d) AS BIGINT) AS sad FROM d GROUP BY ALL HAVING count(*) = 64)
SELECT n, bk AS block_y, bx AS block_x, dy, dx, sad FROM (SELECT *, row_number() OVER (PARTITION BY n, bk, bx ORDER BY sad, abs(dy) + abs(dx), dy, dx) AS r FROM s) WHERE r = 1""")
def motion_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    luma = pan(spark)
    return _named(pixels.motion_search(luma.where("n > 0"), luma.withColumn("n", F.col("n") + 1), 8, 3))


@query("dead_zone_quant", "F12", """WITH c AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding) AS f FROM embeddings), r AS (SELECT vec_id, i, CAST(floor(CAST(f AS DOUBLE) * 1000) AS BIGINT) AS v, CASE WHEN i = 0 THEN 20 ELSE 40 END AS st FROM c)
SELECT vec_id, CAST(i AS INT) AS i, CASE WHEN v < 0 THEN -((-v * 8 + 3 * st) // (st * 8)) ELSE (v * 8 + 3 * st) // (st * 8) END AS level, CASE WHEN v < 0 THEN -((-v * 8 + 3 * st) // (st * 8)) ELSE (v * 8 + 3 * st) // (st * 8) END * st AS back FROM r""")
def dead_zone_quant(spark: SparkSession, sf_dir: str) -> DataFrame:
    dc, ac = samples.steps(32)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "f")).select("vec_id", "i", F.floor(F.col("f").cast("double") * 1000).alias("v"))
    step = F.when(F.col("i") == 0, F.lit(dc)).otherwise(F.lit(ac))
    level = samples.quantise(F.col("v"), step)
    return rows.select("vec_id", "i", level.alias("level"), (level * step).alias("back"))


@query("vector_sse", "A2 J5", """WITH a AS (SELECT vec_id, unnest(range(len(embedding))) AS i, CAST(floor(unnest(embedding) * 100) AS BIGINT) AS v FROM embeddings)
SELECT a.vec_id, CAST(sum((a.v - b.v) * (a.v - b.v)) AS BIGINT) AS sse, count(*) AS samples FROM a JOIN a b ON b.vec_id = a.vec_id + 1 AND b.i = a.i GROUP BY 1""")
def vector_sse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector against the next, as sample arrays: element-wise without exploding."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda f: F.floor(samples.scaled(f, 100))).alias("a"))
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    e = F.zip_with("a", "b", lambda x, y: (x - y) * (x - y))
    return rows.join(after, "vec_id").select("vec_id", F.aggregate(e, F.lit(0).cast("long"), lambda acc, x: acc + x).alias("sse"), F.size("a").cast("long").alias("samples"))


@query("flagship", "J5 A1 A2 A3 W1 P6 J3", f"""WITH {SYNTH}, q AS (SELECT n, y, x, v, CASE WHEN n >= 6 THEN 255 - v ELSE v END AS w, CASE WHEN n = 0 THEN 0 ELSE v - v // 7 * 7 END AS e FROM px),
p AS (SELECT n, CASE WHEN sum(e * e) = 0 THEN 99.0 ELSE round(10 * log10(65025.0 * count(*) / sum(e * e)), 6) END AS psnr FROM q GROUP BY n),
d AS (SELECT n, abs(w - lag(w) OVER (PARTITION BY y, x ORDER BY n)) AS d FROM q), c AS (SELECT n, coalesce(sum(d) > 28 * count(*), FALSE) AS cut FROM d GROUP BY n),
k AS (SELECT user_id, event_id, event_id * 1000000 AS t_ns, (SELECT max(n) FROM range({N}) f(n) WHERE CAST(n AS BIGINT) * 1001 * 1000000000 // 30000 <= event_id * 1000000) AS shown FROM events)
SELECT user_id, event_id, t_ns, shown, coalesce(lag(shown) OVER (PARTITION BY user_id ORDER BY t_ns) <> shown, TRUE) AS changed, psnr, cut FROM k JOIN p ON p.n = shown JOIN c ON c.n = shown""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generated clip watched by every user of `events`: the frame on screen at each of their ticks, whether it
    changed, its quality against a quantised copy, and whether it is a cut."""
    from ..functions import timing

    quality = frame_psnr(spark, sf_dir).select("n", "psnr").join(scene_cut(spark, sf_dir).select("n", "cut"), "n")
    rate = F.lit(30000).cast("long"), F.lit(1001).cast("long")
    ticks = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") * 1_000_000).alias("t_ns"))
    shown = ticks.withColumn("shown", F.least(timing.frame_at(F.col("t_ns"), *rate), F.lit(N - 1)).cast("long"))
    before = F.lag("shown").over(Window.partitionBy("user_id").orderBy("t_ns"))
    shown = shown.withColumn("changed", F.coalesce(before != F.col("shown"), F.lit(True)))
    return shown.join(F.broadcast(quality.withColumnRenamed("n", "shown")), "shown").select("user_id", "event_id", "t_ns", "shown", "changed", "psnr", "cut")
