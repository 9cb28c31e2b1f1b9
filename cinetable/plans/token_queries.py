"""Queries over symbols (word lengths of `documents` by language) and over rate points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rates, tokens
from .registry import query, table

_TOK = "t AS (SELECT lang, source, least(length(unnest(string_split(text, ' '))), 15) AS sym FROM documents), h AS (SELECT lang, sym, count(*) AS count FROM t GROUP BY 1, 2)"
_FREQ = """b AS (SELECT *, greatest(1, CAST(count * 4096 // sum(count) OVER (PARTITION BY lang) AS BIGINT)) AS f FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY f DESC, sym) AS r, 4096 - sum(f) OVER (PARTITION BY lang) AS short FROM b), f AS (SELECT lang, sym, count, CAST(f + CASE WHEN r = 1 THEN short ELSE 0 END AS BIGINT) AS freq FROM o)"""


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, sym): the length of each word, at most 15."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", "source", F.explode(F.split("text", " ", -1)).alias("w")).select("doc_id", "lang", "source", F.least(F.length("w"), F.lit(15)).cast("long").alias("sym"))


@query("token_histogram", "A5", f"WITH {_TOK} SELECT * FROM h")
def token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.histogram(symbols(spark, sf_dir), ctx="lang")


@query("freq_normalise", "A6", f"WITH {_TOK}, {_FREQ} SELECT lang, sym, count, freq FROM f")
def freq_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.normalised(tokens.histogram(symbols(spark, sf_dir), ctx="lang"), ["lang"])


@query("token_entropy", "A7", f"WITH {_TOK}, {_FREQ}, e AS (SELECT freq, sym FROM f WHERE lang = 'en') SELECT h.lang, CAST(sum(count) AS BIGINT) AS tokens, round(sum(count * CASE WHEN freq IS NULL THEN 20.0 ELSE log2(4096.0 / freq) END), 3) AS bits FROM h LEFT JOIN e USING (sym) GROUP BY 1")
def token_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of every language's symbols under the model of English."""
    counts = tokens.histogram(symbols(spark, sf_dir), ctx="lang")
    model = tokens.normalised(counts.where("lang = 'en'"), ["lang"]).select("sym", "freq")
    return tokens.cost_bits(counts, model, ["lang"])


@query("bit_audit_rollup", "A11", f"WITH {_TOK}, {_FREQ} SELECT lang, source, count(*) AS tokens, round(sum(log2(4096.0 / freq)), 3) AS bits, CAST(sum(CASE WHEN sym = 0 THEN 1 ELSE 0 END) AS BIGINT) AS empty FROM t JOIN f USING (lang, sym) GROUP BY ROLLUP (lang, source)")
def bit_audit_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = symbols(spark, sf_dir)
    by_source = rows.groupBy("lang", "source", "sym").agg(F.count("*").alias("c"))
    model = tokens.normalised(by_source.groupBy("lang", "sym").agg(F.sum("c").alias("count")), ["lang"]).select("lang", "sym", "freq")
    bits = F.col("c") * F.log2(F.lit(4096.0) / F.col("freq"))
    return by_source.join(model, ["lang", "sym"]).rollup("lang", "source").agg(F.sum("c").alias("tokens"), F.round(F.sum(bits), 3).alias("bits"), F.sum(F.when(F.col("sym") == 0, F.col("c")).otherwise(0)).alias("empty"))


_POINTS = "p AS (SELECT o_custkey % 10 AS clip, o_orderkey % 5 AS codec, 20 + o_orderkey // 5 % 30 + o_custkey % 7 / 10.0 AS psnr, min(CAST(o_totalprice AS BIGINT) + 1) AS size FROM orders GROUP BY 1, 2, 3)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`orders` as rate points: one size for each clip, codec and quality."""
    rows = table(spark, sf_dir, "orders").selectExpr("o_custkey % 10 AS clip", "o_orderkey % 5 AS codec", "20 + o_orderkey div 5 % 30 + o_custkey % 7 / 10.0D AS psnr", "cast(o_totalprice AS BIGINT) + 1 AS size")
    return rows.groupBy("clip", "codec", "psnr").agg(F.min("size").alias("size"))


@query("rate_interpolate", "O6", f"WITH {_POINTS.replace('CAST(o_totalprice AS BIGINT)', 'CAST(trunc(o_totalprice) AS BIGINT)')}, w AS (SELECT *, lead(psnr) OVER (PARTITION BY clip, codec ORDER BY psnr) AS q2, lead(size) OVER (PARTITION BY clip, codec ORDER BY psnr) AS s2 FROM p) SELECT clip, codec, round(exp(ln(size) + (36.0 - psnr) / (q2 - psnr) * (ln(s2) - ln(size))), 4) AS size FROM w WHERE psnr <= 36.0 AND q2 > 36.0")
def rate_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.size_at(points(spark, sf_dir), 36.0, ["clip", "codec"])


@query("corpus_summary", "A10", f"WITH {_POINTS.replace('CAST(o_totalprice AS BIGINT)', 'CAST(trunc(o_totalprice) AS BIGINT)')}, r AS (SELECT a.codec, a.size * 1.0 / b.size AS ratio FROM p a JOIN p b ON a.clip = b.clip AND a.psnr = b.psnr AND b.codec = 0 AND a.codec > 0) SELECT codec, round(quantile_cont(CAST(ratio AS DOUBLE), 0.5), 9) AS median, min(CAST(ratio AS DOUBLE)) AS least, max(CAST(ratio AS DOUBLE)) AS most, count(*) AS clips FROM r GROUP BY 1")
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir)
    base = rows.where("codec = 0").select("clip", "psnr", F.col("size").alias("base"))
    ratios = rows.where("codec > 0").join(base, ["clip", "psnr"]).select("codec", (F.col("size").cast("double") / F.col("base")).alias("ratio"))
    return rates.summary(ratios, ["codec"])
