"""The queries opN_<name> over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_trie, license_scan, line_dedup, packing, pii, quality, simhash, token_counts, url_filter, weighted_sampling
from .common import table, widened

#: The rules that every url is held against.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: The listed canonical URLs: pages 0..PAGES_LISTED - 1 of each spam host and language, as OP1_SQL has them; larger numbers aren't listed.
SPAM_HOSTS = ["spam-farm.example.org", "spam-farm.example.com", "spam-farm.example.net"]
LANGS = ["en", "de", "fr", "es"]
PAGES_LISTED = 1000


def listed_urls(spark: SparkSession) -> DataFrame:
    """len(SPAM_HOSTS) * len(LANGS) * PAGES_LISTED canonical URLs."""
    one = lambda names: F.explode(F.array(*map(F.lit, names)))
    return spark.range(PAGES_LISTED).select("id", one(SPAM_HOSTS).alias("host")).select("id", "host", one(LANGS).alias("lang")).select(F.format_string("%s/%s/%d", "host", "lang", "id").alias("url"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return widened(table(spark, sf_dir, "documents"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), listed_urls(spark), URL_RULES).drop("possible_hit", "listed")


OP1_SQL = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages
), r AS (
  SELECT *, CASE
      WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
      WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
      WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
      WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule,
    regexp_replace(host, '^(www|m)\.', '') AS plain_host, regexp_replace(path, '(\.html)?/*$', '') AS plain_path
  FROM u
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN plain_host IN ('spam-farm.example.org', 'spam-farm.example.com', 'spam-farm.example.net')
      AND regexp_full_match(plain_path, '/(en|de|fr|es)/(0|[1-9][0-9]{0,2})') THEN 'block'
    ELSE 'allow' END AS verdict
FROM r
"""


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rejected_by isn't returned: which of several rules comes first may differ from run to run; the verdict doesn't."""
    measures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    judged = quality.judge_quality(documents(spark, sf_dir), measures=measures)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return judged.select("doc_id", *measures, failed.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))


OP2_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS lines
  FROM documents
), pos AS (
  SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) > 5
), win AS (
  SELECT rid, i, array_to_string(words[i:i + 4], ' ') AS k FROM pos
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1
), rep AS (
  SELECT rid, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM twice) GROUP BY rid
), m AS (
  SELECT doc_id, text, CAST(len(words) AS BIGINT) AS n_words, CAST(len(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    length(text) - length(translate(text, '!', '')) AS shouts, length(regexp_replace(text, '\P{Lu}', '', 'g')) AS upper, length(regexp_replace(text, '\P{L}', '', 'g')) AS letters
  FROM w LEFT JOIN rep USING (rid)
), b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 10 > n_words OR (n_dup_lines >= 2 AND n_dup_lines * 100 > 35 * n_lines) OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR shouts * 2 > n_words OR upper * 10 > letters * 3 OR letters * 2 < word_chars) AS kept
FROM b
"""


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def document_paths(docs: DataFrame) -> DataFrame:
    """A path for each document: source/lang/group/file, every 64th being a LICENSE file of its group, language or source."""
    number = F.col("doc_id")
    root, lang, group = F.col("source"), F.concat_ws("/", "source", "lang"), F.concat_ws("/", "source", "lang", F.expr("doc_id div 256").cast("string"))
    path = F.when(number % 512 == 0, F.concat(root, F.lit("/LICENSE"))).when(number % 256 == 0, F.concat(lang, F.lit("/LICENSE"))).when(number % 64 == 0, F.concat(group, F.lit("/LICENSE")))
    return docs.select("doc_id", "text", path.otherwise(F.concat(group, F.lit("/"), number.cast("string"), F.lit(".txt"))).alias("path"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(document_paths(documents(spark, sf_dir)), keep=["doc_id"])


OP3_SQL = r"""
WITH t(k, license, txt) AS (VALUES TEMPLATES),
tt AS (SELECT k, unnest(regexp_extract_all(lower(txt), '[a-z0-9]+')) AS term FROM t),
tf AS (SELECT k, term, count(*) AS n FROM tt GROUP BY 1, 2),
idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM t)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY 1),
tw AS (SELECT k, term, n * idf AS w FROM tf JOIN idf USING (term)),
tn AS (SELECT k, sqrt(sum(w * w)) AS norm FROM tw GROUP BY 1),
f AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
  CASE WHEN doc_id % 512 = 0 THEN source || '/LICENSE' WHEN doc_id % 256 = 0 THEN source || '/' || lang || '/LICENSE'
    WHEN doc_id % 64 = 0 THEN source || '/' || lang || '/' || (doc_id // 256) || '/LICENSE'
    ELSE source || '/' || lang || '/' || (doc_id // 256) || '/' || doc_id || '.txt' END AS path FROM documents),
p AS (SELECT rid, unnest(CASE WHEN path LIKE '%/LICENSE' THEN list_append(string_split(text, chr(10)), text) ELSE string_split(text, chr(10)) END) AS part,
  unnest(range(1, len(string_split(text, chr(10))) + 1 + CAST(path LIKE '%/LICENSE' AS INT))) AS line FROM f),
w AS (SELECT rid, line, unnest(regexp_extract_all(translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')) AS term FROM p),
c AS (SELECT rid, line, term, count(*) * coalesce(any_value(idf), ln(1.0 + (SELECT count(*) FROM t)) + 1) AS wt FROM w LEFT JOIN idf USING (term) GROUP BY 1, 2, 3),
n AS (SELECT rid, line, sqrt(sum(wt * wt)) AS norm FROM c GROUP BY 1, 2),
d AS (SELECT rid, line, k, sum(wt * w) AS dot FROM c JOIN tw USING (term) GROUP BY 1, 2, 3),
s AS (SELECT rid, k, round(dot / n.norm / tn.norm, 6) AS score FROM d JOIN n USING (rid, line) JOIN tn USING (k)),
own AS (SELECT rid, k, score FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, k) AS r FROM s WHERE score >= 0.75) WHERE r = 1),
g AS (SELECT f.*, own.k, own.score, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM f LEFT JOIN own USING (rid)),
dl AS (SELECT dir AS above, k AS dk, score AS ds FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY score DESC, k) AS r FROM g WHERE path LIKE '%/LICENSE' AND k IS NOT NULL) WHERE r = 1),
near AS (SELECT rid, above, dk, ds FROM (SELECT rid, above, dk, ds, row_number() OVER (PARTITION BY rid ORDER BY length(above) DESC) AS r
  FROM g JOIN dl ON g.dir = dl.above OR starts_with(g.dir, dl.above || '/') OR dl.above = '') WHERE r = 1)
SELECT doc_id, path, coalesce(a.license, b.license) AS license, coalesce(score, ds) AS score, CASE WHEN g.k IS NOT NULL THEN 'file' ELSE above END AS found_in
FROM g LEFT JOIN near USING (rid) LEFT JOIN t a ON a.k = g.k LEFT JOIN t b ON b.k = near.dk
""".replace("TEMPLATES", ", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(license_scan.TEMPLATES)))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_email to n_phone count the spans of the fixed patterns, as base_sha256 lists them; spans holds all."""
    found = pii.find_pii(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["by"] == "pattern")
    found = found.withColumn("base", base)
    of_kind = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [of_kind(k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.span_text(F.col("base")), 256).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.fingerprint_against_next(documents(spark, sf_dir))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, s.last IS NOT NULL AND s.last <> k.doc_id AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY rid, doc_id
"""


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_trie.encode_decode(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))
    n_tokens = (F.octet_length("ids") / 4).cast("long")
    return coded.select("doc_id", n_tokens.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_quality_rules": op2_quality_rules,
    "op3_license_scan": op3_license_scan,
    "op4_pii": op4_pii,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_fingerprints": op6_fingerprints,
    "op7_line_dedup": op7_line_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_bpe_codec": op10_bpe_codec,
}
ORACLE_SQL: dict[str, str] = {"op1_url_filter": OP1_SQL, "op2_quality_rules": OP2_SQL, "op3_license_scan": OP3_SQL, "op7_line_dedup": OP7_SQL}
