"""URL filter: host and path rules first, then a blocked Bloom filter in front of an exact hash join.

The Bloom filter is cut into 256-bit blocks; a listed URL sets two bits in each of the four longs of one block. Blocks
are packed into shards, one array of longs each, 32 bytes a block and nothing else. Pages probe the array of their
shard, and only possible hits come to the exact join, so false positives never reach the result. Shards, and listed
URLs, are broadcast if they have at most BROADCAST_BYTES (a million blocks, 16 million URLs); beyond that they are
shuffled with the small side repeated over salts, so that one very common URL is spread, and pages that the filter
rules out go around the exact join.

Nulls, urls without `://` and empty texts have empty host and path, fit no rule and are allowed. Of rules that fit
the longest wins, of equally long ones the last given. Urls of any length are judged whole. Repeated rows are judged
one by one. An empty table gives an empty one; an empty list blocks nothing. Extra columns of the input are dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import ascii_lower, salted_left_join, size_in_bytes, staged

#: (verdict, host, path prefix)
Rule = tuple[str, str, str]

BITS_PER_URL = 16
BLOCK_BITS = 256
#: Blocks of a shard: an array of 128 KB.
SHARD_BLOCKS = 4096


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(found)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """The listed form: host without a leading www. or m., path without .html and closing slashes, no query."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(\.html)?/*$", ""))


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule, as `host/path`, and its verdict; both null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(prefix)
        name = F.when(fits, F.lit(rule_host + prefix)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(n_blocks).cast("long"))


def _masks(key: Column) -> list[Column]:
    bits = F.xxhash64(key, F.lit("bits"))
    one = F.lit(1).cast("long")

    def bit(at: int) -> Column:
        return F.call_function("shiftleft", one, F.shiftrightunsigned(bits, 6 * at).bitwiseAND(F.lit(63)).cast("int"))

    return [bit(2 * j).bitwiseOR(bit(2 * j + 1)) for j in range(4)]


def bloom_shards(listed: DataFrame, column: str, n_blocks: int) -> DataFrame:
    """_shard and _words: the longs of its SHARD_BLOCKS blocks (the last shard may have fewer), one after the other."""
    none = [F.lit(0).cast("long").alias(f"_m{j}") for j in range(4)]
    masks = [m.alias(f"_m{j}") for j, m in enumerate(_masks(F.col(column)))]
    marks = listed.select(_block(F.col(column), n_blocks).alias("_block"), *masks).unionAll(listed.sparkSession.range(n_blocks).select(F.col("id").alias("_block"), *none))
    blocks = marks.groupBy("_block").agg(F.array(*[F.bit_or(f"_m{j}") for j in range(4)]).alias("_w"))
    packed = blocks.groupBy(F.floor(F.col("_block") / SHARD_BLOCKS).alias("_shard")).agg(F.array_sort(F.collect_list(F.struct("_block", "_w"))).alias("_blocks"))
    return packed.select("_shard", F.flatten(F.col("_blocks._w")).alias("_words"))


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", listed_col: str = "url") -> DataFrame:
    """Judges every row of `pages`: id, host, path, rule, verdict, possible_hit, listed.

    `listed` holds canonical URLs (see `canonical`) to be blocked unless a rule decides. Null entries are ignored.
    """
    keys = staged(listed.select(F.col(listed_col).alias("_key")).where("_key is not null").distinct(), "listed")
    n_listed = keys.count()
    n_blocks = max(1, -(-n_listed * BITS_PER_URL // BLOCK_BITS))
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    judged = pages.select(F.col(id_col).alias("_row"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    judged = judged.select("*", rule.alias("rule"), verdict.alias("_verdict"), canonical(F.col("host"), F.col("path")).alias("_key"))
    block = _block(F.col("_key"), n_blocks)
    judged = judged.select("*", F.floor(block / SHARD_BLOCKS).alias("_shard"), (F.pmod(block, F.lit(SHARD_BLOCKS)) * 4).cast("int").alias("_at"))
    judged = salted_left_join(judged, bloom_shards(keys, "_key", n_blocks), "_shard", n_blocks * BLOCK_BITS // 8)
    inside = [F.get("_words", F.col("_at") + j).bitwiseAND(m) == m for j, m in enumerate(_masks(F.col("_key")))]
    judged = judged.select("_row", "host", "path", "rule", "_verdict", "_key", F.coalesce(inside[0] & inside[1] & inside[2] & inside[3], F.lit(False)).alias("possible_hit"))
    exact = keys.withColumn("_listed", F.lit(True))
    n_bytes = size_in_bytes(keys, "_key")
    if n_bytes <= common.BROADCAST_BYTES:  # a null key meets nothing
        judged = salted_left_join(judged.withColumn("_key", F.when(F.col("possible_hit"), F.col("_key"))), exact, "_key", n_bytes)
    else:
        around = judged.where("not possible_hit").withColumn("_listed", F.lit(None).cast("boolean"))
        judged = salted_left_join(judged.where("possible_hit"), exact, "_key", n_bytes).unionByName(around)
    hit = F.coalesce(F.col("_listed"), F.lit(False))
    decided = F.coalesce(F.col("_verdict"), F.when(hit, F.lit("block")).otherwise(F.lit("allow")))
    return judged.select(F.col("_row").alias(id_col), "host", "path", "rule", decided.alias("verdict"), "possible_hit", hit.alias("listed"))
