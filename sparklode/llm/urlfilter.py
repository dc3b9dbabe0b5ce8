"""URL rules: a blocked Bloom filter of the listed canonical keys, then an exact hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklode.llm.common import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Listed keys up to which the filter words and the rules are broadcast (under about 40 MB); longer lists are joined by shuffle.
BROADCAST_RULES = 200_000

#: Bits of filter for each listed key, and bits set for a key within its 64-bit block.
BITS_PER_KEY, PROBES = 16, 5


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _mask(h: Column) -> Column:
    """The bits of a key in its block, from the low 30 bits of its hash."""
    mask = F.lit(0).cast("long")
    for i in range(PROBES):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return mask


def _block(h: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 32), F.lit(blocks))


def bloom_words(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter as (block, word): one row for each block that has bits."""
    h = F.xxhash64(key)
    return keys.select(_block(h, blocks).alias("block"), _mask(h).alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("word"))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The rule that decides each page.

    pages: page_id, url and any other columns, which are left out. rules: host, path, verdict; a rule
    fits its host and the host's subdomains where the url's path starts with the rule's path; the
    longest fitting rule (host and path together, then host) decides, and of equal rules with two verdicts
    block does. Returns a row for each row of pages: page_id, host, path, rule (null if none fits),
    verdict (default if none fits).

    A null url, or one without ://, has an empty host and path and meets no rule with a host. Repeated
    rows and null ids are kept as they are. An empty list gives every page the default. Each distinct host and path gives
    one key for each suffix of the host and each listed path length; the blocked Bloom filter lets through
    listed keys and a few others, and the join on the whole key removes those. What decides a host and path then
    goes back to its pages by a join that can split a hot one.
    """
    spark = pages.sparkSession
    listed = rules.select(
        F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict")
    ).filter("r_host != '' and r_verdict is not null")
    listed = listed.groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict")).withColumn("key", F.concat_ws("\n", "r_host", "r_path"))
    n_rules = listed.count()
    # path lengths of the list: at most as many as a listed path has characters
    lengths = sorted(r[0] for r in listed.select(F.length("r_path")).distinct().collect())
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not n_rules:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    small = F.broadcast if n_rules <= BROADCAST_RULES else (lambda df: df)
    blocks = max(1, n_rules * BITS_PER_KEY // 64)
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.struct(F.lit(n).alias("n"), F.substring("path", 1, n).alias("p")) for n in lengths]), lambda x: F.length(x["p"]) == x["n"])
    keys = (
        rows.filter("host != ''").select("host", "path").distinct()
        .withColumn("prefix", F.explode(F.transform(prefixes, lambda x: x["p"])))
        .withColumn("suffix", F.explode(suffixes))
        .withColumn("key", F.concat_ws("\n", "suffix", "prefix"))
        .withColumn("h", F.xxhash64("key"))
        .withColumn("block", _block(F.col("h"), blocks))
        .withColumn("mask", _mask(F.col("h")))
    )
    words = bloom_words(listed, "key", blocks)
    passed = keys.join(small(words), "block").filter(F.col("word").bitwiseAND(F.col("mask")) == F.col("mask")).select("host", "path", "key")
    exact = passed.join(small(listed), "key")
    fit = F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("nh"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))
    # a table of its own, so that the join deals both sides itself and can split a hot host and path
    best = Scratch(spark, "urls").table(exact.groupBy("host", "path").agg(F.max(fit).alias("best")), "best")
    out = rows.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
