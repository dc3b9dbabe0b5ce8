"""Findings as a store: distinct values, occurrences, the ledger of packages, the point query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklode.functions import rules as R
from sparklode.plans.taxonomy import type_dimension


def cap_bytes(text: Column, most: int = R.MOST_TEXT_BYTES) -> Column:
    """The longest prefix of whole characters in that many UTF-8 bytes."""
    data = text.cast("binary")
    # the cut bytes in hexadecimal; a character's first byte says how long it is, so a torn one shows in its first byte's place from the end
    digits = F.hex(F.substring(data, 1, most))
    tail = F.when(digits.rlike("[CDEF].\\z"), 1).when(digits.rlike("[EF].[89AB].\\z"), 2).when(digits.rlike("F.[89AB].[89AB].\\z"), 3).otherwise(0)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.substring(data, F.lit(1), F.lit(most) - tail).cast("string"))


def with_types(findings: DataFrame, spark: SparkSession) -> DataFrame:
    """kind_id, type_id and risk_id of each finding's slug; an unknown slug is of kind 99 and risk 200."""
    types = F.broadcast(type_dimension(spark))
    joined = findings.join(types, "slug", "left")
    return joined.withColumn("kind_id", F.coalesce("category_id", F.lit(99))).withColumn("risk_id", F.lit(200) + F.coalesce("risk_level", F.lit(0)))


def items_of(findings: DataFrame) -> DataFrame:
    """Distinct values: hash_sha256, type_id (of the first in order of app, file, pos), raw_value, ref_count (occurrences less one).

    findings: pkg, file, pos, type_id, value. Partial aggregates by hash: a value that occurs everywhere meets as one row a task.
    """
    order = F.struct("pkg", "file", "pos", "type_id")
    rows = findings.withColumn("hash_sha256", F.sha2("value", 256))
    out = rows.groupBy("hash_sha256").agg(F.min_by("type_id", order).alias("type_id"), F.min("value").alias("value"), (F.count("*") - 1).alias("ref_count"))
    return out.select("hash_sha256", "type_id", cap_bytes(F.col("value")).alias("raw_value"), "ref_count")


def occurrences_of(findings: DataFrame) -> DataFrame:
    """A row for each finding: appid, hash_sha256, source_file, detector_source, source_snippet."""
    return findings.select(F.col("pkg").alias("appid"), F.sha2("value", 256).alias("hash_sha256"), F.col("file").alias("source_file"), F.col("src").alias("detector_source"), cap_bytes(F.col("context")).alias("source_snippet"))


def merge_items(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new items: an old one keeps its type and value, and counts the new one's occurrences too."""
    both = old.withColumn("age", F.lit(0)).unionByName(new.withColumn("age", F.lit(1)))
    merged = both.groupBy("hash_sha256").agg(F.min_by("type_id", "age").alias("type_id"), F.min_by("raw_value", "age").alias("raw_value"), (F.sum(F.col("ref_count") + 1) - 1).alias("ref_count"))
    return merged.select("hash_sha256", "type_id", "raw_value", "ref_count")


def merge_statuses(results: DataFrame) -> DataFrame:
    """One status for each (pkg, rel_path): the first infrastructure status, else the first of all. results: pkg, rel_path, seq, status."""
    infra = F.col("status").isin(*R.INFRA_STATUSES)
    return results.groupBy("pkg", "rel_path").agg(F.coalesce(F.min_by(F.when(infra, F.col("status")), F.when(infra, F.col("seq"))), F.min_by("status", "seq")).alias("status"))


def completed_packages(statuses: DataFrame, dispatched: DataFrame) -> DataFrame:
    """pkg, completed: all dispatched files have a status, and none is of infrastructure. dispatched: pkg, n."""
    found = statuses.groupBy("pkg").agg(F.count("*").alias("results"), F.max(F.col("status").isin(*R.INFRA_STATUSES)).alias("infra"))
    expected = dispatched.groupBy("pkg").agg(F.max("n").alias("n"))
    joined = expected.join(found, "pkg", "left")
    return joined.select("pkg", ((F.coalesce("results", F.lit(0)) == F.col("n")) & ~F.coalesce("infra", F.lit(False))).alias("completed"))


def failures(statuses: DataFrame) -> DataFrame:
    """pkg, rel_path, status, kind (infra or file) of what failed."""
    infra = F.col("status").isin(*R.INFRA_STATUSES)
    file = F.col("status").isin(*R.FILE_FAILURE_STATUSES) | F.col("status").startswith("error:extract:")
    return statuses.filter(infra | file).withColumn("kind", F.when(infra, "infra").otherwise("file"))


def look_up(items: DataFrame, occurrences: DataFrame, apps: DataFrame, hash_sha256: str, spark: SparkSession, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """The item with its type, and its first occurrences with their apps."""
    item = items.filter(F.col("hash_sha256") == hash_sha256).join(F.broadcast(type_dimension(spark)), "type_id", "left")
    where = occurrences.filter(F.col("hash_sha256") == hash_sha256).join(apps, "appid").orderBy("appid", "source_file").limit(most)
    return item, where
