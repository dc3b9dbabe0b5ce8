"""The scan as one plan: files, constants, filter, classification, typed findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklode.operators.classify import classify
from sparklode.operators.noise import filter_constants
from sparklode.operators.store import with_types
from sparklode.sources.extract import extract


def findings_of(constants: DataFrame, spark: SparkSession, smart: bool = False) -> DataFrame:
    """Typed findings of constants (pkg, file, sid, value, src, stmt)."""
    key = F.concat_ws("\x00", "pkg", "file")
    rows = constants.filter(F.col("value").isNotNull()).select(key.alias("file"), "sid", "value", "src", "stmt")
    found = classify(filter_constants(rows, smart))
    found = found.withColumn("pkg", F.substring_index("file", "\x00", 1)).withColumn("file", F.substring_index("file", "\x00", -1))
    return with_types(found, spark).select("pkg", "file", "pos", "src", "slug", "kind_id", "type_id", "risk_id", "value", "context")


def scan(files: DataFrame, spark: SparkSession, smart: bool = False) -> tuple[DataFrame, DataFrame]:
    """(findings, statuses) of files (pkg, file, ext, content); findings and statuses read the extraction, so persist files' constants if both are used."""
    constants = extract(files)
    statuses = constants.filter(F.col("value").isNull()).select("pkg", F.col("file").alias("rel_path"), "status")
    return findings_of(constants, spark, smart), statuses
