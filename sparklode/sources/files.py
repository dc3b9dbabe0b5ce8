"""Package trees as DataFrames."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklode.functions import rules as R


def scan_tree(spark: SparkSession, root: str, done: DataFrame | None = None) -> DataFrame:
    """pkg, file, ext, content of the files to scan below root/package: six extensions, no third-party or media folder, no script
    whose name has "game", package names of at most MOST_APP_ID characters, no package of done (column pkg). Files without bytes are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(R.SCANNED_EXTENSIONS) + "}").load(root)
    return _described(df, root, done)


def stream_tree(spark: SparkSession, root: str, files_per_batch: int = 1000, done: DataFrame | None = None) -> DataFrame:
    """The same as a stream of files."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    df = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(R.SCANNED_EXTENSIONS) + "}").option("maxFilesPerTrigger", files_per_batch).load(root)
    return _described(df, root, done)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; a temporary one in a session of one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="sparklode-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _described(df: DataFrame, root: str, done: DataFrame | None) -> DataFrame:
    base = re.escape(re.sub(r"\Afile:/*", "/", root.rstrip("/")))
    rel = F.regexp_extract("path", rf"{base}/(.+)\z", 1)
    df = df.withColumn("rel", rel).withColumn("pkg", F.substring_index("rel", "/", 1)).withColumn("file", F.col("rel")).withColumn("ext", F.lower(F.substring_index("rel", ".", -1)))
    folders = "|".join(re.escape(f) for f in R.EXCLUDED_FOLDERS)
    name = F.lower(F.substring_index("rel", "/", -1))
    df = df.filter(F.col("rel").contains("/") & (F.length("pkg") <= R.MOST_APP_ID) & ~F.col("rel").rlike(rf"/(?:{folders})/") & ~((F.col("ext") == "js") & name.contains("game")))
    if done is not None:
        df = df.join(done.select("pkg"), "pkg", "left_anti")
    return df.select("pkg", "file", "ext", "content")


def read_interchange(spark: SparkSession, path: str) -> DataFrame:
    """Constants of interchange JSON files: {"statements": [text], "constants": [[value, statement, source]]}."""
    raw = spark.read.schema("statements array<string>, constants array<array<string>>").option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    each = raw.select("file", "statements", F.posexplode("constants").alias("pos", "c"))
    sid = F.col("c")[1].cast("int")
    return each.select("file", F.col("c")[0].alias("value"), sid.alias("sid"), F.col("c")[2].alias("src"), F.try_element_at("statements", sid + 1).alias("stmt"), F.col("pos").cast("long").alias("pos"))
