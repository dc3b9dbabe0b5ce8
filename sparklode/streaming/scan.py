"""The scan as a stream: a file source whose batches are written to the store, with the ledger of packages that lets a scan go on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparklode.operators.store import completed_packages, items_of, merge_statuses, occurrences_of
from sparklode.plans.pipeline import findings_of
from sparklode.sources.extract import content_key, extract, one_of_each
from sparklode.sources.files import scan_tree, stream_tree

LEDGER = "pkg string, rel_path string, status string, batch int"
ITEMS = "hash_sha256 string, type_id int, raw_value string, ref_count long, batch int"
OCCURRENCES = "appid string, hash_sha256 string, source_file string, detector_source string, source_snippet string, batch int"


def start_stream(files: DataFrame, store: str, every: str | None = None) -> StreamingQuery:
    """Scans a stream of files (pkg, file, ext, content). Each batch writes its items, occurrences and statuses to folders of its own
    number, the statuses last, so a batch that is run again overwrites itself and a file counts as done only when its findings are
    there. A batch whose files are all left out writes nothing. Files of a batch with equal content are extracted and classified once, and
    each gets the findings. every: a trigger interval such as "2 seconds"; without one the query ends when all that is there has been read."""
    spark = files.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        if batch.select("pkg").isEmpty():
            return
        keyed = batch.withColumn("key", content_key())
        where = keyed.select("pkg", "file", "key").persist()
        constants = extract(one_of_each(keyed)).persist()
        each = findings_of(constants, spark).withColumnsRenamed({"pkg": "key", "file": "one"}).drop("one").persist()
        try:
            found = where.join(each, "key")
            items_of(found).write.mode("overwrite").parquet(f"{store}/items/batch={number}")
            occurrences_of(found).write.mode("overwrite").parquet(f"{store}/occurrences/batch={number}")
            statuses = constants.filter(F.col("value").isNull()).select(F.col("pkg").alias("key"), "status")
            ledger = where.join(statuses, "key").select("pkg", F.col("file").alias("rel_path"), "status")
            ledger.write.mode("overwrite").parquet(f"{store}/ledger/batch={number}")
        finally:
            for held in (each, constants, where):
                held.unpersist()

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return files.writeStream.foreachBatch(write).option("checkpointLocation", f"{store}/checkpoint").trigger(**trigger).start()


def start_scan(spark: SparkSession, root: str, store: str, files_per_batch: int = 1000, every: str | None = None) -> StreamingQuery:
    """Scans what lies in root into the store. Packages that the store's ledger has as complete are left out, so
    a scan also goes on where its checkpoint is gone."""
    done = None if read_ledger(spark, store).isEmpty() else read_completed(spark, root, store).filter("completed")
    return start_stream(stream_tree(spark, root, files_per_batch, done), store, every)


def _read(spark: SparkSession, at: str, schema: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(at)


def read_items(spark: SparkSession, store: str) -> DataFrame:
    """The items of all batches, merged: the earliest batch gives type and value."""
    rows = _read(spark, f"{store}/items", ITEMS)
    return rows.groupBy("hash_sha256").agg(F.min_by("type_id", "batch").alias("type_id"), F.min_by("raw_value", "batch").alias("raw_value"), (F.sum(F.col("ref_count") + 1) - 1).alias("ref_count"))


def read_ledger(spark: SparkSession, store: str) -> DataFrame:
    """pkg, rel_path, status of every file that some batch has finished."""
    return merge_statuses(_read(spark, f"{store}/ledger", LEDGER).withColumnRenamed("batch", "seq"))


def read_completed(spark: SparkSession, root: str, store: str) -> DataFrame:
    """pkg, completed: whether the ledger has all files of a package that lie in root, none with a status of infrastructure."""
    dispatched = scan_tree(spark, root).groupBy("pkg").agg(F.count("*").alias("n"))
    return completed_packages(read_ledger(spark, store), dispatched)
