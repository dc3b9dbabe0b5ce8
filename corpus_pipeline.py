"""The corpus pipeline: each stage works on what its predecessor kept, written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklode.llm.common import Scratch, read_table
from sparklode.llm.debruijn import dedup_substrings
from sparklode.llm.decontaminate import decontaminate
from sparklode.llm.minhash import near_duplicates
from sparklode.llm.packing import pack_documents
from sparklode.llm.quality import score_quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    rejected = score_quality(docs, read_table(spark, sf_dir, "labels")).filter("not keep").select("doc_id")
    return docs.join(rejected, "doc_id", "left_anti").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id: five words, similarity 0.8 or more."""
    extra = near_duplicates(docs, shingle=5).filter("not kept").select("doc_id")
    return docs.join(extra, "doc_id", "left_anti").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; the documents stay with what is left of their texts."""
    cut = dedup_substrings(docs, keep_text=True).select("doc_id", "text")
    return docs.select("doc_id", "lang", "source").join(cut, "doc_id").withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    bad = decontaminate(docs, read_table(spark, sf_dir, "benchmark")).filter("contaminated").select("doc_id")
    return docs.join(bad, "doc_id", "left_anti").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left as sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("packing", packing)]

#: Signatures, classifiers and token ids have no SQL; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has written on its way goes when its result is written."""
    scratch = Scratch(spark, "pipeline")
    since = len(Scratch.made)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        Scratch.clear(spark, since)
    return docs
