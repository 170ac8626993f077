"""Corpus pipeline: quality, line dedup, near-dedup, decontamination, mixing, in this order.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns of
documents. run() writes each stage's result to the shared folder and reads it as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm.common import cut, forget
from tokenloom.llm.decontaminate import drop_contaminated
from tokenloom.llm.lines import dedup_lines
from tokenloom.llm.mixing import mix
from tokenloom.llm.quality import score_quality, train
from tokenloom.llm.simhash import SimHash, drop_near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bytes of texts that a Python worker gets at once; the workers of an executor live beside its heap.
BATCH, BATCH_KEY = "16m", "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Must hold when a stage's frame is run, so a stage leaves it set; run() puts back what was."""
    spark.conf.set(BATCH_KEY, BATCH)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    small_batches(spark)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    return score_quality(docs, model).filter("predicted = 1").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go, and documents of which nothing else was left."""
    out = dedup_lines(docs.select(*COLUMNS))
    left = out.filter((F.col("removed_chunks") == 0) | (F.btrim("text", F.lit(" \t\r\n\x0b\f")) != ""))
    return left.withColumn("n_chars", F.when(F.col("removed_chunks") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8."""
    small_batches(spark)
    return drop_near_duplicates(docs.select(*COLUMNS), SimHash.for_similarity(0.8, shingle=5))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    small_batches(spark)
    return drop_contaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place in the mixture of sources."""
    return mix(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("mixing_to_target_weights", mixing),
]

#: SQL cannot express the stages; the tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    before = spark.conf.get(BATCH_KEY)
    try:
        for _, stage in STAGES[:-1]:
            old = path
            docs, path = cut(stage(spark, docs, sf_dir))
            if old:
                forget(spark, old)
    finally:
        spark.conf.set(BATCH_KEY, before)
    return STAGES[-1][1](spark, docs, sf_dir)
