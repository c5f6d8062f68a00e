"""Corpus pipeline: quality rules, near duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet
in the shared folder and rereads it as the next stage's ``docs``. All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.session import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the cascade; null and empty texts go."""
    from tablescope.llm.quality import quality_cascade

    return quality_cascade(docs).filter("kept").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity of 0.8 or more.

    The row with the smallest id stays (null ids last; of one id the smallest hash of the
    text); of repeated rows with equal id and text one stays. Rows without words have no
    group and stay. Rows that go are named by id and text hash, so the texts themselves are
    not shuffled while those names are few enough to broadcast.
    """
    from tablescope.llm.jaccard import BROADCAST_ROWS, jaccard_groups

    groups = materialize(jaccard_groups(docs, words=5, percent=80).filter("n_shingles > 0"))
    go = materialize(groups.filter("NOT leads").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct())
    again = groups.filter("leads").groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).count().filter("count > 1").drop("count")
    hashed = docs.withColumn("_text", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash"))

    def sized(names: DataFrame) -> DataFrame:
        return F.broadcast(names) if names.count() <= BROADCAST_ROWS else names

    kept = hashed.join(sized(go), same, "left_anti")
    again = materialize(again)
    if not again.isEmpty():
        one = kept.join(sized(again), same, "left_semi").dropDuplicates(["doc_id", "_text"])
        kept = kept.join(sized(again), same, "left_anti").unionByName(one)
    return kept.select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified benchmark item."""
    from tablescope.llm.decontaminate import find_leaks, split_item

    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    question, answer = split_item(F.col("text"))
    return find_leaks(docs, items, question, answer).filter(F.size("leaks") == 0).select(*docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark; n_chars follows the new text."""
    from tablescope.llm.secret_scan import find_secrets, redact

    masked = redact(find_secrets(docs)).withColumn("n_chars", F.when(
        F.size("spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return masked.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of pieces of all documents: doc_id, piece, n_tokens, bucket, bucket_len, batch, slot."""
    from tablescope.llm.packing import pack

    return pack(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secret_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the stages (searches, models and numbering by hash); tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs


QUERIES = {"pipeline": (run, ORACLE_SQL)}
