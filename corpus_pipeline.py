"""A corpus made ready for training: quality rules, near-dedup, decontamination, secrets, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. Rows that a stage rejects are gone for those after it.
A row without doc_id is judged by its text alone.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barfold.llm import bpe, chosen_path, decontaminate, divergence, randomness
from barfold.llm.shared import written


#: Least Jaccard similarity of near copies, over shingles of five words; the op3 query has its own.
NEAR_PER_CENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the counts and don't stray from their language."""
    return divergence.judge(docs).filter("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id; of rows with one id and one text, one."""
    judged = written(chosen_path.near_duplicates(docs, per_cent=NEAR_PER_CENT))
    out = _without(docs, judged.filter("NOT kept").select("doc_id").distinct(), "left_anti")
    repeated = written(judged.filter("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if not repeated.isEmpty():
        once = _without(out, repeated, "left_semi").dropDuplicates(["doc_id", "text"])
        out = _without(out, repeated, "left_anti").unionByName(once)
    return out.select(*docs.columns)


def _without(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """docs joined with ids, which are broadcast if they are few enough."""
    ids = written(ids)
    return docs.join(F.broadcast(ids) if ids.count() <= chosen_path.BROADCAST_IDS else ids, "doc_id", how)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.search(docs, items).filter(F.size("hit_items") == 0).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by their kind, and n_chars made to fit."""
    found = randomness.scan(docs)
    clean = F.when(F.size("secrets") > 0, randomness.redact(F.col("text"), F.col("secrets"))).otherwise(F.col("text"))
    out = found.withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("secrets") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids; the texts are what the ids decode to."""
    coded = bpe.encode_decode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality),
    ("near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("byte-level BPE", token_ids),
]

#: BPE can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
