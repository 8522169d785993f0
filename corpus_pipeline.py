"""Corpus preparation: quality, near duplicates, repeated passages, benchmark leaks, tokens.

Every stage but the last returns the columns of documents. A null doc_id is handled like an id of its own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismlake.llm import bpe, decontam, neardup, quality, suffixdedup
from prismlake.llm.common import staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    scored = quality.quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=COLUMNS)
    return scored.where("predicted = 1").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, one of the smallest doc_id (null where none has an id), of each group of near duplicates.

    Rows without words are in no group; of those with the same id and text one is kept. Of repeated rows whose
    other columns differ the one with the least values, nulls first, is kept.
    """
    found = neardup.grouped(docs)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least")
    words = found.where("n_shingles > 0").groupBy("group").agg(least).select("least.doc_id", "least.row")
    kept = words.unionByName(found.where("n_shingles = 0").select("doc_id", "row").distinct()).toDF("kept_id", "row")
    rest = F.struct(*(c for c in COLUMNS if c not in ("doc_id", "text"))).alias("rest")
    rows = docs.groupBy("doc_id", "text").agg(F.min(rest).alias("rest")).withColumn("kept_row", neardup.row_hash())
    same = rows["doc_id"].eqNullSafe(kept["kept_id"]) & (rows["kept_row"] == kept["row"])
    return rows.join(kept, same, "left_semi").select("doc_id", "text", "rest.*").select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their passages that are repeated anywhere."""
    cut = suffixdedup.without_repeats(docs, with_kept=True, carry=["lang", "source"])
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold passages of several benchmark items."""
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = staged(found.where("contaminated").select(F.col("doc_id").alias("bad_id")).distinct(), "contaminated")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]), "left_anti").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents that are left."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", one_of_each),
    ("suffix-array dedup", without_repeats),
    ("benchmark decontamination", without_benchmark),
    ("byte-level BPE", tokens),
]

#: No stage's models and digests can be written as SQL; tests/llm hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each from what the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
