"""The corpus pipeline: each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written and reread."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldstat.llm import exact_dedup, jaccard, packing, substring_dedup, toxicity
from foldstat.llm.common import stored


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at or above the toxicity threshold of their language go. Labels of a third of the ids are left to measure by."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, usable=F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    return toxicity.rejected_out(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the row with the largest doc_id stays."""
    return exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of their five-word shingles of 0.8 or more, the smallest doc_id stays."""
    return jaccard.deduplicated(docs, shingle=5, similarity=(4, 5))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under a 20-word window that also starts earlier go; n_chars follows the text."""
    out = substring_dedup.deduplicated(docs, k=20)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 ids, placed in as few sequences as best fit finds."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0, ids=False)


STAGES = [("toxicity", toxic_out), ("exact_dedup", exact), ("near_dedup", near), ("substring_dedup", passages), ("packing", packed)]

#: No SQL: the first stage scores with a trained network. The stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
