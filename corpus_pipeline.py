"""From raw documents to packed training sequences: classify, deduplicate, mix, pack.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents. ``run`` writes each stage's rows as Parquet to the session's shared checkpoint folder and reads them again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from precis.llm import mixing, packing, probminhash, weak_labels
from precis.llm.common import ensure_checkpoint_dir
from precis.llm.queries import tokenizer
from precis.session import ship_package


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Weak-label classifier (operator 7): documents that it rejects go."""
    ship_package(spark)
    return weak_labels.accepted(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """ProbMinHash (operator 5): one document of each group of near-duplicates stays."""
    ship_package(spark)
    return probminhash.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Water-filling mix (operator 10): each document as often as its source's target asks."""
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sum-of-squares packing (operator 6): one row per piece of a sequence."""
    ship_package(spark)
    return packing.ids_crc32(packing.pack(docs, tokenizer("word_bpe_49k.json")))


STAGES = [("quality", quality), ("deduplicate", deduplicate), ("mix", mix), ("pack", pack)]

#: Model fitting, signatures and tokenising are no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    shared = f"{spark.sparkContext.getCheckpointDir()}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{shared}/{name}")
            docs = spark.read.parquet(f"{shared}/{name}")
    return docs
