"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagflow.llm import bpe, decontaminate, dedup, quality, suffix
from bagflow.llm.common import discard, prepared, scratch_deleted, shared_dir, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality.keep_good),
    ("minhash_near_dedup", dedup.one_of_each),
    ("suffix_array_dedup", suffix.without_repeats),
    ("benchmark_decontamination", decontaminate.keep_clean),
    ("byte_level_bpe", bpe.tokenised),
]

#: Signatures, suffix order, BM25 and merges can't be said in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stages leave of the documents: every column but the text, the token ids, their number and their digest.

    Null, empty and short texts go in the first stage, rows that repeat an id and text in the second. An empty table gives no
    rows; further columns of any name pass through. A stage's table, and what the stage stored for itself, is deleted when the
    next one's stands; the last stage reads the fourth one's, which stays, as this frame is run by the caller."""
    prepared(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch_deleted(spark):
            docs = stored(stage(spark, docs, sf_dir), f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}.parquet")
        discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir).withColumn("ids_sha256", F.sha2("ids", 256))
