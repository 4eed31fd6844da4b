"""A training corpus from ``documents``: each stage is one operator; the last also tokenises."""

from __future__ import annotations

import gc
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejobs.llm import bpe, decontaminate, exact_dedup, jaccard, quality
from lakejobs.llm.queries import tokenizer_path
from lakejobs.llm.tables import bounded_batches, executors_hand_back, hand_back
from lakejobs.plans.registry import table
from lakejobs.session import scratch_path

# A classifier's decisions are not expressible in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def _with_room(spark: SparkSession) -> None:
    """Small Arrow batches, and executors without the heap that earlier steps took: Python workers need the room."""
    bounded_batches(spark)
    executors_hand_back(spark)


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents the quality classifier rejects."""
    _with_room(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id."""
    _with_room(spark)
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of similar texts the one with the smallest id."""
    _with_room(spark)
    return jaccard.drop_similar(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a window of a benchmark item."""
    _with_room(spark)
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With token ids (packed little-endian), their number, and a check that they decode to the text."""
    _with_room(spark)
    path = tokenizer_path()
    lexicon = bpe.corpus_lexicon(docs, path)
    executors_hand_back(spark)  # counting words takes the heap, encoding the workers
    decoded = bpe.encode_and_decode(docs, path, lexicon)
    return decoded.withColumns({
        "n_tokens": (F.octet_length("ids") / 4).cast("bigint"),
        "round_trip": F.col("decoded") == F.coalesce("text", F.lit("")),
    }).drop("decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_documents),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("decontaminate", without_benchmark),
    ("tokenise", tokenised),
]


def _between_stages(spark: SparkSession) -> None:
    """Let the driver give back what a stage's plans, models and word lists took; nothing of it is used by the next."""
    gc.collect()
    hand_back()
    spark._jvm.System.gc()  # also lets Spark clean up the stage's shuffles and broadcasts


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        _between_stages(spark)
    return docs
