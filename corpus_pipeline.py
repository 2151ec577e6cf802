"""A training corpus from raw documents: five stages, each on all that the one before it kept.

``run`` writes each stage's rows as Parquet in the shared folder and rereads
them as the next one's documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamark.llm import decontaminate, kn_rules, mix, near_dup, token_ids
from seamark.llm.store import drop, materialize
from seamark.session import ship


def _keep(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is among ``ids (keep_id)``; a null id equals a null id."""
    return docs.join(ids, docs["doc_id"].eqNullSafe(F.col("keep_id")), "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that the quality rules reject go. Of rows with one id, all stay if one does."""
    verdict = kn_rules.quality_rules(docs)
    return _keep(docs, verdict.where("kept").select(F.col("doc_id").alias("keep_id")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3, on five-word shingles at 0.8: the document with the smallest id of each group stays."""
    found = near_dup.near_duplicates(docs, width=5, percent=80)
    return _keep(docs, found.where("kept").select(F.col("doc_id").alias("keep_id")))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that hold a benchmark item, whole or edited, go. Of rows with one id, or without one, all go if one does."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = decontaminate.contaminated(docs, benchmark).select(F.col("doc_id").alias("hit_id")).distinct()
    return docs.join(hit, docs["doc_id"].eqNullSafe(F.col("hit_id")), "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: each document as often as its source's share asks for."""
    return mix.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: token ids in the binary format; per document what is read back from it."""
    return token_ids.read_digests(spark, token_ids.write_token_ids(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("token ids", tokens),
]

#: The stages are models, sketches and files: not SQL. Tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        kept = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop(docs)
        docs = kept
    return docs
