"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. All but the last return the
columns of ``docs``.

Defined cases: a decision is made for each row and not for each doc_id, so rows
that share a doc_id, or have none, stand and fall alone; of rows with the same text
one stays, the one of the largest doc_id, and of near copies the one of the
smallest. A null text is an empty one. Other columns may have any names, dots
and the operators' own among them; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontaminate, exact_dedup, ngram_join, packing, quality_crf
from quillon.llm.documents import keyed
from quillon.llm.scratch import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (operator 2). The model is learnt from the labels of ``docs``."""
    model = quality_crf.train(docs, _table(spark, sf_dir, "labels"))
    return quality_crf.scored(docs, model).where(F.col("score") >= quality_crf.THRESHOLD).select("row.*")


def _asked(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("key").alias("doc_id"), "text")


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose key is not among ``gone`` (doc_id), with their own columns."""
    return rows.join(gone.select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti").select("row.*")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts (operator 4)."""
    rows = keyed(docs, Scratch(spark, "exact-copies"))
    return _without(rows, exact_dedup.exact_dedup(spark, _asked(rows)).where("not kept"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram join (operator 1): 5-word shingles, similarity 0.8."""
    rows = keyed(docs, Scratch(spark, "near-copies"))
    return _without(rows, ngram_join.similarity_components(spark, _asked(rows)).where("component_id <> doc_id"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item has leaked into (operator 5)."""
    rows = keyed(docs, Scratch(spark, "without-benchmark"))
    return _without(rows, decontaminate.decontaminate(spark, _asked(rows), _table(spark, sf_dir, "benchmark")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences (operator 7)."""
    return packing.pack_documents(spark, docs)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", without_benchmark),
    ("packing", packed),
]

#: Neither a trained model nor a tokenizer can be put in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
