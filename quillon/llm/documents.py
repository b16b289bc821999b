"""The columns that operators take of a table of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def id_and_text(docs: DataFrame, known: bool = True) -> DataFrame:
    """doc_id and text alone, whatever else the table has; rows without a doc_id are left out if ``known``."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.where("doc_id is not null") if known else rows


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct, whatever their names; its ``.*`` gives them back."""
    return F.struct(*(F.col("`" + name.replace("`", "``") + "`") for name in docs.columns))


def keyed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, text, row): every row under a key of its own, in the order of doc_ids.

    The key is the doc_id where each row has another one. Where some are null or
    repeated, rows are numbered by doc_id and text, nulls first, and saved so that
    a number stays with its row.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("key"), docs["text"].cast("string").alias("text"), whole_row(docs).alias("row"))
    odd = rows.groupBy("key").count().where("count > 1 or key is null").limit(1).count()
    if not odd:
        return rows
    dealt = rows.repartitionByRange("key", F.xxhash64("text")).sortWithinPartitions("key", "text")
    return scratch.save(dealt.select(F.monotonically_increasing_id().alias("key"), "text", "row"), "keyed")


def one_row_each(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` with one row for each doc_id: of repeated ones the largest text, null being the least.

    ``ids`` is a narrow table with the doc_ids of all rows; only if it has
    repeats are the texts dealt by doc_id.
    """
    repeated = ids.groupBy("doc_id").count().where("count > 1").limit(1).count()
    return docs.groupBy("doc_id").agg(F.max("text").alias("text")) if repeated else docs
