"""Exact dedup over content-defined chunk recipes, in DataFrame functions only.

A normalised text (A-Z lower-cased, nothing else) is cut into chunks whose ends
its own characters choose: after CHUNK_MIN characters a chunk ends at the next
sentence or line end, and at CHUNK_MAX at the latest. A document's recipe is its
ordered list of chunk fingerprints, a few bytes for a few hundred characters, and
the recipes are what is shuffled and compared; a text is read once and never moved.

A fingerprint becomes an identifier once it is verified: among the documents
whose recipes repeat, each fingerprint must stand for one chunk content, told by
the chunk's SHA-256. Where one stands for two, the SHA-256 values take its
recipes' place. Documents are equal when their ordered identifier lists are.

Defined cases: a null text is an empty one, and all empty texts are equal; of
equal texts the row with the largest doc_id stays; repeated rows of one doc_id
and text are members of one group, each with a row in the result, and a null
doc_id sorts before all others; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

CHUNK_MIN = 256
CHUNK_MAX = 2048

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())


def chunks(text: Column) -> Column:
    """The chunks of a text, which join to the text again."""
    pattern = rf"(?s).{{{CHUNK_MIN - 1},{CHUNK_MAX - 1}}}?[.!?\n]|.{{1,{CHUNK_MAX}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _recipes(docs: DataFrame) -> DataFrame:
    text = docs.select(docs["doc_id"].cast("long").alias("doc_id"), normalised(docs["text"].cast("string")).alias("text"))
    cut = text.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), chunks(F.col("text")).alias("chunks"))
    return cut.select("doc_id", "text_sha256", F.transform("chunks", lambda c: F.xxhash64(c)).alias("recipe"), F.transform("chunks", lambda c: F.unhex(F.sha2(c.cast("binary"), 256))).alias("contents"))


def verified(recipes: DataFrame, scratch: Scratch) -> DataFrame:
    """``recipes`` with ``ids``, the ordered identifier list: recipe, and contents where a fingerprint was unsure (else empty)."""
    repeated = recipes.groupBy("recipe").agg(F.count("*").alias("n")).where("n > 1").select("recipe")
    pairs = recipes.join(repeated, "recipe", "left_semi").select(F.explode(F.arrays_zip("recipe", "contents")).alias("c")).select(F.col("c.recipe").alias("fp"), F.col("c.contents").alias("content")).distinct()
    unsure = scratch.save(pairs.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp"), "unsure")
    exact = F.expr("cast(array() as array<binary>)")
    if not unsure.limit(1).count():
        return recipes.withColumn("ids", F.struct("recipe", exact.alias("exact")))
    doubtful = recipes.select("recipe", F.explode("recipe").alias("fp")).join(unsure, "fp", "left_semi").select("recipe").distinct().withColumn("doubtful", F.lit(True))
    marked = recipes.join(doubtful, "recipe", "left")
    return marked.withColumn("ids", F.struct("recipe", F.when(F.col("doubtful"), F.col("contents")).otherwise(exact).alias("exact"))).drop("doubtful")


def exact_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``."""
    scratch = Scratch(spark, "exact-dedup")
    recipes = verified(scratch.save(_recipes(docs), "recipes"), scratch).select("doc_id", "text_sha256", "ids")
    groups = recipes.groupBy("ids").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    joined = recipes.join(groups, "ids", "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256")
