"""Incremental forms, beyond what a request-response server has.

Each takes a streaming DataFrame. Sources are the version log's folder or any
stream of the same columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extract import write_index
from ..registry import Registry
from ..schema import LOG


def tail(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """New versions of a log folder as they are committed."""
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def maintain_indexes(stream: DataFrame, registry: Registry, path: str, checkpoint: str):
    """A query that appends the index rows of new versions, a folder a kind.

    Rows carry their version, and readers keep those of current ones. A batch is
    written under its number in the layout of write_index(), so a batch that runs
    again replaces its own rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        write_index(batch, registry, path, number)
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def distinct_versions(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each version once, however often it is delivered within the delay."""
    timed = stream.withColumn("at", F.col("last_updated").cast("timestamp")).withWatermark("at", delay)
    return timed.dropDuplicatesWithinWatermark(["tenant_id", "resource_type", "fhir_id", "version_id"])


def window_counts(stream: DataFrame, time: str, key: str, length: str = "1 hour", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts by key in tumbling (or sliding) windows; late rows within the delay count."""
    timed = stream.withColumn("at", F.col(time).cast("timestamp")).withWatermark("at", delay)
    return timed.groupBy(F.window("at", length, slide or length), key).agg(F.count("*").alias("n")).select("window.start", "window.end", key, "n")


def session_counts(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    timed = stream.withColumn("at", F.col(time).cast("timestamp")).withWatermark("at", delay)
    return timed.groupBy(F.session_window("at", gap), key).agg(F.count("*").alias("n")).select("session_window.start", "session_window.end", key, "n")


def streaming_last_n(stream: DataFrame, key: str, time: str, most: int = 1) -> DataFrame:
    """(key, fhir_id, at): the latest ``most`` of each key after each batch; state is that many rows a key."""

    def update(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = [tuple(x) for x in zip(*state.get, strict=True)] if state.exists else []
        for f in frames:
            now += list(zip(f["fhir_id"], f["at"], strict=True))
            now = sorted(set(now), key=lambda x: (-pd.Timestamp(x[1]).value, x[0]))[:most]
        state.update(([i for i, _ in now], [pd.Timestamp(t).to_pydatetime() for _, t in now]))
        yield pd.DataFrame({key: [k[0]] * len(now), "fhir_id": [i for i, _ in now], "at": [t for _, t in now]})

    rows = stream.select(F.col(key).cast("string").alias(key), F.col("fhir_id").cast("string").alias("fhir_id"), F.col(time).cast("timestamp").alias("at"))
    return rows.groupBy(key).applyInPandasWithState(update, f"{key} string, fhir_id string, at timestamp", "ids array<string>, times array<timestamp>", "update", "NoTimeout")
