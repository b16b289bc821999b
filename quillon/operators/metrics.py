"""Counters and latencies of requests and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Upper bounds of the latency buckets, in seconds.
BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def sanitised(path: Column) -> Column:
    """A request path with {id} for UUIDs and numbers, so that paths stay few."""
    uuid = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
    return F.regexp_replace(path, rf"(?<=/)(?:{uuid}|\d+)(?=/|$)", "{id}")


def request_counts(requests: DataFrame) -> DataFrame:
    """n and cumulative latency buckets by method, path and status; ``requests``: method, path, status, seconds."""
    buckets = [F.count(F.when(F.col("seconds") <= b, 1)).alias(f"le_{b:g}") for b in BOUNDS]
    return requests.withColumn("path", sanitised(F.col("path"))).groupBy("method", "path", "status").agg(F.count("*").alias("n"), F.sum("seconds").alias("seconds"), *buckets)


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The rows, counted as they pass; the observation has ``rows`` after an action."""
    watch = Observation(name)
    return df.observe(watch, F.count(F.lit(1)).alias("rows")), watch
