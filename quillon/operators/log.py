"""The version log: append-only snapshots, current state, history, writes.

A log is a DataFrame of schema.LOG. Nothing is updated in place: a write appends a
version, a delete appends a tombstone, and the current state is the latest
version of each key, by a hash aggregate that keeps one row a key on the map side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import Conflict, Gone, NotFound
from ..functions.bands import _literal, date_band
from .project import put_meta

KEY = ("tenant_id", "resource_type", "fhir_id")


def of_tenant(log: DataFrame, tenant_id: str) -> DataFrame:
    import re

    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_-]{0,62}", tenant_id or ""):
        raise NotFound("unknown tenant")
    return log.where(F.col("tenant_id") == tenant_id)


def latest(log: DataFrame, with_deleted: bool = False) -> DataFrame:
    """The latest version of each key; soft-deleted ones are left out unless asked for."""
    rest = [c for c in log.columns if c not in KEY]
    best = log.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "version_id").alias("v")).select(*KEY, "v.*").select(*log.columns)
    return best if with_deleted else best.where("not is_deleted")


def read(log: DataFrame, resource_type: str, fhir_id) -> DataFrame:
    """The current version of one resource; NotFound or Gone otherwise."""
    rows = latest(log.where((F.col("resource_type") == resource_type) & (F.col("fhir_id") == fhir_id)), True)
    found = rows.select("is_deleted").take(1)
    if not found:
        raise NotFound(f"{resource_type}/{fhir_id}")
    if found[0][0]:
        raise Gone(f"{resource_type}/{fhir_id}")
    return rows


def version(log: DataFrame, resource_type: str, fhir_id, version_id: int) -> DataFrame:
    return log.where((F.col("resource_type") == resource_type) & (F.col("fhir_id") == fhir_id) & (F.col("version_id") == version_id))


def instance_history(log: DataFrame, resource_type: str, fhir_id) -> DataFrame:
    return log.where((F.col("resource_type") == resource_type) & (F.col("fhir_id") == fhir_id)).orderBy(F.col("version_id").desc())


def history(log: DataFrame, resource_type: str | None = None, since: str | None = None, count: int | None = None, page: int = 1) -> DataFrame:
    """Versions of a type or all types, strictly after ``since``, newest first, paged."""
    rows = log
    if resource_type:
        rows = rows.where(F.col("resource_type") == resource_type)
    if since is not None:
        rows = rows.where(F.col("last_updated") > _literal(date_band(since)[0]))
    if count is None:
        return rows
    return rows.orderBy(F.col("last_updated").desc(), "resource_type", "fhir_id", F.col("version_id").desc()).offset((page - 1) * count).limit(count)


def history_total(log: DataFrame, resource_type: str | None = None, since: str | None = None) -> DataFrame:
    """The number of versions that history() pages through."""
    return history(log, resource_type, since).agg(F.count("*").alias("total"))


def number_versions(writes: DataFrame, order: str = "last_updated") -> DataFrame:
    """Version ids 1, 2, ... of a bulk load of writes, by their order within a key."""
    return writes.withColumn("version_id", F.row_number().over(Window.partitionBy(*KEY).orderBy(order)))


def with_meta(rows: DataFrame) -> DataFrame:
    """Bodies with meta.versionId and meta.lastUpdated set, as reads show them."""
    own = F.create_map(F.lit("versionId"), F.col("version_id").cast("string").cast("variant"), F.lit("lastUpdated"), F.date_format("last_updated", "yyyy-MM-dd'T'HH:mm:ss'Z'").cast("variant"))
    return rows.withColumn("resource", put_meta(F.col("resource"), lambda meta: F.map_concat(F.map_filter(meta, lambda k, _: ~k.isin("versionId", "lastUpdated")), own)))


def apply_writes(log: DataFrame, writes: DataFrame, recorded_at) -> DataFrame:
    """The versions that a batch of writes appends; one pass for any number of them.

    ``writes``: schema.LOG's key columns, ``operation`` (POST, PUT, PATCH,
    DELETE), ``resource``, and ``if_match`` (expected version, or null). One
    write a key. The result has ``outcome``: created, updated, deleted, or the
    refusal conflict, not_found, gone; refused rows have no version. A PUT
    creates what is missing unless if_match is set, and revives what is deleted.
    Deleting what is deleted is no new version (outcome "unchanged").
    """
    # only versions of keys that are written are looked at, and only those to be deleted keep their body
    kept = writes.where("operation = 'DELETE'").select(*KEY).distinct().withColumn("body_kept", F.lit(True))
    touched = log.join(writes.select(*KEY).distinct(), list(KEY), "left_semi").join(kept, list(KEY), "left")
    touched = touched.select(*KEY, "version_id", "is_deleted", F.when(F.col("body_kept"), F.col("resource")).alias("resource"))
    now = latest(touched, True).select(*KEY, F.col("version_id").alias("now_version"), F.col("is_deleted").alias("now_deleted"), F.col("resource").alias("now_resource"))
    joined = writes.join(now, list(KEY), "left")
    missing, dead = F.col("now_version").isNull(), F.coalesce("now_deleted", F.lit(False))
    op, expected = F.col("operation"), F.col("if_match")
    outcome = (
        F.when(expected.isNotNull() & (missing | (expected != F.col("now_version"))), F.when(missing, "not_found").otherwise("conflict"))
        .when(op == "POST", F.when(missing, "created").otherwise("conflict"))
        .when(op == "PUT", F.when(missing, "created").otherwise("updated"))
        .when(op == "PATCH", F.when(missing, "not_found").when(dead, "gone").otherwise("updated"))
        .when(op == "DELETE", F.when(missing, "not_found").when(dead, "unchanged").otherwise("deleted"))
    )
    done = joined.withColumn("outcome", outcome)
    appended = F.col("outcome").isin("created", "updated", "deleted")
    return done.select(
        *KEY,
        F.when(appended, F.coalesce("now_version", F.lit(0)) + 1).cast("int").alias("version_id"),
        F.when(appended, F.lit(recorded_at).cast("timestamp_ntz")).alias("last_updated"),
        "operation",
        (op == "DELETE").alias("is_deleted"),
        F.when(op == "DELETE", F.col("now_resource")).otherwise(F.col("resource")).alias("resource"),
        "outcome",
    )


def appended(applied: DataFrame) -> DataFrame:
    """The log rows of applied writes."""
    return applied.where("version_id is not null").drop("outcome")


class LogStore:
    """A log in a folder of Parquet files, partitioned by tenant and type.

    One writer; each commit appends files of its own, so readers see whole
    commits of earlier listings, and small files are for a compaction job.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def log(self) -> DataFrame:
        from ..schema import LOG

        names = [c.split()[0] for c in LOG.split(", ")]
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(self.path).select(*names)

    def commit(self, writes: DataFrame, recorded_at, all_or_nothing: bool = False) -> DataFrame:
        """Appends what the writes give; returns key, version_id and outcome of each. With ``all_or_nothing`` a refusal leaves the log as it was."""
        applied = apply_writes(self.log(), writes, recorded_at).cache()
        outcomes = applied.select(*KEY, "version_id", "outcome")
        refused = outcomes.where(F.col("outcome").isin("conflict", "not_found", "gone"))
        if all_or_nothing and (first := refused.take(1)):
            raise Conflict(f"{first[0].resource_type}/{first[0].fhir_id}: {first[0].outcome}")
        rows = [tuple(r) for r in outcomes.collect()]  # one row a write of this batch, as its response
        appended(applied).write.mode("append").partitionBy("tenant_id", "resource_type").parquet(self.path)
        applied.unpersist()
        return self.spark.createDataFrame(rows, "tenant_id string, resource_type string, fhir_id string, version_id int, outcome string")

    def compact(self, to: str) -> None:
        """The whole log in one sorted run of files a partition, written elsewhere."""
        self.log().repartition("tenant_id", "resource_type").sortWithinPartitions("fhir_id", "version_id").write.partitionBy("tenant_id", "resource_type").parquet(to)
