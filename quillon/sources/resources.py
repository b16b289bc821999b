"""A dataset over a version log of JSON resources, with index rows derived or stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extract import current_rows, index_rows, stored_rows
from ..operators.log import latest, of_tenant
from ..plans.dataset import Dataset
from ..registry import Registry, SearchParam
from ..schema import LOG, value_columns

#: A string of JSON with its quotes, and the colon that makes it a member's name.
_STRING = r'"(?:[^"\\]|\\.)*+"(?:\s*:)?'


def string_values(body: Column) -> Column:
    """The string values of a JSON body at any depth, without member names, numbers and booleans, parted by spaces."""
    strings = F.regexp_extract_all(F.to_json(F.try_parse_json(body)), F.lit(_STRING), F.lit(0))
    values = F.transform(F.filter(strings, lambda s: s.endswith('"')), lambda v: v.substr(F.lit(2), F.length(v) - 2))
    return F.regexp_replace(F.array_join(values, " "), r"\\[nrtbf]", " ")


def log_dataset(spark: SparkSession, log: DataFrame, registry: Registry, tenant_id: str = "default", index_path: str | None = None) -> Dataset:
    """``index_path``: where write_index() has put the index tables; without it rows are derived from the log at each use."""
    current = latest(of_tenant(log, tenant_id))

    def resources(resource_type: str) -> DataFrame:
        return current.where(F.col("resource_type") == resource_type).drop("tenant_id", "is_deleted")

    def index(resource_type: str, param: SearchParam) -> DataFrame | None:
        kind = param.kind
        if kind not in ("string", "token", "date", "number", "quantity", "uri", "reference", "composite"):
            return None
        if index_path:
            stored = stored_rows(spark, index_path, kind).where((F.col("tenant_id") == tenant_id) & (F.col("resource_type") == resource_type))
            return current_rows(stored.where(F.col("param_name") == param.name), current).select("resource_id", *value_columns(kind))
        base = param.name.removesuffix(":of-type")
        known = registry.get(resource_type, base)
        if known is None or known.kind != kind:
            return None
        one = Registry()
        one.register(SearchParam(resource_type, base, kind, known.expression, known.targets, known.components))
        return index_rows(current, one, resource_type, kind).where(F.col("param_name") == param.name).select("resource_id", *value_columns(kind))

    def texts(resource_type: str) -> DataFrame:
        """All string values of a resource; its ``text`` narrative is among them."""
        return resources(resource_type).select("fhir_id", string_values(F.col("resource")).alias("text"))

    body = F.parse_json("resource")
    entries = current.where("resource_type = 'List'").select(F.col("fhir_id").alias("list_id"), F.explode(F.coalesce(F.try_variant_get(body, "$.entry", "array<variant>"), F.expr("cast(array() as array<variant>)"))).alias("e"))
    reference = F.try_variant_get("e", "$.item.reference", "string")
    lists = entries.select("list_id", F.regexp_extract(reference, r"([A-Za-z]+)/([^/]+)$", 1).alias("target_type"), F.regexp_extract(reference, r"([A-Za-z]+)/([^/]+)$", 2).alias("target_id"))
    return Dataset(spark, registry, resources, index, lists=lists, texts=texts)


def log_rows(spark: SparkSession, resources: list[dict], last_updated: str = "2024-01-01 00:00:00", tenant_id: str = "default") -> DataFrame:
    """A log with version 1 of each resource, for small inputs and tests."""
    import json
    from datetime import datetime

    at = datetime.fromisoformat(last_updated)
    rows = [(tenant_id, r["resourceType"], r["id"], 1, at, "POST", False, json.dumps(r)) for r in resources]
    return spark.createDataFrame(rows, LOG)
