"""The star-schema test tables as logical resources.

Each parameter of each type is a projection of its base table, so a search reads
the columns that it needs and its comparisons reach the scan. Ids keep their
native type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bands import value_band
from ..plans.dataset import Dataset
from ..registry import Registry, SearchParam

S = SearchParam


def table_registry() -> Registry:
    r = Registry()
    r.register(
        S("Location", "name", "string"),
        S("Organization", "name", "string"),
        S("Organization", "partof", "reference", targets=("Location",)),
        S("Patient", "name", "string"),
        S("Patient", "segment", "token"),
        S("Patient", "geo", "token"),
        S("Patient", "organization", "reference", targets=("Organization",)),
        S("Patient", "balance", "quantity"),
        S("Practitioner", "name", "string"),
        S("Practitioner", "organization", "reference", targets=("Organization",)),
        S("Practitioner", "balance", "quantity"),
        S("Medication", "name", "string"),
        S("Medication", "brand", "token"),
        S("Medication", "form", "token"),
        S("Medication", "size", "number"),
        S("Medication", "price", "quantity"),
        S("Encounter", "status", "token"),
        S("Encounter", "priority", "token"),
        S("Encounter", "subject", "reference", targets=("Patient",)),
        S("Encounter", "date", "date"),
        S("Encounter", "total", "quantity"),
        S("Invoice", "code", "token"),
        S("Invoice", "status", "token"),
        S("Invoice", "quantity", "quantity"),
        S("Invoice", "line-code-quantity", "composite", components=(("code", "token"), ("quantity", "quantity"))),
        S("Invoice", "code-status", "composite", components=(("code", "token"), ("status", "token"))),
        S("Invoice", "performer", "reference", targets=("Practitioner",)),
        S("Invoice", "product", "reference", targets=("Medication",)),
        S("Invoice", "involves", "reference", targets=("Practitioner", "Medication")),
        S("Invoice", "ship", "date"),
        S("Invoice", "encounter", "reference", targets=("Encounter",)),
        S("Observation", "code", "token"),
        S("Observation", "subject", "reference", targets=("Patient",)),
        S("Observation", "date", "date"),
        S("Observation", "value-quantity", "quantity"),
        S("Observation", "code-value-quantity", "composite", components=(("code", "token"), ("value-quantity", "quantity"))),
        S("DocumentReference", "size", "number"),
        S("DocumentReference", "description", "string"),
        S("Communication", "sender", "token"),
        S("Endpoint", "url", "uri"),
    )
    r.compartments = {
        ("Patient", "Encounter"): ("subject",),
        ("Patient", "Observation"): ("subject",),
        ("Encounter", "Invoice"): ("encounter",),
        ("Practitioner", "Invoice"): ("performer",),
    }
    return r


#: type -> (table, id column, last_updated expression)
_RESOURCES = {
    "Location": ("region", "r_regionkey", "cast(null as timestamp_ntz)"),
    "Organization": ("nation", "n_nationkey", "cast(null as timestamp_ntz)"),
    "Patient": ("customer", "c_custkey", "cast(null as timestamp_ntz)"),
    "Practitioner": ("supplier", "s_suppkey", "cast(null as timestamp_ntz)"),
    "Medication": ("part", "p_partkey", "cast(null as timestamp_ntz)"),
    "Encounter": ("orders", "o_orderkey", "o_orderdate"),
    "Observation": ("events", "event_id", "ts"),
    "DocumentReference": ("documents", "doc_id", "cast(null as timestamp_ntz)"),
    "Endpoint": ("pages", "page_id", "cast(null as timestamp_ntz)"),
}
_DAY = "interval 1 day - interval 1 second"
#: (type, parameter) -> (table, id column, value expressions in the order of the kind's columns)
_TOKEN = "'{system}' as system, {column} as code, {column} as display"
_INDEX = {
    ("Location", "name"): ("region", "r_regionkey", ("string", "r_name")),
    ("Organization", "name"): ("nation", "n_nationkey", ("string", "n_name")),
    ("Organization", "partof"): ("nation", "n_nationkey", ("reference", "Location", "n_regionkey")),
    ("Patient", "name"): ("customer", "c_custkey", ("string", "c_name")),
    ("Patient", "segment"): ("customer", "c_custkey", ("token", "urn:segment", "c_mktsegment")),
    ("Patient", "geo"): ("customer", "c_custkey", ("token", "urn:geo", "concat('N', c_nationkey)")),
    ("Patient", "organization"): ("customer", "c_custkey", ("reference", "Organization", "c_nationkey")),
    ("Patient", "balance"): ("customer", "c_custkey", ("quantity", "c_acctbal", "urn:iso:4217", "USD")),
    ("Practitioner", "name"): ("supplier", "s_suppkey", ("string", "s_name")),
    ("Practitioner", "organization"): ("supplier", "s_suppkey", ("reference", "Organization", "s_nationkey")),
    ("Practitioner", "balance"): ("supplier", "s_suppkey", ("quantity", "s_acctbal", "urn:iso:4217", "USD")),
    ("Medication", "name"): ("part", "p_partkey", ("string", "p_name")),
    ("Medication", "brand"): ("part", "p_partkey", ("token", "urn:brand", "p_brand")),
    ("Medication", "form"): ("part", "p_partkey", ("token", "urn:form", "p_type")),
    ("Medication", "size"): ("part", "p_partkey", ("number", "p_size")),
    ("Medication", "price"): ("part", "p_partkey", ("quantity", "p_retailprice", "urn:iso:4217", "USD")),
    ("Encounter", "status"): ("orders", "o_orderkey", ("token", "urn:os", "o_orderstatus")),
    ("Encounter", "priority"): ("orders", "o_orderkey", ("token", "urn:priority", "o_orderpriority")),
    ("Encounter", "subject"): ("orders", "o_orderkey", ("reference", "Patient", "o_custkey")),
    ("Encounter", "date"): ("orders", "o_orderkey", ("date", "o_orderdate", f"o_orderdate + {_DAY}")),
    ("Encounter", "total"): ("orders", "o_orderkey", ("quantity", "o_totalprice", "urn:iso:4217", "USD")),
    ("Invoice", "code"): ("lineitem", "l_orderkey", ("token", "urn:rf", "l_returnflag")),
    ("Invoice", "status"): ("lineitem", "l_orderkey", ("token", "urn:ls", "l_linestatus")),
    ("Invoice", "quantity"): ("lineitem", "l_orderkey", ("quantity", "l_quantity", "urn:u", "unit")),
    ("Invoice", "line-code-quantity"): ("lineitem", "l_orderkey", ("composite", "urn:rf", "l_returnflag", "l_quantity", "urn:u", "unit")),
    ("Invoice", "performer"): ("lineitem", "l_orderkey", ("reference", "Practitioner", "l_suppkey")),
    ("Invoice", "product"): ("lineitem", "l_orderkey", ("reference", "Medication", "l_partkey")),
    ("Invoice", "ship"): ("lineitem", "l_orderkey", ("date", "l_shipdate", f"l_shipdate + {_DAY}")),
    ("Invoice", "encounter"): ("lineitem", "l_orderkey", ("reference", "Encounter", "l_orderkey")),
    ("Observation", "code"): ("events", "event_id", ("token", "urn:event", "event_type")),
    ("Observation", "subject"): ("events", "event_id", ("reference", "Patient", "user_id")),
    ("Observation", "date"): ("events", "event_id", ("date", "ts", "ts")),
    ("Observation", "value-quantity"): ("events", "event_id", ("quantity", "value", "urn:u", "unit")),
    ("Observation", "code-value-quantity"): ("events", "event_id", ("composite", "urn:event", "event_type", "value", "urn:u", "unit")),
    ("DocumentReference", "_language"): ("documents", "doc_id", ("token", "urn:ietf:bcp:47", "lang")),
    ("DocumentReference", "_source"): ("documents", "doc_id", ("uri", "source")),
    ("DocumentReference", "size"): ("documents", "doc_id", ("number", "n_chars")),
    ("DocumentReference", "description"): ("documents", "doc_id", ("string", "text")),
    ("DocumentReference", "_tag"): ("labels", "doc_id", ("token", "urn:quality", "cast(quality as string)")),
    ("DocumentReference", "_security"): ("labels", "doc_id", ("token", "urn:toxic", "cast(toxic as string)")),
    ("Endpoint", "url"): ("pages", "page_id", ("uri", "url")),
}


#: (type, name, kind) of rows that are indexed under names no registry knows, for heuristic search.
_UNREGISTERED = {
    ("Encounter", "note", "string"): ("orders", "o_orderkey", ("string", "o_orderpriority")),
    ("Encounter", "note", "token"): ("orders", "o_orderkey", ("token", "urn:os", "o_orderstatus")),
    ("Encounter", "note", "date"): ("orders", "o_orderkey", ("date", "o_orderdate", f"o_orderdate + {_DAY}")),
    ("Encounter", "note", "number"): ("orders", "o_orderkey", ("number", "o_custkey")),
}


def index_row(table: DataFrame, id_column: str, spec: tuple) -> DataFrame:
    """Index rows of one parameter from a base table."""
    kind, *args = spec
    own = [F.col(id_column).alias("resource_id")]
    if kind == "string":
        text = F.expr(args[0])
        own += [text.alias("value_exact"), F.lower(text).alias("value_lower")]
    elif kind == "token":
        own += [F.lit(args[0]).alias("system"), F.expr(args[1]).alias("code"), F.expr(args[1]).alias("display")]
    elif kind == "date":
        own += [F.expr(args[0]).cast("timestamp_ntz").alias("value_low"), F.expr(args[1]).cast("timestamp_ntz").alias("value_high")]
    elif kind in ("number", "quantity"):
        low, high = value_band(F.expr(args[0]))
        own += [F.expr(args[0]).cast("decimal(20,6)").alias("value"), low.alias("value_low"), high.alias("value_high")]
        if kind == "quantity":
            own += [F.lit(args[1]).alias("system"), F.lit(args[2]).alias("code")]
    elif kind == "uri":
        own += [F.expr(args[0]).alias("value")]
    elif kind == "reference":
        own += [F.lit(args[0]).alias("target_type"), F.expr(args[1]).alias("target_id"), F.lit(None).cast("string").alias("identifier_system"), F.lit(None).cast("string").alias("identifier_value")]
    elif kind == "composite":
        low, high = value_band(F.expr(args[2]))
        own += [F.lit(args[0]).alias("system"), F.expr(args[1]).alias("code"), F.expr(args[2]).cast("decimal(20,6)").alias("value"), low.alias("value_low"), high.alias("value_high"), F.lit(args[3]).alias("qty_system"), F.lit(args[4]).alias("qty_code")]
    return table.select(*own)


def table_dataset(spark: SparkSession, sf_dir: str) -> Dataset:
    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def resources(resource_type: str) -> DataFrame:
        if resource_type == "Invoice":  # lines are elements: one resource an order that has any
            return table("lineitem").groupBy(F.col("l_orderkey").alias("fhir_id")).agg(F.max("l_shipdate").alias("last_updated"))
        if resource_type == "Communication":  # the last turn is the current version
            return table("conversations").groupBy(F.col("conv_id").alias("fhir_id")).agg(F.max("turn").alias("version_id")).withColumn("last_updated", F.lit(None).cast("timestamp_ntz"))
        name, key, updated = _RESOURCES[resource_type]
        rows = table(name)
        return rows.select(F.col(key).alias("fhir_id"), F.expr(updated).alias("last_updated"), *(c for c in rows.columns if c != key))

    def index(resource_type: str, param: SearchParam) -> DataFrame | None:
        if (resource_type, param.name) == ("Communication", "sender"):
            last = table("conversations").groupBy("conv_id").agg(F.max_by("role", "turn").alias("role"))
            return index_row(last, "conv_id", ("token", "urn:role", "role"))
        if (resource_type, param.name) == ("Invoice", "involves"):
            return index("Invoice", registry.get("Invoice", "performer")).unionByName(index("Invoice", registry.get("Invoice", "product")))
        known = _INDEX.get((resource_type, param.name)) or _UNREGISTERED.get((resource_type, param.name, param.kind))
        return index_row(table(known[0]), known[1], known[2]) if known else None

    registry = table_registry()

    def value_set(url: str) -> DataFrame | None:
        sets = {"urn:vs:active": [("urn:event", "click"), ("", "view")], "urn:vs:trouble": [("urn:event", "error")]}
        return spark.createDataFrame(sets[url], "system string, code string") if url in sets else None

    nations = table("nation")
    concepts = nations.select(F.lit("urn:geo").alias("system"), F.concat(F.lit("N"), F.col("n_nationkey")).alias("code"), F.concat(F.lit("R"), F.col("n_regionkey")).alias("parent"))
    orders = table("orders")
    lists = orders.select(F.concat(F.lit("vip-"), F.col("o_orderpriority").substr(1, 1)).alias("list_id"), F.lit("Encounter").alias("target_type"), F.col("o_orderkey").alias("target_id")).where("target_id % 100 = 0")
    texts = lambda t: table("documents").select(F.col("doc_id").alias("fhir_id"), "text") if t == "DocumentReference" else None
    return Dataset(spark, registry, resources, index, value_set, concepts, lists, texts)
