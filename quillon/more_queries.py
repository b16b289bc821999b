"""More of the query catalogue: JSON patients, stored indexes, totals and limits, patches, metadata, profiles."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import fhirpath as P
from .functions.bands import date_columns
from .operators import extract, log, metrics, page, patch, project, validate
from .plans.request import parse
from .queries import _HIGH, _LOG, _ORDERS, _query, _search, _shape, conversation_log, observation_log, observation_registry, profile, spread
from .registry import Registry
from .registry import SearchParam as S
from .sources import seed
from .sources.resources import log_dataset
from .sources.tables import table_dataset
from .sources.terminology import Terminology

# -- searches over the tables
_search("concept_below", "Patient", [("geo:below", "urn:geo|R2")], "SELECT c_custkey AS fhir_id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2")
_search("concept_above", "Patient", [("geo:above", "urn:geo|N3")], "SELECT c_custkey AS fhir_id FROM customer WHERE c_nationkey = 3")
_search(
    "has_two_targets",
    "Practitioner",
    "_has:Invoice:involves:ship=lt1995-01-10",
    "SELECT s_suppkey AS fhir_id FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-01-10'))",
)
_search("heuristic_string_token", "Encounter", "note=1-urg", _ORDERS + "lower(o_orderpriority) LIKE '1-urg%' OR o_orderstatus = '1-urg'")
_search("heuristic_token_code", "Encounter", "note=F", _ORDERS + "lower(o_orderpriority) LIKE 'f%' OR o_orderstatus = 'F'")
_search("heuristic_token", "Encounter", "note=urn:os|F", _ORDERS + "o_orderstatus = 'F'")
_search("heuristic_date", "Encounter", "note=1997-05", _ORDERS + f"o_orderdate >= TIMESTAMP '1997-05-01' AND {_HIGH} < TIMESTAMP '1997-06-01'")


@_query("capped_total", "SELECT least(count(*), 100) AS total FROM orders WHERE o_orderstatus = 'F'")
def capped_total(spark, sf_dir):
    return page.capped_total(table_dataset(spark, sf_dir), parse("Encounter", "status=F"), 100)


@_query("capped_total_not_reached", "SELECT count(*) AS total FROM orders WHERE o_orderkey IN (1, 5)")
def capped_total_not_reached(spark, sf_dir):
    return page.capped_total(table_dataset(spark, sf_dir), parse("Encounter", "_id=1,5"), 100)


@_query("reverse_includes", "SELECT * FROM (VALUES ('Medication', 'Invoice:involves,Invoice:product'), ('Practitioner', 'Invoice:involves,Invoice:performer'), ('Encounter', 'Invoice:encounter')) t(target, sources)")
def reverse_includes(spark, sf_dir):
    found = table_dataset(spark, sf_dir).registry.reverse_includes()
    return spark.createDataFrame([(t, ",".join(found[t])) for t in ("Medication", "Practitioner", "Encounter")], "target string, sources string")


# -- the version log
@_query("history_total", f"SELECT count(*) AS total FROM {_LOG} WHERE recorded > TIMESTAMP '2024-01-02'")
def history_total(spark, sf_dir):
    return log.history_total(conversation_log(spark, sf_dir), "Communication", "2024-01-02")


@_query("read_current", f"SELECT fhir_id, max(version_id) AS version_id FROM {_LOG} WHERE fhir_id = '10' GROUP BY ALL")
def read_current(spark, sf_dir):
    return log.read(conversation_log(spark, sf_dir), "Communication", "10").select("fhir_id", "version_id")


@_query("tenant_rows", f"SELECT count(*) FILTER (fhir_id::INTEGER % 2 = 0) AS even, 0::BIGINT AS nobody FROM {_LOG}")
def tenant_rows(spark, sf_dir):
    two = conversation_log(spark, sf_dir).withColumn("tenant_id", F.when(F.col("fhir_id").cast("int") % 2 == 0, "even").otherwise("odd"))
    one = lambda t: log.of_tenant(two, t).agg(F.count("*").alias(t))
    return one("even").crossJoin(one("nobody"))  # a row each


@_query("numbered_versions", f"SELECT fhir_id, version_id AS was, row_number() OVER (PARTITION BY fhir_id ORDER BY recorded)::INTEGER AS version_id FROM {_LOG}")
def numbered_versions(spark, sf_dir):
    writes = conversation_log(spark, sf_dir).withColumnRenamed("version_id", "was")
    return log.number_versions(writes).select("fhir_id", "was", "version_id")


@_query("meta_injected", f"SELECT fhir_id, version_id::VARCHAR AS version, strftime(recorded, '%Y-%m-%dT%H:%M:%SZ') AS updated, role FROM {_LOG}")
def meta_injected(spark, sf_dir):
    rows = log.with_meta(conversation_log(spark, sf_dir))
    at = lambda p: F.get_json_object("resource", p)
    return rows.select("fhir_id", at("$.meta.versionId").alias("version"), at("$.meta.lastUpdated").alias("updated"), at("$.role").alias("role"))


def _sender_registry() -> Registry:
    r = Registry()
    r.register(S("Communication", "sender", "token", "Communication.role"), S("Communication", "topic", "string", "Communication.text"))
    return r


_CURRENT = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fhir_id ORDER BY version_id DESC) AS r FROM {_LOG}) WHERE r = 1 AND NOT is_deleted)"


@_query("stored_index_after_update", f"SELECT fhir_id FROM {_CURRENT} WHERE role = 'user'")
def stored_index_after_update(spark, sf_dir):
    """Index rows of all versions, as a stream appends them, cut to those of current ones."""
    versions = conversation_log(spark, sf_dir)
    rows = extract.index_rows(versions.where("not is_deleted"), _sender_registry(), "Communication", "token")
    current = extract.current_rows(rows, log.latest(versions))
    return current.where("param_name = 'sender' and code = 'user'").select(F.col("resource_id").alias("fhir_id"))


@_query("row_counts", f"SELECT 'token' AS kind, 'sender' AS param_name, count(*) AS n FROM {_CURRENT} WHERE role IS NOT NULL UNION ALL SELECT 'string', 'topic', count(*) FROM {_CURRENT} WHERE text <> ''")
def row_counts(spark, sf_dir):
    return extract.row_counts(log.latest(conversation_log(spark, sf_dir)), _sender_registry(), "Communication")


@_query("text_on_log", "SELECT event_id::VARCHAR AS fhir_id FROM events WHERE event_type = 'click'")
def text_on_log(spark, sf_dir):
    """Words of string values, not of member names: every body has a member resourceType."""
    data = log_dataset(spark, observation_log(spark, sf_dir), observation_registry())
    return page.search(data, parse("Observation", "_text=click,resourcetype")).select("fhir_id")


# -- patients as JSON resources


def patient_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spread(spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("fhir_id", F.col("c_custkey").cast("string")), "fhir_id")
    key, nation = F.col("fhir_id"), F.col("c_nationkey").cast("string")
    coding = lambda system, code: F.struct(F.lit(system).alias("system"), code.alias("code"))
    body = F.struct(
        F.lit("Patient").alias("resourceType"),
        key.alias("id"),
        F.struct(F.array(coding("urn:segment", F.col("c_mktsegment"))).alias("tag"), F.array(F.concat(F.lit("urn:profile:"), F.col("c_custkey") % 3)).alias("profile"), F.concat(F.lit("urn:src:"), nation).alias("source")).alias("meta"),
        F.array(F.struct(F.struct(F.array(coding("urn:t", F.when(F.col("c_custkey") % 2 == 0, "MR").otherwise("DL"))).alias("coding")).alias("type"), F.lit("urn:id").alias("system"), key.alias("value"))).alias("identifier"),
        F.array(F.struct(F.col("c_name").alias("family"), F.struct(F.concat(F.lit("20"), F.lpad((F.col("c_custkey") % 20).cast("string"), 2, "0")).alias("start"), F.when(F.col("c_custkey") % 2 == 0, "2024-06").alias("end")).alias("period"))).alias("name"),
        F.struct(F.struct(F.lit("urn:nation").alias("system"), nation.alias("value")).alias("identifier")).alias("managingOrganization"),
        F.lit("<div>Patient</div>").alias("text"),
    )
    return c.select(F.lit("default").alias("tenant_id"), F.lit("Patient").alias("resource_type"), key, F.lit(1).alias("version_id"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("last_updated"), F.lit("POST").alias("operation"), F.lit(False).alias("is_deleted"), F.to_json(body).alias("resource"))


def patient_registry() -> Registry:
    r = Registry()
    r.register(S("Patient", "identifier", "token", "Patient.identifier"), S("Patient", "organization", "reference", "Patient.managingOrganization", ("Organization",)), S("Patient", "known", "date", "Patient.name.period"), S("Patient", "family", "string", "Patient.name.family"))
    return r


def _patients(name: str, query, sql: str) -> None:
    @_query(name, "SELECT c_custkey::VARCHAR AS fhir_id FROM customer WHERE " + sql)
    def run(spark, sf_dir):
        data = log_dataset(spark, patient_log(spark, sf_dir), patient_registry())
        return page.search(data, parse("Patient", query)).select("fhir_id")


_patients("of_type", [("identifier:of-type", "urn:t|MR|42")], "c_custkey = 42")
_patients("of_type_wrong", [("identifier:of-type", "urn:t|DL|42")], "false")
_patients("of_type_two_parts", [("identifier:of-type", "MR|42,DL|43")], "c_custkey IN (42, 43)")
_patients("ref_identifier", [("organization:identifier", "urn:nation|3")], "c_nationkey = 3")
_patients("ref_identifier_bare", [("organization:identifier", "4")], "c_nationkey = 4")
_patients("profile_uri", [("_profile", "urn:profile:1")], "c_custkey % 3 = 1")
_patients("period_overlap", [("known", "ge2024-06-30")], "c_custkey % 2 = 0 OR TRUE")
_patients("period_before", [("known", "eb2024-07")], "c_custkey % 2 = 0")


def _patient_rows(name: str, kind: str, params: tuple[str, ...], columns: list[str], sql: str) -> None:
    @_query(name, sql)
    def run(spark, sf_dir):
        rows = extract.index_rows(patient_log(spark, sf_dir), patient_registry(), "Patient", kind)
        return rows.where(F.col("param_name").isin(*params)).select("resource_id", "param_name", *columns)


_OWN = "SELECT c_custkey::VARCHAR AS resource_id"
_patient_rows("index_of_type", "token", ("identifier:of-type",), ["system", "code"], f"{_OWN}, 'identifier:of-type' AS param_name, CASE WHEN c_custkey % 2 = 0 THEN 'urn:t|MR' ELSE 'urn:t|DL' END AS system, c_custkey::VARCHAR AS code FROM customer")
_patient_rows("index_uri", "uri", ("_profile", "_source"), ["value"], f"{_OWN}, '_profile' AS param_name, 'urn:profile:' || (c_custkey % 3) AS value FROM customer UNION ALL {_OWN}, '_source', 'urn:src:' || c_nationkey FROM customer")
_patient_rows("index_meta", "token", ("_tag",), ["system", "code"], f"{_OWN}, '_tag' AS param_name, 'urn:segment' AS system, c_mktsegment AS code FROM customer")
_patient_rows("index_period", "date", ("known",), ["value_low"], f"{_OWN}, 'known' AS param_name, make_timestamp(2000 + c_custkey % 20, 1, 1, 0, 0, 0) AS value_low FROM customer")


@_query("meta_profiles", "SELECT DISTINCT 'urn:profile:' || (c_custkey % 3) AS value FROM customer")
def meta_profiles(spark, sf_dir):
    from .operators import graph

    data = log_dataset(spark, patient_log(spark, sf_dir), patient_registry())
    return graph.meta(data, "Patient").where("kind = 'profile'").select(F.col("code").alias("value"))


# -- projections, patches and metadata of bodies
@_query("summary_data", "SELECT event_id::VARCHAR AS fhir_id, CASE WHEN event_id % 10 = 0 THEN '' ELSE 'status,' END AS status, 'SUBSETTED' AS tag FROM events")
def summary_data(spark, sf_dir):
    shape = _shape(observation_log(spark, sf_dir), project.summary(F.col("resource"), "data", "Observation"))
    # through the generator, as the optimiser puts a filter on bodies before the rows are dealt, and then one task makes them all
    kept = shape.select("fhir_id", F.explode_outer(F.array(F.struct("names", "tag"))).alias("s")).where("s.names not like '%text%'")
    return kept.select("fhir_id", F.when(F.col("s.names").contains("status"), "status,").otherwise("").alias("status"), "s.tag")


@_query("meta_added", "SELECT c_custkey::VARCHAR AS fhir_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 2 END::INTEGER AS n_tags, 'urn:profile:new' AS last_profile, c_name AS family FROM customer")
def meta_added(spark, sf_dir):
    body = project.change_meta(F.col("resource"), {"tag": [{"system": "urn:segment", "code": "BUILDING"}], "profile": ["urn:profile:new"]})
    return _meta_of(patient_log(spark, sf_dir), body)


@_query("meta_deleted", "SELECT c_custkey::VARCHAR AS fhir_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END::INTEGER AS n_tags, CASE WHEN c_custkey % 3 <> 1 THEN 'urn:profile:' || (c_custkey % 3) END AS last_profile, c_name AS family FROM customer")
def meta_deleted(spark, sf_dir):
    body = project.change_meta(F.col("resource"), delete={"tag": [{"system": "urn:segment", "code": "BUILDING"}], "profile": ["urn:profile:1"]})
    return _meta_of(patient_log(spark, sf_dir), body)


def _meta_of(rows: DataFrame, body) -> DataFrame:
    rows = rows.select("fhir_id", F.parse_json(body).alias("b"))
    items = lambda p, t: F.coalesce(F.try_variant_get("b", p, f"array<{t}>"), F.array().cast(f"array<{t}>"))
    return rows.select("fhir_id", F.size(items("$.meta.tag", "variant")).alias("n_tags"), F.try_element_at(items("$.meta.profile", "string"), F.lit(-1)).alias("last_profile"), F.try_variant_get("b", "$.name[0].family", "string").alias("family"))


_FHIR_PATCH = {
    "resourceType": "Parameters",
    "parameter": [
        {"name": "operation", "part": [{"name": "type", "valueCode": "replace"}, {"name": "path", "valueString": "Patient.name[0].family"}, {"name": "value", "valueString": "Doe"}]},
        {"name": "operation", "part": [{"name": "type", "valueCode": "add"}, {"name": "path", "valueString": "Patient"}, {"name": "name", "valueString": "gender"}, {"name": "value", "valueCode": "other"}]},
        {"name": "operation", "part": [{"name": "type", "valueCode": "delete"}, {"name": "path", "valueString": "Patient.text"}]},
    ],
}
_PATCHED = "SELECT c_custkey::VARCHAR AS fhir_id, 'Doe' AS family, 'other' AS gender, NULL::VARCHAR AS text FROM customer"


def _patched(spark, sf_dir, text: str, kind: str) -> DataFrame:
    rows = patient_log(spark, sf_dir).select("fhir_id", patch.patched(F.col("resource"), F.lit(text), kind).alias("p"))
    at = lambda p: F.get_json_object("p.resource", p)
    return rows.select("fhir_id", at("$.name[0].family").alias("family"), at("$.gender").alias("gender"), at("$.text").alias("text"))


@_query("patch_fhir", _PATCHED)
def patch_fhir(spark, sf_dir):
    return _patched(spark, sf_dir, json.dumps(_FHIR_PATCH), "fhir")


@_query("patch_xml", _PATCHED)
def patch_xml(spark, sf_dir):
    text = '<diff xmlns="http://hl7.org/fhir"><replace sel="Patient/name[1]/family"><family value="Doe"/></replace><add sel="Patient"><gender value="other"/></add><remove sel="Patient/text"/></diff>'
    return _patched(spark, sf_dir, text, "xml")


@_query("fhirpath_residuals", "SELECT event_id::VARCHAR AS fhir_id, event_type AS first_code, 'unit' AS unit FROM events")
def fhirpath_residuals(spark, sf_dir):
    """An index that is passed over, exists() as identity in a path, and a type test behind a choice."""
    body = F.parse_json("resource")
    text = lambda e: F.transform(P.evaluate(e, body), P.text_of)
    return observation_log(spark, sf_dir).select("fhir_id", F.try_element_at(text("Observation.code.coding[0].code"), F.lit(1)).alias("first_code"), F.try_element_at(text("(Observation.value as Quantity).code"), F.lit(1)).alias("unit"))


# -- profiles and definitions
_RULES = {
    "resourceType": "StructureDefinition",
    "type": "Patient",
    "snapshot": {
        "element": [
            {"path": "Patient"},
            {"path": "Patient.managingOrganization.identifier.system", "fixedUri": "urn:nation"},
            {"path": "Patient.identifier.system", "fixedUri": "urn:other"},
            {"path": "Patient.text", "max": "0"},
            {"path": "Patient.identifier", "id": "Patient.identifier:mr", "sliceName": "mr", "min": 1, "patternIdentifier": {"type": {"coding": [{"code": "MR"}]}}},
        ]
    },
}


@_query(
    "validate_rules",
    "SELECT c_custkey::VARCHAR AS fhir_id, code, expression FROM customer, (VALUES ('value', 'Patient.identifier.system'), ('structure', 'Patient.text')) t(code, expression)"
    " UNION ALL SELECT c_custkey::VARCHAR, 'required', 'Patient.identifier:mr' FROM customer WHERE c_custkey % 2 = 1",
)
def validate_rules(spark, sf_dir):
    """fixed[x], max = 0 and a slice."""
    return validate.validate(patient_log(spark, sf_dir), validate.compile_profile(_RULES)).select("fhir_id", "code", "expression")


@_query("validate_instance", "SELECT code, expression FROM (VALUES ('value', 'Patient.identifier.system'), ('structure', 'Patient.text'), ('required', 'Patient.identifier:mr')) t(code, expression)")
def validate_instance(spark, sf_dir):
    return validate.validate_instance(patient_log(spark, sf_dir), "Patient", "7", validate.compile_profile(_RULES)).select("code", "expression")


@_query(
    "validate_system",
    "SELECT 'Patient' AS resource_type, 'required' AS code, count(*) AS n FROM customer WHERE c_custkey % 2 = 1 HAVING count(*) > 0"
    " UNION ALL SELECT 'Observation', 'invariant', count(*) FROM events WHERE value > 400 HAVING count(*) > 0",
)
def validate_system(spark, sf_dir):
    both = patient_log(spark, sf_dir).unionByName(observation_log(spark, sf_dir))
    rules = {"Patient": [validate.compile_profile(_RULES)], "Observation": [validate.compile_profile(profile())]}
    found = validate.validate_system(both, rules).where("code = 'invariant' or expression = 'Patient.identifier:mr'")
    return found.groupBy("resource_type", "code").agg(F.count("*").alias("n"))


@_query("terminology_filter", "SELECT 'urn:geo' AS system, 'N' || n_nationkey AS code FROM nation WHERE contains(lower(n_name), 'ion_1')")
def terminology_filter(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    rows = n.select(F.lit("urn:vs:nations").alias("url"), F.lit("urn:geo").alias("system"), F.concat(F.lit("N"), "n_nationkey").alias("code"), F.col("n_name").alias("display"))
    return Terminology(lambda: rows).matching("urn:vs:nations", "Ion_1").select("system", "code")


def _definitions(spark: SparkSession) -> DataFrame:
    base = {"resourceType": "StructureDefinition", "kind": "resource", "derivation": "specialization", "url": "urn:base:Basket", "type": "Basket", "snapshot": {"element": [{"path": "Basket"}, {"path": "Basket.code", "isSummary": True}, {"path": "Basket.when[x]", "isSummary": True}, {"path": "Basket.note"}, {"path": "Basket.code.text", "isSummary": True}]}}
    rows = [("urn:base:Basket", "Basket", json.dumps(base))] + [(f"urn:p:{k}", t, json.dumps({"derivation": "constraint"})) for k, t in enumerate(("Basket", "Basket", "Patient"))]
    return spark.createDataFrame(rows, "url string, type string, definition string")


@_query("profiles_by_type", "SELECT * FROM (VALUES ('Basket', 'urn:p:0,urn:p:1'), ('Patient', 'urn:p:2')) t(type, profiles)")
def profiles_by_type(spark, sf_dir):
    return seed.profiles_by_type(_definitions(spark)).select("type", F.array_join("profiles", ",").alias("profiles"))


@_query("summary_elements", "SELECT 'Basket' AS type, 'code,when' AS names")
def summary_elements(spark, sf_dir):
    found = seed.summary_elements(_definitions(spark).where("url like 'urn:base%'"))
    return found.select("type", F.array_join("names", ",").alias("names"))


# -- times, metrics, streams
@_query("utc_offsets", "SELECT event_id AS fhir_id, date_trunc('second', ts) - INTERVAL 2 HOUR AS low FROM events")
def utc_offsets(spark, sf_dir):
    low, _ = date_columns(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+02:00'"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("fhir_id"), low.alias("low"))


@_query("request_metrics", "SELECT 'GET' AS method, '/Observation/{id}' AS path, event_type AS status, count(*) AS n, count(*) FILTER (value / 100 <= 0.1) AS fast FROM events GROUP BY event_type")
def request_metrics(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    requests = e.select(F.lit("GET").alias("method"), F.concat(F.lit("/Observation/"), "event_id").alias("path"), F.col("event_type").alias("status"), (F.col("value") / 100).alias("seconds"))
    return metrics.request_counts(requests).select("method", "path", "status", "n", F.col("`le_0.1`").alias("fast"))


@_query(
    "stream_sessions",
    """WITH s AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
 g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM s)
 SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, g""",
)
def stream_sessions(spark, sf_dir):
    """The streaming session count, over a bounded read of the same source."""
    from .streaming.increments import session_counts

    found = session_counts(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", "user_id", "6 hours")
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")

