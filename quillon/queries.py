"""The query catalogue: a Spark callable for each operator, and SQL over the base tables for most."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import fhirpath as P
from .functions.bands import date_columns
from .operators import graph, log, page, patch, project, validate
from .plans.request import parse
from .sources import codecs
from .sources.tables import table_dataset

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def put(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


def _search(name: str, resource_type: str, query, sql: str) -> None:
    """A search for all matching ids."""
    _QUERIES[name] = lambda spark, sf_dir: page.search(table_dataset(spark, sf_dir), parse(resource_type, query)).select("fhir_id")
    _SQL[name] = sql


_ORDERS = "SELECT o_orderkey AS fhir_id FROM orders WHERE "
_EVENTS = "SELECT event_id AS fhir_id FROM events WHERE "
_PARTS = "SELECT p_partkey AS fhir_id FROM part WHERE "
_LINES = "SELECT DISTINCT l_orderkey AS fhir_id FROM lineitem WHERE "
_PAGES = "SELECT page_id AS fhir_id FROM pages WHERE "
_DOCS = "SELECT doc_id AS fhir_id FROM documents WHERE "

# -- tokens
_search("token_code", "Encounter", "status=F", _ORDERS + "o_orderstatus = 'F'")
_search("token_sys_code", "Encounter", "status=urn:os|F", _ORDERS + "o_orderstatus = 'F'")
_search("token_sys_only", "Encounter", "status=urn:os|", _ORDERS + "true")
_search("token_pipe_code", "Encounter", "status=|O", _ORDERS + "o_orderstatus = 'O'")
_search("token_or", "Observation", "code=click,error", _EVENTS + "event_type IN ('click', 'error')")
_search("token_not", "Encounter", "status:not=F", _ORDERS + "o_orderstatus <> 'F'")
_search("token_text", "Encounter", "priority:text=urgent", _ORDERS + "lower(o_orderpriority) LIKE '%urgent%'")
_search("token_in", "Observation", "code:in=urn:vs:active", _EVENTS + "event_type IN ('click', 'view')")
_search("token_not_in", "Observation", "code:not-in=urn:vs:active", _EVENTS + "event_type NOT IN ('click', 'view')")
_search("missing_true", "DocumentReference", "_tag:missing=true", _DOCS + "doc_id NOT IN (SELECT doc_id FROM labels)")
_search("missing_false", "DocumentReference", "_tag:missing=false", _DOCS + "doc_id IN (SELECT doc_id FROM labels)")
_search("universal_tag", "DocumentReference", "_tag=urn:quality|0", "SELECT doc_id AS fhir_id FROM labels WHERE quality = 0 AND doc_id IN (SELECT doc_id FROM documents)")
_search("universal_language", "DocumentReference", "_language=fr,de", _DOCS + "lang IN ('fr', 'de')")
_search("universal_source", "DocumentReference", "_source:below=src1", _DOCS + "starts_with(source, 'src1')")
_search("multi_not", "Invoice", "code:not=R", "SELECT DISTINCT l_orderkey AS fhir_id FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
# -- strings
_search("string_prefix", "Medication", "name=small", _PARTS + "lower(p_name) LIKE 'small%'")
_search("string_contains", "Medication", "name:contains=ring", _PARTS + "lower(p_name) LIKE '%ring%'")
_search("string_exact", "Medication", [("name:exact", "small ring")], _PARTS + "p_name = 'small ring'")
_search("text_words", "DocumentReference", "_text=the that", _DOCS + r"list_contains(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), 'the') AND list_contains(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), 'that')")
# -- dates: a day's band is [midnight, last second]
_LOW, _END = "TIMESTAMP '1997-05-01'", "TIMESTAMP '1997-06-01'"
_HIGH = "o_orderdate + INTERVAL 1 DAY - INTERVAL 1 SECOND"
for _p, _test in {
    "eq": f"o_orderdate >= {_LOW} AND {_HIGH} < {_END}",
    "ne": f"NOT (o_orderdate >= {_LOW} AND {_HIGH} < {_END})",
    "ge": f"{_HIGH} >= {_LOW}",
    "gt": f"{_HIGH} >= {_END}",
    "eb": f"{_HIGH} < {_LOW}",
    "le": f"o_orderdate < {_END}",
    "lt": f"o_orderdate < {_LOW}",
    "sa": f"o_orderdate >= {_END}",
    "ap": f"o_orderdate < {_END} AND {_HIGH} >= {_LOW}",
}.items():
    _search(f"date_{_p}", "Encounter", f"date={_p}1997-05", _ORDERS + _test)
_search("date_gt_day", "Encounter", "date=gt2001-07-01", _ORDERS + f"{_HIGH} >= TIMESTAMP '2001-07-02'")
_search("instant_eq_day", "Observation", "date=2024-01-10", _EVENTS + "ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'")
_search("last_updated", "Observation", "_lastUpdated=ge2024-01-20", _EVENTS + "ts >= TIMESTAMP '2024-01-20'")
# -- numbers and quantities
_band = lambda c, f: f"round({c} - abs({c}) * 1e-7, 6) <= {f + (abs(f) * 1e-7 or 1e-7)} AND round({c} + abs({c}) * 1e-7, 6) >= {f - (abs(f) * 1e-7 or 1e-7)}"
_search("number_eq", "Medication", "size=10", _PARTS + "p_size = 10")
_search("number_ne", "Medication", "size=ne10", _PARTS + "p_size <> 10")
_search("number_gt", "Medication", "size=gt45", _PARTS + "p_size > 45")
_search("number_range", "Medication", "size=ge10&size=lt20", _PARTS + "p_size >= 10 AND p_size < 20")
_search("qty_gt", "Observation", "value-quantity=gt400", _EVENTS + "round(value + abs(value) * 1e-7, 6) > 400.00004")
_search("qty_eq", "Observation", "value-quantity=6.55", _EVENTS + _band("value", 6.55))
_search("qty_unit", "Observation", "value-quantity=gt10|urn:u|unit", _EVENTS + "round(value + abs(value) * 1e-7, 6) > 10.000001")
_search("qty_other_unit", "Observation", "value-quantity=gt10|urn:u|other", _EVENTS + "false")
_search("qty_negative", "Patient", "balance=lt-100", "SELECT c_custkey AS fhir_id FROM customer WHERE round(c_acctbal - abs(c_acctbal) * 1e-7, 6) < -100.00001")
_search("multi_ne", "Invoice", "quantity=ne10", _LINES + "NOT (" + _band("l_quantity", 10.0) + ")")
# -- composites
_search("composite_tq", "Observation", "code-value-quantity=click$gt100", _EVENTS + "event_type = 'click' AND round(value + abs(value) * 1e-7, 6) > 100.00001")
_search("composite_same_element", "Invoice", "line-code-quantity=R$gt45", _LINES + "l_returnflag = 'R' AND l_quantity > 45.00001")
_search("composite_cross", "Invoice", "code=R&quantity=gt45", "SELECT DISTINCT l_orderkey AS fhir_id FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45.00001)")
_search("composite_token_token", "Invoice", "code-status=R$F", "SELECT DISTINCT l_orderkey AS fhir_id FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')")
# -- uris
_search("uri_exact", "Endpoint", [("url", "http://ththre.example.com/fr/825?page=2&ref=x")], _PAGES + "url = 'http://ththre.example.com/fr/825?page=2&ref=x'")
_search("uri_below", "Endpoint", "url:below=http://", _PAGES + "starts_with(url, 'http://')")
_search("uri_above", "Endpoint", [("url:above", "https://thther.example.org/en/685/more/below")], _PAGES + "starts_with('https://thther.example.org/en/685/more/below', url)")
# -- references
_search("ref_typed", "Encounter", "subject=Patient/7", _ORDERS + "o_custkey = 7")
_search("ref_bare", "Encounter", "subject=7", _ORDERS + "o_custkey = 7")
_search("ref_modifier", "Encounter", "subject:Patient=7", _ORDERS + "o_custkey = 7")
_search("ref_multi", "Encounter", "subject=Patient/7,Patient/9", _ORDERS + "o_custkey IN (7, 9)")
_search("ref_multivalued", "Invoice", "performer=Practitioner/7", _LINES + "l_suppkey = 7")
_search("chain_1", "Encounter", "subject:Patient.segment=BUILDING", "SELECT o_orderkey AS fhir_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
_search("chain_3", "Encounter", "subject.organization.partof.name=ASIA", "SELECT o_orderkey AS fhir_id FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE lower(r_name) LIKE 'asia%'")
_search("has", "Patient", "_has:Encounter:subject:status=F", "SELECT c_custkey AS fhir_id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
_search("has_and_not", "Patient", "_has:Encounter:subject:priority=1-URGENT&segment:not=BUILDING", "SELECT c_custkey AS fhir_id FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
# -- ids, lists, filters
_search("id_list", "Encounter", "_id=1,5,99,100000000", _ORDERS + "o_orderkey IN (1, 5, 99)")
_search("list_param", "Encounter", "_list=vip-1,vip-2", _ORDERS + "o_orderkey % 100 = 0 AND substr(o_orderpriority, 1, 1) IN ('1', '2')")
_search("filter_and", "Encounter", [("_filter", "status eq F and priority eq 1-URGENT")], _ORDERS + "o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
_search("filter_or", "Encounter", [("_filter", "status eq F or priority eq 1-URGENT")], _ORDERS + "o_orderstatus = 'F' OR o_orderpriority = '1-URGENT'")
_search("filter_ne", "Encounter", [("_filter", "status ne F")], _ORDERS + "o_orderstatus <> 'F'")
_search("filter_nested", "Encounter", [("_filter", '(status eq F or status eq O) and not (priority eq "1-URGENT") and date ge 1997')], _ORDERS + f"o_orderstatus IN ('F', 'O') AND o_orderpriority <> '1-URGENT' AND {_HIGH} >= TIMESTAMP '1997-01-01'")
_search("filter_string", "Medication", [("_filter", "name sw small or name co ring or name ew bolt")], _PARTS + "lower(p_name) LIKE 'small%' OR lower(p_name) LIKE '%ring%' OR lower(p_name) LIKE '%bolt'")
_search("filter_present", "DocumentReference", [("_filter", "_tag pr true")], _DOCS + "doc_id IN (SELECT doc_id FROM labels)")
_search("and_multi", "Encounter", "status=F&date=ge1997&subject:Patient.segment=BUILDING", f"SELECT o_orderkey AS fhir_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND {_HIGH} >= TIMESTAMP '1997-01-01' AND c_mktsegment = 'BUILDING'")
_search("heuristic_unknown", "Encounter", "nothing=abc", _ORDERS + "false")


@_query("anti_no_invoice", "SELECT o_orderkey AS fhir_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def anti_no_invoice(spark, sf_dir):
    data = table_dataset(spark, sf_dir)
    edges = data.index("Invoice", data.registry.get("Invoice", "encounter"))
    rows = data.resources("Encounter")
    return rows.join(edges, rows["fhir_id"] == edges["target_id"], "left_anti").select("fhir_id")


# -- sorting, paging, totals, includes


def _page(name: str, resource_type: str, query: str, sql: str) -> None:
    _QUERIES[name] = lambda spark, sf_dir: page.ordered_page(table_dataset(spark, sf_dir), parse(resource_type, query)).select("fhir_id", F.col("position").cast("long").alias("position"))
    _SQL[name] = f"SELECT fhir_id, row_number() OVER (ORDER BY p) - 1 AS position FROM ({sql})"


_page("sort_page", "Encounter", "_sort=-date,_id&_count=20&_page=2", "SELECT o_orderkey AS fhir_id, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS p FROM orders QUALIFY p BETWEEN 21 AND 40")
_page("sort_default", "Observation", "code=click&_count=10", "SELECT event_id AS fhir_id, row_number() OVER (ORDER BY ts DESC, event_id) AS p FROM events WHERE event_type = 'click' QUALIFY p <= 10")
_page("sort_min", "Invoice", "_sort=ship&_count=30", "SELECT l_orderkey AS fhir_id, row_number() OVER (ORDER BY min(l_shipdate), l_orderkey) AS p FROM lineitem GROUP BY l_orderkey QUALIFY p <= 30")
_page("sort_max", "Invoice", "_sort=-ship&_count=30", "SELECT l_orderkey AS fhir_id, row_number() OVER (ORDER BY max(l_shipdate) DESC, l_orderkey) AS p FROM lineitem GROUP BY l_orderkey QUALIFY p <= 30")
_page("sort_nulls_last", "DocumentReference", "_sort=_tag,-_id&_count=500", "SELECT d.doc_id AS fhir_id, row_number() OVER (ORDER BY quality NULLS LAST, d.doc_id DESC) AS p FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id QUALIFY p <= 500")


@_query("page_bodies", "SELECT o_orderkey AS fhir_id, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS p FROM orders WHERE o_orderstatus = 'F') WHERE p <= 20")
def page_bodies(spark, sf_dir):
    return page.page(table_dataset(spark, sf_dir), parse("Encounter", "status=F&_sort=-date&_count=20")).select("fhir_id", "o_totalprice")


@_query("total", "SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'F'")
def total(spark, sf_dir):
    return page.total(table_dataset(spark, sf_dir), parse("Encounter", "status=F"))


_TOP = f"SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS p FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND {_HIGH} >= TIMESTAMP '1997-01-01' AND c_mktsegment = 'BUILDING' QUALIFY p <= 20"


@_query(
    "flagship",
    f"WITH top AS ({_TOP}) SELECT 'Encounter' AS resource_type, o_orderkey::VARCHAR AS fhir_id, 'match' AS mode FROM top UNION SELECT 'Patient', o_custkey::VARCHAR, 'include' FROM top",
)
def flagship(spark, sf_dir):
    """A chained search, sorted and paged, with its included subjects."""
    query = "status=F&date=ge1997&subject:Patient.segment=BUILDING&_sort=-date&_count=20&_include=Encounter:subject"
    return page.bundle(table_dataset(spark, sf_dir), parse("Encounter", query))


@_query("include_all", "SELECT DISTINCT 'Patient' AS resource_type, o_custkey::VARCHAR AS fhir_id FROM orders WHERE o_orderstatus = 'P'")
def include_all(spark, sf_dir):
    data = table_dataset(spark, sf_dir)
    return page.forward(data, page.search(data, parse("Encounter", "status=P")), "Encounter")


@_query("revinclude_all", "SELECT DISTINCT 'Encounter' AS resource_type, o_orderkey::VARCHAR AS fhir_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def revinclude_all(spark, sf_dir):
    data = table_dataset(spark, sf_dir)
    return page.backward(data, page.search(data, parse("Patient", "segment=BUILDING")), "Patient", "Encounter:subject")


# -- graph operations
_EVERYTHING = """SELECT 'Patient' AS resource_type, c_custkey::VARCHAR AS fhir_id FROM customer{0}
 UNION SELECT 'Organization', c_nationkey::VARCHAR FROM customer{0}
 UNION SELECT 'Encounter', o_orderkey::VARCHAR FROM orders JOIN customer ON o_custkey = c_custkey{0}
 UNION SELECT 'Observation', event_id::VARCHAR FROM events JOIN customer ON user_id = c_custkey{0}"""


@_query("everything", _EVERYTHING.format(" WHERE c_custkey = 7"))
def everything(spark, sf_dir):
    return graph.everything(table_dataset(spark, sf_dir), "Patient", [7])


@_query("everything_type", _EVERYTHING.format(""))
def everything_type(spark, sf_dir):
    return graph.everything(table_dataset(spark, sf_dir), "Patient")


@_query("everything_since", "SELECT 'Observation' AS resource_type, event_id::VARCHAR AS fhir_id FROM events WHERE user_id = 7 AND ts > TIMESTAMP '2024-01-15 23:59:59'")
def everything_since(spark, sf_dir):
    return graph.everything(table_dataset(spark, sf_dir), "Patient", [7], since="2024-01-15", types=("Observation,Patient",))


@_query(
    "document",
    """SELECT 'Encounter' AS resource_type, o_orderkey::VARCHAR AS fhir_id, 0 AS depth FROM orders WHERE o_orderkey IN (1, 2, 3)
 UNION SELECT 'Patient', o_custkey::VARCHAR, 1 FROM orders WHERE o_orderkey IN (1, 2, 3)
 UNION SELECT 'Organization', c_nationkey::VARCHAR, 2 FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey IN (1, 2, 3)
 UNION SELECT 'Location', n_regionkey::VARCHAR, 3 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey IN (1, 2, 3)""",
)
def document(spark, sf_dir):
    return graph.document(table_dataset(spark, sf_dir), "Encounter", [1, 2, 3])


@_query("lastn", "SELECT event_id AS fhir_id, rank::INTEGER AS rank FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS rank FROM events) WHERE rank <= 2")
def lastn(spark, sf_dir):
    return graph.last_n(table_dataset(spark, sf_dir), parse("Observation"), 2)


@_query("lastn_filtered", "SELECT event_id AS fhir_id, rank::INTEGER AS rank FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS rank FROM events WHERE user_id = 7) WHERE rank <= 1")
def lastn_filtered(spark, sf_dir):
    return graph.last_n(table_dataset(spark, sf_dir), parse("Observation", "subject=Patient/7"), 1)


@_query("meta_type", "SELECT DISTINCT 'language' AS kind, 'urn:ietf:bcp:47' AS system, lang AS code FROM documents UNION SELECT DISTINCT 'tag', 'urn:quality', quality::VARCHAR FROM labels UNION SELECT DISTINCT 'security', 'urn:toxic', toxic::VARCHAR FROM labels")
def meta_type(spark, sf_dir):
    return graph.meta(table_dataset(spark, sf_dir), "DocumentReference")


@_query("compartment", "SELECT o_orderkey AS fhir_id FROM orders WHERE o_custkey = 7 AND o_orderstatus <> 'P'")
def compartment(spark, sf_dir):
    return graph.compartment(table_dataset(spark, sf_dir), "Patient", 7, "Encounter", parse("Encounter", "status:not=P")).select("fhir_id")


# -- the version log: conversations as versions of their thread


def conversation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    body = F.to_json(F.struct(F.lit("Communication").alias("resourceType"), F.col("conv_id").cast("string").alias("id"), "role", "text"))
    at = F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(conv_id * 60 + turn as int))")
    return turns.select(
        F.lit("default").alias("tenant_id"),
        F.lit("Communication").alias("resource_type"),
        F.col("conv_id").cast("string").alias("fhir_id"),
        (F.col("turn") + 1).cast("int").alias("version_id"),
        at.alias("last_updated"),
        F.when(F.col("turn") == 0, "POST").when((F.col("turn") == 4) & (F.col("role") == "user"), "DELETE").otherwise("PUT").alias("operation"),
        ((F.col("turn") == 4) & (F.col("role") == "user")).alias("is_deleted"),
        body.alias("resource"),
    )


_LOG = "(SELECT conv_id::VARCHAR AS fhir_id, (turn + 1)::INTEGER AS version_id, role, text, turn = 4 AND role = 'user' AS is_deleted, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * (conv_id * 60 + turn) AS recorded FROM conversations)"


@_query("current_versions", f"SELECT fhir_id, version_id FROM (SELECT *, row_number() OVER (PARTITION BY fhir_id ORDER BY version_id DESC) AS r FROM {_LOG}) WHERE r = 1 AND NOT is_deleted")
def current_versions(spark, sf_dir):
    return log.latest(conversation_log(spark, sf_dir)).select("fhir_id", "version_id")


@_query("soft_deleted", f"SELECT fhir_id, version_id FROM (SELECT *, row_number() OVER (PARTITION BY fhir_id ORDER BY version_id DESC) AS r FROM {_LOG}) WHERE r = 1 AND is_deleted")
def soft_deleted(spark, sf_dir):
    return log.latest(conversation_log(spark, sf_dir), True).where("is_deleted").select("fhir_id", "version_id")


@_query("history_instance", f"SELECT version_id FROM {_LOG} WHERE fhir_id = '3'")
def history_instance(spark, sf_dir):
    return log.instance_history(conversation_log(spark, sf_dir), "Communication", "3").select("version_id")


@_query("vread", f"SELECT fhir_id, version_id, text FROM {_LOG} WHERE fhir_id = '3' AND version_id = 2")
def vread(spark, sf_dir):
    found = log.version(conversation_log(spark, sf_dir), "Communication", "3", 2)
    return found.select("fhir_id", "version_id", F.get_json_object("resource", "$.text").alias("text"))


@_query("history_since", f"SELECT fhir_id, version_id FROM {_LOG} WHERE recorded > TIMESTAMP '2024-01-02'")
def history_since(spark, sf_dir):
    return log.history(conversation_log(spark, sf_dir), "Communication", since="2024-01-02").select("fhir_id", "version_id")


@_query("history_page", f"SELECT fhir_id, version_id FROM {_LOG} ORDER BY recorded DESC, fhir_id, version_id DESC LIMIT 15 OFFSET 15")
def history_page(spark, sf_dir):
    return log.history(conversation_log(spark, sf_dir), None, None, 15, 2).select("fhir_id", "version_id")


@_query(
    "bulk_writes",
    f"""WITH now AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fhir_id ORDER BY version_id DESC) AS r FROM {_LOG}) WHERE r = 1),
 w AS (SELECT c_custkey::VARCHAR AS fhir_id, c_custkey % 4 AS k FROM customer)
 SELECT w.fhir_id, CASE k WHEN 0 THEN CASE WHEN now.fhir_id IS NULL THEN 'created' ELSE 'conflict' END WHEN 1 THEN CASE WHEN now.fhir_id IS NULL THEN 'created' ELSE 'updated' END
  WHEN 2 THEN CASE WHEN now.fhir_id IS NULL THEN 'not_found' WHEN now.is_deleted THEN 'unchanged' ELSE 'deleted' END
  ELSE CASE WHEN now.fhir_id IS NULL THEN 'not_found' WHEN now.version_id <> 6 THEN 'conflict' ELSE 'updated' END END AS outcome,
 CASE WHEN k = 0 AND now.fhir_id IS NULL OR k = 1 OR k = 2 AND now.fhir_id IS NOT NULL AND NOT now.is_deleted OR k = 3 AND now.version_id = 6 THEN coalesce(now.version_id, 0) + 1 END::INTEGER AS version_id
 FROM w LEFT JOIN now ON w.fhir_id = now.fhir_id""",
)
def bulk_writes(spark, sf_dir):
    from datetime import datetime

    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    kind = F.col("c_custkey") % 4
    writes = customers.select(
        F.lit("default").alias("tenant_id"),
        F.lit("Communication").alias("resource_type"),
        F.col("c_custkey").cast("string").alias("fhir_id"),
        F.when(kind == 0, "POST").when(kind == 2, "DELETE").otherwise("PUT").alias("operation"),
        F.lit("{}").alias("resource"),
        F.when(kind == 3, 6).cast("int").alias("if_match"),
    )
    return log.apply_writes(conversation_log(spark, sf_dir), writes, datetime(2025, 1, 1)).select("fhir_id", "outcome", "version_id")


# -- extraction, FHIRPath, validation, projection, patches, codecs over JSON resources


#: The most rows of a table that a task turns into resources, about: a row costs up to some 0.2 ms.
ROWS_A_TASK = 100_000


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a table dealt by their key, as what follows costs a parse a row.

    A scan gives no task less than a row group, and its other splits are empty, so
    their number says nothing: rows are counted, from the footers. Dealt by the id of the
    resource, the rows need no further exchange for the latest version of each.
    """
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_A_TASK))
    return rows.repartition(tasks, key)


def observation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as Observation resources in JSON."""
    e = spread(spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("fhir_id", F.col("event_id").cast("string")), "fhir_id")
    body = F.to_json(
        F.struct(
            F.lit("Observation").alias("resourceType"),
            F.col("fhir_id").alias("id"),
            F.when(F.col("event_id") % 10 == 0, F.lit(None)).otherwise("final").alias("status"),
            F.struct(F.array(F.struct(F.lit("urn:event").alias("system"), F.col("event_type").alias("code")), F.struct(F.lit("urn:all").alias("system"), F.lit("any").alias("code"))).alias("coding")).alias("code"),
            F.struct(F.concat(F.lit("Patient/"), "user_id").alias("reference")).alias("subject"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("effectiveDateTime"),
            F.struct("value", F.lit("urn:u").alias("system"), F.lit("unit").alias("code")).alias("valueQuantity"),
            F.array(F.struct(F.lit("urn:ext:k").alias("url"), F.get_json_object("props", "$.k").cast("int").alias("valueInteger"))).alias("extension"),
            F.lit("<div>text</div>").alias("text"),
        )
    )
    return e.select(F.lit("default").alias("tenant_id"), F.lit("Observation").alias("resource_type"), "fhir_id", F.lit(1).alias("version_id"), F.col("ts").alias("last_updated"), F.lit("POST").alias("operation"), F.lit(False).alias("is_deleted"), body.alias("resource"))


def observation_registry():
    from .registry import Registry
    from .registry import SearchParam as S

    r = Registry()
    r.register(
        S("Observation", "code", "token", "Observation.code"),
        S("Observation", "status", "token", "Observation.status"),
        S("Observation", "subject", "reference", "Observation.subject", ("Patient",)),
        S("Observation", "patient", "reference", "Observation.subject.where(resolve() is Patient)", ("Patient",)),
        S("Observation", "date", "date", "Observation.effective"),
        S("Observation", "value-quantity", "quantity", "Observation.value.ofType(Quantity)"),
        S("Observation", "k", "number", "Observation.extension('urn:ext:k').value.ofType(integer)"),
        S("Observation", "narrative", "string", "Observation.text"),
        S("Observation", "code-value-quantity", "composite", "", components=(("code", "token"), ("value.ofType(Quantity)", "quantity"))),
    )
    return r


def _index(kind: str, columns: list, sql: str) -> None:
    def run(spark, sf_dir):
        from .operators.extract import index_rows

        return index_rows(observation_log(spark, sf_dir), observation_registry(), "Observation", kind).select("resource_id", "param_name", *columns)

    _QUERIES[f"index_{kind}"], _SQL[f"index_{kind}"] = run, sql


_ID = "event_id::VARCHAR AS resource_id"
_dec = lambda x: f"CAST({x} AS DECIMAL(20,6))"
_index("token", ["system", "code"], f"SELECT {_ID}, 'code' AS param_name, 'urn:event' AS system, event_type AS code FROM events UNION ALL SELECT {_ID}, 'code', 'urn:all', 'any' FROM events UNION ALL SELECT {_ID}, 'status', NULL, 'final' FROM events WHERE event_id % 10 <> 0")
_index("string", ["value_exact", "value_lower"], f"SELECT {_ID}, 'narrative' AS param_name, '<div>text</div>' AS value_exact, '<div>text</div>' AS value_lower FROM events")
_index("date", ["value_low", "value_high"], f"SELECT {_ID}, 'date' AS param_name, date_trunc('second', ts) AS value_low, date_trunc('second', ts) AS value_high FROM events")
_index("number", ["value"], f"SELECT {_ID}, 'k' AS param_name, {_dec(chr(39).join(['json_extract(props, ', '$.k', ')::INTEGER']))} AS value FROM events")
_index("quantity", ["value", "system", "code"], f"SELECT {_ID}, 'value-quantity' AS param_name, {_dec('value')} AS value, 'urn:u' AS system, 'unit' AS code FROM events")
_index("reference", ["target_type", "target_id"], f"SELECT {_ID}, p AS param_name, 'Patient' AS target_type, user_id::VARCHAR AS target_id FROM events, (VALUES ('subject'), ('patient')) t(p)")
_index("composite", ["code", "value", "qty_code"], f"SELECT {_ID}, 'code-value-quantity' AS param_name, c AS code, {_dec('value')} AS value, 'unit' AS qty_code FROM (SELECT *, unnest([event_type, 'any']) AS c FROM events)")


@_query("json_search", "SELECT event_id::VARCHAR AS fhir_id FROM events WHERE event_type = 'click' AND round(value + abs(value) * 1e-7, 6) > 100.00001 AND event_id % 10 <> 0")
def json_search(spark, sf_dir):
    """The search engine over index rows that are extracted from JSON on the fly."""
    from .sources.resources import log_dataset

    data = log_dataset(spark, observation_log(spark, sf_dir), observation_registry())
    return page.search(data, parse("Observation", "code-value-quantity=urn:event|click$gt100&status=final")).select("fhir_id")


@_query("fhirpath_where", "SELECT event_id::VARCHAR AS fhir_id, event_type AS code FROM events")
def fhirpath_where(spark, sf_dir):
    items = P.evaluate("Observation.code.coding.where(system='urn:event').code", F.parse_json("resource"))
    return observation_log(spark, sf_dir).select("fhir_id", F.explode_outer(F.transform(items, P.text_of)).alias("code"))


@_query("fhirpath_extension_union", "SELECT event_id::VARCHAR AS fhir_id, json_extract_string(props, '$.k') AS v FROM events UNION ALL SELECT event_id::VARCHAR, 'final' FROM events WHERE event_id % 10 <> 0")
def fhirpath_extension_union(spark, sf_dir):
    items = P.evaluate("Observation.extension('urn:ext:k').value | Observation.status", F.parse_json("resource"))
    return observation_log(spark, sf_dir).select("fhir_id", F.explode_outer(F.transform(items, P.text_of)).alias("v"))


@_query("bool_invariants", "SELECT event_id::VARCHAR AS fhir_id, event_id % 10 <> 0 AS has_status, (event_type <> 'click' OR value > 50) AS click_is_large, event_id % 10 = 0 OR user_id >= 0 AS implied FROM events")
def bool_invariants(spark, sf_dir):
    body = F.col("body")
    rows = observation_log(spark, sf_dir).select("fhir_id", F.parse_json("resource").alias("body"))
    return rows.select(
        "fhir_id",
        P.check("status.exists() and code.coding.count() = 2", body).alias("has_status"),
        P.check("code.coding.where(code='click').empty() or value.value > 50", body).alias("click_is_large"),
        P.check("status.exists() implies subject.reference.startsWith('Patient/')", body).alias("implied"),
    )


def profile() -> dict:
    return {
        "resourceType": "StructureDefinition",
        "type": "Observation",
        "snapshot": {
            "element": [
                {"path": "Observation", "constraint": [{"key": "obs-x", "severity": "error", "expression": "value.value <= 400", "human": "no value over 400"}]},
                {"path": "Observation.status", "min": 1, "max": "1", "fixedCode": "final"},
                {"path": "Observation.code", "min": 1, "patternCodeableConcept": {"coding": [{"system": "urn:all", "code": "any"}]}},
                {"path": "Observation.bodySite", "max": "0"},
                {"path": "Observation.code.coding", "id": "Observation.code.coding:view", "sliceName": "view", "min": 1, "patternCoding": {"code": "view"}},
            ]
        },
    }


@_query(
    "validate",
    "SELECT event_id::VARCHAR AS fhir_id, 'error' AS severity, 'required' AS code, 'Observation.status' AS expression FROM events, (VALUES (1), (2)) t(k) WHERE event_id % 10 = 0"
    " UNION ALL SELECT event_id::VARCHAR, 'error', 'invariant', 'Observation' FROM events WHERE value > 400"
    " UNION ALL SELECT event_id::VARCHAR, 'error', 'required', 'Observation.code.coding:view' FROM events WHERE event_type <> 'view'",
)
def validated(spark, sf_dir):
    found = validate.validate(observation_log(spark, sf_dir), validate.compile_profile(profile()))
    return found.select("fhir_id", "severity", "code", "expression")


@_query("elements", "SELECT event_id::VARCHAR AS fhir_id, CASE WHEN event_id % 10 = 0 THEN 'id,meta,resourceType' ELSE 'id,meta,resourceType,status' END AS names, 'SUBSETTED' AS tag FROM events")
def elements(spark, sf_dir):
    body = project.elements(F.col("resource"), ["status"])
    return _shape(observation_log(spark, sf_dir), body)


@_query("summary_text", "SELECT event_id::VARCHAR AS fhir_id, 'id,meta,resourceType,text' AS names, 'SUBSETTED' AS tag FROM events")
def summary_text(spark, sf_dir):
    return _shape(observation_log(spark, sf_dir), project.summary(F.col("resource"), "text", "Observation"))


@_query("summary_true", "SELECT event_id::VARCHAR AS fhir_id, CASE WHEN event_id % 10 = 0 THEN 'code,id,meta,resourceType,subject' ELSE 'code,id,meta,resourceType,status,subject' END AS names, 'SUBSETTED' AS tag FROM events")
def summary_true(spark, sf_dir):
    return _shape(observation_log(spark, sf_dir), project.summary(F.col("resource"), "true", "Observation"))


def _shape(rows: DataFrame, body) -> DataFrame:
    return rows.select("fhir_id", body.alias("b")).select("fhir_id", F.array_join(F.array_sort(F.json_object_keys("b")), ",").alias("names"), F.get_json_object("b", "$.meta.tag[0].code").alias("tag"))


@_query("patch_json", "SELECT event_id::VARCHAR AS fhir_id, 'amended' AS status, CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END::INTEGER AS failed FROM events WHERE event_id % 10 <> 0 UNION ALL SELECT event_id::VARCHAR, NULL, 1 FROM events WHERE event_id % 10 = 0")
def patch_json(spark, sf_dir):
    ops = json.dumps([{"op": "replace", "path": "/status", "value": "amended"}, {"op": "remove", "path": "/code/coding/1"}])
    rows = observation_log(spark, sf_dir).select("fhir_id", patch.patched(F.col("resource"), F.lit(ops), "json").alias("p"))
    return rows.select("fhir_id", F.get_json_object("p.resource", "$.status").alias("status"), F.col("p.error").isNotNull().cast("int").alias("failed"))


@_query("patch_merge", "SELECT event_id::VARCHAR AS fhir_id, 'amended' AS status, NULL::VARCHAR AS subject FROM events")
def patch_merge(spark, sf_dir):
    rows = observation_log(spark, sf_dir).select("fhir_id", patch.patched(F.col("resource"), F.lit('{"status": "amended", "subject": null}'), "merge").alias("p"))
    return rows.select("fhir_id", F.get_json_object("p.resource", "$.status").alias("status"), F.get_json_object("p.resource", "$.subject").alias("subject"))


@_query("codec_xml", "SELECT event_id::VARCHAR AS fhir_id, event_type AS code FROM events")
def codec_xml(spark, sf_dir):
    rows = observation_log(spark, sf_dir).select("fhir_id", codecs.converted(codecs.converted(F.col("resource"), "json", "xml"), "xml", "json").alias("r"))
    return rows.select("fhir_id", F.get_json_object("r", "$.code.coding[0].code").alias("code"))


@_query("codec_turtle", "SELECT event_id::VARCHAR AS fhir_id, user_id AS subject FROM events")
def codec_turtle(spark, sf_dir):
    rows = observation_log(spark, sf_dir).select("fhir_id", codecs.converted(codecs.converted(F.col("resource"), "json", "turtle"), "turtle", "json").alias("r"))
    return rows.select("fhir_id", F.substring_index(F.get_json_object("r", "$.subject.reference"), "/", -1).cast("long").alias("subject"))


@_query("date_precision", "SELECT o_orderkey AS fhir_id, date_trunc('month', o_orderdate) AS low, date_trunc('month', o_orderdate) + INTERVAL 1 MONTH - INTERVAL 1 SECOND AS high FROM orders")
def date_precision(spark, sf_dir):
    low, high = date_columns(F.date_format("o_orderdate", "yyyy-MM"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("fhir_id"), low.alias("low"), high.alias("high"))


@_query("capability")
def capability(spark, sf_dir):
    return table_dataset(spark, sf_dir).registry.capability(spark)


@_query("stream_windows", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    """The streaming window count, over a bounded read of the same source."""
    from .streaming.increments import window_counts

    found = window_counts(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", "event_type", "1 day")
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import more_queries  # noqa: F401  registers its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import more_queries  # noqa: F401

    return dict(_SQL)
