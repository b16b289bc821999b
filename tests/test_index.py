"""Stored indexes over updates and changed definitions, limits that are reported, totals."""

import pytest
from pyspark.sql import functions as F

from quillon.errors import TooLarge
from quillon.operators import extract, graph, log, page
from quillon.plans.request import parse
from quillon.registry import Registry
from quillon.registry import SearchParam as S
from quillon.schema import LOG
from quillon.sources import seed
from quillon.sources.resources import log_dataset, log_rows, string_values
from quillon.sources.tables import table_dataset

SMALL = "/root/testdata/sf0.001"


def registry():
    r = Registry()
    r.register(S("Patient", "gender", "token", "Patient.gender"), S("Patient", "family", "string", "Patient.name.family"))
    return r


def versions(spark):
    first = log_rows(spark, [{"resourceType": "Patient", "id": i, "gender": "male", "name": [{"family": i}]} for i in "abc"])
    changed = log_rows(spark, [{"resourceType": "Patient", "id": "a", "gender": "female", "name": [{"family": "a"}]}]).withColumn("version_id", F.lit(2))
    gone = log_rows(spark, [{"resourceType": "Patient", "id": "b", "gender": "male"}]).withColumn("version_id", F.lit(2)).withColumn("is_deleted", F.lit(True))
    names = [c.split()[0] for c in LOG.split(", ")]
    return first, changed.unionByName(gone).select(*names)


def found(spark, rows, path, query, r=None):
    return {x.fhir_id for x in page.search(log_dataset(spark, rows, r or registry(), index_path=path), parse("Patient", query)).collect()}


def test_stored_index_after_updates(spark, tmp_path):
    first, later = versions(spark)
    both, path = first.unionByName(later), str(tmp_path / "index")
    extract.write_index(first, registry(), path, 0)
    extract.write_index(later, registry(), path, 1)
    extract.write_index(later, registry(), path, 1)  # the same batch again
    assert found(spark, both, path, "gender=male") == {"c"}
    assert found(spark, both, path, "gender=female") == {"a"}
    assert found(spark, both, path, "gender:missing=true") == set()

    compact = str(tmp_path / "compact")
    extract.reindex(spark, path, compact, both, registry())
    rows = extract.stored_rows(spark, compact, "token").select("resource_id", "code").collect()
    assert sorted(map(tuple, rows)) == [("a", "female"), ("c", "male")]

    r, more = registry(), str(tmp_path / "more")
    definition = {"resourceType": "SearchParameter", "type": "string", "code": "named", "base": ["Patient"], "expression": "Patient.name.family"}
    changed = seed.sync_parameter(r, definition)
    assert changed == (("Patient", "named"),)
    extract.reindex(spark, compact, more, both, r, changed)
    assert found(spark, both, more, "named=c", r) == {"c"} and found(spark, both, more, "gender=female", r) == {"a"}
    without = str(tmp_path / "without")
    extract.reindex(spark, more, without, both, r, seed.sync_parameter(r, definition, gone=True))
    assert extract.stored_rows(spark, without, "string").where("param_name = 'named'").count() == 0


def test_limits_are_reported(spark):
    data = table_dataset(spark, SMALL)
    with pytest.raises(TooLarge):
        graph.everything(data, "Patient", most=3)
    with pytest.raises(TooLarge):
        graph.document(data, "Encounter", [1, 2, 3], most=3)
    owner = data.index("Encounter", data.registry.get("Encounter", "subject")).groupBy("target_id").count().orderBy(F.desc("count")).first()
    with pytest.raises(TooLarge):
        graph.compartment(data, "Patient", owner[0], "Encounter", most=owner[1] - 1)
    assert graph.compartment(data, "Patient", owner[0], "Encounter", most=owner[1]).count() == owner[1]


def test_string_values(spark):
    body = '{"resourceType":"X","a":["one",":two"],"n":12,"t":true,"deep":{"k":"say \\"hi\\"\\nthere é"},"none":null}'
    text = spark.createDataFrame([(body,)], "b string").select(string_values(F.col("b"))).first()[0]
    words = set(text.replace('\\"', " ").split())
    assert {"X", "one", ":two", "say", "hi", "there", "é"} <= words and not words & {"resourceType", "a", "12", "true", "deep", "k", "none"}


def test_writes_look_at_written_keys_only(spark):
    first, later = versions(spark)
    writes = spark.createDataFrame([("default", "Patient", "a", "PUT", "{}", None)], "tenant_id string, resource_type string, fhir_id string, operation string, resource string, if_match int")
    applied = log.apply_writes(first.unionByName(later), writes, __import__("datetime").datetime(2025, 1, 1))
    assert [(r.version_id, r.outcome) for r in applied.collect()] == [(3, "updated")]
    assert "LeftSemi" in applied._jdf.queryExecution().executedPlan().toString()


def test_terminology_is_kept_for_a_while(spark):
    from quillon.sources.terminology import Terminology

    now, asked = [0.0], []

    def rows():
        asked.append(now[0])
        return spark.createDataFrame([("v", "s", "a", "Apple"), ("v", "s", "b", "Pear"), ("v", "s", "papp", None)], "url string, system string, code string, display string")

    t = Terminology(rows, 10, lambda: now[0])
    assert [r.code for r in t.matching("v", "APP").collect()] == ["a", "papp"]
    assert [r.code for r in t.matching("v", "", 1, 1).collect()] == ["b"] and t.expand("w") is None
    assert asked == [0.0, 0.0]
    now[0] = 11.0
    assert t.expand("v").count() == 3 and asked == [0.0, 0.0, 11.0]


def test_packages_by_name_and_version(tmp_path):
    from quillon.errors import NotFound

    asked = []

    def fetch(name, version, to):
        asked.append((name, version))
        open(to, "wb").close()

    cache = str(tmp_path)
    with pytest.raises(NotFound):
        seed.find_package("some.guide@1.0.0", cache)
    path = seed.find_package("some.guide@1.0.0", cache, fetch)
    assert path.endswith("some.guide-1.0.0.tgz") and seed.find_package("some.guide@1.0.0", cache) == path and asked == [("some.guide", "1.0.0")]
    assert seed.find_package(path, cache) == path
    with pytest.raises(NotFound):
        seed.find_package("../x@1", cache, fetch)


def test_summary_by_loaded_definitions(spark):
    from quillon.operators import project

    rows = spark.createDataFrame([('{"resourceType":"Basket","id":"1","code":"a","note":"b","text":"t"}',)], "b string")
    shown = rows.select(project.summary(F.col("b"), "true", "Basket", {"Basket": ["code"]})).first()[0]
    assert '"code"' in shown and "note" not in shown and '"text"' not in shown and "SUBSETTED" in shown
    assert "note" in rows.select(project.summary(F.col("b"), "true", "Basket")).first()[0]
