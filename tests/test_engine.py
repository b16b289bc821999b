"""Search over JSON resources: extraction, modifiers, refusals."""

import pytest
from pyspark.sql import functions as F

from quillon.errors import TooLarge, UnsupportedParam
from quillon.functions import fhirpath as P
from quillon.operators import extract, graph, page
from quillon.plans.request import parse
from quillon.registry import Registry
from quillon.registry import SearchParam as S
from quillon.sources.resources import log_dataset, log_rows

UCUM, LOINC = "http://unitsofmeasure.org", "http://loinc.org"


def observation(i, code, value, **more):
    return {"resourceType": "Observation", "id": i, "status": "final", "code": {"coding": [{"system": LOINC, "code": code, "display": "Heart rate"}]}, "subject": {"reference": "Patient/p1"}, "effectiveDateTime": "2024-03-01", "valueQuantity": {"value": value, "system": UCUM, "code": "/min"}} | more


RESOURCES = [
    {"resourceType": "Patient", "id": "p1", "active": True, "gender": "male", "birthDate": "2000-03-13", "language": "en", "name": [{"family": "Newman", "given": ["Ann", "Bee"]}], "identifier": [{"system": "urn:mrn", "value": "77", "type": {"coding": [{"system": "urn:t", "code": "MR"}]}}], "managingOrganization": {"reference": "Organization/o1"}, "meta": {"tag": [{"system": "urn:x", "code": "vip"}], "profile": ["http://p/a"], "source": "urn:s"}},
    {"resourceType": "Patient", "id": "p2", "gender": "female", "birthDate": "2000", "name": [{"family": "O'Hara"}], "deceasedDateTime": "2020-01"},
    {"resourceType": "Organization", "id": "o1", "name": "Acme Health", "partOf": {"reference": "http://x.org/fhir/Organization/o0/_history/2"}},
    {"resourceType": "Organization", "id": "o0", "name": "Root"},
    observation("a", "8867-4", 55),
    observation("b", "8867-4", 60, effectiveDateTime="2024-03-05T10:00:00-05:00"),
    observation("c", "8867-4", 65, effectiveDateTime=None, effectivePeriod={"start": "2024-01-01", "end": "2024-06-01"}),
    observation("d", "85354-9", 1, valueQuantity=None, component=[{"code": {"coding": [{"system": LOINC, "code": "8480-6"}]}, "valueQuantity": {"value": 120, "code": "mm[Hg]"}}, {"code": {"coding": [{"system": LOINC, "code": "8867-4"}]}, "valueQuantity": {"value": 55, "code": "/min"}}]),
    {"resourceType": "CodeSystem", "id": "cs", "url": "http://a.org/fhir/x", "status": "active"},
    {"resourceType": "List", "id": "l1", "entry": [{"item": {"reference": "Patient/p2"}}, {"item": {"reference": "Observation/a"}}]},
]


def registry():
    r = Registry()
    r.register(
        S("Patient", "name", "string", "Patient.name"),
        S("Patient", "family", "string", "Patient.name.family"),
        S("Patient", "gender", "token", "Patient.gender"),
        S("Patient", "active", "token", "Patient.active"),
        S("Patient", "identifier", "token", "Patient.identifier"),
        S("Patient", "birthdate", "date", "Patient.birthDate"),
        S("Patient", "death-date", "date", "(Patient.deceased as dateTime)"),
        S("Patient", "organization", "reference", "Patient.managingOrganization", ("Organization",)),
        S("Organization", "name", "string", "Organization.name"),
        S("Organization", "partof", "reference", "Organization.partOf", ("Organization",)),
        S("Observation", "code", "token", "Observation.code"),
        S("Observation", "combo-code", "token", "Observation.code | Observation.component.code"),
        S("Observation", "status", "token", "Observation.status"),
        S("Observation", "date", "date", "Observation.effective"),
        S("Observation", "subject", "reference", "Observation.subject", ("Patient",)),
        S("Observation", "patient", "reference", "Observation.subject.where(resolve() is Patient)", ("Patient",)),
        S("Observation", "value-quantity", "quantity", "Observation.value.ofType(Quantity)"),
        S("Observation", "component-code-value-quantity", "composite", "Observation.component", components=(("code", "token"), ("value.ofType(Quantity)", "quantity"))),
        S("Observation", "code-value-quantity", "composite", "", components=(("code", "token"), ("value.ofType(Quantity)", "quantity"))),
        S("Observation", "near", "special", ""),
        S("CodeSystem", "url", "uri", "CodeSystem.url"),
    )
    return r


@pytest.fixture(scope="module")
def data(spark):
    log = log_rows(spark, RESOURCES)
    deleted = log_rows(spark, [{"resourceType": "Patient", "id": "gone", "gender": "male"}]).withColumn("is_deleted", F.lit(True))
    foreign = log_rows(spark, [{"resourceType": "Patient", "id": "other", "gender": "male"}], tenant_id="other")
    d = log_dataset(spark, log.union(deleted).union(foreign).cache(), registry())
    d.concepts = spark.createDataFrame([(LOINC, "8867-4", "vital"), (LOINC, "8480-6", "bp"), (LOINC, "bp", "vital"), (LOINC, "vital", None)], "system string, code string, parent string")
    d.value_sets = lambda url: spark.createDataFrame([(LOINC, "8867-4"), ("", "85354-9")], "system string, code string").where("true" if url == "urn:both" else "system <> ''")
    return d


@pytest.mark.parametrize(
    "resource_type,query,want",
    [
        ("Patient", "", "p1 p2"),
        ("Patient", "name=newm", "p1"),
        ("Patient", "name=bee", "p1"),
        ("Patient", "family:exact=Newman", "p1"),
        ("Patient", "family:exact=newman", ""),
        ("Patient", "family:contains=har", "p2"),
        ("Patient", "gender=male", "p1"),
        ("Patient", "gender=male,female", "p1 p2"),
        ("Patient", "gender:not=male", "p2"),
        ("Patient", "active=true", "p1"),
        ("Patient", "active:missing=true", "p2"),
        ("Patient", "active:missing=false", "p1"),
        ("Patient", "identifier=urn:mrn|77", "p1"),
        ("Patient", "identifier=urn:mrn|", "p1"),
        ("Patient", "identifier=|77", "p1"),
        ("Patient", "identifier=urn:no|77", ""),
        ("Patient", "identifier:of-type=urn:t|MR|77", "p1"),
        ("Patient", "identifier:of-type=MR|77", "p1"),
        ("Patient", "identifier:of-type=urn:t|XX|77", ""),
        ("Patient", "birthdate=2000", "p1 p2"),
        ("Patient", "birthdate=2000-03", "p1"),
        ("Patient", "birthdate=ne2000-03-13", "p2"),
        ("Patient", "death-date=2020", "p2"),
        ("Patient", "_id=p2,zz", "p2"),
        ("Patient", "_tag=urn:x|vip", "p1"),
        ("Patient", "_profile=http://p/a", "p1"),
        ("Patient", "_source=urn:s", "p1"),
        ("Patient", "_language=en", "p1"),
        ("Patient", "_list=l1", "p2"),
        ("Patient", "_lastUpdated=2024-01-01", "p1 p2"),
        ("Patient", "_lastUpdated=ne2024-01-01", ""),
        ("Patient", "_text=newman ann", "p1"),
        ("Patient", "organization=Organization/o1", "p1"),
        ("Patient", "organization.name=acme", "p1"),
        ("Patient", "organization.partof.name=root", "p1"),
        ("Patient", "_has:Observation:subject:code=8867-4", "p1"),
        ("Patient", "unknown=1", ""),
        ("Organization", "partof=Organization/o0", "o1"),
        ("Observation", "code:text=heart", "a b c d"),
        ("Observation", "code:in=urn:one", "a b c"),
        ("Observation", "code:in=urn:both", "a b c d"),
        ("Observation", "code:not-in=urn:one", "d"),
        ("Observation", f"code:below={LOINC}|vital", "a b c"),
        ("Observation", f"combo-code:below={LOINC}|vital", "a b c d"),
        ("Observation", f"combo-code:above={LOINC}|8867-4", "a b c d"),
        ("Observation", "value-quantity=60", "b"),
        ("Observation", "value-quantity=ne60", "a c"),
        ("Observation", "value-quantity=gt60", "c"),
        ("Observation", f"value-quantity=ge60|{UCUM}|/min", "b c"),
        ("Observation", f"value-quantity=ge60|{UCUM}|kg", ""),
        ("Observation", "code-value-quantity=8867-4$60", "b"),
        ("Observation", "code-value-quantity=8867-4$ne60", "a c"),
        ("Observation", "code-value-quantity=8867-4$ge60", "b c"),
        ("Observation", f"code-value-quantity={LOINC}|8867-4$le60", "a b"),
        ("Observation", "component-code-value-quantity=8867-4$lt60", "d"),
        ("Observation", "component-code-value-quantity=8480-6$lt60", ""),
        ("Observation", "component-code-value-quantity=8480-6$gt100", "d"),
        ("Observation", "date=ge2024-05", "c"),
        ("Observation", "date=2024-03-05", "b"),
        ("Observation", "date=eb2024-03-02", "a d"),
        ("Observation", "patient=p1&code:not=85354-9&date=2024-03", "a b"),
        ("CodeSystem", "url:below=http://a.org/fhir", "cs"),
        ("CodeSystem", "url:above=http://a.org/fhir/x/y", "cs"),
        ("CodeSystem", "url=http://a.org/fhir", ""),
    ],
)
def test_search(data, resource_type, query, want):
    from urllib.parse import quote

    pairs = [tuple(p.split("=", 1)) for p in query.split("&")] if query else []
    assert quote("") == ""
    got = page.search(data, parse(resource_type, pairs)).select("fhir_id").collect()
    assert sorted(r.fhir_id for r in got) == want.split()


@pytest.mark.parametrize(
    "resource_type,key,value",
    [
        ("Observation", "near", "1"),
        ("Observation", "value-quantity", "abc"),
        ("Observation", "date", "soon"),
        ("Observation", "code:frobnicate", "x"),
        ("Observation", "code:below", "x"),
        ("Observation", "code-value-quantity", "x"),
        ("Observation", "code-value-quantity", "x$abc"),
        ("Observation", "status.name", "x"),
        ("Patient", "_id:not", "p1"),
        ("Patient", "_has:Observation:code:status", "x"),
        ("Patient", "_filter", "name gt 4"),
        ("Patient", "organization.partof.partof.partof.partof.partof.partof.partof.name", "x"),
    ],
)
def test_refused(data, resource_type, key, value):
    with pytest.raises(UnsupportedParam):
        page.search(data, parse(resource_type, [(key, value)])).collect()


def test_extracted_rows(data, spark):
    rows = data.index("Observation", registry().get("Observation", "date")).orderBy("resource_id").selectExpr("resource_id", "cast(value_low as string) lo", "cast(value_high as string) hi").collect()
    assert [tuple(r) for r in rows][1] == ("b", "2024-03-05 15:00:00", "2024-03-05 15:00:00")
    assert [tuple(r) for r in rows][2] == ("c", "2024-01-01 00:00:00", "2024-06-01 23:59:59")
    q = data.index("Observation", registry().get("Observation", "value-quantity")).where("resource_id = 'a'").collect()
    assert [(str(r.value), str(r.value_low), str(r.value_high), r.code) for r in q] == [("55.000000", "54.999995", "55.000006", "/min")]


def test_stored_index_gives_the_same(data, spark, tmp_path):
    log = log_rows(spark, RESOURCES)
    extract.write_index(log, registry(), str(tmp_path / "i"))
    stored = log_dataset(spark, log, registry(), index_path=str(tmp_path / "i"))
    for t, q in (("Patient", "name=newm"), ("Patient", "organization.name=acme"), ("Observation", "code-value-quantity=8867-4$ge60"), ("Patient", "identifier:of-type=urn:t|MR|77")):
        a, b = ({r.fhir_id for r in page.search(d, parse(t, [tuple(q.split("=", 1))])).collect()} for d in (data, stored))
        assert a == b and a


def test_searchset(data):
    got = page.searchset(data, parse("Patient", "organization.name=acme&_include=Patient:organization&_total=accurate&_elements=name"), "http://h")
    assert got["total"] == 1 and [(e["fullUrl"], e["search"]["mode"]) for e in got["entry"]] == [("http://h/Patient/p1", "match"), ("http://h/Organization/o1", "include")]
    assert set(got["entry"][0]["resource"]) == {"resourceType", "id", "meta", "name"} and {x["relation"] for x in got["link"]} == {"self", "first", "last"}
    assert page.searchset(data, parse("Patient", "_summary=count"))["total"] == 2


def test_metrics(spark):
    from quillon.operators import metrics

    rows = spark.createDataFrame([("GET", "/Patient/12/_history/3", 200, 0.02), ("GET", "/Patient/0a1b2c3d-0000-1111-2222-333344445555/_history/4", 200, 3.0), ("GET", "/Patient/abc", 404, 0.2)], "method string, path string, status int, seconds double")
    got = {r.path: (r.n, r["le_0.025"], r.le_5) for r in metrics.request_counts(rows).collect()}
    assert got == {"/Patient/{id}/_history/{id}": (2, 1, 2), "/Patient/abc": (1, 0, 1)}
    seen, watch = metrics.observed(rows, "requests")
    seen.collect()
    assert watch.get["rows"] == 3


def test_guard(data):
    rows = data.index("Observation", registry().get("Observation", "combo-code")).withColumn("resource_type", F.lit("Observation"))
    assert extract.guard(rows, 3).count() == 6
    with pytest.raises(TooLarge):
        extract.guard(rows, 2)


def test_last_n_and_document(data):
    got = {r.fhir_id: r["rank"] for r in graph.last_n(data, parse("Observation"), 1).collect()}
    assert got == {"b": 1, "d": 1}
    reached = {(r.resource_type, r.fhir_id, r.depth) for r in graph.document(data, "Observation", ["a"], depth=4).collect()}
    assert reached == {("Observation", "a", 0), ("Patient", "p1", 1), ("Organization", "o1", 2), ("Organization", "o0", 3)}


def test_fhirpath_booleans(spark):
    body = '{"a": [{"k": "x", "n": 4}, {"k": "y", "n": "5"}], "s": "abc", "t": true, "f": false}'
    row = spark.createDataFrame([(body,)], "b string").select(F.parse_json("b").alias("v"))
    cases = {
        "a.exists()": True, "b.exists()": False, "b.empty()": True, "a.count() = 2": True, "s.matches('^a.c$')": True, "s.startsWith('b')": False,
        "a.where(k='x').n = 4": True, "a.where(k='y').n > 4.5": True, "t": True, "f": False, "f.not()": True, "t and f": False, "t or f": True, "t xor t": False, "f implies b.exists()": True,
        "t implies (b.exists() or s = 'abc')": True, "(t and (f or t))": True, "a.where(k!='x').count() = 1": True, "a.where(z!='x').exists()": False, "a.all(k.exists())": True, "b = 1": False,
    }
    got = row.select(*(P.check(e, F.col("v")).alias(f"c{k}") for k, e in enumerate(cases))).first()
    assert dict(zip(cases, got)) == cases


@pytest.mark.parametrize("text", ["a..b", "a.where(", "a b", "'x", "a.frob()"])
def test_bad_fhirpath(spark, text):
    with pytest.raises(UnsupportedParam):
        P.check(text, F.col("v"))
