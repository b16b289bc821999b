import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillon.errors import Conflict, Gone, Invalid, NotFound
from quillon.operators import bundle as Bu
from quillon.operators import log as L
from quillon.operators import patch as Pa
from quillon.operators import project, validate
from quillon.plans.request import parse
from quillon.registry import Registry
from quillon.registry import SearchParam as S
from quillon.sources import codecs, seed
from quillon.sources.resources import log_dataset

T = datetime(2024, 5, 1)
ROW = "tenant_id string, resource_type string, fhir_id string, operation string, resource string, if_match int"


def write(spark, *rows):
    return spark.createDataFrame([("t1", "Patient", i, op, body, match) for i, op, body, match in rows], ROW)


@pytest.fixture
def store(spark, tmp_path):
    return L.LogStore(spark, str(tmp_path / "log"))


def outcomes(df):
    return {r.fhir_id: (r.outcome, r.version_id) for r in df.collect()}


def test_writes_and_reads(spark, store):
    assert outcomes(store.commit(write(spark, ("a", "POST", '{"n":1}', None), ("b", "PUT", "{}", None), ("c", "DELETE", None, None), ("d", "PATCH", "{}", None), ("e", "PUT", "{}", 1)), T)) == {"a": ("created", 1), "b": ("created", 1), "c": ("not_found", None), "d": ("not_found", None), "e": ("not_found", None)}
    assert outcomes(store.commit(write(spark, ("a", "PUT", '{"n":2}', 1), ("b", "PUT", "{}", 7)), T)) == {"a": ("updated", 2), "b": ("conflict", None)}
    assert outcomes(store.commit(write(spark, ("a", "DELETE", None, None)), T)) == {"a": ("deleted", 3)}
    assert outcomes(store.commit(write(spark, ("a", "DELETE", None, None)), T)) == {"a": ("unchanged", None)}
    with pytest.raises(Gone):
        L.read(store.log(), "Patient", "a")
    with pytest.raises(NotFound):
        L.read(store.log(), "Patient", "zz")
    assert outcomes(store.commit(write(spark, ("a", "PUT", '{"n":3}', None)), T)) == {"a": ("updated", 4)}
    assert L.read(store.log(), "Patient", "a").first().resource == '{"n":3}'
    assert [r.version_id for r in L.instance_history(store.log(), "Patient", "a").collect()] == [4, 3, 2, 1]
    assert L.version(store.log(), "Patient", "a", 2).first().resource == '{"n":2}'
    meta = json.loads(L.with_meta(L.read(store.log(), "Patient", "a")).first().resource)["meta"]
    assert meta == {"versionId": "4", "lastUpdated": "2024-05-01T00:00:00Z"}


def test_all_or_nothing_and_compaction(spark, store, tmp_path):
    store.commit(write(spark, ("a", "POST", "{}", None)), T)
    with pytest.raises(Conflict):
        store.commit(write(spark, ("b", "POST", "{}", None), ("a", "POST", "{}", None)), T, all_or_nothing=True)
    assert store.log().count() == 1
    store.compact(str(tmp_path / "new"))
    assert L.LogStore(spark, str(tmp_path / "new")).log().count() == 1
    with pytest.raises(NotFound):
        L.of_tenant(store.log(), "no such tenant!")


def test_version_numbers_of_a_bulk_load(spark):
    rows = spark.createDataFrame([("t", "P", "a", datetime(2024, 1, d)) for d in (3, 1, 2)] + [("t", "P", "b", T)], "tenant_id string, resource_type string, fhir_id string, last_updated timestamp_ntz")
    assert sorted((r.fhir_id, r.last_updated.day, r.version_id) for r in L.number_versions(rows).collect()) == [("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("b", 1, 1)]


def test_bundles(spark, store):
    r = Registry()
    r.register(S("Patient", "identifier", "token", "Patient.identifier"), S("Observation", "subject", "reference", "Observation.subject", ("Patient",)))
    ids = iter(f"n{k}" for k in range(20))
    entries = [
        {"fullUrl": "urn:uuid:1", "request": {"method": "POST", "url": "Patient"}, "resource": {"resourceType": "Patient", "identifier": [{"system": "s", "value": "1"}]}},
        {"request": {"method": "POST", "url": "Observation"}, "resource": {"resourceType": "Observation", "subject": {"reference": "urn:uuid:1"}}},
        {"request": {"method": "PUT", "url": "Patient/x"}, "resource": {"resourceType": "Patient", "id": "x"}},
    ]
    data = lambda: log_dataset(spark, store.log(), r, "t1")
    first = Bu.transaction(store, data(), {"entry": entries}, T, "t1", new_id=lambda: next(ids))
    assert [a["status"] for a in first] == ["201", "201", "201"]
    body = json.loads(L.read(store.log(), "Observation", "n1").first().resource)
    assert body["subject"]["reference"] == "Patient/n0"
    again = {"fullUrl": "urn:uuid:2", "request": {"method": "POST", "url": "Patient", "ifNoneExist": "identifier=s|1"}, "resource": {"resourceType": "Patient"}}
    second = Bu.transaction(store, data(), {"entry": [again, {"request": {"method": "GET", "url": "Patient/x"}}, {"request": {"method": "DELETE", "url": "Patient/x"}}]}, T, "t1")
    assert [a["status"] for a in second] == ["200", "200", "204"] and second[0]["location"] == "Patient/n0"
    mixed = Bu.batch(store, data(), {"entry": [{"request": {"method": "PATCH", "url": "Patient/none"}, "resource": {}}, {"request": {"method": "GET", "url": "Patient?identifier=s|1"}}, {"request": {"method": "POST", "url": "bad"}}]}, T, "t1")
    assert [a["status"] for a in mixed] == ["409", "200", "400"] and len(mixed[1]["resource"]["entry"]) == 1
    assert [o.verb for o in Bu.plan({"entry": [{"request": {"method": m, "url": "Patient/1"}} for m in ("GET", "PATCH", "PUT", "DELETE")]}, data())] == ["DELETE", "PUT", "PATCH", "GET"]
    assert Bu.etag_version('W/"3"') == 3 and Bu.parse_url("Patient/1/_history/2") == ("Patient", "1", 2, "")
    with pytest.raises(Invalid):
        Bu.parse_url("http://elsewhere/Patient/1", "http://here")


def test_patches():
    doc = {"a": [1, 2, 3], "o": {"x/y": 1, "m~n": 2}}
    ops = [{"op": "add", "path": "/a/-", "value": 4}, {"op": "add", "path": "/a/0", "value": 0}, {"op": "remove", "path": "/a/2"}, {"op": "replace", "path": "/o/x~1y", "value": 9}, {"op": "move", "from": "/o/m~0n", "path": "/k"}, {"op": "copy", "from": "/a", "path": "/b"}, {"op": "test", "path": "/k", "value": 2}]
    assert Pa.json_patch(doc, ops) == {"a": [0, 1, 3, 4], "o": {"x/y": 9}, "k": 2, "b": [0, 1, 3, 4]} and doc["a"] == [1, 2, 3]
    for bad in ({"op": "remove", "path": "/z"}, {"op": "test", "path": "/a/0", "value": 5}, {"op": "zz", "path": "/a"}, {"op": "add", "path": "/a/9", "value": 1}, {"op": "add", "path": "a", "value": 1}, {"op": "replace", "path": "/q", "value": 1}):
        with pytest.raises(Invalid):
            Pa.json_patch(doc, [bad])
    assert Pa.merge({"a": {"b": 1, "c": 2}, "d": [1]}, {"a": {"b": None, "e": 3}, "d": [2]}) == {"a": {"c": 2, "e": 3}, "d": [2]}


def operation(**parts):
    values = {"type": "valueCode", "path": "valueString", "name": "valueString", "index": "valueInteger", "source": "valueInteger", "destination": "valueInteger", "value": "valueString"}
    return {"name": "operation", "part": [{"name": k, values[k]: v} for k, v in parts.items()]}


def test_fhir_and_xml_patches():
    doc = {"resourceType": "Patient", "name": [{"given": ["a", "b", "c"]}], "gender": "male"}
    run = lambda *ops: Pa.fhir_patch(doc, {"resourceType": "Parameters", "parameter": list(ops)})
    assert run(operation(type="replace", path="Patient.gender", value="female"))["gender"] == "female"
    assert run(operation(type="add", path="Patient", name="birthDate", value="2000"))["birthDate"] == "2000"
    assert "gender" not in run(operation(type="delete", path="Patient.gender"))
    assert run(operation(type="insert", path="Patient.name[0].given", index=1, value="z"))["name"][0]["given"] == ["a", "z", "b", "c"]
    assert run(operation(type="move", path="Patient.name[0].given", source=2, destination=0))["name"][0]["given"] == ["c", "a", "b"]
    with pytest.raises(Invalid):
        run(operation(type="delete", path="Patient.nothing"))
    xml = '<diff xmlns:f="http://hl7.org/fhir"><replace sel="f:Patient/f:gender/@value">other</replace><remove sel="f:Patient/f:name[1]/f:given[2]"/><add sel="f:Patient"><birthDate value="1999"/></add></diff>'
    assert Pa.xml_patch(doc, xml) == {"resourceType": "Patient", "name": [{"given": ["a", "c"]}], "gender": "other", "birthDate": "1999"}


def test_codecs():
    doc = {"resourceType": "Patient", "id": "x", "active": True, "name": [{"family": 'N "q" <&>', "given": ["a", "b"]}], "n": 1.5, "contained": [{"resourceType": "Organization", "id": "o"}], "_skip": 1}
    back = codecs.from_xml(codecs.to_xml(doc))
    assert back == {"resourceType": "Patient", "id": "x", "active": "true", "name": {"family": 'N "q" <&>', "given": ["a", "b"]}, "n": "1.5", "contained": {"resourceType": "Organization", "id": "o"}}
    plain = {k: v for k, v in doc.items() if k not in ("_skip", "contained")}
    assert codecs.from_turtle(codecs.to_turtle(plain)) == plain
    for bad in ("<x", "", "[ a fhir:Patient"):
        with pytest.raises(Invalid):
            codecs.from_xml(bad) if bad[:1] != "[" else codecs.from_turtle(bad)
    assert [codecs.negotiate(*a) for a in ((None, None), ("xml", "application/json"), (None, "text/turtle"), (None, "application/fhir+xml, */*"))] == ["json", "xml", "turtle", "xml"]


def test_projections_and_meta(spark):
    doc = {"resourceType": "Patient", "id": "x", "gender": "male", "text": {"div": "d"}, "photo": [], "meta": {"tag": [{"code": "SUBSETTED"}], "profile": ["p"]}}
    row = spark.createDataFrame([(json.dumps(doc),)], "resource string")
    get = lambda c: json.loads(row.select(c.alias("r")).first().r)
    body = F.col("resource")
    assert set(get(project.elements(body, ["gender"]))) == {"resourceType", "id", "meta", "gender"}
    assert len(get(project.elements(body, ["gender"]))["meta"]["tag"]) == 1 and get(project.elements(body, []))["meta"]["profile"] == ["p"]
    assert "text" not in get(project.summary(body, "data", "Patient")) and "photo" not in get(project.summary(body, "true", "Patient"))
    assert get(project.summary(body, "false", "Patient")) == doc
    changed = get(project.change_meta(body, {"tag": [{"code": "new"}, {"code": "SUBSETTED"}]}, {"profile": ["p"]}))["meta"]
    assert changed == {"tag": [{"code": "SUBSETTED"}, {"code": "new"}]}


def test_validation(spark):
    definition = {
        "type": "Observation",
        "snapshot": {
            "element": [
                {"path": "Observation", "constraint": [{"key": "dom-1", "severity": "error", "expression": "status.exists()", "human": "w"}, {"key": "x-1", "severity": "error", "expression": "value.exists() or component.exists()", "human": "h"}]},
                {"path": "Observation.component.code", "min": 1},
                {"path": "Observation.note", "max": "0"},
                {"path": "Observation.category", "patternCodeableConcept": {"coding": [{"code": "vital"}]}},
                {"path": "Observation.issued", "fixedInstant": "2020"},
            ]
        },
    }
    rows = [("good", {"resourceType": "Observation", "status": "final", "code": {"text": "c"}, "valueString": "v", "category": [{"coding": [{"code": "vital", "system": "s"}]}]}), ("bad", {"resourceType": "Observation", "code": {}, "component": [{"code": {}}, {"x": 1}], "note": [1], "category": [{"coding": [{"code": "no"}]}], "issued": "2021"}), ("alien", {"resourceType": "Patient"})]
    issues = validate.validate(spark.createDataFrame([(i, json.dumps(b)) for i, b in rows], "fhir_id string, resource string"), validate.compile_profile(definition)).collect()
    assert not [i for i in issues if i.fhir_id == "good"]
    assert sorted((i.severity, i.expression) for i in issues if i.fhir_id == "bad") == [("error", "Observation.category"), ("error", "Observation.code"), ("error", "Observation.component.code"), ("error", "Observation.issued"), ("error", "Observation.note"), ("error", "Observation.status"), ("warning", "Observation")]
    assert ("fatal", "Observation") in {(i.severity, i.expression) for i in issues if i.fhir_id == "alien"}


def test_seed_and_packages(spark, tmp_path):
    import io
    import tarfile

    (tmp_path / "p.csv").write_text('Base,Code,Type,FHIRPath,Target\nPatient,name,string,Patient.name,\nEncounter,subject,reference,Encounter.subject,Patient|Group\n,x,string,,\nPatient,odd,wrong,,\n')
    r = Registry()
    assert seed.register_csv(r, seed.read_csv(spark, str(tmp_path / "p.csv"))) == 2
    assert r.get("Encounter", "subject").targets == ("Patient", "Group") and r.reverse_includes() == {"Group": ["Encounter:subject"], "Patient": ["Encounter:subject"]}
    with tarfile.open(tmp_path / "g.tgz", "w:gz") as t:
        for name, body in {"package/SearchParameter-a.json": {"resourceType": "SearchParameter", "code": "race", "type": "token", "base": ["Patient"], "expression": "Patient.race"}, "package/SearchParameter-b.json": {"resourceType": "SearchParameter", "code": "name", "type": "token", "base": ["Patient"], "expression": "x"}, "package/StructureDefinition-c.json": {"resourceType": "StructureDefinition", "url": "u"}, "package/other.json": {}}.items():
            raw = json.dumps(body).encode()
            info = tarfile.TarInfo(name)
            info.size = len(raw)
            t.addfile(info, io.BytesIO(raw))
    loaded = set()
    n, profiles = seed.load_package(r, str(tmp_path / "g.tgz"), loaded)
    assert n == 1 and [p["url"] for p in profiles] == ["u"] and r.get("Patient", "name").kind == "string"
    assert seed.load_package(r, str(tmp_path / "g.tgz"), loaded) == (0, [])
    assert parse("Patient", "race=x").predicates
    (tmp_path / "base.json").write_text(json.dumps({"entry": [{"resource": {"resourceType": "StructureDefinition", "url": "u", "type": "Patient", "kind": "resource", "derivation": "specialization"}}, {"resource": {"kind": "complex-type", "derivation": "specialization"}}]}))
    assert [r.type for r in seed.base_definitions(spark, str(tmp_path / "base.json")).collect()] == ["Patient"]
