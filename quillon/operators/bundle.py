"""Transaction and batch bundles.

A bundle is planned on the driver (it is one request), its conditional entries by
searches of the committed state, and written as one batch.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark.sql import DataFrame

from ..errors import Conflict, EngineError, Invalid, NotFound
from ..plans.dataset import Dataset
from ..plans.request import parse
from .log import LogStore
from .page import search

#: The order in which verbs take effect.
VERBS = ("DELETE", "POST", "PUT", "PATCH", "GET")


@dataclass
class Op:
    """One planned entry; ``skip``: a conditional create whose match exists."""

    index: int
    verb: str
    resource_type: str
    fhir_id: str | None
    query: str = ""
    version: int | None = None
    resource: dict | None = None
    if_match: int | None = None
    skip: bool = False
    outcome: str = ""


def etag_version(text: str | None) -> int | None:
    """W/"3" -> 3"""
    if not text:
        return None
    m = re.fullmatch(r'(?:W/)?"?(\d+)"?', text.strip())
    if not m:
        raise Invalid(f"not a version tag: {text!r}")
    return int(m[1])


def parse_url(url: str, base: str = "") -> tuple[str, str | None, int | None, str]:
    """(type, id, version, query) of an entry's URL, relative or below ``base``."""
    parts = urlsplit(url)
    path = parts.path
    if parts.scheme and not (base and url.startswith(base)):
        raise Invalid(f"{url} is not of this server")
    if parts.scheme:
        path = url[len(base) :].split("?")[0]
    steps = [s for s in path.split("/") if s]
    if not steps or not re.fullmatch(r"[A-Z][A-Za-z]+", steps[0]):
        raise Invalid(f"{url} names no type")
    version = int(steps[3]) if len(steps) == 4 and steps[2] == "_history" else None
    return steps[0], steps[1] if len(steps) > 1 else None, version, parts.query


def match_one(data: Dataset, resource_type: str, query: str):
    """The id of the one match of a search, or None; Conflict if there are several."""
    found = search(data, parse(resource_type, query)).select("fhir_id").limit(2).collect()
    if len(found) > 1:
        raise Conflict(f"{resource_type}?{query} matches several")
    return found[0][0] if found else None


def plan(bundle: dict, data: Dataset, base: str = "", new_id=lambda: str(uuid.uuid4())) -> list[Op]:
    """Ops with ids given, conditions met and references rewritten, in verb order."""
    ops, names = [], {}
    for k, entry in enumerate(bundle.get("entry", [])):
        request = entry.get("request") or {}
        verb = request.get("method", "")
        if verb not in VERBS or not request.get("url"):
            raise Invalid(f"entry {k} needs a method and a url")
        resource_type, fhir_id, version, query = parse_url(request["url"], base)
        op = Op(k, verb, resource_type, fhir_id, query, version, entry.get("resource"), etag_version(request.get("ifMatch")))
        if verb == "POST":
            condition = request.get("ifNoneExist")
            found = match_one(data, resource_type, condition) if condition else None
            op.skip, op.fhir_id = found is not None, str(found) if found is not None else new_id()
        elif verb in ("PUT", "PATCH", "DELETE") and fhir_id is None:
            found = match_one(data, resource_type, query)
            if found is None and verb == "PATCH":
                raise NotFound(f"{resource_type}?{query}")
            op.skip = found is None and verb == "DELETE"
            op.fhir_id = str(found) if found is not None else (op.resource or {}).get("id") or new_id()
        if entry.get("fullUrl") and op.fhir_id:
            names[entry["fullUrl"]] = f"{resource_type}/{op.fhir_id}"
        ops.append(op)
    for op in ops:
        if op.resource is not None:
            op.resource = rewritten(op.resource, names) | {"id": op.fhir_id}
    return sorted(ops, key=lambda op: VERBS.index(op.verb))


def rewritten(value, names: dict[str, str]):
    """A body whose references to entries' full URLs name the resources."""
    if isinstance(value, dict):
        return {k: names.get(v, v) if k == "reference" and isinstance(v, str) else rewritten(v, names) for k, v in value.items()}
    if isinstance(value, list):
        return [rewritten(v, names) for v in value]
    return value


_WRITES = "tenant_id string, resource_type string, fhir_id string, operation string, resource string, if_match int"


def writes(spark, ops: list[Op], tenant_id: str) -> DataFrame:
    rows = [(tenant_id, op.resource_type, op.fhir_id, op.verb, json.dumps(op.resource) if op.resource is not None else None, op.if_match) for op in ops if op.verb != "GET" and not op.skip]
    keys = [(r[1], r[2]) for r in rows]
    if len(set(keys)) < len(keys):
        raise Invalid("a bundle writes a resource once")
    return spark.createDataFrame(rows, _WRITES)


def transaction(store: LogStore, data: Dataset, bundle: dict, recorded_at, tenant_id: str = "default", **more) -> list[dict]:
    """All entries or none. GET entries see the state before the bundle."""
    ops = plan(bundle, data, **more)
    answers = {op.index: _read(data, op) for op in ops if op.verb == "GET"}
    done = store.commit(writes(data.spark, ops, tenant_id), recorded_at, all_or_nothing=True)
    outcome = {(r.resource_type, r.fhir_id): r for r in done.collect()}
    for op in ops:
        if op.verb != "GET":
            r = outcome.get((op.resource_type, op.fhir_id))
            answers[op.index] = _answer(op, r)
    return [answers[k] for k in sorted(answers)]


def batch(store: LogStore, data: Dataset, bundle: dict, recorded_at, tenant_id: str = "default", **more) -> list[dict]:
    """Each entry by itself, with a status of its own."""
    out = []
    for entry in bundle.get("entry", []):
        try:
            out += transaction(store, data, {"entry": [entry]}, recorded_at, tenant_id, **more)
        except EngineError as e:
            out.append({"status": {NotFound: "404", Conflict: "409"}.get(type(e), "400"), "diagnostics": str(e)})
    return out


def _answer(op: Op, row) -> dict:
    if row is None:
        return {"status": "200" if op.fhir_id else "204", "location": f"{op.resource_type}/{op.fhir_id}" if op.fhir_id else None}
    status = {"created": "201", "updated": "200", "deleted": "204", "unchanged": "204"}[row.outcome]
    return {"status": status, "location": f"{op.resource_type}/{op.fhir_id}/_history/{row.version_id}", "etag": f'W/"{row.version_id}"'}


def _read(data: Dataset, op: Op) -> dict:
    from pyspark.sql import functions as F

    rows = data.resources(op.resource_type)
    if op.fhir_id:
        found = rows.where(F.col("fhir_id") == op.fhir_id).select("resource").take(1)
        return {"status": "200", "resource": json.loads(found[0][0])} if found else {"status": "404"}
    from .page import page

    found = page(data, parse(op.resource_type, op.query)).select("resource").collect()
    return {"status": "200", "resource": {"resourceType": "Bundle", "type": "searchset", "entry": [{"resource": json.loads(r[0])} for r in found]}}
