"""Projections of bodies: _elements and _summary, with the SUBSETTED tag."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Top-level summary elements of resource types (FHIR R4, isSummary), choice names without "[x]".
SUMMARY = {
    "Patient": "id meta implicitRules identifier active name telecom gender birthDate deceased address managingOrganization link",
    "Observation": "id meta implicitRules identifier basedOn partOf status code subject focus encounter effective issued value hasMember derivedFrom component",
    "Encounter": "id meta implicitRules identifier status class type serviceType subject episodeOfCare participant appointment reasonCode reasonReference diagnosis location",
    "Organization": "id meta implicitRules identifier active type name",
    "Practitioner": "id meta implicitRules identifier active name telecom address gender birthDate",
    "Location": "id meta implicitRules identifier status operationalStatus name alias description mode type physicalType managingOrganization",
    "Condition": "id meta implicitRules identifier clinicalStatus verificationStatus code bodySite subject encounter onset recordedDate recorder asserter",
    "Medication": "id meta implicitRules identifier code status manufacturer amount",
    "CodeSystem": "id meta implicitRules url identifier version name title status experimental date publisher contact useContext jurisdiction caseSensitive valueSet hierarchyMeaning compositional versionNeeded content supplements count filter property",
    "DocumentReference": "id meta implicitRules masterIdentifier identifier status docStatus type category subject date author description securityLabel relatesTo content context",
    "Communication": "id meta implicitRules identifier instantiatesCanonical instantiatesUri basedOn partOf status statusReason priority subject encounter reasonCode reasonReference",
}
_ALWAYS = ("resourceType", "id", "meta")
_TAG = {"system": "http://terminology.hl7.org/CodeSystem/v3-ObservationValue", "code": "SUBSETTED"}


def _members(body: Column) -> Column:
    return F.from_json(body, "map<string,variant>")


def subset(body: Column, keep: Column | None = None, names: list[str] | None = None, drop: list[str] | None = None) -> Column:
    """A JSON body with the named members only (or without some), tagged SUBSETTED."""
    members = _members(body)
    chosen = F.map_filter(members, lambda k, _: k.isin([*_ALWAYS, *names])) if names is not None else F.map_filter(members, lambda k, _: ~k.isin(drop or []))
    meta = F.coalesce(F.from_json(F.to_json(F.get(F.map_values(F.map_filter(members, lambda k, _: k == "meta")), 0)), "map<string,variant>"), F.expr("map()").cast("map<string,variant>"))
    tags = F.coalesce(F.from_json(F.to_json(F.get(F.map_values(F.map_filter(meta, lambda k, _: k == "tag")), 0)), "array<variant>"), F.expr("cast(array() as array<variant>)"))
    tagged = F.exists(tags, lambda t: F.try_variant_get(t, "$.code", "string") == _TAG["code"])
    own = F.parse_json(F.lit('{"system":"%s","code":"%s"}' % (_TAG["system"], _TAG["code"])))
    new_tags = F.when(tagged, tags).otherwise(F.concat(tags, F.array(own)))
    new_meta = F.map_concat(F.map_filter(meta, lambda k, _: k != "tag"), F.create_map(F.lit("tag"), F.parse_json(F.to_json(new_tags))))
    rest = F.map_filter(chosen, lambda k, _: k != "meta")
    return F.to_json(F.map_concat(rest, F.create_map(F.lit("meta"), F.parse_json(F.to_json(new_meta)))))


def elements(body: Column, names: list[str]) -> Column:
    return subset(body, names=names)


def summary(body: Column, mode: str, resource_type: str, known: dict[str, list[str]] | None = None) -> Column:
    """``mode``: text, data, true, or false (the body as it is). ``known``: summary elements by type from loaded definitions, before the fixed ones."""
    if mode == "text":
        return subset(body, names=["text"])
    if mode == "data":
        return subset(body, drop=["text"])
    if mode == "true":
        if known and resource_type in known:
            return subset(body, names=list(known[resource_type]))
        if resource_type in SUMMARY:
            return subset(body, names=SUMMARY[resource_type].split())
        return subset(body, drop=["text", "contained"])
    return body


def _map(value: Column) -> Column:
    return F.coalesce(F.from_json(F.to_json(value), "map<string,variant>"), F.expr("map()").cast("map<string,variant>"))


def put_meta(body: Column, change: Callable[[Column], Column]) -> Column:
    """A JSON body with its meta, a map of variants, changed; a null body stays null."""
    members = _members(body)
    meta = change(_map(_member(members, "meta")))
    return F.to_json(F.map_concat(F.map_filter(members, lambda k, _: k != "meta"), F.create_map(F.lit("meta"), F.parse_json(F.to_json(meta)))))


def _same(key: str, value) -> Callable[[Column], Column]:
    """Whether an item is the tag or label of the value's system and code, or the profile."""
    if key == "profile":
        return lambda i: F.try_variant_get(i, "$", "string").eqNullSafe(F.lit(value))
    return lambda i: F.try_variant_get(i, "$.system", "string").eqNullSafe(F.lit(value.get("system"))) & F.try_variant_get(i, "$.code", "string").eqNullSafe(F.lit(value.get("code")))


def _other(key: str, value) -> Callable[[Column], Column]:
    return lambda i: ~_same(key, value)(i)


def _member(of: Column, name: str) -> Column:
    return F.get(F.map_values(F.map_filter(of, lambda k, _: k == name)), 0)


def change_meta(body: Column, add: dict | None = None, delete: dict | None = None) -> Column:
    """$meta-add and $meta-delete: tags and labels by system and code, profiles by value."""

    def change(meta: Column) -> Column:
        rest = F.map_filter(meta, lambda k, _: ~k.isin("tag", "security", "profile"))
        for key in ("tag", "security", "profile"):
            now = F.coalesce(F.from_json(F.to_json(_member(meta, key)), "array<variant>"), F.expr("cast(array() as array<variant>)"))
            for value in (add or {}).get(key, []):
                now = F.when(F.exists(now, _same(key, value)), now).otherwise(F.concat(now, F.array(F.parse_json(F.lit(json.dumps(value))))))
            for value in (delete or {}).get(key, []):
                now = F.filter(now, _other(key, value))
            rest = F.when(F.size(now) > 0, F.map_concat(rest, F.create_map(F.lit(key), F.parse_json(F.to_json(now))))).otherwise(rest)
        return rest

    return put_meta(body, change)
