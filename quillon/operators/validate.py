"""Validation against profiles, compiled to columns.

A StructureDefinition compiles to a list of rules, a rule to a boolean column over
the resource as VARIANT; all rules of a profile run in one projection and give
issue rows (severity, code, expression, diagnostics).
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import UnsupportedParam
from ..functions import fhirpath as P
from .log import latest, read

#: Elements that the base specification requires of types whose definitions are not loaded.
REQUIRED = {
    "Observation": ("status", "code"),
    "Condition": ("subject",),
    "Encounter": ("status", "class"),
    "MedicationRequest": ("status", "intent", "subject"),
    "DiagnosticReport": ("status", "code"),
}
#: Constraints that every type inherits; broken ones are warnings.
_BASE_PREFIXES = ("ele-", "ext-", "dom-")


@dataclass
class Profile:
    type: str
    minimum: dict[str, int] = field(default_factory=dict)
    absent: list[str] = field(default_factory=list)
    fixed: dict[str, object] = field(default_factory=dict)
    pattern: dict[str, object] = field(default_factory=dict)
    invariants: list[tuple[str, str, str, str, str]] = field(default_factory=list)
    slices: dict[str, list[tuple[str, object]]] = field(default_factory=dict)


def compile_profile(definition: dict) -> Profile:
    """The constraints of a StructureDefinition's snapshot, by path below the type."""
    root = definition.get("type") or ""
    out = Profile(root)
    elements = definition.get("snapshot", {}).get("element", [])
    slice_minimum: dict[str, int] = {}
    for e in elements:
        path = e.get("path", "")
        own = path[len(root) + 1 :] if path.startswith(f"{root}.") else ""
        value = next(((k, v) for k, v in e.items() if k.startswith(("fixed", "pattern"))), None)
        for c in e.get("constraint", []):
            out.invariants.append((own, c.get("key", ""), "warning" if c.get("key", "").startswith(_BASE_PREFIXES) else c.get("severity", "error"), c.get("expression", ""), c.get("human", "")))
        if not own:
            continue
        if e.get("sliceName"):
            if e.get("min", 0) >= 1:
                slice_minimum[f"{own}:{e['sliceName']}"] = e["min"]
                if value:
                    out.slices.setdefault(own, []).append((e["sliceName"], value[1]))
            continue
        if ":" in e.get("id", ""):
            # an element below a slice: it constrains that slice alone
            head, _, name = e["id"].partition(":")
            name = name.split(".")[0]
            base = head[len(root) + 1 :]
            if value and f"{base}:{name}" in slice_minimum:
                inner = own[len(base) + 1 :]
                wanted = value[1]
                for step in reversed(inner.split(".")):
                    wanted = {step: wanted}
                out.slices.setdefault(base, []).append((name, wanted))
            continue
        if e.get("min", 0) >= 1:
            out.minimum[own] = e["min"]
        if e.get("max") == "0":
            out.absent.append(own)
        if value:
            (out.fixed if value[0].startswith("fixed") else out.pattern)[own] = value[1]
    return out


def contains(item: Column, pattern) -> Column:
    """Whether a variant holds all that a pattern says: members of objects, some item for each of an array's."""
    if isinstance(pattern, dict):
        test = F.lit(True)
        for key, value in pattern.items():
            held = P.named(F.array(item), key)
            wanted = value if isinstance(value, list) else [value]
            for w in wanted:
                test = test & F.exists(held, _holding(w))
        return test
    if isinstance(pattern, list):
        return _and([F.exists(P.as_array(item), _holding(w)) for w in pattern])
    if isinstance(pattern, bool):
        return F.coalesce(F.try_variant_get(item, "$", "boolean") == pattern, F.lit(False))
    if isinstance(pattern, int | float):
        return F.coalesce(F.try_variant_get(item, "$", "double") == float(pattern), F.lit(False))
    return F.coalesce(P.text_of(item) == str(pattern), F.lit(False))


def _holding(pattern):
    """contains() with the pattern bound, as a function of an item alone."""
    return lambda i: contains(i, pattern)


def _lacking(pattern):
    return lambda i: ~contains(i, pattern)


def _and(tests: list[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def _walk(body: Column, path: str) -> Column:
    items = F.array(body)
    for name in path.replace("[x]", "").split(".") if path else []:
        items = P.member(items, name)
    return items


def _issue(severity: str, code: str, expression: str, diagnostics: str, broken: Column) -> Column:
    return F.when(broken, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit(expression).alias("expression"), F.lit(diagnostics).alias("diagnostics")))


def _holding_all(patterns: list):
    return lambda i: _and([contains(i, p) for p in patterns])


def _short(name: str, least: int):
    return lambda i: F.size(P.member(F.array(i), name)) < least


def _unequal(value):
    """Not the same object or array: a part is lacking, or there is more than the parts."""
    size = len(json.dumps(value, separators=(",", ":"), ensure_ascii=False))
    return lambda i: ~(contains(i, value) & (F.length(F.to_json(i)) == size))


def _breaking(expression: str):
    P.parse(expression)
    return lambda i: ~P.check(expression, i)


def rules(profile: Profile, body: Column) -> list[Column]:
    """An issue or null for each constraint."""
    out = []
    at = lambda path: f"{profile.type}.{path}" if path else profile.type
    for path, n in sorted(profile.minimum.items()):
        above, _, leaf = path.rpartition(".")
        # only where the parent is present, and then in each of its occurrences
        short = F.exists(_walk(body, above), _short(leaf.replace("[x]", ""), n))
        out.append(_issue("error", "required", at(path), f"{at(path)} needs at least {n}", short))
    for path in profile.absent:
        out.append(_issue("error", "structure", at(path), f"{at(path)} is not allowed", F.size(_walk(body, path)) > 0))
    for path, value in sorted(profile.fixed.items()):
        exact = json.dumps(value, sort_keys=True)
        if isinstance(value, dict | list):
            wrong = F.exists(_walk(body, path), _unequal(value))
        else:
            wrong = F.exists(_walk(body, path), _lacking(value))
        out.append(_issue("error", "value", at(path), f"{at(path)} must be {exact}", wrong))
    for path, value in sorted(profile.pattern.items()):
        out.append(_issue("error", "value", at(path), f"{at(path)} must hold {json.dumps(value, sort_keys=True)}", F.exists(_walk(body, path), _lacking(value))))
    for path, named in sorted(profile.slices.items()):
        by_name: dict[str, list] = {}
        for name, pattern in named:
            by_name.setdefault(name, []).append(pattern)
        for name, patterns in by_name.items():
            none = ~F.exists(_walk(body, path), _holding_all(patterns))
            parent = path.rpartition(".")[0]
            out.append(_issue("error", "required", f"{at(path)}:{name}", f"slice {name} is missing", none & (F.size(_walk(body, parent)) > 0)))
    for path, key, severity, expression, human in profile.invariants:
        try:
            broken = F.exists(_walk(body, path), _breaking(expression))
        except UnsupportedParam:
            continue  # an expression outside the subset is not judged
        out.append(_issue(severity, "invariant", at(path), f"{key}: {human}", broken))
    return out


def required(resource_type: str, body: Column) -> list[Column]:
    """Missing or empty elements of the types with a list of their own."""

    def empty(name: str) -> Column:
        return F.forall(P.member(F.array(body), name), lambda i: F.to_json(i).isin('""', "{}", "[]"))

    return [_issue("error", "required", f"{resource_type}.{n}", f"{resource_type}.{n} is missing", empty(n)) for n in REQUIRED.get(resource_type, ())]


def validate(resources: DataFrame, profile: Profile) -> DataFrame:
    """fhir_id and issue columns, one row an issue; ``resources``: fhir_id, resource (JSON)."""
    body = F.col("body")
    every = rules(profile, body) + required(profile.type, body)
    parsed = resources.select("fhir_id", F.try_parse_json("resource").alias("body"), F.col("resource"))
    wrong = _issue("fatal", "structure", profile.type, f"not a {profile.type}", F.coalesce(F.try_variant_get(body, "$.resourceType", "string"), F.lit("")) != profile.type)
    issues = parsed.select("fhir_id", F.explode_outer(F.array_compact(F.array(wrong, *every))).alias("i")).where("i is not null")
    return issues.select("fhir_id", "i.severity", "i.code", "i.expression", "i.diagnostics")


def validate_instance(log: DataFrame, resource_type: str, fhir_id, profile: Profile) -> DataFrame:
    """The issues of one resource's current version; NotFound or Gone where there is none."""
    return validate(read(log, resource_type, fhir_id), profile)


def validate_system(log: DataFrame, profiles: dict[str, list[Profile]]) -> DataFrame:
    """resource_type, profile (its place in the type's list) and issues of the current versions of all types that have profiles."""
    current, parts = latest(log), []
    for resource_type, own in sorted(profiles.items()):
        rows = current.where(F.col("resource_type") == resource_type)
        parts += [validate(rows, p).select(F.lit(resource_type).alias("resource_type"), F.lit(k).alias("profile"), "*") for k, p in enumerate(own)]
    if not parts:
        raise UnsupportedParam("no profile is given")
    return reduce(DataFrame.unionByName, parts)
