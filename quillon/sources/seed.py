"""Parameter definitions from CSV files and from implementation-guide packages."""

from __future__ import annotations

import json
import os
import re
import tarfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import NotFound
from ..registry import KINDS, Registry, SearchParam

#: Header names that a column may go by.
ALIASES = {
    "resource_type": ("resource_type", "resourcetype", "base", "resource"),
    "name": ("name", "param_name", "code", "param"),
    "kind": ("kind", "type", "param_type"),
    "expression": ("expression", "fhirpath", "path"),
    "targets": ("targets", "target", "target_types"),
    "components": ("components", "component"),
}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """resource_type, name, kind, expression, targets, components; rows without a type or name are skipped."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    by_name = {c.strip().lower(): c for c in raw.columns}
    columns = [next((F.trim(F.col(f"`{by_name[a]}`")) for a in names if a in by_name), F.lit(None)).cast("string").alias(c) for c, names in ALIASES.items()]
    return raw.select(*columns).where("coalesce(resource_type, '') <> '' and coalesce(name, '') <> ''")


def register_csv(registry: Registry, rows: DataFrame, replace: bool = True) -> int:
    """Registers definitions (a bounded list); returns their number. Targets and components are separated by "|"."""
    n = 0
    for r in rows.collect():
        if (r.kind or "").lower() not in KINDS:
            continue
        split = lambda text: tuple(x.strip() for x in (text or "").replace(",", "|").split("|") if x.strip())
        components = tuple(tuple(c.rsplit("=", 1)) for c in split(r.components) if "=" in c)
        registry.register(SearchParam(r.resource_type, r.name, r.kind.lower(), r.expression or "", split(r.targets), components), replace=replace)
        n += 1
    return n


def from_resource(resource: dict) -> list[SearchParam]:
    """The definitions of a SearchParameter resource, one for each base type."""
    kind = resource.get("type", "")
    if resource.get("resourceType") != "SearchParameter" or kind not in KINDS or not resource.get("code"):
        return []
    out = []
    for base in resource.get("base", []):
        parts = [p.strip() for p in (resource.get("expression") or "").split("|")]
        own = [p for p in parts if p.lstrip("(").startswith(f"{base}.")] or parts
        out.append(SearchParam(base, resource["code"], kind, " | ".join(own), tuple(resource.get("target", ()))))
    return out


def read_package(path: str) -> tuple[list[dict], list[dict]]:
    """(SearchParameter, StructureDefinition) resources of a package file (.tgz)."""
    params, profiles = [], []
    with tarfile.open(path, "r:gz") as archive:
        for entry in archive:
            name = entry.name.rsplit("/", 1)[-1]
            if not entry.isfile() or not name.endswith(".json") or not name.startswith(("SearchParameter-", "StructureDefinition-")):
                continue
            body = json.load(archive.extractfile(entry))
            {"SearchParameter": params, "StructureDefinition": profiles}.get(body.get("resourceType"), []).append(body)
    return params, profiles


def find_package(spec: str, cache: str, fetch: Callable[[str, str, str], None] | None = None) -> str:
    """The file of a package: a path as it is, or name@version from the cache folder, where ``fetch(name, version, to)`` puts what it lacks."""
    name, at, version = spec.rpartition("@")
    if not at or os.path.exists(spec):
        return spec
    if not re.fullmatch(r"[a-z0-9][a-z0-9._-]*", name) or not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9.+-]*", version):
        raise NotFound(f"{spec} names no package")
    file = os.path.join(cache, f"{name}-{version}.tgz")
    if not os.path.exists(file):
        if fetch is None:
            raise NotFound(f"{spec} is not in the cache")
        part = f"{file}.{os.getpid()}"
        fetch(name, version, part)
        os.replace(part, file)
    return file


def load_package(registry: Registry, path: str, loaded: set[str]) -> tuple[int, list[dict]]:
    """Registers a package's parameters where the registry lacks them; a package is loaded once. Returns their number and its profiles."""
    if path in loaded:
        return 0, []
    params, profiles = read_package(path)
    found = [p for r in params for p in from_resource(r)]
    before = len(registry.params)
    registry.register(*found, replace=False)
    loaded.add(path)
    return len(registry.params) - before, profiles


def sync_parameter(registry: Registry, resource: dict, gone: bool = False) -> tuple[tuple[str, str], ...]:
    """Registers (or removes) a SearchParameter resource's definitions; returns the (type, name) pairs that changed, for extract.reindex()."""
    found = from_resource(resource)
    for p in found:
        if gone:
            registry.remove(p.resource_type, p.name)
        else:
            registry.register(p)
    return tuple((p.resource_type, p.name) for p in found)


def profiles_by_type(definitions: DataFrame) -> DataFrame:
    """(type, profiles): the URLs of the profiles of each type; ``definitions``: url, type, definition (JSON) with its derivation."""
    derived = F.coalesce(F.get_json_object("definition", "$.derivation"), F.lit("constraint")) == "constraint"
    return definitions.where(derived).groupBy("type").agg(F.sort_array(F.collect_set("url")).alias("profiles"))


def summary_elements(definitions: DataFrame) -> DataFrame:
    """(type, names): the top-level elements that base definitions mark isSummary, choice names without "[x]", for project.summary()."""
    elements = definitions.select("type", F.explode(F.try_variant_get(F.parse_json("definition"), "$.snapshot.element", "array<variant>")).alias("e"))
    path = F.try_variant_get("e", "$.path", "string")
    top = elements.where(F.coalesce(F.try_variant_get("e", "$.isSummary", "boolean"), F.lit(False)) & (F.size(F.split(path, "[.]")) == 2))
    return top.groupBy("type").agg(F.sort_array(F.collect_set(F.regexp_replace(F.split(path, "[.]")[1], r"\[x\]$", ""))).alias("names"))


def base_definitions(spark: SparkSession, path: str) -> DataFrame:
    """url, type, definition (JSON) of the resource types in a bundle of StructureDefinitions."""
    entries = spark.read.text(path, wholetext=True).select(F.explode(F.try_variant_get(F.parse_json("value"), "$.entry", "array<variant>")).alias("e"))
    body = F.try_variant_get("e", "$.resource", "variant")
    get = lambda p: F.try_variant_get(body, f"$.{p}", "string")
    return entries.where((get("kind") == "resource") & (get("derivation") == "specialization")).select(get("url").alias("url"), get("type").alias("type"), F.to_json(body).alias("definition"))
