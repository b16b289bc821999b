"""From matches to a result page: order, offset and limit, totals, late bodies, includes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import UnsupportedParam
from ..plans.compiler import Compiler
from ..plans.dataset import Dataset
from ..plans.request import Request, Sort
from ..registry import SearchParam

#: The column of an index table that a sort on a parameter of a kind uses.
_SORT_VALUE = {"string": "value_lower", "token": "code", "date": "value_low", "number": "value", "quantity": "value", "uri": "value", "reference": "target_id"}


def search(data: Dataset, request: Request) -> DataFrame:
    """All matching resources with their columns, in no order."""
    return Compiler(data).matches(request.resource_type, request.predicates)


def total(data: Dataset, request: Request) -> DataFrame:
    return search(data, request).agg(F.count("*").alias("total"))


def capped_total(data: Dataset, request: Request, cap: int) -> DataFrame:
    """The number of matches, counted up to ``cap`` and no further."""
    return search(data, request).select("fhir_id").limit(cap).agg(F.count("*").alias("total"))


def with_sort_keys(data: Dataset, rows: DataFrame, resource_type: str, sorts: list[Sort]) -> tuple[DataFrame, list[Column], list[str]]:
    """Rows with a key column for each sort, the order, and the key columns.

    A parameter sorts by its least value ascending and by its greatest
    descending; resources without it come last both ways. Unknown keys are left
    out. fhir_id breaks ties.
    """
    order, keys = [], []
    for k, s in enumerate(sorts):
        if s.name in ("_id", "_lastUpdated"):
            column = F.col("fhir_id" if s.name == "_id" else "last_updated")
        else:
            param = data.registry.get(resource_type, s.name)
            value = _SORT_VALUE.get(param.kind) if param else None
            index = data.index(resource_type, param) if value else None
            if index is None:
                continue
            key = f"_key{k}"
            best = index.groupBy("resource_id").agg((F.max if s.descending else F.min)(value).alias(key))
            rows = rows.join(best, rows["fhir_id"] == best["resource_id"], "left").drop("resource_id")
            keys.append(key)
            column = F.col(key)
        order.append(column.desc_nulls_last() if s.descending else column.asc_nulls_last())
    if not order:
        order.append(F.col("last_updated").desc_nulls_last())
    if not any(s.name == "_id" for s in sorts):
        order.append(F.col("fhir_id").asc())
    return rows, order, keys


def page(data: Dataset, request: Request) -> DataFrame:
    """The request's page with its bodies.

    Matches are cut to the page on ids and sort keys alone (a top-k, no full
    sort); the bodies of at most a page of rows are joined afterwards.
    """
    narrow = search(data, request).select("fhir_id", "last_updated")
    narrow, order, _ = with_sort_keys(data, narrow, request.resource_type, request.sort)
    skip = (request.page - 1) * request.count
    top = narrow.orderBy(*order).offset(skip).limit(request.count).select("fhir_id")
    # a page has at most request.count rows
    return data.resources(request.resource_type).join(F.broadcast(top), "fhir_id", "left_semi") if request.count <= 100_000 else data.resources(request.resource_type).join(top, "fhir_id", "left_semi")


def ordered_page(data: Dataset, request: Request) -> DataFrame:
    """fhir_id and position (from 0) of the request's page."""
    narrow = search(data, request).select("fhir_id", "last_updated")
    narrow, order, keys = with_sort_keys(data, narrow, request.resource_type, request.sort)
    top = narrow.orderBy(*order).offset((request.page - 1) * request.count).limit(request.count)
    from pyspark.sql import Window

    # one task, of a page of rows
    return top.select("fhir_id", (F.row_number().over(Window.orderBy(*order)) - 1).alias("position"))


def _selected(data: Dataset, params: list[SearchParam], selector: str) -> list[SearchParam]:
    """A selector Type:param[:target] names one reference; "*" or a bare type all of them."""
    parts = selector.split(":")
    if len(parts) < 2 or parts[1] == "*":
        return params
    chosen = [p for p in params if p.name == parts[1] and p.resource_type == parts[0]]
    if not chosen:
        raise UnsupportedParam(f"{selector} names no reference")
    return chosen


def forward(data: Dataset, rows: DataFrame, resource_type: str, selector: str = "*") -> DataFrame:
    """(resource_type, fhir_id) of live resources that ``rows`` (fhir_id) of a type point at, distinct."""
    found = []
    for param in _selected(data, data.registry.references(resource_type), selector):
        edges = data.index(resource_type, param)
        if edges is None:
            continue
        edges = edges.join(rows.select(F.col("fhir_id").alias("resource_id")), "resource_id", "left_semi").select("target_type", "target_id").distinct()
        for target in param.targets:
            own = edges.where(F.col("target_type") == target)
            live = data.resources(target).select("fhir_id")
            found.append(live.join(own, live["fhir_id"] == own["target_id"], "left_semi").select(F.lit(target).alias("resource_type"), F.col("fhir_id").cast("string").alias("fhir_id")))
    return _distinct(data, found)


def backward(data: Dataset, rows: DataFrame, resource_type: str, selector: str = "*") -> DataFrame:
    """(resource_type, fhir_id) of live resources that point at ``rows`` of a type, distinct."""
    found = []
    sources = [p for (_, _), p in sorted(data.registry.params.items()) if p.kind == "reference" and resource_type in p.targets]
    for param in _selected(data, sources, selector):
        edges = data.index(param.resource_type, param)
        if edges is None:
            continue
        edges = edges.where(F.col("target_type") == resource_type)
        own = edges.join(rows.select(F.col("fhir_id").alias("target_id")), "target_id", "left_semi").select("resource_id").distinct()
        live = data.resources(param.resource_type).select("fhir_id")
        found.append(live.join(own, live["fhir_id"] == own["resource_id"], "left_semi").select(F.lit(param.resource_type).alias("resource_type"), F.col("fhir_id").cast("string").alias("fhir_id")))
    return _distinct(data, found)


def _distinct(data: Dataset, found: list[DataFrame]) -> DataFrame:
    if not found:
        return data.spark.createDataFrame([], "resource_type string, fhir_id string")
    return reduce(DataFrame.union, found).distinct()


def bundle(data: Dataset, request: Request) -> DataFrame:
    """resource_type, fhir_id, mode ("match" or "include") of a searchset page."""
    rows = ordered_page(data, request).select("fhir_id")
    out = rows.select(F.lit(request.resource_type).alias("resource_type"), F.col("fhir_id").cast("string").alias("fhir_id"), F.lit("match").alias("mode"))
    parts = [forward(data, rows, request.resource_type, s) for s in request.include] + [backward(data, rows, request.resource_type, s) for s in request.revinclude]
    if parts:
        extra = reduce(DataFrame.union, parts).distinct().join(out, ["resource_type", "fhir_id"], "left_anti")
        out = out.unionByName(extra.withColumn("mode", F.lit("include")))
    return out


def searchset(data: Dataset, request: Request, base: str = "", pairs: list[tuple[str, str]] | None = None) -> dict:
    """The searchset bundle of a page: entries with fullUrl, body and mode, links, and the total where it is asked for.

    A page and what it includes are small; they are the answer to one request.
    """
    import json

    from ..plans.request import page_links
    from .project import elements, summary

    known = total(data, request).first()[0] if request.total in ("accurate", "estimate") or request.summary == "count" else None
    out: dict = {"resourceType": "Bundle", "type": "searchset"}
    entries = []
    if request.summary != "count":
        found = bundle(data, request)
        position = ordered_page(data, request).select(F.col("fhir_id").cast("string").alias("fhir_id"), "position")
        parts = []
        for t in sorted({request.resource_type, *data.registry.types()}) if request.include or request.revinclude else [request.resource_type]:
            body = F.col("resource")
            body = elements(body, list(request.elements)) if request.elements else summary(body, request.summary, t)
            rows = data.resources(t).select(F.lit(t).alias("resource_type"), F.col("fhir_id").cast("string").alias("fhir_id"), body.alias("resource"))
            parts.append(rows.join(found, ["resource_type", "fhir_id"]))
        rows = reduce(DataFrame.unionByName, parts).join(position, "fhir_id", "left").orderBy(F.col("mode").desc(), "position", "resource_type", "fhir_id").collect()
        entries = [{"fullUrl": f"{base}/{r.resource_type}/{r.fhir_id}", "resource": json.loads(r.resource), "search": {"mode": r["mode"]}} for r in rows]
    matches = sum(e["search"]["mode"] == "match" for e in entries)
    out["link"] = [{"relation": k, "url": v} for k, v in page_links(f"{base}/{request.resource_type}", pairs or [], request.page, request.count, matches, known).items()]
    if known is not None:
        out["total"] = known
    return out | {"entry": entries} if entries else out
