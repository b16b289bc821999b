"""Operations over the reference graph: everything, document, compartment, last-n, meta."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import TooLarge, UnsupportedParam
from ..plans.compiler import Compiler
from ..plans.dataset import Dataset
from ..plans.request import Request
from ..registry import SearchParam
from .cut import cut
from .page import backward, forward


def _split_types(types: list[str] | tuple[str, ...]) -> list[str]:
    return [t for value in types for t in value.split(",") if t]


def _within(rows: DataFrame, most: int | None, what: str) -> DataFrame:
    """The rows, if there are no more than ``most``; a limit is reported, not applied in silence."""
    if most is not None and rows.limit(most + 1).count() > most:
        raise TooLarge(f"{what}: more than {most}")
    return rows


def everything(data: Dataset, resource_type: str, ids: list | None = None, since: str | None = None, types: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """(resource_type, fhir_id) of the anchors, what they point at and what points at them.

    ``ids=None``: all resources of the type are anchors, in one set-based pass.
    ``since``: only resources updated strictly after it. ``types``: only these.
    ``most``: TooLarge if there are more anchors.
    """
    anchors = data.resources(resource_type).select("fhir_id")
    if ids is not None:
        anchors = anchors.where(F.col("fhir_id").isin(ids))
    _within(anchors, most, f"{resource_type}: anchors")
    own = anchors.select(F.lit(resource_type).alias("resource_type"), F.col("fhir_id").cast("string").alias("fhir_id"))
    found = own.union(forward(data, anchors, resource_type)).union(backward(data, anchors, resource_type)).distinct()
    wanted = _split_types(types)
    if wanted:
        found = found.where(F.col("resource_type").isin(wanted))
    if since is not None:
        from ..functions.bands import _literal, date_band

        after = _literal(date_band(since)[1])
        reachable = {resource_type, *(t for p in data.registry.references(resource_type) for t in p.targets), *(p.resource_type for p in data.registry.params.values() if p.kind == "reference" and resource_type in p.targets)}
        fresh = [data.resources(t).where(F.col("last_updated") > after).select(F.lit(t).alias("resource_type"), F.col("fhir_id").cast("string").alias("fhir_id")) for t in sorted(reachable)]
        found = found.join(reduce(DataFrame.union, fresh), ["resource_type", "fhir_id"], "left_semi")
    return found


def document(data: Dataset, resource_type: str, ids: list, depth: int | None = None, most: int | None = None) -> DataFrame:
    """(resource_type, fhir_id, depth): the anchors and all that their references lead to, by breadth.

    One join a level over the edges that the level's types can have; what has
    been reached is left out by an anti join, so cycles end. Each level is cut.
    ``depth``: levels that are followed, all by default. ``most``: TooLarge if more
    resources are reached.
    """
    anchors = data.resources(resource_type).where(F.col("fhir_id").isin(ids))
    front = cut(anchors.select(F.lit(resource_type).alias("resource_type"), F.col("fhir_id").cast("string").alias("fhir_id")))
    reached, types = front.withColumn("depth", F.lit(0)), {resource_type}
    for level in count(1) if depth is None else range(1, depth + 1):
        edges = edge_list(data, types)
        if edges is None:
            break
        after = edges.join(front, (edges["source_type"] == front["resource_type"]) & (edges["source_id"] == front["fhir_id"]), "left_semi")
        after = after.select(F.col("target_type").alias("resource_type"), F.col("target_id").alias("fhir_id")).distinct()
        front = cut(after.join(reached, ["resource_type", "fhir_id"], "left_anti"))
        if not front.take(1):
            break
        reached = _within(reached.unionByName(front.withColumn("depth", F.lit(level))), most, f"{resource_type}: a document's resources")
        types = {t for s in types for p in data.registry.references(s) for t in p.targets}
    return reached


def edge_list(data: Dataset, types: set[str] | None = None) -> DataFrame | None:
    """References (of some source types) as (source_type, source_id, param_name, target_type, target_id), ids as strings; None without any."""
    found = []
    for (t, name), p in sorted(data.registry.params.items()):
        rows = data.index(t, p) if p.kind == "reference" and (types is None or t in types) else None
        if rows is not None:
            found.append(rows.select(F.lit(t).alias("source_type"), F.col("resource_id").cast("string").alias("source_id"), F.lit(name).alias("param_name"), "target_type", F.col("target_id").cast("string").alias("target_id")))
    return reduce(DataFrame.union, found) if found else None


def compartment(data: Dataset, owner_type: str, owner_id, target_type: str, request: Request | None = None, most: int | None = None) -> DataFrame:
    """Resources of a type in the owner's compartment: any of its listed references points at the owner. ``most``: TooLarge if one of them gives more."""
    names = data.registry.compartments.get((owner_type, target_type))
    if not names:
        raise UnsupportedParam(f"{target_type} is not in the {owner_type} compartment")
    sets = []
    for name in names:
        param = data.registry.get(target_type, name)
        rows = data.index(target_type, param) if param else None
        if rows is not None:
            own = rows.where((F.col("target_type") == owner_type) & (F.col("target_id") == owner_id)).select("resource_id")
            sets.append(_within(own, most, f"{owner_type}/{owner_id}: {target_type} by {name}"))
    if not sets:
        raise UnsupportedParam(f"no reference of {target_type} to {owner_type} is indexed")
    ids = reduce(DataFrame.union, sets).distinct()
    rows = Compiler(data).matches(target_type, request.predicates if request else [])
    return rows.join(ids, rows["fhir_id"] == ids["resource_id"], "left_semi")


#: Filters that last_n looks at; others are ignored.
LAST_N_FILTERS = ("patient", "subject", "category", "code")


def last_n(data: Dataset, request: Request, most: int = 1, resource_type: str = "Observation") -> DataFrame:
    """(fhir_id, rank): for each code the ``most`` latest resources; one of several codes is given once, by its best rank.

    The latest is by the date parameter's band, and by last_updated without
    one. Resources without a code have no group and are left out.
    """
    kept = [p for p in request.predicates if getattr(p, "name", getattr(p, "reference", "")) in LAST_N_FILTERS]
    rows = Compiler(data).matches(resource_type, kept).select("fhir_id", "last_updated")
    codes = data.index(resource_type, data.registry.get(resource_type, "code")).select("resource_id", "system", "code").distinct()
    dates = data.index(resource_type, data.registry.get(resource_type, "date")).groupBy("resource_id").agg(F.max("value_low").alias("at"))
    joined = rows.join(codes, rows["fhir_id"] == codes["resource_id"]).drop("resource_id")
    joined = joined.join(dates, joined["fhir_id"] == dates["resource_id"], "left").drop("resource_id")
    # the limit on row_number lets each task keep its own best rows of a code before the shuffle
    latest = Window.partitionBy("system", "code").orderBy(F.coalesce("at", "last_updated").desc(), F.col("fhir_id").asc())
    ranked = joined.withColumn("rank", F.row_number().over(latest)).where(F.col("rank") <= most)
    return ranked.groupBy("fhir_id").agg(F.min("rank").alias("rank"))


def meta(data: Dataset, resource_type: str | None = None, ids: list | None = None) -> DataFrame:
    """(kind, system, code) distinct over tags, security labels and profiles of a type (or all) or of some ids."""
    found = []
    for t in [resource_type] if resource_type else data.registry.types():
        for name, kind in (("_tag", "tag"), ("_security", "security"), ("_profile", "profile"), ("_language", "language")):
            rows = data.index(t, SearchParam("Resource", name, "uri" if name == "_profile" else "token"))
            if rows is None:
                continue
            if ids is not None:
                rows = rows.where(F.col("resource_id").isin(ids))
            value = [F.lit("").alias("system"), F.col("value").alias("code")] if name == "_profile" else [F.coalesce("system", F.lit("")).alias("system"), "code"]
            found.append(rows.select(F.lit(kind).alias("kind"), *value))
    if not found:
        return data.spark.createDataFrame([], "kind string, system string, code string")
    return reduce(DataFrame.union, found).distinct()
