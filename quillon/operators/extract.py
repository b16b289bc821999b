"""Index rows from resources: a pure function of the version log.

Each parameter compiles to an array column by its kind, all parameters of a kind
are joined into one array, and one explode a kind gives the rows. Recomputing them
needs no bookkeeping, so a new parameter is a new column, not a migration.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import TooLarge
from ..functions import fhirpath as P
from ..functions.bands import date_columns, period_columns, value_band
from ..registry import UNIVERSAL, Registry, SearchParam
from ..schema import INDEX_COLUMNS, index_schema, value_columns


def _get(item: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(item, f"$.{path}", kind)


def _is_object(item: Column) -> Column:
    return F.try_variant_get(item, "$", "map<string,variant>").isNotNull()


def _leaves(item: Column) -> Column:
    """The string leaves of an item down to two levels: a name's family and given names, an address's lines."""
    inner = F.map_values(F.coalesce(F.try_variant_get(item, "$", "map<string,variant>"), F.expr("map()").cast("map<string,variant>")))
    below = F.flatten(F.transform(inner, P.as_array))
    return F.when(_is_object(item), F.filter(F.transform(below, lambda v: F.when(~_is_object(v), P.text_of(v))), lambda s: s.isNotNull())).otherwise(F.array(P.text_of(item)))


def _strings(items: Column) -> Column:
    texts = F.filter(F.flatten(F.transform(items, _leaves)), lambda s: s.isNotNull() & (s != ""))
    return F.transform(texts, lambda s: F.struct(s.alias("value_exact"), F.lower(s).alias("value_lower")))


def _token(system: Column, code: Column, display: Column) -> Column:
    return F.struct(system.alias("system"), code.alias("code"), display.alias("display"))


def _codings(item: Column) -> Column:
    """Of a CodeableConcept one token a coding; of a Coding, Identifier, ContactPoint or plain value one."""
    concept = F.transform(P.named(F.array(item), "coding"), lambda c: _token(_get(c, "system"), _get(c, "code"), F.coalesce(_get(c, "display"), _get(item, "text"))))
    single = _token(_get(item, "system"), F.coalesce(_get(item, "code"), _get(item, "value")), F.coalesce(_get(item, "display"), _get(item, "text")))
    plain = _token(F.lit(None).cast("string"), P.text_of(item), F.lit(None).cast("string"))
    return P.once(concept, lambda c: F.when(F.size(c) > 0, c).when(_is_object(item), F.array(single)).otherwise(F.array(plain)))


def _tokens(items: Column) -> Column:
    return F.filter(F.flatten(F.transform(items, _codings)), lambda t: t["code"].isNotNull() & (t["code"] != ""))


def _typed_identifiers(items: Column) -> Column:
    """Rows for :of-type: the type's system|code and the identifier's value."""

    def one(item: Column) -> Column:
        return F.transform(P.named(F.array(item), "type.coding"), lambda c: _token(F.concat_ws("|", F.coalesce(_get(c, "system"), F.lit("")), _get(c, "code")), _get(item, "value"), F.lit(None).cast("string")))

    return F.filter(F.flatten(F.transform(items, one)), lambda t: t["code"].isNotNull())


def _dates(items: Column) -> Column:
    def one(item: Column) -> Column:
        low, high = date_columns(P.text_of(item))
        start, end = period_columns(_get(item, "start"), _get(item, "end"))
        return F.struct(F.when(_is_object(item), start).otherwise(low).alias("value_low"), F.when(_is_object(item), end).otherwise(high).alias("value_high"))

    return F.filter(F.transform(items, one), lambda d: d["value_low"].isNotNull() & d["value_high"].isNotNull())


def _numbers(items: Column) -> Column:
    def one(item: Column) -> Column:
        value = F.try_variant_get(item, "$", "string").try_cast("double")
        low, high = value_band(value)
        return F.struct(value.cast("decimal(20,6)").alias("value"), low.alias("value_low"), high.alias("value_high"))

    return F.filter(F.transform(items, one), lambda n: n["value"].isNotNull())


def _quantity(item: Column) -> Column:
    value = _get(item, "value").try_cast("double")
    low, high = value_band(value)
    return F.struct(value.cast("decimal(20,6)").alias("value"), low.alias("value_low"), high.alias("value_high"), _get(item, "system").alias("system"), F.coalesce(_get(item, "code"), _get(item, "unit")).alias("code"))


def _quantities(items: Column) -> Column:
    return F.filter(F.transform(items, _quantity), lambda q: q["value"].isNotNull())


def _uris(items: Column) -> Column:
    return F.filter(F.transform(items, lambda i: F.struct(P.text_of(i).alias("value"))), lambda u: u["value"].isNotNull() & (u["value"] != ""))


def _references(items: Column) -> Column:
    def one(item: Column) -> Column:
        text = F.regexp_replace(F.coalesce(_get(item, "reference"), F.when(~_is_object(item), P.text_of(item))), r"/_history/.*$", "")
        empty = lambda c: P.once(c, lambda v: F.when(v != "", v))

        def parts(text: Column) -> Column:
            kind, own = F.regexp_extract(text, r"([A-Za-z]+)/([^/]+)/?$", 1), F.regexp_extract(text, r"([^/]+)/?$", 1)
            return F.struct(empty(kind).alias("target_type"), empty(own).alias("target_id"), _get(item, "identifier.system").alias("identifier_system"), _get(item, "identifier.value").alias("identifier_value"))

        return P.once(text, parts)

    return F.filter(F.transform(items, one), lambda r: r["target_id"].isNotNull() | r["identifier_value"].isNotNull())


_EXTRACT = {"string": _strings, "token": _tokens, "date": _dates, "number": _numbers, "quantity": _quantities, "uri": _uris, "reference": _references}


def _composites(param: SearchParam, resource: Column) -> Column:
    """Token and quantity pairs within one element: every coding with every quantity."""
    element = P.evaluate(param.expression, resource) if param.expression else F.array(resource)
    code_path, value_path = (c for c, _ in param.components)

    def pairs(item: Column) -> Column:
        codes = _tokens(P.items_of(P.parse(code_path), F.array(item)))
        values = _quantities(P.items_of(P.parse(value_path), F.array(item)))
        both = F.transform(
            codes,
            lambda c: F.transform(
                values,
                lambda q: F.struct(c["system"].alias("system"), c["code"].alias("code"), q["value"].alias("value"), q["value_low"].alias("value_low"), q["value_high"].alias("value_high"), q["system"].alias("qty_system"), q["code"].alias("qty_code")),
            ),
        )
        return F.flatten(both)

    return F.flatten(F.transform(element, pairs))


def index_rows(log: DataFrame, registry: Registry, resource_type: str, kind: str) -> DataFrame:
    """All rows of one kind's index table for one type; ``log``: rows with ``resource`` a JSON string. A row carries the version that it was made from."""
    rows = log.where(F.col("resource_type") == resource_type)
    body = F.col("body")
    arrays = []

    def named(name: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(name).alias("param_name"), *(v[c].alias(c) for c in value_columns(kind))))

    for param in [p for p in registry.of_type(resource_type) if p.expression or p.components] + list(UNIVERSAL.values()):
        if param.kind != kind:
            continue
        if kind == "composite":
            if tuple(k for _, k in param.components) == ("token", "quantity"):
                arrays.append(named(param.name, _composites(param, body)))
            continue
        items = P.evaluate(param.expression, body)
        arrays.append(named(param.name, _EXTRACT[kind](items)))
        if kind == "token" and param.name == "identifier":
            arrays.append(named(f"{param.name}:of-type", _typed_identifiers(items)))
    parsed = rows.select("tenant_id", F.col("fhir_id").alias("resource_id"), "version_id", "resource_type", "last_updated", F.parse_json("resource").alias("body"))
    if not arrays:
        return parsed.where("false").select("tenant_id", "resource_id", "version_id", "resource_type", F.lit("").alias("param_name"), "last_updated", *(F.lit(None).cast(c.split(" ", 1)[1]).alias(c.split()[0]) for c in INDEX_COLUMNS[kind].split(", ")))
    # the outer form keeps the optimiser from adding a filter that extracts once more
    each = parsed.select("tenant_id", "resource_id", "version_id", "resource_type", "last_updated", F.explode_outer(reduce(lambda a, b: F.concat(a, b), arrays)).alias("v")).where("v is not null")
    return each.select("tenant_id", "resource_id", "version_id", "resource_type", "v.param_name", "last_updated", *(F.col(f"v.{c}") for c in value_columns(kind)))


def guard(rows: DataFrame, most: int) -> DataFrame:
    """The rows, if no resource has more than ``most`` of them."""
    over = rows.groupBy("resource_type", "resource_id").count().where(F.col("count") > most).take(1)
    if over:
        raise TooLarge(f"{over[0].resource_type}/{over[0].resource_id} gives {over[0]['count']} index rows")
    return rows


def row_counts(log: DataFrame, registry: Registry, resource_type: str) -> DataFrame:
    """(kind, param_name, n): index rows of a type by table and parameter, to see what a write limit is spent on."""
    parts = [index_rows(log, registry, resource_type, kind).select(F.lit(kind).alias("kind"), "param_name") for kind in INDEX_COLUMNS]
    return reduce(DataFrame.union, parts).groupBy("kind", "param_name").agg(F.count("*").alias("n"))


_VERSION = ("tenant_id", "resource_type", "resource_id", "version_id")


def current_rows(rows: DataFrame, current: DataFrame) -> DataFrame:
    """Stored index rows without those of superseded or deleted versions. ``current``: the log's current state; no body is read of it."""
    return rows.join(current.select("tenant_id", "resource_type", F.col("fhir_id").alias("resource_id"), "version_id"), list(_VERSION), "left_semi")


def _write(rows: DataFrame, kind: str, path: str) -> None:
    rows.sortWithinPartitions("resource_type", "param_name", value_columns(kind)[0]).write.mode("overwrite").partitionBy("resource_type", "param_name").parquet(path)


def write_index(log: DataFrame, registry: Registry, path: str, batch: int = -1) -> None:
    """All index tables as Parquet, a folder a kind and batch, partitioned by type and parameter and sorted by value for tight row-group statistics.

    Any versions may be in ``log``; readers keep the rows of current ones. A batch
    that is written again replaces its own rows.
    """
    for kind in INDEX_COLUMNS:
        rows = reduce(DataFrame.unionByName, [index_rows(log.where("not is_deleted"), registry, t, kind) for t in registry.types()])
        _write(rows.repartition("resource_type", "param_name", F.pmod(F.xxhash64("resource_id"), F.lit(64))), kind, f"{path}/{kind}/batch={batch}")


def stored_rows(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """What write_index() has put in a folder, batch by batch."""
    return spark.read.schema(f"{index_schema(kind)}, batch long").parquet(f"{path}/{kind}").drop("batch")


def reindex(spark: SparkSession, path: str, to: str, log: DataFrame, registry: Registry, changed: tuple[tuple[str, str], ...] = ()) -> None:
    """The stored index without superseded rows, as one batch elsewhere.

    ``changed``: (type, parameter) pairs whose definition is new or gone. Their rows
    are made again from the log, and all others are kept as they are.
    """
    from .log import latest

    current = latest(log)
    for kind in INDEX_COLUMNS:
        rows = current_rows(stored_rows(spark, path, kind), current)
        for resource_type, name in changed:
            rows = rows.where(~((F.col("resource_type") == resource_type) & F.col("param_name").isin(name, f"{name}:of-type")))
            param = registry.get(resource_type, name)
            if param is not None and param.kind == kind:
                one = Registry()
                one.register(param)
                rows = rows.unionByName(index_rows(current, one, resource_type, kind).where(F.col("param_name").isin(name, f"{name}:of-type")).select(*rows.columns))
        _write(rows.repartition("resource_type", "param_name", F.pmod(F.xxhash64("resource_id"), F.lit(64))), kind, f"{to}/{kind}/batch=-1")
