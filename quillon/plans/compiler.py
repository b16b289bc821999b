"""Predicates as id sets, and their algebra as semi and anti joins.

A parameter is multi-valued, so a predicate is an existence test: the index rows
for which it holds, cut to their distinct resource ids. OR is one union of id
sets, AND a chain of semi joins, NOT an anti join. Chains and reverse chains nest
from the inside out, one semi join a hop. Comparisons stand on stored columns
alone, so scans take them as pushed filters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import UnsupportedParam
from ..functions.bands import date_range, number_range, split_prefix
from ..registry import SearchParam
from . import request as R
from .dataset import Dataset

#: Hops that a chain may have.
MAX_CHAIN = 6
#: Levels that a concept hierarchy may have; a deeper one is an error.
MAX_DEPTH = 90

_MODIFIERS = {
    "string": {"", "exact", "contains", "endswith"},
    "token": {"", "text", "of-type", "in", "not-in", "below", "above"},
    "date": {""},
    "number": {""},
    "quantity": {""},
    "uri": {"", "below", "above"},
    "composite": {""},
}


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


class Compiler:
    def __init__(self, data: Dataset):
        self.data = data

    # -- id sets

    def _index(self, resource_type: str, param: SearchParam) -> DataFrame:
        rows = self.data.index(resource_type, param)
        if rows is None:
            raise UnsupportedParam(f"{resource_type}.{param.name} is not indexed")
        return rows

    def _empty(self, resource_type: str) -> DataFrame:
        return self.data.resources(resource_type).select(F.col("fhir_id").alias("resource_id")).where("false")

    def matches(self, resource_type: str, predicates: list) -> DataFrame:
        """The resources for which all predicates hold, with all their columns."""
        rows = self.data.resources(resource_type)
        for p in predicates:
            rows = self._restrict(rows, resource_type, p)
        return rows

    def _restrict(self, rows: DataFrame, resource_type: str, p) -> DataFrame:
        if isinstance(p, R.Value) and p.name == "_id":
            if p.modifier:
                raise UnsupportedParam("_id takes no modifier")
            return rows.where(F.col("fhir_id").isin(list(p.values)))
        if isinstance(p, R.Value) and p.name == "_lastUpdated":
            return rows.where(_any([date_range(*split_prefix(v)).column(F.col("last_updated"), F.col("last_updated")) for v in p.values]))
        if isinstance(p, R.And):
            return reduce(lambda r, q: self._restrict(r, resource_type, q), p.parts, rows)
        ids, negated = self.ids(resource_type, p)
        return rows.join(ids, rows["fhir_id"] == ids["resource_id"], "left_anti" if negated else "left_semi")

    def ids(self, resource_type: str, p) -> tuple[DataFrame, bool]:
        """(distinct resource_id, negated) of a predicate."""
        if isinstance(p, R.Not):
            ids, negated = self.ids(resource_type, p.inner)
            return ids, not negated
        if isinstance(p, R.Or):
            parts = [self._positive(resource_type, q) for q in p.parts]
            return reduce(DataFrame.union, parts).distinct(), False
        if isinstance(p, R.And) or isinstance(p, R.Value) and p.name in ("_id", "_lastUpdated"):
            return self._positive(resource_type, p), False
        if isinstance(p, R.Chain):
            return self._chain(resource_type, p, 1), False
        if isinstance(p, R.Has):
            return self._has(resource_type, p), False
        return self._value(resource_type, p)

    def _positive(self, resource_type: str, p) -> DataFrame:
        if not isinstance(p, R.And | R.Value) or isinstance(p, R.Value) and p.name not in ("_id", "_lastUpdated"):
            ids, negated = self.ids(resource_type, p)
            if not negated:
                return ids
        return self._restrict(self.data.resources(resource_type), resource_type, p).select(F.col("fhir_id").alias("resource_id"))

    def _value(self, resource_type: str, p: R.Value) -> tuple[DataFrame, bool]:
        if p.name in ("_text", "_content"):
            return self._text(resource_type, p), False
        if p.name == "_list":
            return self._listed(resource_type, p), False
        param, modifier = self.data.registry.get(resource_type, p.name), p.modifier
        if modifier == "missing":
            present = self._present(resource_type, param, p.name)
            return present, p.values[0] == "true"
        if modifier.startswith("_filter_"):
            return self._filtered(resource_type, param, p)
        if param is None:
            ids = self._heuristic(resource_type, R.Value(p.name, "" if modifier == "not" else modifier, p.values))
            return ids, modifier == "not"
        if modifier in ("not", "not-in"):
            inner = R.Value(p.name, "in" if modifier == "not-in" else "", p.values)
            return self._value(resource_type, inner)[0], True
        return self._any_value(resource_type, param, modifier, p.values), False

    def _present(self, resource_type: str, param: SearchParam | None, name: str) -> DataFrame:
        if param is None:
            return self._empty(resource_type)
        return self._index(resource_type, param).select("resource_id").distinct()

    def _any_value(self, resource_type: str, param: SearchParam, modifier: str, values: tuple[str, ...]) -> DataFrame:
        kind = param.kind
        if kind == "special":
            raise UnsupportedParam(f"{param.name} cannot be searched")
        if kind in _MODIFIERS and modifier not in _MODIFIERS[kind]:
            raise UnsupportedParam(f"{param.name}:{modifier} is not supported for a {kind} parameter")
        if kind == "composite":
            return self._composite(resource_type, param, values)
        if kind == "token" and modifier in ("in", "below", "above"):
            return self._by_concepts(resource_type, param, modifier, values)
        if kind == "token" and modifier == "of-type":
            rows = self._index(resource_type, SearchParam(param.resource_type, f"{param.name}:of-type", "token", param.expression))
            return rows.where(_any([self._of_type(v) for v in values])).select("resource_id").distinct()
        rows = self._index(resource_type, param)
        return rows.where(self._test(param, modifier, values)).select("resource_id").distinct()

    # -- tests on index rows

    def _test(self, param: SearchParam, modifier: str, values: tuple[str, ...]) -> Column:
        kind = param.kind
        if kind == "string":
            return _any([self._string(modifier, v) for v in values])
        if kind == "token":
            return self._tokens(modifier, values)
        if kind == "date":
            return _any([date_range(*split_prefix(v)).column(F.col("value_low"), F.col("value_high")) for v in values])
        if kind == "number":
            return _any([number_range(*split_prefix(v)).column(F.col("value_low"), F.col("value_high")) for v in values])
        if kind == "quantity":
            return _any([self._quantity(v) for v in values])
        if kind == "uri":
            return self._uri(modifier, values)
        return self._references(param, modifier, values)

    @staticmethod
    def _string(modifier: str, value: str) -> Column:
        if modifier == "exact":
            return F.col("value_exact") == value
        text = F.col("value_lower")
        return {"": text.startswith, "contains": text.contains, "endswith": text.endswith}[modifier](value.lower())

    @staticmethod
    def _tokens(modifier: str, values: tuple[str, ...]) -> Column:
        if modifier == "text":
            return _any([F.contains(F.lower("display"), F.lit(v.lower())) for v in values])
        codes, tests = [], []
        for v in values:
            system, bar, code = v.partition("|")
            if not bar or not system:
                codes.append(code if bar else v)
            elif not code:
                tests.append(F.col("system") == system)
            else:
                tests.append((F.col("system") == system) & (F.col("code") == code))
        return _any(([F.col("code").isin(codes)] if codes else []) + tests)

    @staticmethod
    def _of_type(value: str) -> Column:
        """Auxiliary rows have the type's system and code as system, and the identifier's value as code."""
        parts = value.split("|")
        if len(parts) == 3:
            return (F.col("system") == f"{parts[0]}|{parts[1]}") & (F.col("code") == parts[2])
        if len(parts) == 2:
            return F.col("system").endswith(f"|{parts[0]}") & (F.col("code") == parts[1])
        return F.col("code") == parts[0]

    @staticmethod
    def _quantity(value: str) -> Column:
        number, *unit = value.split("|")
        test = number_range(*split_prefix(number)).column(F.col("value_low"), F.col("value_high"))
        system, code = (unit + ["", ""])[:2] if len(unit) > 1 else ("", unit[0] if unit else "")
        if system:
            test &= F.col("system") == system
        if code:
            test &= F.col("code") == code
        return test

    @staticmethod
    def _uri(modifier: str, values: tuple[str, ...]) -> Column:
        stored = F.col("value")
        if modifier == "below":
            return _any([stored.startswith(v) for v in values])
        if modifier == "above":
            return _any([F.startswith(F.lit(v), stored) for v in values])
        return stored.isin(list(values))

    @staticmethod
    def reference_parts(value: str) -> tuple[str | None, str]:
        """(type, id) of a literal: Type/id, an absolute URL that ends so, or a bare id."""
        parts = value.split("/_history/")[0].rstrip("/").split("/")
        return (parts[-2], parts[-1]) if len(parts) > 1 and parts[-2] else (None, parts[-1])

    def _references(self, param: SearchParam, modifier: str, values: tuple[str, ...]) -> Column:
        if modifier == "identifier":
            tests = []
            for v in values:
                system, bar, value = v.partition("|")
                own = F.col("identifier_value") == (value if bar else v)
                tests.append(own & (F.col("identifier_system") == system) if bar and system else own)
            return _any(tests)
        by_type: dict[str | None, list[str]] = {}
        for v in values:
            kind, own = self.reference_parts(v)
            by_type.setdefault(modifier or kind, []).append(own)
        return _any([F.col("target_id").isin(ids) if t is None else (F.col("target_type") == t) & F.col("target_id").isin(ids) for t, ids in by_type.items()])

    # -- predicates over several tables

    def _composite(self, resource_type: str, param: SearchParam, values: tuple[str, ...]) -> DataFrame:
        if len(param.components) < 2:
            raise UnsupportedParam(f"{param.name} has no components")
        kinds = tuple(k for _, k in param.components)
        found = []
        for value in values:
            parts = value.split("$")
            if len(parts) != len(kinds) or not all(parts):
                raise UnsupportedParam(f"{param.name} needs {len(kinds)} parts joined by $")
            if kinds == ("token", "quantity"):
                number, *unit = parts[1].split("|")
                test = self._tokens("", (parts[0],)) & number_range(*split_prefix(number)).column(F.col("value_low"), F.col("value_high"))
                system, code = (unit + ["", ""])[:2] if len(unit) > 1 else ("", unit[0] if unit else "")
                for column, wanted in (("qty_system", system), ("qty_code", code)):
                    if wanted:
                        test &= F.col(column) == wanted
                found.append(self._index(resource_type, param).where(test).select("resource_id"))
                continue
            # other pairs meet in the resource only
            sets = []
            for (name, kind), part in zip(param.components, parts, strict=True):
                own = self.data.registry.get(resource_type, name)
                if own is None or own.kind != kind:
                    raise UnsupportedParam(f"{param.name}: component {name} is unknown")
                sets.append(self._any_value(resource_type, own, "", (part,)))
            found.append(reduce(lambda a, b: a.join(b, "resource_id", "left_semi"), sets))
        return reduce(DataFrame.union, found).distinct()

    def _by_concepts(self, resource_type: str, param: SearchParam, modifier: str, values: tuple[str, ...]) -> DataFrame:
        rows = self._index(resource_type, param)
        if modifier == "in":
            sets = [s for s in (self.data.value_sets(v) for v in values) if s is not None]
            if not sets:
                return self._empty(resource_type)
            wanted = reduce(DataFrame.union, [s.select("system", "code") for s in sets]).distinct()
        else:
            wanted = reduce(DataFrame.union, [self.concept_closure(v, modifier == "below") for v in values]).distinct()
        # a set's row without a system stands for the code in any system
        free = wanted.where("system is null or system = ''").select("code")
        tied = wanted.where("system <> ''")
        own = rows.join(tied, (rows["code"] == tied["code"]) & (rows["system"] == tied["system"]), "left_semi").select("resource_id")
        return own.union(rows.join(free, "code", "left_semi").select("resource_id")).distinct()

    def concept_closure(self, value: str, below: bool) -> DataFrame:
        """(system, code) of a concept and all below or above it."""
        system, bar, code = value.partition("|")
        if not bar or not system or not code:
            raise UnsupportedParam(f":below and :above need system|code, not {value!r}")
        if self.data.concepts is None:
            raise UnsupportedParam("no concept hierarchy is known")
        edges = self.data.concepts.where(F.col("system") == system)
        edges = edges.select(F.col("parent").alias("a"), F.col("code").alias("b")) if below else edges.select(F.col("code").alias("a"), F.col("parent").alias("b"))
        edges = edges.where("a is not null and b is not null")
        walk = self.data.spark.sql(
            """WITH RECURSIVE reached (code, depth) AS (
                 SELECT :code, 0
                 UNION ALL
                 SELECT e.b, r.depth + 1 FROM reached r JOIN {edges} e ON e.a = r.code WHERE r.depth < :depth)
               SELECT DISTINCT :system AS system, if(depth < :depth, code, raise_error('the concept hierarchy is too deep')) AS code FROM reached""",
            args={"code": code, "system": system, "depth": MAX_DEPTH},
            edges=edges,
        )
        return walk

    def _target(self, resource_type: str, p: R.Chain) -> tuple[SearchParam, str]:
        param = self.data.registry.get(resource_type, p.reference)
        if param is None or param.kind != "reference":
            raise UnsupportedParam(f"{resource_type}.{p.reference} is not a reference")
        if p.target:
            return param, p.target
        title = p.reference[:1].upper() + p.reference[1:]
        if title in self.data.registry.types():
            return param, title
        if len(param.targets) == 1:
            return param, param.targets[0]
        raise UnsupportedParam(f"{p.reference} can point at several types; name one as {p.reference}:Type")

    def _chain(self, resource_type: str, p: R.Chain, hop: int) -> DataFrame:
        if hop > MAX_CHAIN:
            raise UnsupportedParam("the chain is too long")
        param, target = self._target(resource_type, p)
        inner = self._chain(target, p.inner, hop + 1) if isinstance(p.inner, R.Chain) else self._positive(target, p.inner)
        edges = self._index(resource_type, param).where(F.col("target_type") == target)
        return edges.join(inner.withColumnRenamed("resource_id", "inner_id"), F.col("target_id") == F.col("inner_id"), "left_semi").select("resource_id").distinct()

    def _has(self, resource_type: str, p: R.Has) -> DataFrame:
        param = self.data.registry.get(p.source, p.reference)
        if param is None or param.kind != "reference":
            raise UnsupportedParam(f"{p.source}.{p.reference} is not a reference")
        sources = self._positive(p.source, p.inner)
        edges = self._index(p.source, param).where(F.col("target_type") == resource_type)
        return edges.join(sources, "resource_id", "left_semi").select(F.col("target_id").alias("resource_id")).distinct()

    def _heuristic(self, resource_type: str, p: R.Value) -> DataFrame:
        """An unknown parameter, by the look of its value: nothing is indexed under its name unless the data has such rows."""
        found = []
        for value in p.values:
            _, rest = split_prefix(value)
            kinds = ("string", "token")
            if "|" in value:
                kinds = ("token",)
            else:
                for kind, test in (("date", date_range), ("number", number_range)):
                    try:
                        test("eq", rest)
                    except UnsupportedParam:
                        continue
                    if kind == "number" or "-" in rest:
                        kinds = (kind,)
                        break
            for kind in kinds:
                param = SearchParam(resource_type, p.name, kind)
                rows = self.data.index(resource_type, param)
                if rows is not None:
                    found.append(rows.where(self._test(param, "", (value,))).select("resource_id"))
        return reduce(DataFrame.union, found).distinct() if found else self._empty(resource_type)

    def _text(self, resource_type: str, p: R.Value) -> DataFrame:
        """All words of the value occur in the text, whatever their case and order."""
        rows = self.data.texts(resource_type)
        if rows is None:
            return self._empty(resource_type)
        words = F.split(F.lower("text"), r"[^\p{L}\p{N}]+")
        tests = []
        for value in p.values:
            wanted = [w for w in "".join(c if c.isalnum() else " " for c in value.lower()).split()]
            tests.append(F.size(F.array_except(F.array(*map(F.lit, wanted)), words)) == 0 if wanted else F.lit(False))
        return rows.where(_any(tests)).select(F.col("fhir_id").alias("resource_id")).distinct()

    def _listed(self, resource_type: str, p: R.Value) -> DataFrame:
        if self.data.lists is None:
            return self._empty(resource_type)
        rows = self.data.lists.where(F.col("list_id").isin(list(p.values)) & (F.col("target_type") == resource_type))
        return rows.select(F.col("target_id").alias("resource_id")).distinct()

    def _filtered(self, resource_type: str, param: SearchParam | None, p: R.Value) -> tuple[DataFrame, bool]:
        op, value = p.modifier.removeprefix("_filter_"), p.values[0]
        if param is None:
            raise UnsupportedParam(f"_filter: {p.name} is unknown")
        if param.kind in ("date", "number", "quantity"):
            if op in ("co", "sw", "ew"):
                raise UnsupportedParam(f"_filter: {op} needs a string parameter")
            return self._any_value(resource_type, param, "", ((value if op == "ne" else op + value),)), op == "ne"
        if op in ("gt", "lt", "ge", "le"):
            raise UnsupportedParam(f"_filter: {op} needs an ordered parameter")
        if param.kind == "string":
            modifier = {"eq": "exact", "ne": "exact", "co": "contains", "sw": "", "ew": "endswith"}[op]
            return self._any_value(resource_type, param, modifier, (value,)), op == "ne"
        if op in ("co", "sw", "ew"):
            raise UnsupportedParam(f"_filter: {op} needs a string parameter")
        return self._any_value(resource_type, param, "", (value,)), op == "ne"
