"""FHIRPath, the part that indexes and invariants use, compiled to columns over VARIANT.

An expression compiles to a column of array<variant>: every step flattens arrays,
a missing member gives nothing. Boolean expressions compile to boolean columns.
Parsing happens once on the driver and is cached; no Python runs per row.

path        a.b.c, leading type name, choice types (value -> valueQuantity ...)
functions   where(k='v'), where(k!='v'), where(resolve() is T), extension('url'),
            ofType(T), as(T), exists(), first(), [n] (all items, as indexes take it)
union       a | b, without removing repeats
boolean     implies, xor, or, and; = != < > <= >=; exists() empty() not() count()
            matches() startsWith()
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import UnsupportedParam

#: The data types that a choice element "x[x]" can end in (FHIR R4, datatypes).
CHOICE_TYPES = (
    "Base64Binary Boolean Canonical Code Date DateTime Decimal Id Instant Integer Markdown Oid PositiveInt String Time UnsignedInt Uri Url Uuid Address Age Annotation Attachment CodeableConcept Coding ContactPoint Count Distance Duration "
    "HumanName Identifier Money Period Quantity Range Ratio Reference SampledData Signature Timing ContactDetail Contributor DataRequirement Expression ParameterDefinition RelatedArtifact TriggerDefinition UsageContext Dosage Meta"
).split()
#: Elements that are choices, by their base name; others are looked up under their own name alone.
CHOICES = frozenset("value effective onset abatement deceased multipleBirth performed occurrence medication reported timing scheduled serviced born age due start defaultValue asNeeded allowed product item location entity subject content source target".split())

_TOKEN = re.compile(r"\s*(?:(?P<string>'(?:[^'\\]|\\.)*')|(?P<number>\d+(?:\.\d+)?)|(?P<name>\$this|%?[A-Za-z_][A-Za-z0-9_-]*)|(?P<op><=|>=|!=|!~|[.()\[\],|=<>~+]))")


@dataclass(frozen=True)
class Step:
    """``kind``: name, where, extension, oftype, index, or call; ``args``: of the kind."""

    kind: str
    args: tuple = ()


@dataclass(frozen=True)
class Path:
    steps: tuple[Step, ...]


@dataclass(frozen=True)
class Literal:
    value: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


class _Parser:
    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise UnsupportedParam(f"FHIRPath: cannot read {text[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0):
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else (None, None)

    def take(self, value: str | None = None):
        kind, text = self.peek()
        if kind is None or value is not None and text != value:
            raise UnsupportedParam(f"FHIRPath: {value or 'more'} expected in {self.text!r}")
        self.at += 1
        return kind, text

    LEVELS = (("implies",), ("or", "xor"), ("and",), ("in", "contains"), ("=", "!=", "~", "!~"), ("<", ">", "<=", ">="), ("|",), ("is", "as"))

    def expression(self, level: int = 0):
        if level == len(self.LEVELS):
            return self.postfix()
        left = self.expression(level + 1)
        while self.peek()[1] in self.LEVELS[level] and self.peek()[0] != "string":
            _, op = self.take()
            if op in ("is", "as"):
                _, name = self.take()
                left = Binary(op, left, Literal(name))
            else:
                left = Binary(op, left, self.expression(level + 1))
        return left

    def postfix(self):
        kind, text = self.peek()
        if kind == "string":
            self.take()
            return Literal(re.sub(r"\\(.)", r"\1", text[1:-1]))
        if kind == "number":
            self.take()
            return Literal(float(text))
        if text in ("true", "false") and kind == "name":
            self.take()
            return Literal(text == "true")
        if text == "(":
            self.take()
            inner = self.expression()
            self.take(")")
            steps = self.steps(False)
            return Path((Step("inner", (inner,)), *steps)) if steps else inner
        steps = self.steps(True)
        if steps and steps[0].kind == "name" and steps[0].args[0][:1].isupper():
            steps = steps[1:]  # the resource's own type
        return Path(tuple(steps))

    def steps(self, first: bool) -> list[Step]:
        out = []
        while True:
            kind, text = self.peek()
            if text == "[" and kind == "op":
                self.take()
                out.append(Step("index", (self.take()[1],)))
                self.take("]")
                continue
            if not first:
                if text != "." or kind != "op":
                    return out
                self.take()
            first = False
            kind, name = self.take()
            if kind != "name":
                raise UnsupportedParam(f"FHIRPath: a name is expected in {self.text!r}")
            if self.peek()[1] != "(":
                out.append(Step("name", (name,)))
                continue
            self.take("(")
            args = []
            if name in ("ofType", "as"):
                args.append(Literal(self.take()[1]))
            while self.peek()[1] != ")":
                args.append(self.expression())
                if self.peek()[1] == ",":
                    self.take()
            self.take(")")
            out.append(Step("call", (name, tuple(args))))


@lru_cache(maxsize=4096)
def parse(expression: str):
    p = _Parser(expression)
    out = p.expression()
    if p.at < len(p.tokens):
        raise UnsupportedParam(f"FHIRPath: {p.peek()[1]!r} is not expected in {expression!r}")
    return out


# -- columns


def _none() -> Column:
    return F.expr("cast(array() as array<variant>)")


def once(value: Column, then) -> Column:
    """then() of a value, which is computed once however often then() names it."""
    return F.get(F.transform(F.array(value), then), 0)


def as_array(v: Column) -> Column:
    """The items of a variant: of an array its items, of a null none, of anything else itself."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.when(v.isNull() | F.is_variant_null(v), _none()).otherwise(F.array(v)))


def named(items: Column, name: str) -> Column:
    """The members of exactly that name of all items, flattened."""
    return F.flatten(F.transform(F.transform(items, lambda i: F.try_variant_get(i, f"$.{name}", "variant")), as_array))


def member(items: Column, name: str) -> Column:
    """The members of that name of all items, flattened; for a choice element those of all its types."""
    if name not in CHOICES:
        return named(items, name)
    names = [name, *(name + t for t in CHOICE_TYPES)]

    def of(item: Column) -> Column:
        own = F.map_values(F.map_filter(F.try_variant_get(item, "$", "map<string,variant>"), lambda k, v: k.isin(names)))
        return F.coalesce(F.flatten(F.transform(own, as_array)), _none())

    return F.flatten(F.transform(items, of))


def text_of(item: Column) -> Column:
    return F.try_variant_get(item, "$", "string")


def _first_text(items: Column) -> Column:
    return text_of(F.get(items, 0))




def items_of(node, root: Column) -> Column:
    """array<variant> of a parsed path; ``root`` is array<variant> too."""
    if isinstance(node, Binary):
        if node.op == "|":
            return F.concat(items_of(node.left, root), items_of(node.right, root))
        if node.op == "as":
            return _of_type(node.left, node.right.value, root)
        raise UnsupportedParam(f"FHIRPath: {node.op} gives no items")
    if isinstance(node, Literal):
        return F.transform(F.array(F.lit(node.value)), lambda x: x.cast("variant"))
    out = root
    for k, step in enumerate(node.steps):
        out = _step(out, step, node.steps[:k], root)
    return out


def _of_type(node, type_name: str, root: Column) -> Column:
    """value.ofType(Quantity): the member valueQuantity, or resources of that type."""
    if isinstance(node, Path) and node.steps and node.steps[-1].kind == "name":
        base = node.steps[-1].args[0]
        above = items_of(Path(node.steps[:-1]), root)
        own = base + type_name[:1].upper() + type_name[1:]
        return F.concat(named(above, own), _resources(member(above, base) if base not in CHOICES else _none(), type_name))
    return _resources(items_of(node, root), type_name)


def _resources(items: Column, type_name: str) -> Column:
    return F.filter(items, lambda i: F.try_variant_get(i, "$.resourceType", "string") == type_name)


def _step(items: Column, step: Step, before: tuple[Step, ...], root: Column) -> Column:
    if step.kind == "inner":
        return items_of(step.args[0], root)
    if step.kind == "name":
        return items if step.args[0] == "$this" else member(items, step.args[0])
    if step.kind == "index":
        return items
    name, args = step.args
    if name in ("exists", "first", "resolve", "distinct") and not args:
        return items
    if name == "extension" and len(args) == 1:
        return F.filter(member(items, "extension"), lambda i: F.try_variant_get(i, "$.url", "string") == args[0].value)
    if name in ("ofType", "as") and len(args) == 1:
        return _of_type(Path(before), args[0].value, root)
    if name == "where" and len(args) == 1:
        return _where(items, args[0])
    raise UnsupportedParam(f"FHIRPath: {name}() is not supported here")


def _where(items: Column, test) -> Column:
    if isinstance(test, Binary) and test.op == "is" and test.left == Path((Step("call", ("resolve", ())),)):
        return F.filter(items, lambda i: F.coalesce(F.try_variant_get(i, "$.reference", "string"), text_of(i)).startswith(f"{test.right.value}/"))
    if isinstance(test, Binary) and test.op in ("=", "!=") and isinstance(test.right, Literal):

        def holds(i: Column) -> Column:
            value, wanted = _first_text(items_of(test.left, F.array(i))), _plain(test.right.value)
            return F.coalesce((value == wanted) if test.op == "=" else (value != wanted), F.lit(False))

        return F.filter(items, holds)
    return F.filter(items, lambda i: F.coalesce(boolean(test, F.array(i)), F.lit(False)))


def _plain(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    return f"{value:g}" if isinstance(value, float) else str(value)


def boolean(node, root: Column) -> Column:
    """A boolean column of a parsed expression; a missing value counts as false."""
    if isinstance(node, Binary):
        if node.op in ("and", "or", "xor", "implies"):
            a, b = boolean(node.left, root), boolean(node.right, root)
            return {"and": a & b, "or": a | b, "xor": a != b, "implies": ~a | b}[node.op]
        if node.op in ("=", "!=", "<", ">", "<=", ">="):
            return _compare(node.op, _scalar(node.left, root), _scalar(node.right, root))
        if node.op == "in":
            return F.coalesce(F.array_contains(F.transform(items_of(node.right, root), text_of), _scalar(node.left, root)), F.lit(False))
        if node.op == "is":
            return F.size(_resources(items_of(node.left, root), node.right.value)) > 0
        return F.size(items_of(node, root)) > 0
    if isinstance(node, Literal):
        return F.lit(bool(node.value))
    if node.steps and node.steps[-1].kind == "call":
        name, args = node.steps[-1].args
        before = Path(node.steps[:-1])
        if name == "exists":
            inner = items_of(before, root) if not args else _where(items_of(before, root), args[0])
            return F.size(inner) > 0
        if name == "empty":
            return F.size(items_of(before, root)) == 0
        if name == "not":
            return ~boolean(before, root) if before.steps else ~boolean(args[0], root)
        if name == "matches":
            return F.coalesce(F.rlike(_scalar(before, root), F.lit(args[0].value)), F.lit(False))
        if name == "startsWith":
            return F.coalesce(F.startswith(_scalar(before, root), F.lit(args[0].value)), F.lit(False))
        if name == "all":
            items = items_of(before, root)
            return F.size(items) == F.size(_where(items, args[0]))
    if len(node.steps) == 1 and node.steps[0].kind == "inner":
        return boolean(node.steps[0].args[0], root)
    return once(items_of(node, root), lambda items: F.coalesce(F.when(F.size(items) == 1, _first_text(items) != "false").otherwise(F.size(items) > 0), F.lit(False)))


def _scalar(node, root: Column) -> Column:
    if isinstance(node, Literal):
        return F.lit(_plain(node.value))
    if isinstance(node, Path) and node.steps and node.steps[-1].kind == "call":
        name, _ = node.steps[-1].args
        if name == "count":
            return F.size(items_of(Path(node.steps[:-1]), root)).cast("string")
        if name in ("exists", "empty", "not", "matches", "startsWith"):
            return boolean(node, root).cast("string")
        if name == "length":
            return F.length(_scalar(Path(node.steps[:-1]), root)).cast("string")
    return _first_text(items_of(node, root))


def _compare(op: str, a: Column, b: Column) -> Column:
    """By number where both sides are numbers, else by text."""
    ops = {"=": Column.__eq__, "!=": Column.__ne__, "<": Column.__lt__, ">": Column.__gt__, "<=": Column.__le__, ">=": Column.__ge__}

    def of(a: Column, b: Column) -> Column:
        x, y = a.try_cast("double"), b.try_cast("double")
        return F.coalesce(F.when(x.isNotNull() & y.isNotNull(), ops[op](x, y)).otherwise(ops[op](a, b)), F.lit(False))

    return once(F.struct(a.alias("a"), b.alias("b")), lambda s: of(s["a"], s["b"]))


def evaluate(expression: str, resource: Column) -> Column:
    """array<variant> of an expression over a variant column."""
    return items_of(parse(expression), F.array(resource))


def check(expression: str, resource: Column) -> Column:
    """Whether an invariant holds for a variant column."""
    return boolean(parse(expression), F.array(resource))


def union_all(columns: list[Column]) -> Column:
    return reduce(lambda a, b: F.concat(a, b), columns)
