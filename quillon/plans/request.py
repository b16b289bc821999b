"""From a query string or a mapping to a search request: controls and predicates."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from urllib.parse import parse_qsl, quote, urlencode

from ..errors import UnsupportedParam

DEFAULT_COUNT = 20


@dataclass(frozen=True)
class Value:
    """Any of ``values`` holds for one value of the parameter."""

    name: str
    modifier: str
    values: tuple[str, ...]


@dataclass(frozen=True)
class Chain:
    """The reference leads to a resource for which ``inner`` holds."""

    reference: str
    target: str
    inner: object


@dataclass(frozen=True)
class Has:
    """A ``source`` resource for which ``inner`` holds points here by its parameter ``reference``."""

    source: str
    reference: str
    inner: object


@dataclass(frozen=True)
class Not:
    inner: object


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Sort:
    name: str
    descending: bool


@dataclass
class Request:
    resource_type: str
    predicates: list = field(default_factory=list)
    sort: list[Sort] = field(default_factory=list)
    count: int = DEFAULT_COUNT
    page: int = 1
    total: str = "none"
    summary: str = ""
    elements: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    revinclude: tuple[str, ...] = ()


def split_values(text: str) -> tuple[str, ...]:
    r"""Comma-separated alternatives; "\," is a comma of the value."""
    parts = re.split(r"(?<!\\),", text)
    return tuple(p.replace(r"\,", ",").replace(r"\|", "|") if "\\" in p else p for p in parts)


def predicate(key: str, text: str):
    """The predicate of one key and value."""
    if key.startswith("_has:"):
        parts = key.split(":")
        if len(parts) != 4 or not all(parts[1:]):
            raise UnsupportedParam(f"_has needs _has:Type:reference:param, not {key!r}")
        return Has(parts[1], parts[2], Value(parts[3], "", split_values(text)))
    head, dot, rest = key.partition(".")
    if dot and not key.startswith("_"):
        reference, _, target = head.partition(":")
        return Chain(reference, target, predicate(rest, text))
    name, _, modifier = key.partition(":")
    if name == "_filter":
        return Filter(text).parsed()
    return Value(name, modifier, split_values(text))


def _whole(text: str, what: str) -> int:
    try:
        return int(text)
    except ValueError as e:
        raise UnsupportedParam(f"{what} needs a whole number, not {text!r}") from e


def parse(resource_type: str, query: str | dict | list = "", max_count: int | None = None) -> Request:
    """``query``: a query string, a mapping of keys to a value or values, or pairs."""
    if isinstance(query, str):
        pairs = parse_qsl(query.lstrip("?"), keep_blank_values=True)
    else:
        items = query.items() if isinstance(query, dict) else query
        pairs = [(k, v) for k, vs in items for v in (vs if isinstance(vs, list | tuple) else [vs])]
    out = Request(resource_type)
    for key, value in pairs:
        if key == "_sort":
            out.sort += [Sort(s.lstrip("-"), s.startswith("-")) for s in value.split(",") if s.strip("-")]
        elif key == "_count":
            out.count = max(0, _whole(value, key))
        elif key == "_page":
            out.page = max(1, _whole(value, key))
        elif key == "_total":
            out.total = value
        elif key == "_summary":
            out.summary = value
        elif key == "_elements":
            out.elements += tuple(x.strip() for x in value.split(",") if x.strip())
        elif key == "_include":
            out.include += (value,)
        elif key == "_revinclude":
            out.revinclude += (value,)
        elif key == "_format":
            continue
        else:
            out.predicates.append(predicate(key, value))
    if max_count is not None:
        out.count = min(out.count, max_count)
    return out


def page_links(base: str, pairs: list[tuple[str, str]], page: int, count: int, returned: int, total: int | None) -> dict[str, str]:
    """Links self, first, previous, next and last of a result page; without a total, a full page may have a next one."""

    def link(n: int) -> str:
        own = sorted([(k, v) for k, v in pairs if k not in ("_page", "_count")] + [("_page", str(n)), ("_count", str(count))])
        return f"{base}?{urlencode(own, quote_via=quote)}"

    last = None if total is None else max(1, -(-total // count)) if count else 1
    out = {"self": link(page), "first": link(1)}
    if page > 1:
        out["previous"] = link(page - 1)
    if page < last if last is not None else count and returned >= count:
        out["next"] = link(page + 1)
    if last is not None:
        out["last"] = link(last)
    return out


_WORD = re.compile(r'\s*(\(|\)|"(?:[^"\\]|\\.)*"|[^\s()]+)')
_OPERATORS = {"eq": "", "ne": "", "co": "contains", "sw": "", "ew": "endswith", "gt": "", "lt": "", "ge": "", "le": "", "pr": "missing"}


class Filter:
    """The _filter language: ``param op value``, ``param pr true|false``, and, or, not(...), parentheses.

    ``and`` binds tighter than ``or``.
    """

    def __init__(self, text: str):
        self._words, at = [], 0
        while at < len(text.rstrip()):
            m = _WORD.match(text, at)
            self._words.append(m[1])
            at = m.end()
        self._at = 0

    def parsed(self):
        out = self._any()
        if self._at < len(self._words):
            raise UnsupportedParam(f"_filter: {self._words[self._at]!r} is not expected")
        return out

    def _peek(self) -> str:
        return self._words[self._at] if self._at < len(self._words) else ""

    def _next(self) -> str:
        if self._at >= len(self._words):
            raise UnsupportedParam("_filter ends too early")
        self._at += 1
        return self._words[self._at - 1]

    def _any(self):
        parts = [self._all()]
        while self._peek().lower() == "or":
            self._next()
            parts.append(self._all())
        return parts[0] if len(parts) == 1 else Or(tuple(parts))

    def _all(self):
        parts = [self._one()]
        while self._peek().lower() == "and":
            self._next()
            parts.append(self._one())
        return parts[0] if len(parts) == 1 else And(tuple(parts))

    def _one(self):
        word = self._next()
        if word == "(" or word.lower() == "not" and self._peek() == "(":
            if word != "(":
                self._next()
            inner = self._any()
            if self._next() != ")":
                raise UnsupportedParam("_filter: a parenthesis is not closed")
            return inner if word == "(" else Not(inner)
        op = self._next().lower()
        if op not in _OPERATORS:
            raise UnsupportedParam(f"_filter: unknown operator {op!r}")
        raw = self._next()
        if raw in "()":
            raise UnsupportedParam(f"_filter: {word} {op} needs a value")
        value = re.sub(r"\\(.)", r"\1", raw[1:-1]) if raw[0] == '"' else raw
        if op == "pr":
            return Value(word, "missing", ("false" if value == "true" else "true",))
        return Value(word, f"_filter_{op}", (value,))
