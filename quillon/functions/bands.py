"""Interval algebra of search values.

A stored date, number or quantity is a closed band [lo, hi]. A literal gives a
band too, and each comparator is a plain comparison between the two, so that
Catalyst can push it to the scan.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import UnsupportedParam

PREFIXES = ("eq", "ne", "gt", "lt", "ge", "le", "sa", "eb", "ap")
#: Relative half-width of a number's implicit band.
PRECISION = 1e-7
#: Open ends of a period.
EARLIEST, LATEST = datetime(1, 1, 1), datetime(9999, 12, 31, 23, 59, 59)


def split_prefix(value: str) -> tuple[str, str]:
    """(comparator, rest); "eq" where the value names none."""
    if len(value) > 2 and value[:2] in PREFIXES:
        return value[:2], value[2:]
    return "eq", value


_DATETIME = re.compile(r"(\d{4}-\d\d-\d\d)[Tt ](\d\d:\d\d)(:\d\d)?(\.\d+)?(Z|z|[+-]\d\d:\d\d)?")


def date_band(text: str) -> tuple[datetime, datetime]:
    """First and last instant that a date of any precision stands for, as UTC without a zone; the last one in whole seconds."""
    try:
        if re.fullmatch(r"\d{4}", text):
            low = datetime(int(text), 1, 1)
            return low, (datetime(low.year + 1, 1, 1) if low.year < 9999 else LATEST + timedelta(seconds=1)) - timedelta(seconds=1)
        if re.fullmatch(r"\d{4}-\d\d", text):
            low = datetime(int(text[:4]), int(text[5:]), 1)
            after = (low + timedelta(days=31)).replace(day=1) if (low.year, low.month) != (9999, 12) else None
            return low, (after - timedelta(seconds=1)) if after else LATEST
        if re.fullmatch(r"\d{4}-\d\d-\d\d", text):
            low = datetime.strptime(text, "%Y-%m-%d")
            return low, low.replace(hour=23, minute=59, second=59)
        if m := _DATETIME.fullmatch(text):
            at = datetime.fromisoformat(f"{m[1]}T{m[2]}{m[3] or ':00'}{((m[4] or '')[:7])}{(m[5] or '').upper().replace('Z', '+00:00')}")
            if at.tzinfo:
                at = at.astimezone(timezone.utc).replace(tzinfo=None)
            return at, at
    except (ValueError, OverflowError) as e:
        raise UnsupportedParam(f"not a date: {text!r}") from e
    raise UnsupportedParam(f"not a date: {text!r}")


def open_end(high: datetime) -> datetime:
    """The instant just after a band: a second later, or a microsecond for a fraction of a second."""
    try:
        return high + (timedelta(microseconds=1) if high.microsecond else timedelta(seconds=1))
    except OverflowError:
        return datetime.max


def rounded(x: float) -> Decimal:
    """To six decimal places, halves away from zero."""
    return Decimal(repr(x)).quantize(Decimal("0.000001"), ROUND_HALF_UP)


def number_band(text: str) -> tuple[Decimal, Decimal]:
    """[L, H] of a number literal."""
    try:
        x = float(text)
    except ValueError as e:
        raise UnsupportedParam(f"not a number: {text!r}") from e
    if not math.isfinite(x):
        raise UnsupportedParam(f"not a finite number: {text!r}")
    eps = abs(x) * PRECISION or PRECISION
    return rounded(x - eps), rounded(x + eps)


@dataclass(frozen=True)
class Range:
    """A comparison as half-bounded tests: each is (which end of the stored band, operator, bound)."""

    tests: tuple[tuple[str, str, object], ...]
    negated: bool = False

    def holds(self, lo, hi) -> bool:
        """The same in plain Python."""
        ops = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
        ok = all(ops[op](lo if end == "lo" else hi, bound) for end, op, bound in self.tests)
        return ok != self.negated

    def column(self, lo: Column, hi: Column) -> Column:
        ops = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}
        out = None
        for end, op, bound in self.tests:
            test = ops[op](lo if end == "lo" else hi, _literal(bound))
            out = test if out is None else out & test
        return ~out if self.negated else out


def _literal(bound) -> Column:
    if isinstance(bound, datetime):
        return F.lit(bound.isoformat(sep=" ")).cast("timestamp_ntz")
    if isinstance(bound, Decimal):
        return F.lit(str(bound)).cast("decimal(20,6)")
    return F.lit(bound)


def date_range(prefix: str, text: str) -> Range:
    low, high = date_band(text)
    end = open_end(high)
    return {
        "ge": Range((("hi", ">=", low),)),
        "gt": Range((("hi", ">=", end),)),
        "eb": Range((("hi", "<", low),)),
        "le": Range((("lo", "<", end),)),
        "lt": Range((("lo", "<", low),)),
        "sa": Range((("lo", ">=", end),)),
        "eq": Range((("lo", ">=", low), ("hi", "<", end))),
        "ap": Range((("lo", "<", end), ("hi", ">=", low))),
        "ne": Range((("lo", ">=", low), ("hi", "<", end)), True),
    }[prefix]


def number_range(prefix: str, text: str) -> Range:
    low, high = number_band(text)
    inside = (("lo", "<=", high), ("hi", ">=", low))
    return {
        "ge": Range((("hi", ">=", low),)),
        "gt": Range((("hi", ">", high),)),
        "eb": Range((("hi", "<", low),)),
        "le": Range((("lo", "<=", high),)),
        "lt": Range((("lo", "<", low),)),
        "sa": Range((("lo", ">", high),)),
        "eq": Range(inside),
        "ap": Range(inside),
        "ne": Range(inside, True),
    }[prefix]


def value_band(value: Column) -> tuple[Column, Column]:
    """Stored band of a number column."""
    v = value.cast("double")
    eps = F.abs(v) * F.lit(PRECISION)
    return (v - eps).cast("decimal(20,6)"), (v + eps).cast("decimal(20,6)")


def date_columns(text: Column) -> tuple[Column, Column]:
    """Stored band of a date string column of any precision; nulls where it is none."""
    n = F.length(text)
    year = F.try_to_timestamp(F.concat(text, F.lit("-01-01")), F.lit("yyyy-MM-dd"))
    month = F.try_to_timestamp(F.concat(text, F.lit("-01")), F.lit("yyyy-MM-dd"))
    day = F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))
    instant = F.try_to_timestamp(F.regexp_replace(text, r"(\.\d+)", ""))
    second = F.expr("interval 1 second")
    low = F.when(n == 4, year).when(n == 7, month).when(n == 10, day).when(text.rlike(r"^\d{4}-\d\d-\d\d[T ]"), F.coalesce(F.try_to_timestamp(text), instant))
    high = (
        F.when(n == 4, F.add_months(year, 12).cast("timestamp") - second)
        .when(n == 7, F.add_months(month, 1).cast("timestamp") - second)
        .when(n == 10, day + F.expr("interval 1 day") - second)
        .otherwise(F.date_trunc("second", low))
    )
    return low.cast("timestamp_ntz"), high.cast("timestamp_ntz")


def period_columns(start: Column, end: Column) -> tuple[Column, Column]:
    """Stored band of a period; open ends become sentinels, and a period without both is null."""
    some = start.isNotNull() | end.isNotNull()
    low, high = date_columns(start)[0], date_columns(end)[1]
    return F.when(some, F.coalesce(low, _literal(EARLIEST))), F.when(some, F.coalesce(high, _literal(LATEST)))
