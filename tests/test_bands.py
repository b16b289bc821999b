"""The interval algebra, in plain Python and as columns."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quillon.errors import UnsupportedParam
from quillon.functions import bands as B


def date(query, low, high):
    return B.date_range(*B.split_prefix(query)).holds(low, high)


@pytest.mark.parametrize(
    "query,match",
    [("gt2021-02-16", True), ("ge2021-02-16", True), ("lt2021-02-16", True), ("le2021-02-16", True), ("eb2021-06-02", True), ("eb2020-12-31", False), ("sa2020-12-31", True), ("sa2021-06-02", False)],
)
def test_period_against_days(query, match):
    assert date(query, datetime(2021, 1, 1), datetime(2021, 6, 1, 23, 59, 59)) is match


@pytest.mark.parametrize(
    "query,year,month,day",
    [("2000-03-13", False, False, True), ("eq2000-03-13", False, False, True), ("2000-03", False, True, True), ("2000", True, True, True), ("ne2000-03-13", True, True, False)],
)
def test_partial_dates(query, year, month, day):
    for text, match in (("2000", year), ("2000-03", month), ("2000-03-13", day)):
        assert date(query, *B.date_band(text)) is match


def test_containment_of_periods():
    day = (datetime(2020, 6, 15, 8), datetime(2020, 6, 15, 23, 59, 59, 900_000))
    for query, match in {"2020-06-15": True, "ne2020-06-15": False, "le2020-06-15": True, "gt2020-06-15": False, "sa2020-06-14": True}.items():
        assert date(query, *day) is match
    span = (datetime(2026, 7, 10), datetime(2026, 7, 12, 23, 59, 59))
    for query, match in {"ap2026-07-11": True, "2026-07-11": False, "2026-07": True, "ne2026-07-11": True}.items():
        assert date(query, *span) is match
    unended = (datetime(2026, 8, 1), B.LATEST)
    for query, match in {"2026-08-01": False, "2026": False, "ne2026-08-01": True}.items():
        assert date(query, *unended) is match


def test_comparators_as_bounds():
    day, after = datetime(2020, 6, 15), datetime(2020, 6, 16)
    want = {"gt": ("hi", ">=", after), "sa": ("lo", ">=", after), "le": ("lo", "<", after), "ge": ("hi", ">=", day), "lt": ("lo", "<", day), "eb": ("hi", "<", day)}
    for prefix, test in want.items():
        assert B.date_range(prefix, "2020-06-15").tests == (test,)


def test_quantity_band():
    for query, match in {"ge99999": True, "gt99999": True, "eb100051": True, "eb49": False, "lt100": True, "le100": True, "sa49": True, "sa100051": False}.items():
        assert B.number_range(*B.split_prefix(query)).holds(Decimal(50), Decimal(100050)) is match


def test_number_bands_are_rounded():
    assert B.number_band("72") == (Decimal("71.999993"), Decimal("72.000007"))
    assert B.number_band("107") == (Decimal("106.999989"), Decimal("107.000011"))
    assert B.number_band("0") == (Decimal("0.000000"), Decimal("0.000000"))


@pytest.mark.parametrize("text", ["", "20-1", "2020-13", "2020-02-30", "x", "2020-01-01T25:00"])
def test_bad_dates(text):
    with pytest.raises(UnsupportedParam):
        B.date_band(text)


@pytest.mark.parametrize("text", ["abc", "nan", "inf", ""])
def test_bad_numbers(text):
    with pytest.raises(UnsupportedParam):
        B.number_band(text)


def test_zones_and_fractions():
    assert B.date_band("2020-01-01T00:30:00+02:00")[0] == datetime(2019, 12, 31, 22, 30)
    assert B.open_end(B.date_band("2020-01-01T00:00:00.5Z")[1]) == datetime(2020, 1, 1, 0, 0, 0, 500_001)
    assert B.open_end(B.date_band("2020-01-01T00:00:00Z")[1]) == datetime(2020, 1, 1, 0, 0, 1)


def test_columns_agree_with_plain_python(spark):
    rng = random.Random(7)
    start = datetime(2019, 12, 30)
    rows = []
    for k in range(300):
        low = start + timedelta(hours=rng.randint(0, 24 * 70))
        rows.append((k, low, low + timedelta(seconds=rng.choice([0, 3600, 86399, 86400 * 20]))))
    table = spark.createDataFrame(rows, "k int, lo timestamp_ntz, hi timestamp_ntz").cache()
    for prefix in B.PREFIXES:
        for text in ("2020", "2020-01", "2020-01-15", "2020-02-01T12:00:00Z"):
            r = B.date_range(prefix, text)
            got = {x.k for x in table.where(r.column(F.col("lo"), F.col("hi"))).collect()}
            assert got == {k for k, lo, hi in rows if r.holds(lo, hi)}, (prefix, text)


def test_number_columns_agree_with_plain_python(spark):
    values = [round(random.Random(3).uniform(-5, 5), 2), 0.0, 1.0, -1.0, 2.5, 1e6, 0.1, 4.0000001]
    table = spark.createDataFrame(list(enumerate(values)), "k int, v double")
    low, high = B.value_band(F.col("v"))
    table = table.select("k", low.alias("lo"), high.alias("hi")).cache()
    stored = {r.k: (r.lo, r.hi) for r in table.collect()}
    for prefix in B.PREFIXES:
        for text in ("0", "1", "-1", "2.5", "4"):
            r = B.number_range(prefix, text)
            got = {x.k for x in table.where(r.column(F.col("lo"), F.col("hi"))).collect()}
            assert got == {k for k, (lo, hi) in stored.items() if r.holds(lo, hi)}, (prefix, text)


def test_date_columns(spark):
    texts = ["2000", "2000-02", "2000-02-29", "2001-12", "2020-01-01T00:30:00+02:00", "2020-01-01T00:00:00.250Z", "nonsense", None, "2000-13"]
    low, high = B.date_columns(F.col("t"))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", low.alias("lo"), high.alias("hi")).collect()
    for r in rows[:5]:
        assert (r.lo, r.hi) == B.date_band(r.t)
    assert rows[5].hi == datetime(2020, 1, 1)
    assert all(r.lo is None and r.hi is None for r in rows[6:])


def test_period_columns(spark):
    rows = spark.createDataFrame([("2020", None), (None, "2021-03"), (None, None)], "s string, e string")
    low, high = B.period_columns(F.col("s"), F.col("e"))
    got = rows.select(low.cast("string").alias("lo"), high.cast("string").alias("hi")).collect()
    assert [tuple(r) for r in got] == [("2020-01-01 00:00:00", "9999-12-31 23:59:59"), ("0001-01-01 00:00:00", "2021-03-31 23:59:59"), (None, None)]
