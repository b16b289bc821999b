import pytest

from quillon.errors import UnsupportedParam
from quillon.plans import request as R


def test_controls_and_predicates():
    r = R.parse("Encounter", "status=a,b&date=ge2020&_sort=-date,_id&_count=5&_page=3&_include=Encounter:subject&_summary=true&_elements=id,status")
    assert r.predicates == [R.Value("status", "", ("a", "b")), R.Value("date", "", ("ge2020",))]
    assert r.sort == [R.Sort("date", True), R.Sort("_id", False)]
    assert (r.count, r.page, r.summary, r.elements, r.include) == (5, 3, "true", ("id", "status"), ("Encounter:subject",))
    assert R.parse("X", "_count=500", max_count=100).count == 100


def test_chains_and_has():
    assert R.parse("E", "subject:Patient.organization.name=x").predicates == [R.Chain("subject", "Patient", R.Chain("organization", "", R.Value("name", "", ("x",))))]
    assert R.parse("P", "_has:E:subject:status=F").predicates == [R.Has("E", "subject", R.Value("status", "", ("F",)))]
    with pytest.raises(UnsupportedParam):
        R.parse("P", "_has:E:status=F")


def test_escapes():
    assert R.split_values(r"a\,b,c") == ("a,b", "c")


def test_filter_precedence():
    v = lambda n, x: R.Value(n, "_filter_eq", (x,))
    assert R.Filter("a eq 1 or b eq 2 and c eq 3").parsed() == R.Or((v("a", "1"), R.And((v("b", "2"), v("c", "3")))))
    assert R.Filter('(a eq 1 or b eq "x y") and not (c eq 3)').parsed() == R.And((R.Or((v("a", "1"), v("b", "x y"))), R.Not(v("c", "3"))))
    assert R.Filter("a pr true").parsed() == R.Value("a", "missing", ("false",))


@pytest.mark.parametrize("text", ["", "a", "a eq", "a zz 1", "(a eq 1", "a eq 1)", "a eq 1 b", "a eq )"])
def test_bad_filters(text):
    with pytest.raises(UnsupportedParam):
        R.Filter(text).parsed()


def test_page_links():
    links = R.page_links("/X", [("a", "1")], 2, 10, 10, 25)
    assert links == {"self": "/X?_count=10&_page=2&a=1", "first": "/X?_count=10&_page=1&a=1", "previous": "/X?_count=10&_page=1&a=1", "next": "/X?_count=10&_page=3&a=1", "last": "/X?_count=10&_page=3&a=1"}
    assert "next" not in R.page_links("/X", [], 1, 10, 7, None)
    assert "next" in R.page_links("/X", [], 1, 10, 10, None)
