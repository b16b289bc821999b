"""How much of a table one task takes."""

import pytest
from pyspark.sql import functions as F

from quillon import queries as Q

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def small_splits(spark, monkeypatch):
    """Many splits of a file with one row group: all of them but one are empty."""
    monkeypatch.setattr(Q, "ROWS_A_TASK", 100, raising=False)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("name", ["codec_turtle", "codec_xml", "validate", "index_token", "index_reference", "index_composite", "summary_true", "summary_data"])
def test_rows_of_one_row_group_are_dealt(spark, small_splits, name):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    assert events.count() == 1000 and events.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    found = Q.queries()[name](spark, SMALL)
    most = found.groupBy(F.spark_partition_id()).agg(F.count_distinct(found.columns[0]).alias("n")).agg(F.max("n")).first()[0]
    assert most <= 200


def test_turtle_is_read_in_one_pass():
    """A reader that looks at the whole text for each token takes minutes over this one."""
    import time

    from quillon.sources import codecs

    doc = {"resourceType": "Bundle", "entry": [{"n": k, "text": "x" * 20} for k in range(100_000)]}
    text = codecs.to_turtle(doc)
    began = time.process_time()
    assert codecs.from_turtle(text) == doc
    assert time.process_time() - began < 10


def test_xml_is_written_as_a_tree_is():
    import xml.etree.ElementTree as ET

    from quillon.sources import codecs

    def tree(doc):
        root = ET.Element(doc["resourceType"], xmlns=codecs.FHIR)
        codecs._fill(root, doc)
        return ET.tostring(root, encoding="unicode")

    docs = [
        {"resourceType": "A"},
        {"resourceType": "A", "b": {}, "c": [], "_d": 1, "e": [None, True, 2.0, 1e20, "<&>\"'\r\n\té"], "": "x"},
        {"resourceType": "A", "contained": [{"resourceType": "B", "id": "1"}, {"resourceType": "C"}], "f": {"g": [{"h": 1}, {}]}},
    ]
    for doc in docs:
        assert codecs._written(doc) == tree(doc)
    assert codecs._written({"resourceType": "A", "text": {"div": "<div>x</div>"}}) is None


def _plan(spark, name):
    return Q.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


def test_no_body_is_made_before_rows_are_dealt(spark):
    above, below = _plan(spark, "summary_data").split("REPARTITION_BY_NUM")
    assert "jsonObjectKeys" in above and "jsonObjectKeys" not in below


def test_latest_versions_need_no_exchange_of_bodies(spark):
    """Only the counts are exchanged after the rows of the two tables are dealt."""
    plan = _plan(spark, "validate_system")
    assert plan.count("REPARTITION_BY_NUM") == 2 and plan.count("ENSURE_REQUIREMENTS") == 1
