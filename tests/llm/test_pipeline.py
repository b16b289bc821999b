import brute
import corpus_pipeline
import pytest
from test_text import check_packing

from quillon.llm import decontaminate, quality_crf

SMALL = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("labels", "benchmark"))
    after = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after.append(stage(spark, after[-1], SMALL).cache())
        assert after[-1].columns == docs.columns
    kept = [{r.doc_id: r.text for r in d.collect()} for d in after]
    accepted = {r.doc_id for r in quality_crf.quality(spark, docs, labels).collect() if r.predicted}
    assert set(kept[1]) == accepted
    copies = brute.exact_dedup(list(kept[1].items()))
    assert set(kept[2]) == {i for i, x in copies.items() if x[2]}
    near = brute.jaccard_components(list(kept[2].items()), 5, 80)
    assert set(kept[3]) == {i for i, x in near.items() if x[1] == i}
    leaks = {r.doc_id for r in decontaminate.decontaminate(spark, after[3], items).collect()}
    assert set(kept[4]) == set(kept[3]) - leaks and leaks
    pieces = corpus_pipeline.run(spark, SMALL).collect()
    check_packing(pieces, kept[4].items())


@pytest.mark.parametrize("k", range(5))
def test_stages_take_any_rows(spark, k):
    rows = [(1, None, "x", "s", 0), (2, "", None, None, None), (None, "a text", "en", "s", 6), (3, "same text", "en", "s", 9), (3, "same text", "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    corpus_pipeline.STAGES[k][1](spark, docs, SMALL).collect()
    corpus_pipeline.STAGES[k][1](spark, docs.limit(0), SMALL).collect()


LONG = " ".join(f"word{k}" for k in range(60))
#: A doc_id under two texts, equal rows, rows without an id; names that operators use themselves, and one with a dot.
ODD = [
    (3, "same text", 0.5, "a", 1), (3, "other text", 0.5, "b", 2), (5, "Same Text", None, "c", 3), (5, "same text", 0.5, "d", 4), (7, "twice", 0.1, "e", 5), (7, "twice", 0.1, "e", 5),
    (None, "no id", 0.1, "f", 6), (None, "other text", 0.1, "g", 7), (8, LONG, 0.1, "h", 8), (8, LONG + " end", 0.1, "i", 9), (9, LONG.replace("word30", "x"), 0.1, "j", 10), (9, None, 0.1, "k", 11),
]
ODD_SCHEMA = "doc_id long, text string, score double, row string, `a.b` int"


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(*r[:3], r[3], r[4]) for r in ODD], ODD_SCHEMA).repartition(3)


def test_exact_copies_decide_by_row(spark, odd):
    out = corpus_pipeline.exact_copies(spark, odd, SMALL)
    assert out.columns == odd.columns
    got = sorted((r.doc_id or 0, (r.text or "").lower()) for r in out.collect())
    assert got == sorted([(3, "other text"), (5, "same text"), (7, "twice"), (0, "no id"), (8, LONG), (8, LONG + " end"), (9, LONG.replace("word30", "x")), (9, "")])


def test_near_copies_decide_by_row(spark, odd):
    out = corpus_pipeline.near_copies(spark, odd, SMALL)
    got = sorted((r["a.b"]) for r in out.collect())
    assert out.columns == odd.columns
    # equal texts are near copies as well; of each group the smallest doc_id's row stays
    assert [k for k in got if k >= 8] in ([8, 11], [9, 11]) and {2, 7} & set(got) == {7} and 6 in got


def test_leaks_go_by_row(spark, odd):
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").where("length(text) > 80").first().text
    docs = odd.union(spark.createDataFrame([(3, "Before. " + item + " After.", 0.5, "z", 99)], ODD_SCHEMA))
    out = corpus_pipeline.without_benchmark(spark, docs, SMALL)
    assert out.columns == odd.columns and sorted(r["a.b"] for r in out.collect()) == sorted(r[4] for r in ODD)


def test_quality_keeps_columns(spark, odd):
    out = corpus_pipeline.good_quality(spark, odd, SMALL)
    assert out.dtypes == odd.dtypes and {r["a.b"] for r in out.collect()} <= {r[4] for r in ODD}
