import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import exact_dedup, graph, line_dedup, ngram_join, substring_dedup
from quillon.llm.scratch import Scratch


def by_id(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def test_ngram_join(spark, docs, rows):
    assert by_id(ngram_join.similarity_components(spark, docs, 3, 90)) == brute.jaccard_components(rows)
    assert by_id(ngram_join.similarity_components(spark, docs)) == brute.jaccard_components(rows, 5, 80)


def test_ngram_join_in_blocks_and_stars(spark, monkeypatch):
    """A group whose members link through one text only, in trees that are cut into blocks."""
    base = [f"b{k}" for k in range(200)]
    rows = [(50, " ".join(base))]
    for i in range(40):
        words = list(base)
        for k in range(3):
            words[(i * 5 + k * 60) % 200] = f"x{i}y{k}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_id(ngram_join.similarity_components(spark, docs, 3, 90)) == brute.jaccard_components(rows)


def test_ngram_join_in_large_trees(spark, monkeypatch):
    """Hubs, chains and borderline copies in trees of several leaves, with pivots and in blocks."""
    from quillon.llm import tree_search

    rng = random.Random(5)
    base, rows = [f"b{k}" for k in range(120)], []
    for i in range(160):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
            words[rng.randrange(120)] = f"x{i}y{rng.random()}"
        rows.append((i * 7 % 160, " ".join(words)))
    chain = [f"c{k}" for k in range(100)]
    for i in range(30):
        chain[3 * i % 100] = f"z{i}"
        rows.append((1000 - i, " ".join(chain)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.jaccard_components(rows, 5, 80)
    monkeypatch.setattr(ngram_join, "BLOCK", 25)
    assert by_id(ngram_join.similarity_components(spark, docs)) == want
    assert len({c for _, c in want.values()}) > 3


@pytest.mark.parametrize("leaf,dense", [(4, 12), (4, 512), (64, 512)])
def test_searches_lose_no_pair(monkeypatch, leaf, dense):
    from quillon.llm import tree_search as T

    for name, value in (("LEAF", leaf), ("DENSE", dense), ("PIVOTS", 2), ("PAIRS", 50)):
        monkeypatch.setattr(T, name, value)
    rng = np.random.default_rng(leaf)
    sets = []
    for _ in range(3):
        base = rng.integers(0, 1 << 62, 300).astype(np.uint64)
        sets += [np.unique(np.where(rng.random(300) < rng.choice([0, 0.03, 0.1]), rng.integers(0, 1 << 62, 300).astype(np.uint64), base)) for _ in range(25)]
    order = rng.permutation(len(sets))
    sets = [sets[k] for k in order]
    n = len(sets)

    def found(first, tok, label, kind):
        by = np.argsort(tok, kind="stable")
        columns = [tok, np.zeros(n, np.int32), np.arange(n), np.array([len(s) for s in sets]), label, np.array(kind, np.int32)]
        points = [[T.pack(np.bincount((s % np.uint64(T.GROUPS)).astype(int), minlength=T.GROUPS)) for s in sets], [T.parity(s) for s in sets]]
        batch = pa.RecordBatch.from_arrays([pa.array(c[by]) for c in columns] + [pa.array([p[k] for k in by], pa.binary()) for p in points], list("abcdefgh"))
        out = [(a, b) for r in T.search(80, first)(iter([batch.slice(k, 10) for k in range(0, n, 10)])) for a, b in zip(r.column(0).to_pylist(), r.column(1).to_pylist(), strict=True)]
        return set(out)

    linked = {(x, y) for x in range(n) for y in range(x + 1, n) if 100 * len(np.intersect1d(sets[x], sets[y])) >= 80 * len(np.union1d(sets[x], sets[y]))}
    tok, label, ask = np.arange(n) % 2, np.arange(n), np.arange(n) % 3 > 0
    want = {(x, y) for x, y in linked if tok[x] == tok[y] and (ask[x] or ask[y])}
    got = found(False, tok, label, ask.astype(int))
    assert want <= got and len(got) < 2 * len(want) + 20
    first = found(True, np.zeros(n, int), label, np.zeros(n, int))
    assert {i for p in linked for i in p} <= {i for p in first for i in p} or dense < n
    assert len(first) <= 2 * n


def test_parity_bounds_the_difference():
    from quillon.llm import tree_search as T

    rng = np.random.default_rng(3)
    for a, b in ((100, 120), (300, 400), (30, 2500)):
        pool = rng.integers(0, 1 << 63, a + b, np.int64).view(np.uint64)
        sets = [np.unique(pool[:a]), np.unique(pool[a // 2 : a // 2 + b])]
        rows = pa.RecordBatch.from_arrays([pa.array([1, 1]), pa.array([0, 0], pa.int32()), pa.array([1, 2]), pa.array([len(s) for s in sets]), pa.array([1, 2]), pa.array([0, 0], pa.int32()), pa.array([T.pack(np.bincount((s % np.uint64(T.GROUPS)).astype(int), minlength=T.GROUPS)) for s in sets]), pa.array([T.parity(s) for s in sets])], list("abcdefgh"))
        apart = len(np.setxor1d(*sets))
        found = T.Points(rows, 80).distance(np.array([0]), np.array([1]))[0]
        assert found <= apart and (apart - found) % 2 == 0 and (apart > 400 or found > 0.8 * apart)


def thue_morse(letters, n=4096):
    return "".join(letters[bin(k).count("1") & 1] for k in range(n))


def test_hashes_tell_thue_morse_words_apart(spark):
    """Words that agree in any polynomial hash modulo 2**64."""
    a, b = thue_morse("ab"), thue_morse("ba")
    rest = [f"w{k}" for k in range(19)]
    rows = [(1, " ".join([a, *rest])), (2, " ".join([b, *rest])), (3, a + "\n" + b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_id(substring_dedup.digest(substring_dedup.substring_dedup(spark, docs))) == brute.substring_dedup(rows)
    assert by_id(ngram_join.similarity_components(spark, docs, 3, 90)) == brute.jaccard_components(rows)
    assert by_id(line_dedup.digest(line_dedup.line_dedup(spark, docs)))[3][1] == 0


def test_ngram_join_cases(spark, none, repeated):
    assert ngram_join.similarity_components(spark, none).count() == 0
    assert by_id(ngram_join.similarity_components(spark, repeated, 3, 90)) == {1: (7, 1), 2: (7, 1)}


def test_exact_dedup(spark, docs, rows):
    assert by_id(exact_dedup.exact_dedup(spark, docs)) == brute.exact_dedup(rows)


def test_exact_dedup_cases(spark, none, repeated):
    assert exact_dedup.exact_dedup(spark, none).count() == 0
    got = sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(spark, repeated).collect())
    assert got == [(0, None, 1, True), (1, 2, 3, False), (1, 2, 3, False), (2, 2, 3, True)]


def test_chunks_join_to_the_text(spark, docs):
    from pyspark.sql import functions as F

    text = exact_dedup.normalised(F.col("text"))
    assert docs.where(F.concat_ws("", exact_dedup.chunks(text)) != text).count() == 0


def test_unsure_fingerprints(spark):
    """One fingerprint for two contents: the contents tell the recipes apart."""
    rows = [(1, "a", [7, 8], [b"x", b"y"]), (2, "b", [7, 8], [b"x", b"z"]), (3, "b", [7, 8], [b"x", b"z"]), (4, "c", [9], [b"w"]), (5, "c", [9], [b"w"])]
    recipes = spark.createDataFrame(rows, "doc_id long, text_sha256 string, recipe array<long>, contents array<binary>")
    groups = exact_dedup.verified(recipes, Scratch(spark, "test")).groupBy("ids").count().collect()
    assert sorted(r[1] for r in groups) == [1, 2, 2]


@pytest.mark.parametrize("window", [8, 20])
def test_substring_dedup(spark, docs, rows, window):
    assert by_id(substring_dedup.digest(substring_dedup.substring_dedup(spark, docs, window))) == brute.substring_dedup(rows, window)


def test_substring_dedup_crowded(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HELD", 3)
    assert by_id(substring_dedup.digest(substring_dedup.substring_dedup(spark, docs, 8))) == brute.substring_dedup(rows, 8)


def test_substring_dedup_cases(spark, none, repeated):
    assert substring_dedup.substring_dedup(spark, none).count() == 0
    assert by_id(substring_dedup.substring_dedup(spark, repeated, 8))[1][:2] == (9, 0)


@pytest.mark.parametrize("crowd", [64, 0])
def test_line_dedup(spark, docs, rows, monkeypatch, crowd):
    monkeypatch.setattr(line_dedup, "CROWD", crowd)
    assert by_id(line_dedup.digest(line_dedup.line_dedup(spark, docs))) == brute.line_dedup(rows)


def test_line_dedup_keeps_links_of_indexed_lines(spark, monkeypatch):
    """In crowded groups a line that is only ever another's second partner is still linked."""
    import random

    monkeypatch.setattr(line_dedup, "CROWD", 0)
    rng, letters, rows = random.Random(5), "abcdefghijklmnopqrstuvwxyz", []
    for k in range(30):
        p = "".join(rng.choice(letters) for _ in range(30))
        # two edits from p each, four from each other; all three share the last segment only
        for m, places in enumerate([(), (1, 12), (6, 17)]):
            rows.append((3 * k + m, "".join(c.upper() if at in places else c for at, c in enumerate(p))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_id(line_dedup.digest(line_dedup.line_dedup(spark, docs))) == brute.line_dedup(rows)


def test_line_dedup_of_short_lines(spark):
    """Lines under 20 characters go as exact copies only, blank ones never."""
    rows = [(1, "Yes.\nNo.\n\n \nYes."), (2, " Yes. \nyes.\n\nAll rights reserved"), (3, "All rights reserved\nAll rights reserved.\nAll rights reserved."), (4, "a"), (5, "a\na")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.kept_text) for r in line_dedup.line_dedup(spark, docs).collect()}
    assert got == {1: (1, "Yes.\nNo.\n\n "), 2: (1, "yes.\n\nAll rights reserved"), 3: (2, "All rights reserved."), 4: (0, "a"), 5: (2, "")}


def test_groups_of_many_batches(monkeypatch):
    """A group that is longer than what is held at once, with repeats of its lines."""
    monkeypatch.setattr(line_dedup, "HELD", 20)
    rng = np.random.default_rng(2)
    key = np.sort(rng.choice([2, 4, 5, 5, 5, 8, 9], 500))
    line = rng.integers(0, 40, 500)
    batch = pa.RecordBatch.from_arrays([pa.array(key), pa.array(line), pa.array(line * 3)], ["key", "line", "bits"])
    want = {(k >> 1, k & 1, x) for k, x in zip(key.tolist(), line.tolist(), strict=True) if (key >> 1 == k >> 1).sum() > 1}
    got = [r for x in line_dedup._groups(iter([batch.slice(a, 7) for a in range(0, 500, 7)])) for r in zip(x["key"].tolist(), x["side"].tolist(), x["line"].tolist(), strict=True)]
    assert len(got) == len(set(got)) and set(got) == want


def test_line_dedup_cases(spark, none, repeated):
    assert line_dedup.line_dedup(spark, none).count() == 0
    assert {k: v[:2] for k, v in by_id(line_dedup.line_dedup(spark, repeated)).items()} == {1: (1, 0), 2: (1, 1)}


def test_banded_distance():
    import random

    rng = random.Random(5)
    for most in (1, 2, 4):
        a, b = [], []
        for _ in range(400):
            x = [rng.choice("abc") for _ in range(rng.randint(1, 30))]
            y = list(x)
            for _ in range(rng.randint(0, most + 2)):
                k = rng.randint(0, len(y))
                y[k : k + rng.randint(0, 1)] = rng.choice([[], ["a"], ["d"]])
            x, y = sorted(("".join(x), "".join(y)), key=len, reverse=True)
            if len(x) - len(y) <= most:
                a.append(x)
                b.append(y)
        got = line_dedup.banded_distance([line_dedup.codes(x) for x in a], [line_dedup.codes(x) for x in b], most)
        assert list(got) == [min(brute.edit_distance(x, y), most + 1) for x, y in zip(a, b)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (103, 101), (7, 7), (200, 300), (300, 200)]
    got = graph.components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "test")).collect()
    want = brute.components({i for e in edges for i in e}, edges)
    assert sorted((r.id, r.component) for r in got) == sorted(want.items())
