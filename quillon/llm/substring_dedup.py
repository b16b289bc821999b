"""Substring dedup by level-wise doubling of repeated windows.

A passage of ``window`` words that repeats holds repeated windows of half and a
quarter of that length. Windows repeated at one length alone are looked at
twice that length, until those of the full length are left:

* Level 1, window/4 words. Of the short windows inside a full window only the
  one with the smallest hash (the leftmost of equals) stands for it. Equal full
  windows have the same one at the same place, so nothing is lost, and about one
  word in ten gives a row. Neighbouring full windows with the same short window
  form a run. Rows are dealt by the short window; those alone there are unique.
* Runs equal in all their words are settled here, each with its first place:
  the later ones go whole, and only the first is looked at any further.
* Level 2, window/2 words: the short window grown to the left and to the right.
  A run whose grown windows are both alone among the different runs is unique.
* Level 3: the full windows of the runs that are left, by a 128-bit hash.

Exact copies of a whole document are settled before level 1 by a 128-bit hash of
their words, so groups of copies cost one row a document. A hot window is a hot
key of level 1 and is read as a sorted stream with a carry of constant size.

Defined cases: a null text has no words; a text shorter than the window is kept;
of equal windows the one in the smallest doc_id, then the earliest, stays;
repeated rows of one doc_id give one row (of the largest text); a null doc_id is
a document of its own kind and is left out; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .documents import id_and_text, one_row_each
from .scratch import Scratch

WINDOW = 20
#: Different runs of one short window that a task holds; with more, level 2 is left out for them.
HELD = 500_000
_TABLES = (W.byte_table(11, False), W.byte_table(12, False))
_POSITION_BITS = np.uint64(28)


def _anchors(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the short windows, and for each full window the start of the short one that stands for it."""
    short = window // 4
    grams = W.windows(hashes, short)
    span = window - short + 1
    low = (np.uint64(1) << _POSITION_BITS) - np.uint64(1)
    keyed = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    best, have = keyed, 1
    while have < span:
        step = min(have, span - have)
        best = np.minimum(best[:-step], best[step:])
        have += step
    return grams, (best & low).astype(np.int64)


def _copies(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            n_words, one, two = [], [], []
            for _, _, raw, off in W.text_chunks(column):
                starts, ends, first = W.word_spans(raw, off)
                n_words.append(np.diff(first))
                for table, out in zip(_TABLES, (one, two), strict=True):
                    h = W.word_hashes(raw, starts, ends, table)
                    place = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
                    sums = np.zeros(len(h) + 1, np.uint64)
                    np.cumsum(W.mix(h ^ W.mix(place.astype(np.uint64))), out=sums[1:])
                    out.append(sums[first[1:]] - sums[first[:-1]])
            n, a, b = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (n_words, one, two))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int64)), pa.array(W.signed(a)), pa.array(W.signed(b))], ["doc_id", "n_words", "h1", "h2"])

    return run


def _runs(window: int):
    """One row for each run of full windows with the same short window."""
    short = window // 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for r0, r1, raw, off in W.text_chunks(batch.column(1)):
                starts, ends, first = W.word_spans(raw, off)
                h = W.word_hashes(raw, starts, ends, _TABLES[0])
                if len(h) < window:
                    continue
                grams, anchor = _anchors(h, window)
                ok = W.inside(first, len(h), window)
                at = np.flatnonzero(ok)
                if not len(at):
                    continue
                a, row = anchor[at], np.searchsorted(first, at, side="right") - 1
                cut = np.flatnonzero(np.concatenate([[True], (np.diff(a) != 0) | (np.diff(row) != 0)]))
                s, a, row = at[cut], a[cut], row[cut]
                length = np.diff(np.append(cut, len(at)))
                stop = s + length + window - 1  # the word after the last full window
                up, down = W.powers(len(h))
                place = np.cumsum(np.concatenate([[np.uint64(0)], h * up[: len(h)]]), dtype=np.uint64)
                whole = W.mix((place[stop] - place[s]) * down[s] + W.mix(((a - s) * 4096 + length).astype(np.uint64)))
                grown = W.windows(h, 2 * short)
                right = grown[np.minimum(a, len(grown) - 1)] >> np.uint64(32)
                left = grown[np.maximum(a - short, 0)] >> np.uint64(32)
                offset = s - first[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(W.signed(grams[a])), pa.array(W.signed(whole)), pa.array(W.signed((left << np.uint64(32)) | right)), pa.array(ids[r0 + row]), pa.array((offset * 65536 + (a - s) * 256 + length).astype(np.int64))],
                    ["gram", "whole", "grown", "doc_id", "place"],
                )

    return run


_RUN = "gram long, whole long, grown long, doc_id long, place long"
_SETTLED = "doc_id long, place long, later boolean"


def _arrays(batches: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    table = pa.Table.from_batches(batches)
    return {name: table.column(name).combine_chunks().to_numpy() for name in table.column_names}


def _settle(window: int):
    """Rows sorted by gram, whole, doc_id, place: what is equal in whole goes but for the first; what is unique goes.

    The stream keeps the first row of each different run of the gram in hand, HELD at most.
    """
    short = window // 4

    def first_rows(x: dict[str, np.ndarray], gram0, whole0) -> np.ndarray:
        g, w = np.concatenate([[gram0], x["gram"]]), np.concatenate([[whole0], x["whole"]])
        return (np.diff(g) != 0) | (np.diff(w) != 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        crowded = None  # the gram whose different runs are too many to hold: all go on to level 3
        gram0, whole0, begun = np.int64(0), np.int64(0), False
        schema = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("later", pa.bool_())])

        def finish(held: list[pa.RecordBatch], keep_last: bool):
            """Different runs by gram: what is left after level 2; the last gram's stay in hand."""
            table = pa.Table.from_batches(held).combine_chunks()
            x = _arrays(table.to_batches())
            cut = int(np.searchsorted(x["gram"], x["gram"][-1])) if keep_last else len(x["gram"])
            rest = table.slice(cut).to_batches()
            gram, grown, place = x["gram"][:cut], x["grown"][:cut], x["place"][:cut]
            several = np.zeros(cut, bool)
            if cut:
                same = gram[1:] == gram[:-1]
                several[1:] |= same
                several[:-1] |= same
                several |= False if crowded is None else gram == crowded
            at = np.flatnonzero(several)
            offset, length = (place[at] >> 8) & 255, place[at] & 255
            found = np.zeros(len(at), bool)
            # the first window of a run holds the short one furthest to the right
            for half, fits in ((grown[at] & 0xFFFFFFFF, offset - length + 1 <= window - 2 * short), ((grown[at] >> 32) & 0xFFFFFFFF, offset >= short)):
                use = np.flatnonzero(fits)
                order = use[np.lexsort((half[use], gram[at][use]))]
                if len(order):
                    equal = (np.diff(half[order]) == 0) & (np.diff(gram[at][order]) == 0)
                    found[order[1:][equal]] = True
                    found[order[:-1][equal]] = True
            at = at[found | (False if crowded is None else gram[at] == crowded)]
            return pa.RecordBatch.from_arrays([pa.array(x["doc_id"][at]), pa.array(place[at]), pa.array(np.zeros(len(at), bool))], schema=schema), rest

        for batch in batches:
            if not batch.num_rows:
                continue
            x = _arrays([batch])
            if not begun:
                gram0, whole0, begun = ~x["gram"][0], ~x["whole"][0], True
            fresh = first_rows(x, gram0, whole0)
            gram0, whole0 = x["gram"][-1], x["whole"][-1]
            old = np.flatnonzero(~fresh)
            if len(old):
                yield pa.RecordBatch.from_arrays([pa.array(x["doc_id"][old]), pa.array(x["place"][old]), pa.array(np.ones(len(old), bool))], schema=schema)
            new = np.flatnonzero(fresh)
            if len(new):
                held.append(batch.take(pa.array(new)))
                out, held = finish(held, True)
                yield out
                if sum(b.num_rows for b in held) > HELD or held[0].column(0)[0].as_py() == crowded:
                    crowded = held[0].column(0)[0].as_py()
                    x = _arrays(held)
                    yield pa.RecordBatch.from_arrays([pa.array(x["doc_id"]), pa.array(x["place"]), pa.array(np.zeros(len(x["gram"]), bool))], schema=schema)
                    held = []
        if held:
            yield finish(held, False)[0]

    return run


def _full_windows(window: int):
    """The full windows of the runs that are left, by two hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places = batch.column(0).to_numpy(), batch.column(2)
            for r0, r1, raw, off in W.text_chunks(batch.column(1)):
                starts, ends, first = W.word_spans(raw, off)
                hashes = [W.windows(W.word_hashes(raw, starts, ends, t), window) for t in _TABLES]
                lists = places.slice(r0, r1 - r0)
                flat = lists.flatten().to_numpy()
                row = np.repeat(np.arange(r1 - r0), lists.value_lengths().to_numpy())
                offset, length = flat >> 16, flat & 255
                each = np.repeat(np.arange(len(flat)), length)
                step = np.arange(len(each)) - np.repeat(np.cumsum(length) - length, length)
                at = offset[each] + step
                word = first[row[each]] + at
                yield pa.RecordBatch.from_arrays([pa.array(W.signed(h[word])) for h in hashes] + [pa.array(ids[r0 + row[each]]), pa.array(at)], ["h1", "h2", "doc_id", "at"])

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gap = bytes([32, 9, 10, 11, 12, 13])
        to_space = bytes.maketrans(gap, b" " * 6)
        for batch in batches:
            n_words, n_removed, shas = [], [], []
            ids, texts, begins, ends, copy = (batch.column(i) for i in range(5))
            for i in range(batch.num_rows):
                text = texts[i].as_py() or ""
                found = text.encode("utf-8", "surrogatepass").translate(to_space).split(b" ")
                found = [w for w in found if w]
                n = len(found)
                if copy[i].as_py():
                    gone = np.full(n, n >= window)
                else:
                    marks = np.zeros(n + 1, np.int64)
                    if begins[i].is_valid:
                        np.add.at(marks, begins[i].values.to_numpy(), 1)
                        np.add.at(marks, np.minimum(ends[i].values.to_numpy(), n), -1)
                    gone = np.cumsum(marks[:n]) > 0
                kept = found if not gone.any() else [found[k] for k in np.flatnonzero(~gone)]
                n_words.append(n)
                n_removed.append(n - len(kept))
                shas.append((b" ".join(kept)).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(shas, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def substring_dedup(spark: SparkSession, docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (words joined by a space) for every document.

    ``window`` is a multiple of 4 between 8 and 128.
    """
    if window % 4 or not 8 <= window <= 128:
        raise ValueError("window must be a multiple of 4 between 8 and 128")
    scratch = Scratch(spark, "substring")
    docs = id_and_text(docs)
    shape = docs.mapInArrow(_copies(window), "doc_id long, n_words long, h1 long, h2 long")
    shape = scratch.save(shape, "shape")
    docs = one_row_each(docs, shape)
    groups = shape.where(F.col("n_words") >= window).distinct().groupBy("h1", "h2", "n_words").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    later = shape.join(groups, ["h1", "h2", "n_words"]).where("doc_id <> first_id").select("doc_id").distinct()
    later = scratch.save(later, "copies")

    own = docs.join(later, "doc_id", "left_anti")
    runs = own.mapInArrow(_runs(window), _RUN)
    settled = runs.repartition("gram").sortWithinPartitions("gram", "whole", "doc_id", "place").mapInArrow(_settle(window), _SETTLED)
    settled = scratch.save(settled, "runs")

    length, offset = F.col("place").bitwiseAND(F.lit(255)), F.shiftright("place", 16)
    whole = settled.where("later").select("doc_id", offset.alias("s"), (offset + length + (window - 1)).alias("e"))
    left = settled.where("not later").groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    full = docs.join(left, "doc_id").select("doc_id", "text", "places").mapInArrow(_full_windows(window), "h1 long, h2 long, doc_id long, at long")
    full = full.repartition("h1").sortWithinPartitions("h1", "h2", "doc_id", "at").mapInArrow(_later_windows(window), "doc_id long, s long, e long")
    ranges = scratch.save(whole.unionByName(full), "ranges")

    spans = ranges.groupBy("doc_id").agg(F.collect_list("s").alias("s"), F.collect_list("e").alias("e"))
    marks = spans.select("doc_id", "s", "e", F.lit(False).alias("copy")).unionByName(later.select("doc_id", F.lit(None).cast("array<bigint>").alias("s"), F.lit(None).cast("array<bigint>").alias("e"), F.lit(True).alias("copy")))
    joined = docs.join(marks, "doc_id", "left").select("doc_id", "text", "s", "e", F.coalesce("copy", F.lit(False)).alias("copy"))
    return joined.mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept_text string")


def _later_windows(window: int):
    """Of sorted full windows, all but the first of equals, as word ranges; neighbours are joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _arrays([batch])
            a, b = x["h1"], x["h2"]
            same = np.empty(len(a), bool)
            same[0] = before == (a[0], b[0])
            same[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
            before = (a[-1], b[-1])
            at = np.flatnonzero(same)
            order = at[np.lexsort((x["at"][at], x["doc_id"][at]))]
            doc, s = x["doc_id"][order], x["at"][order]
            if len(order):
                cut = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(s) > window)]))
                last = np.append(cut[1:], len(order)) - 1
                yield pa.RecordBatch.from_arrays([pa.array(doc[cut]), pa.array(s[cut]), pa.array(s[last] + window)], ["doc_id", "s", "e"])

    return run


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
