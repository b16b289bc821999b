"""N-gram Jaccard join by R-trees over count vectors.

The tokens of a document are the distinct hashes of its n-word shingles. Hashed
into GROUPS groups they give a point of group counts. The overlap of two sets
is at most the sum over the groups of the smaller count, and for a whole node of
the tree at most that sum with the node's largest counts, so a search goes down
only where the bound still reaches the overlap that the similarity asks for.
Pairs that survive are held against a finer bound that travels with the point, and
what is left is verified on the sets.

How it is dealt out:

* Documents with equal sets are one class, whose smallest doc_id goes on.
* One tree over all points would prune nothing from the top (in many dimensions
  its upper nodes cover everything), so the points are dealt to trees by the
  tokens at the front of their set: two sets with Jaccard similarity t share one
  of the first n - ceil(t n) + 1 tokens of any fixed order (the smaller set even
  of its first n - ceil(2 t n / (1 + t)) + 1), and a token's row goes no further
  unless a row of a fitting size is there to meet it. The order goes by hash, but
  puts tokens last that HOT documents or more have at the front of their hash order
  (counted over all documents, then held as a filter of fixed size, for which any
  answer makes an order), so that trees stay small and no token is left out.
* Tokens with the same smallest and largest class make one tree, so a group of
  copies that share many tokens is a few trees and not one for each token. A tree of
  more than BLOCK points is cut into blocks of points, and those that ask into
  blocks too; each pair of blocks is a task.
* Two searches keep the pairs linear in groups of copies. In the first, every
  class gives its smallest and its nearest surviving partner in each tree, of a
  large tree among a few pivots; verified links make components. The second gives
  all surviving pairs that lie in different components, so no link between
  components is lost. There only classes outside a tree's main component ask, and
  go to all of its blocks.

Defined cases: a null text has no words; a document without words has no
shingles and links with nothing, nor with another empty one; with fewer words
than a shingle the whole sequence is one shingle; a null doc_id is left out;
repeated rows of a doc_id count once, the largest text for all; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .documents import id_and_text, one_row_each
from .graph import components
from .membership import Membership
from .scratch import Scratch
from .tree_search import GROUPS, pack, parity, search
from .words import U64

#: Documents with a token at their front that put it last.
HOT = 32
#: Rows with a text or a set in them that Python gets at once.
WIDE = 500
#: Members of a tree in one task.
BLOCK = 4096

_FIRST = W.byte_table(21, True)


def _shingle_sets(raw: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All rows' distinct shingle hashes, sorted within each row, and where each row begins (with the end)."""
    starts, ends, first = W.word_spans(raw, off)
    h = W.word_hashes(raw, starts, ends, _FIRST)
    rows = len(off) - 1
    row = np.repeat(np.arange(rows), np.diff(first))
    ok = W.inside(first, len(h), n)
    grams, owner = W.windows(h, n)[ok], row[: len(ok)][ok]
    count = np.diff(first)
    for i in np.flatnonzero((count > 0) & (count < n)):  # the whole sequence is the one shingle
        value = np.uint64(count[i])
        for x in h[first[i] : first[i + 1]]:
            value = W.mix(np.array([value], np.uint64) * np.uint64(0x9FB21C651E98DF25) + x)[0]
        grams, owner = np.append(grams, value), np.append(owner, i)
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[fresh], owner[fresh]
    return grams, np.searchsorted(owner, np.arange(rows + 1))


def _fronts(n: int, percent: int):
    """(tok, k): how many documents of a batch have a token at the front of their hash order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for _, _, raw, off in W.text_chunks(batch.column(1)):
                grams, at = _shingle_sets(raw, off, n)
                place = np.arange(len(grams)) - np.repeat(at[:-1], np.diff(at))
                parts.append(grams[place < np.repeat(front_size(np.diff(at), percent), np.diff(at))])
            tok, k = np.unique(np.concatenate(parts) if parts else np.zeros(0, U64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(W.signed(tok)), pa.array(k)], ["tok", "k"])

    return run


def front_size(n: np.ndarray, percent: int) -> np.ndarray:
    """How many tokens of a set of n make its front; none of an empty one."""
    return np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)


def hot_tokens(spark: SparkSession, docs: DataFrame, n: int, percent: int) -> Membership:
    counts = docs.mapInArrow(_fronts(n, percent), "tok long, k long").groupBy("tok").agg(F.sum("k").alias("k"))
    return Membership(spark, counts.where(F.col("k") >= HOT).select("tok"))


def _points(n: int, percent: int, hot: Membership):
    """For each document its set's size and 128-bit hash, its point, its parity vector, and its front tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            sizes, hash1, hash2, points, bits, fronts = [], [], [], [], [], []
            for _, _, raw, off in W.text_chunks(batch.column(1)):
                grams, at = _shingle_sets(raw, off, n)
                late = hot.may(W.signed(grams))
                size = np.diff(at)
                fronted = front_size(size, percent)
                for salt, out in ((1, hash1), (2, hash2)):
                    sums = np.zeros(len(grams) + 1, np.uint64)
                    np.cumsum(W.mix(grams + np.uint64(salt)), out=sums[1:])
                    out.append(sums[at[1:]] - sums[at[:-1]])
                sizes.append(size)
                owner = np.repeat(np.arange(len(size)), size)
                group = (W.mix(grams ^ np.uint64(0xA5A5A5A5)) % np.uint64(GROUPS)).astype(np.int64)
                counts = np.bincount(owner * GROUPS + group, minlength=len(size) * GROUPS).reshape(len(size), GROUPS)
                for i in range(len(size)):
                    own = grams[at[i] : at[i + 1]]
                    if late[at[i] : at[i + 1]].any():
                        own = own[np.argsort(late[at[i] : at[i + 1]], kind="stable")]
                    fronts.append(W.signed(own[: fronted[i]]))
                    points.append(pack(counts[i]))
                    bits.append(parity(grams[at[i] : at[i + 1]]))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(np.concatenate(x).astype(np.uint64).view(np.int64) if x else np.zeros(0, np.int64)) for x in (sizes, hash1, hash2)), pa.array(points, pa.binary()), pa.array(bits, pa.binary()), pa.array(fronts, pa.list_(pa.int64()))], ["doc_id", "n", "h1", "h2", "point", "bits", "front"])

    return run


def _sets(n: int, wanted: Membership):
    """(id, n, data) of the documents that the test passes; data: the sorted shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(wanted.may(batch.column(0).to_numpy())))
            sizes, data = [], []
            for _, _, raw, off in W.text_chunks(batch.column(1)):
                grams, at = _shingle_sets(raw, off, n)
                for i in range(len(at) - 1):
                    own = grams[at[i] : at[i + 1]]
                    sizes.append(len(own))
                    data.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(data, pa.binary())], ["id", "n", "data"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = np.zeros(batch.num_rows, bool)
            left, right = batch.column(4), batch.column(5)
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(x[i].as_buffer(), np.uint64) for x in (left, right))
                both = np.concatenate([a, b])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                linked[i] = 100 * same >= percent * (len(both) - same)
            yield batch.select([0, 1]).filter(pa.array(linked))

    return run


def _with_data(pairs: DataFrame, made: DataFrame) -> DataFrame:
    """Pairs with both sides' sizes and data. Always by merge joins, which can split a hot document's pairs."""
    left, right = (made.select(F.col("id").alias(k), F.col("n").alias(f"n_{k}"), F.col("data").alias(f"data_{k}")).hint("merge") for k in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "data_a", "data_b")


def _members(shared: DataFrame) -> DataFrame:
    """(tree, id, n): the tokens' groups, those with the same smallest and largest class as one. Two trees of one number would only ask more."""
    ends = shared.groupBy("tok").agg(F.min("id").alias("one"), F.max("id").alias("two")).where("one < two").select("tok", F.xxhash64("one", "two").alias("tree"))
    return shared.join(ends, "tok").groupBy("tree", "id").agg(F.first("n").alias("n"))


def _trees(members: DataFrame, points: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The rows of all trees: tree, block, id, n, label, kind, point, bits.

    A tree whose classes are all of one label is left out. Those that ask are the
    first and last class of a cut tree (first search), or all outside its main
    label (second).
    """
    if labels is None:
        rows = members.withColumn("label", F.col("id"))
        kinds = rows.groupBy("tree").agg(F.count("*").alias("k"), F.lit(2).alias("asking"), F.min("id").alias("one"), F.max("id").alias("two"))
    else:
        rows = members.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        own = rows.groupBy("tree", "label").agg(F.count("*").alias("k"))
        kinds = own.groupBy("tree").agg(F.sum("k").alias("k"), (F.sum("k") - F.max("k")).alias("asking"), F.expr("max_by(label, struct(k, label))").alias("one"), F.count("*").alias("labels")).where("labels > 1")
    asks = F.expr("id in (one, two)" if labels is None else "label <> one")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    rows = rows.join(kinds, "tree").select("tree", "id", "n", "label", asks.alias("asks"), blocks("k").alias("nb"), blocks("asking").alias("na"))
    # a row of a cut tree lies in one block, for each block of those that ask; one that asks goes to all blocks
    part = lambda n: F.expr(f"cast(pmod(xxhash64(id, 3), {n}) as int)")
    whole = F.array(F.struct(F.lit(0).alias("block"), F.col("asks").cast("int").alias("kind")))
    lying = F.transform(F.sequence(F.lit(0), F.col("na") - 1), lambda j: F.struct((part("nb") * F.col("na") + j).alias("block"), F.lit(0).alias("kind")))
    asking = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda i: F.struct((i * F.col("na") + part("na")).alias("block"), F.lit(2).alias("kind")))
    cut = F.when(F.col("asks"), F.concat(lying, asking)).otherwise(lying)
    placed = rows.withColumn("at", F.explode(F.when(F.col("nb") == 1, whole).otherwise(cut)))
    return placed.select("tree", "at.block", "id", "n", "label", "at.kind").join(points, "id").select("tree", "block", "id", "n", "label", "kind", "point", "bits")


def similarity_components(spark: SparkSession, docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every document.

    Documents link when 100 * intersection >= percent * union of their sets of
    distinct n-word shingles; component_id is the smallest doc_id reachable by
    links, itself included.
    """
    scratch = Scratch(spark, "ngram-join")
    docs = id_and_text(docs)
    docs = one_row_each(docs, docs.select("doc_id"))
    points = docs.mapInArrow(_points(n, percent, hot_tokens(spark, docs, n, percent)), "doc_id long, n long, h1 long, h2 long, point binary, bits binary, front array<bigint>")
    points = scratch.save(points, "points", WIDE)
    classes = points.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("id"))
    classes = scratch.save(classes, "classes")
    heads = points.join(classes.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "n", "point", "bits", "front")

    # of the tokens' rows only those stay whose token has another class's row
    front = heads.select(F.posexplode("front").alias("at", "tok"), "id", "n")
    early = F.col("at") < F.expr(f"n - (2 * {percent} * n + {99 + percent}) div {100 + percent} + 1")
    front = front.select("tok", "id", (F.col("n") * 2 + early.cast("long")).alias("size"))
    shared = front.repartition("tok").sortWithinPartitions("tok", "size", "id").mapInArrow(_shared(percent), "tok long, id long, n long")
    members = scratch.save(_members(scratch.save(shared, "shared")), "members")
    scratch.release()
    where = heads.select("id", "point", "bits")

    def pairs(labels: DataFrame | None) -> DataFrame:
        rows = _trees(members, where, labels).repartition("tree", "block").sortWithinPartitions("tree", "block")
        return scratch.save(rows.mapInArrow(search(percent, labels is None), "a long, b long").distinct(), "pairs", WIDE)

    def joined(links: DataFrame) -> DataFrame:
        edges = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
        return scratch.save(components(edges, scratch).select("id", F.col("component").alias("label")), "labels")

    def linked(some: DataFrame) -> DataFrame:
        scratch.release()
        ids = some.select("a").unionByName(some.select(F.col("b").alias("a"))).distinct()
        sets = scratch.save(docs.mapInArrow(_sets(n, Membership(spark, ids)), "id long, n long, data binary"), "sets", WIDE)
        found = scratch.save(_with_data(some, sets).mapInArrow(_verify(percent), "a long, b long"), "linked", WIDE)
        scratch.release()
        return found

    some = pairs(None)
    first = linked(some)
    more = pairs(joined(first)).join(some, ["a", "b"], "left_anti")
    label = joined(first.unionByName(linked(scratch.save(more, "more"))))
    by_class = classes.join(label, "id", "left").select("n", "h1", "h2", F.coalesce("label", "id").alias("component_id"))
    return (
        points.select("doc_id", "n", "h1", "h2")
        .join(by_class, ["n", "h1", "h2"], "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    )


def _shared(percent: int):
    """Of rows (token, id, 2 * n + early) sorted by token and size, those that another row of the token can be similar to.

    A pair is looked at from its smaller set x: its token is among the first
    n - ceil(2 t n / (1 + t)) + 1 of x (``early``), and the sizes fit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("tok", pa.int64()), ("id", pa.int64()), ("n", pa.int64())])
        carried = np.zeros((4, 0), np.int64)  # the last row, which needs the next one
        early0 = (0, -1)  # token and size of the last early row before it

        def kept(rows: np.ndarray, decided: int) -> pa.RecordBatch:
            tok, n, early = rows[0], rows[2], rows[3] > 0
            last = np.maximum.accumulate(np.where(early, np.arange(len(tok)), -1))
            before = np.concatenate([[-1], last[:-1]])
            from_tok, from_n = np.where(before >= 0, tok[before], early0[0]), np.where(before >= 0, n[before], early0[1])
            keep = (from_n >= 0) & (from_tok == tok) & (100 * from_n >= percent * n)
            keep[:-1] |= early[:-1] & (tok[1:] == tok[:-1]) & (100 * n[:-1] >= percent * n[1:])
            at = np.flatnonzero(keep[:decided])
            return pa.RecordBatch.from_arrays([pa.array(rows[k][at]) for k in range(3)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            tok, own, size = (batch.column(k).to_numpy() for k in range(3))
            rows = np.concatenate([carried, np.stack([tok, own, size >> 1, size & 1])], axis=1)
            yield kept(rows, rows.shape[1] - 1)
            early = np.flatnonzero(rows[3, :-1])
            if len(early):
                early0 = (rows[0, early[-1]], rows[2, early[-1]])
            carried = rows[:, -1:]
        if carried.shape[1]:
            yield kept(carried, 1)

    return run
