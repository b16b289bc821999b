"""Packing by non-negative least squares over the length histogram.

A document's ids are cut into whole windows and a tail. Whole windows are
sequences of their own. For the tails, shallow combinations of lengths that fill
a window exactly are listed, non-negative least squares finds how often to use
each so that together they meet the histogram, the counts are rounded down, and
what is left over is packed greedily: laid end to end and cut at window ends. The
last window of that is cut at powers of two, which need no padding.

The histogram has at most ``window`` rows and the plan at most COMBINATIONS
combinations, whatever the input's size, so both fit the driver. A tail's place
follows from its rank among the tails of its length: ranks come from a sort by
ranges and one count for each task and length, not from one task.

Ids are made once; a piece carries the CRC-32 of its ids from then on. Only tails
that a window end cuts in two are made again.

Defined cases: a null or empty text has the end id alone; repeated rows of a
doc_id are packed as documents of their own; rows with a null doc_id are packed
too; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch
from .tokens import ROWS, encoder, public_path

WINDOW = 4096
#: Combinations that the least-squares problem has at most.
COMBINATIONS = 40_000
#: Times that a combination takes one length at most.
REPEATS = 48
#: Steps of the solver.
STEPS = 200
#: Cut tails (about 300 bytes each) that are broadcast to where their ids are made again; beyond it they are joined by a shuffle.
BROADCAST_CUTS = 100_000

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def combinations(histogram: np.ndarray, window: int, most: int = COMBINATIONS) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, times): rows of up to four lengths (0 for none) of the histogram, and how often a window holds each.

    Each row fills the window exactly. They are one length taken up to REPEATS
    times with one other to fill up, then threes and fours of the most frequent
    lengths. Beyond ``most`` those whose lengths are rarer go.
    """
    have = np.flatnonzero(histogram[:window])
    have = have[have > 0]
    present = np.zeros(window + 1, bool)
    present[have] = True
    a, m = (v.reshape(-1) for v in np.meshgrid(have, np.arange(1, REPEATS + 1), indexing="ij"))
    b = window - a * m
    fits = (b > 0) & (b != a) & ((m > 1) | (b > a))
    fits[fits] = present[b[fits]]
    a, m, b = a[fits], m[fits], b[fits]
    even = have[(window % have == 0) & (window // have <= REPEATS)]
    zero = lambda v: np.zeros_like(v)
    rows = [np.stack([a, b, zero(a), zero(a)], axis=1), np.stack([even, zero(even), zero(even), zero(even)], axis=1)]
    times = [np.stack([m, zero(m) + 1, zero(m), zero(m)], axis=1), np.stack([window // even, zero(even), zero(even), zero(even)], axis=1)]
    common = np.sort(have[np.argsort(-histogram[have], kind="stable")][: int(np.sqrt(most)) + 1])
    x, y = (v.reshape(-1) for v in np.meshgrid(common, common, indexing="ij"))
    z = window - x - y
    three = (x < y) & (z > y)
    three[three] = present[z[three]]
    rows.append(np.stack([x[three], y[three], z[three], zero(x[three])], axis=1))
    few = common[:: max(1, len(common) // (int(round(most ** (1 / 3))) + 1))]
    x, y, z = (v.reshape(-1) for v in np.meshgrid(few, few, few, indexing="ij"))
    w = window - x - y - z
    four = (x < y) & (y < z) & (w > z)
    four[four] = present[w[four]]
    rows.append(np.stack([x[four], y[four], z[four], w[four]], axis=1))
    times += [(r > 0).astype(int) for r in rows[2:]]
    found, often = np.concatenate(rows), np.concatenate(times)
    if len(found) > most:
        weight = np.log(np.maximum(histogram[found], 1)).sum(axis=1) / (found > 0).sum(axis=1)
        first = np.sort(np.argsort(-weight, kind="stable")[:most])
        found, often = found[first], often[first]
    return found, often


def least_squares(rows: np.ndarray, times: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """x >= 0 that makes the lengths used, A x, close to the histogram.

    A has the combinations as columns. Projected gradient with Nesterov's
    momentum; the step comes from a bound on A'A's largest eigenvalue.
    """

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(rows.reshape(-1), (x[:, None] * times).reshape(-1), minlength=len(histogram))

    def back(r: np.ndarray) -> np.ndarray:
        return (r[rows] * times).sum(axis=1)

    if not len(rows):
        return np.zeros(0)
    target = histogram.astype(float)
    target[0] = 0
    # columns are scaled to a length of one, so that long repeats don't hold the step down
    scale = 1 / np.sqrt((times**2).sum(axis=1))
    bound = max(1.0, (back(forward(scale)) * scale / scale).max() if len(scale) else 1.0)
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        after = np.maximum(0, y - scale * back(forward(scale * y) - target) / bound)
        t_after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = after + (t - 1) / t_after * (after - x)
        x, t = after, t_after
    return x * scale


def rounded(rows: np.ndarray, times: np.ndarray, x: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Whole counts that the histogram can supply: the solution's, the largest first, then as many more as are left."""
    left, counts = histogram.astype(np.int64).copy(), np.zeros(len(rows), np.int64)
    parts = [np.flatnonzero(r) for r in rows]
    for more in (False, True):
        for k in np.argsort(-x, kind="stable"):
            lengths, often = rows[k][parts[k]], times[k][parts[k]]
            most = int((left[lengths] // often).min())
            n = most if more else min(most, int(np.floor(x[k] + 0.5)))
            if n:
                counts[k] += n
                left[lengths] -= n * often
    return counts


class Plan:
    """Where the tail of a length and a rank among its like goes."""

    def __init__(self, histogram: np.ndarray, window: int):
        self.window = window
        rows, times = combinations(histogram, window)
        counts = rounded(rows, times, least_squares(rows, times, histogram), histogram)
        rows, times, counts = rows[counts > 0], times[counts > 0], counts[counts > 0]
        first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.residual_sequence = int(first[-1])
        # one entry for each place of a combination, in the order of its window
        which, place = np.nonzero(rows)
        often = times[which, place]
        which, lengths = np.repeat(which, often), np.repeat(rows[which, place], often)
        ends = np.cumsum(lengths)
        offset = ends - lengths - which * window
        order = np.lexsort((offset, which, lengths))
        which, lengths, offset = which[order], lengths[order], offset[order]
        self._at = np.searchsorted(lengths, np.arange(window + 2))
        self._first, self._offset = first[:-1][which], offset
        self._from = np.cumsum(counts[which]) - counts[which]
        used = np.bincount(lengths, counts[which], minlength=window + 1).astype(np.int64)[: window + 1]
        self.used = used
        rest = histogram[: window + 1] - used
        tokens = rest * np.arange(window + 1)
        self._residual_at = np.concatenate([[0], np.cumsum(tokens)])[:-1]
        self.residual_tokens = int(tokens.sum())
        self._whole, rest = divmod(self.residual_tokens, window)
        bits = [1 << b for b in range(window.bit_length() - 1, -1, -1) if rest >> b & 1]
        self._last_ends = self._whole * window + np.cumsum(bits, dtype=np.int64)
        self.sequences = self.residual_sequence + self._whole + len(bits)

    def _residual(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, its begin, its end) among the leftovers, for places in them."""
        s = at // self.window
        begin, end = s * self.window, (s + 1) * self.window
        late = s >= self._whole
        if late.any():
            k = np.searchsorted(self._last_ends, at[late], side="right")
            s[late], end[late] = self._whole + k, self._last_ends[k]
            begin[late] = np.concatenate([[self._whole * self.window], self._last_ends])[k]
        return self.residual_sequence + s, begin, end

    def pieces(self, length: int, ranks: np.ndarray) -> tuple[np.ndarray, ...]:
        """(index into ranks, start in the tail, length, sequence, offset) of the pieces of tails of one length."""
        own = slice(self._at[length], self._at[length + 1])
        planned = np.flatnonzero(ranks < self.used[length])
        starts = self._starts(own)
        k = np.searchsorted(starts, ranks[planned], side="right") - 1
        parts = [(planned, np.zeros(len(planned), np.int64), np.full(len(planned), length), self._first[own][k] + ranks[planned] - starts[k], self._offset[own][k])]
        rest = np.flatnonzero(ranks >= self.used[length])
        at = self._residual_at[length] + (ranks[rest] - self.used[length]) * length
        done = np.zeros(len(rest), np.int64)
        while len(rest):
            sequence, begin, end = self._residual(at)
            size = np.minimum(end - at, length - done)
            parts.append((rest, done, size, sequence, at - begin))
            more = done + size < length
            rest, done, at = rest[more], (done + size)[more], (at + size)[more]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _starts(self, own: slice) -> np.ndarray:
        """Rank of the first tail of each place of one length."""
        base = self._from[own]
        return base - base[0] if len(base) else base


_DOC = "doc_id long, doc_tokens long, doc_crc long, whole array<bigint>, tail int, tail_crc long, part int, before long"


def _tokenised(tokenizer: str, end_id: int, window: int):
    """One row a document; ``before`` counts the whole windows of the task before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        column, end = encoder(tokenizer).column, int(end_id).to_bytes(4, "little")
        part, before, step = TaskContext.get().partitionId(), 0, 4 * window
        names = ["doc_id", "doc_tokens", "doc_crc", "whole", "tail", "tail_crc", "part", "before"]
        types = [pa.int64()] * 3 + [pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
        for batch in batches:
            rows, doc_ids = [], batch.column(0).to_pylist()
            for first, last, made, at in column(batch.column(1)):
                for k in range(first, last):
                    ids = made[at[k - first] : at[k - first + 1]].tobytes() + end
                    n = len(ids) // 4
                    cut = n // window * step
                    whole = [zlib.crc32(ids[b : b + step]) for b in range(0, cut, step)]
                    tail = zlib.crc32(ids[cut:])
                    rows.append((doc_ids[k], n, zlib.crc32(ids) if cut else tail, whole, n % window, tail, part, before))
                    before += n // window
            columns = zip(*rows, strict=True) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the task's number and their place in it."""
    from pyspark import TaskContext

    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))], [*batch.schema.names, "part", "k"])
        at += n


def _placed(plan: Plan, ranks: dict[tuple[int, int], int]):
    """Pieces of tails. ``ranks``: for (task, length) what to add to k for the rank. A cut piece has no CRC yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in ("doc_tokens", "doc_crc", "tail", "tail_crc", "part", "k")}
            for length in np.unique(x["tail"]):
                own = np.flatnonzero(x["tail"] == length)
                shift = np.array([ranks[p, int(length)] for p in x["part"][own]])
                which, start, size, sequence, offset = plan.pieces(int(length), x["k"][own] + shift)
                row = own[which]
                cut = size < length
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(row)), pa.array(x["doc_tokens"][row] - length + start), pa.array(size.astype(np.int64)), pa.array(x["tail_crc"][row], mask=cut), pa.array(x["doc_tokens"][row]), pa.array(sequence), pa.array(offset), pa.array(x["doc_crc"][row])],
                    [*(f.split()[0] for f in _PIECE.split(", ")), "doc_crc"],
                )

    return run


def _crcs(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column, end = encoder(tokenizer).column, int(end_id).to_bytes(4, "little")
        for batch in batches:
            rows, doc_ids, pieces = [], batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for first, last, made, at in column(batch.column(1)):
                for k in range(first, last):
                    ids = made[at[k - first] : at[k - first + 1]].tobytes() + end
                    whole = zlib.crc32(ids)
                    rows += [(doc_ids[k], p["start"], p["length"], zlib.crc32(ids[4 * p["start"] : 4 * (p["start"] + p["length"])]), p["doc_tokens"], p["sequence_id"], p["offset"]) for p in pieces[k] if p["doc_crc"] == whole and 4 * p["doc_tokens"] == len(ids)]
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], [f.split()[0] for f in _PIECE.split(", ")])

    return run


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, window: int = WINDOW) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``window`` is a power of two. All sequences are full but the last few, whose
    lengths are smaller powers of two, so none is padded.
    """
    if window & (window - 1) or window < 2:
        raise ValueError("window must be a power of two")
    scratch = Scratch(spark, "packing")
    tokenizer = tokenizer or public_path("word_bpe_49k.json")
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    made = scratch.save(texts.mapInArrow(_tokenised(tokenizer, end_id, window), _DOC), "documents", ROWS)

    tails = made.where("tail > 0").select("doc_id", "doc_tokens", "doc_crc", "tail", "tail_crc")
    dealt = tails.repartitionByRange("tail", "doc_id", "doc_crc").sortWithinPartitions("tail", "doc_id", "doc_crc").mapInArrow(_numbered, "doc_id long, doc_tokens long, doc_crc long, tail int, tail_crc long, part int, k long")
    tails = scratch.save(dealt, "tails")
    # the tasks hold ranges of lengths: as many rows as there are tasks and lengths together
    counts = tails.groupBy("part", "tail").agg(F.count("*").alias("n"), F.min("k").alias("k")).orderBy("tail", "part").collect()
    histogram, ranks = np.zeros(window + 1, np.int64), {}
    for part, tail, n, k in counts:
        ranks[part, tail] = int(histogram[tail]) - k
        histogram[tail] += n
    plan = Plan(histogram, window)
    placed = scratch.save(tails.mapInArrow(_placed(plan, ranks), f"{_PIECE}, doc_crc long"), "placed")

    parts = made.groupBy("part").agg(F.sum(F.size("whole")).cast("long").alias("n")).orderBy("part").collect()
    first = plan.sequences + np.concatenate([[0], np.cumsum([n for _, n in parts])]).astype(np.int64)
    offsets = spark.createDataFrame([(part, int(at)) for (part, _), at in zip(parts, first, strict=False)], "part int, at long")
    whole = made.where(F.size("whole") > 0).join(offsets, "part").select("doc_id", "doc_tokens", (F.col("at") + F.col("before")).alias("at"), F.posexplode("whole").alias("k", "ids_crc32"))
    whole = whole.select("doc_id", (F.col("k") * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("at") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    names = whole.columns
    cut = placed.where("ids_crc32 is null").withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    cut = scratch.save(cut.groupBy("key").agg(F.collect_set(F.struct("start", "length", "doc_tokens", "sequence_id", "offset", "doc_crc")).alias("pieces")), "cut")
    wanted = F.broadcast(cut) if cut.count() <= BROADCAST_CUTS else cut
    again = texts.withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63)))).join(wanted, "key").select("doc_id", "text", "pieces").mapInArrow(_crcs(tokenizer, end_id), _PIECE)
    # equal texts under one doc_id would each give the pieces of both
    again = again.dropDuplicates(["sequence_id", "offset"])
    return placed.where("ids_crc32 is not null").select(*names).unionByName(whole).unionByName(again)
