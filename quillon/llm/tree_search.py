"""Searching many count-vector R-trees in one task.

Rows come sorted by tree and block. A tree of at most LEAF points is one leaf, and
the leaves of a batch are gone through together; a larger one is loaded as an
R-tree of its own. In both, a pair goes on if the sum of the smaller group counts
still reaches the overlap that the similarity asks for. What is left is held
against a finer bound: with d groups of the two parity vectors different, the sets
differ in d members at least, so their overlap is (a + b - d) / 2 at most. Parity
vectors have four groups a member, so this bound misses few members.

The first search gives for each point its smallest and its nearest partner; in a
tree of more than DENSE points only a few pivots are asked, then a few of the
points that found none, so its work is linear. The second gives every pair of
points with different labels, asked from the points that don't carry the tree's
main label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .rtree import FAN_OUT, CountRTree
from .words import U64, mix

#: Coordinates of a point.
GROUPS = 128
#: Points of a tree that is one leaf.
LEAF = FAN_OUT
#: Points of the largest tree whose pairs are all looked at in the first search.
DENSE = 512
#: Points asked at once, in a large tree of the first search, and how often.
PIVOTS, TURNS = 16, 6
#: Pairs that are compared at once.
PAIRS = 1 << 15
_PARITY = (512, 8192)


def parity_groups(size: int) -> int:
    """Bits of a document's parity vector: a power of two, four a member within limits."""
    return min(_PARITY[1], max(_PARITY[0], 1 << (4 * max(1, size) - 1).bit_length()))


def parity(grams: np.ndarray) -> bytes:
    """Whether each group by the low bits of the hash has an odd number; half as many groups are the two halves' difference."""
    groups = parity_groups(len(grams))
    at = (mix(grams ^ U64(0xC3C3C3C3)) & U64(groups - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=groups).astype(np.uint8) & 1).tobytes()


def pack(counts: np.ndarray) -> bytes:
    """A point in the narrowest of three widths, which its length tells."""
    top = counts.max(initial=0)
    return counts.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32).tobytes()


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, bytes as a matrix) for each length of a binary column."""
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)
    size = np.diff(off)
    for n in np.flatnonzero(np.bincount(size)):
        rows = np.flatnonzero(size == n)
        yield int(n), rows, data[off[rows][:, None] + np.arange(n)]


class Points:
    """The rows of some whole trees."""

    def __init__(self, batch: pa.RecordBatch, percent: int):
        self.percent = percent
        self.tree, self.block, self.id, self.n, self.label, self.kind = (batch.column(k).to_numpy() for k in range(6))
        self.counts = np.zeros((batch.num_rows, GROUPS), np.int32)
        for n, rows, raw in _by_length(batch.column(6)):
            self.counts[rows] = raw.view({1: np.uint8, 2: np.uint16, 4: np.uint32}[n // GROUPS])
        self._bits, self._groups, self._folded = [], np.zeros(batch.num_rows, np.int64), {}
        for n, rows, raw in _by_length(batch.column(7)):
            self._bits.append((rows, raw.view(U64)))
            self._groups[rows] = 8 * n

    def _parity(self, groups: int) -> np.ndarray:
        if groups not in self._folded:
            out = np.zeros((len(self.id), groups // 64), U64)
            for rows, bits in self._bits:
                if bits.shape[1] >= out.shape[1]:
                    while bits.shape[1] > out.shape[1]:
                        half = bits.shape[1] // 2
                        bits = bits[:, :half] ^ bits[:, half:]
                    out[rows] = bits
            self._folded[groups] = out
        return self._folded[groups]

    def distance(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Members in which two sets differ at least."""
        out = np.zeros(len(x), np.int64)
        common = np.minimum(self._groups[x], self._groups[y])
        for groups in np.flatnonzero(np.bincount(common)) if len(x) else ():
            bits, at = self._parity(int(groups)), np.flatnonzero(common == groups)
            for part in np.array_split(at, len(at) // PAIRS + 1):
                out[part] = np.bitwise_count(bits[x[part]] ^ bits[y[part]]).sum(axis=1)
        return out

    def near(self, x: np.ndarray, y: np.ndarray, coarse: bool) -> tuple[np.ndarray, ...]:
        """Pairs that may be similar enough, with the share in which they differ. ``coarse``: whether the summed minima are still to be asked."""
        p = self.percent
        ok = (self.label[x] != self.label[y]) & ((self.kind[x] < 2) | (self.kind[y] < 2))
        ok &= 100 * np.minimum(self.n[x], self.n[y]) >= p * np.maximum(self.n[x], self.n[y])
        x, y = x[ok], y[ok]
        if coarse:
            ok = np.zeros(len(x), bool)
            for part in np.array_split(np.arange(len(x)), len(x) // PAIRS + 1):
                both = np.minimum(self.counts[x[part]], self.counts[y[part]]).sum(axis=1).astype(np.int64)
                ok[part] = (100 + p) * both >= p * (self.n[x[part]] + self.n[y[part]])
            x, y = x[ok], y[ok]
        d, total = self.distance(x, y), self.n[x] + self.n[y]
        ok = (100 + p) * (total - d) >= 2 * p * total
        return x[ok], y[ok], d[ok] / total[ok]


def _chosen(points: Points, x: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs, those with the smallest or the nearest partner of a point in its tree."""
    x, y, share = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([share, share])
    out = []
    for order in (np.lexsort((points.id[y], x)), np.lexsort((points.id[y], share, x))):
        first = np.ones(len(order), bool)
        first[1:] = x[order][1:] != x[order][:-1]
        out.append(order[first])
    at = np.concatenate(out)
    return x[at], y[at]


def _asked(tree: CountRTree, rows: np.ndarray, points: Points, queries: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """What some points find in a tree over ``rows``."""
    for part in np.array_split(queries, len(queries) * len(rows) // (1 << 20) + 1):
        who, other = tree.search(points.counts[part], points.n[part])
        who, other = part[who], rows[other]
        apart = points.id[who] != points.id[other]
        yield points.near(who[apart], other[apart], False)


def _large(points: Points, rows: np.ndarray, first_search: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    own = rows[points.kind[rows] < 2]
    tree = CountRTree(points.counts[own], points.n[own], points.percent)
    if not first_search:
        for x, y, _ in _asked(tree, own, points, rows[points.kind[rows] > 0]):
            yield x, y
        return
    if len(rows) <= DENSE:
        yield _chosen(points, *(np.concatenate(c) for c in zip(*_asked(tree, own, points, rows), strict=True)))
        return
    order = rows[np.lexsort((points.id[rows], -points.kind[rows]))]  # pivots of the whole tree come first
    met, found = np.zeros(len(points.id), bool), []
    for _ in range(TURNS):
        pivots, order = order[:PIVOTS], order[PIVOTS:]
        here = [np.concatenate(c) for c in zip(*_asked(tree, own, points, pivots), strict=True)]
        found.append(here)
        met[here[0]] = met[here[1]] = True
        order = order[~met[order]]
        if not len(order):
            break
    yield _chosen(points, *(np.concatenate(c) for c in zip(*found, strict=True)))


def pairs_of(points: Points, first_search: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of pairs, the smaller first, with repeats."""
    new = np.ones(len(points.id), bool)
    new[1:] = (points.tree[1:] != points.tree[:-1]) | (points.block[1:] != points.block[:-1])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(new)))
    leaf, found = size <= LEAF, []
    # the leaves' pairs, as many trees at once as give about PAIRS of them
    at, k = start[leaf], size[leaf]
    turn = np.cumsum(k * k) // (4 * PAIRS)
    for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(turn)) + 1) if len(at) else ():
        member = np.repeat(at[part], k[part]) + np.arange(k[part].sum()) - np.repeat(np.cumsum(k[part]) - k[part], k[part])
        end = np.repeat(at[part] + k[part], k[part])
        more = end - member - 1
        x = np.repeat(member, more)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(more) - more, more)
        if not first_search:
            asked = (points.kind[x] > 0) | (points.kind[y] > 0)
            x, y = x[asked], y[asked]
        x, y, share = points.near(x, y, True)
        found.append(_chosen(points, x, y, share) if first_search else (x, y))
    for s, n in zip(start[~leaf], size[~leaf], strict=True):
        found += _large(points, np.arange(s, s + n), first_search)
        if sum(len(x) for x, _ in found) > 4 * PAIRS:
            yield _ids(points, found)
            found = []
    if found:
        yield _ids(points, found)


def _ids(points: Points, found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    a, b = (points.id[np.concatenate(c)] for c in zip(*found, strict=True))
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[fresh], b[fresh]


def whole_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of whole trees, out of rows sorted by tree and block."""
    kept: list[pa.RecordBatch] = []

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        tree, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        other = np.flatnonzero((tree != tree[-1]) | (block != block[-1]))
        last = int(other[-1]) + 1 if len(other) else 0
        if last or (kept and (kept[-1].column(0)[0].as_py(), kept[-1].column(1)[0].as_py()) != (tree[-1], block[-1])):
            if kept or last:
                yield joined([*kept, batch.slice(0, last)] if last else kept)
            kept = []
        kept.append(batch.slice(last))
    if kept:
        yield joined(kept)


def search(percent: int, first_search: bool):
    """Of rows (tree, block, id, n, label, kind, point, bits) sorted by tree and block: pairs (a, b).

    kind: 0 a point, 1 a point that asks, 2 one that asks only and lies elsewhere
    or in another row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_trees(batches):
            for a, b in pairs_of(Points(batch, percent), first_search):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run
