"""A bulk-loaded R-tree over group-count points, searched by an overlap bound."""

from __future__ import annotations

import numpy as np

#: Points of a leaf, and children of a node.
FAN_OUT = 32


class CountRTree:
    """Points of group counts under boxes.

    A box needs its upper corner only, since the overlap of a set with any set
    under it is at most the sum of the smaller of the two counts, and the range
    of the set sizes. Sort-tile-recursive loading: slabs by size, then by the
    counts of the first half of the groups.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, percent: int):
        self.percent = percent
        half = points[:, : points.shape[1] // 2].sum(axis=1)
        by_size = np.argsort(sizes, kind="stable")
        slab = max(1, int(np.sqrt(len(sizes) / FAN_OUT)) * FAN_OUT)
        self.order = np.concatenate([part[np.argsort(half[part], kind="stable")] for part in (by_size[i : i + slab] for i in range(0, len(by_size), slab))]) if len(sizes) else by_size
        self.levels = [(points[self.order], sizes[self.order], sizes[self.order])]
        while len(self.levels[-1][0]) > 1:
            top, low, high = self.levels[-1]
            cut = np.arange(0, len(top), FAN_OUT)
            self.levels.append((np.maximum.reduceat(top, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)))

    def _may(self, counts: np.ndarray, sizes: np.ndarray, level: int, who: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Whether a query's bound at a node reaches the overlap that it needs.

        With sizes a and b, Jaccard similarity p % or more means an overlap of
        p (a + b) / (100 + p) or more, and b between p a / 100 and 100 a / p.
        """
        top, low, high = self.levels[level]
        a, p = sizes[who], self.percent
        ok = (100 * high[node] >= p * a) & (100 * a >= p * low[node])
        at = np.flatnonzero(ok)
        for part in np.array_split(at, max(1, len(at) // 4096)):
            bound = np.minimum(counts[who[part]], top[node[part]]).sum(axis=1)
            least = np.maximum(low[node[part]], -(-p * a[part] // 100))
            ok[part] = (100 + p) * bound.astype(np.int64) >= p * (a[part] + least)
        return ok

    def search(self, counts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) for every point that may be similar enough, in ascending order."""
        who, node = np.arange(len(sizes)), np.zeros(len(sizes), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            ok = self._may(counts, sizes, level, who, node)
            who, node = who[ok], node[ok]
            if level:
                below = len(self.levels[level - 1][0])
                child = node[:, None] * FAN_OUT + np.arange(FAN_OUT)
                who, node = np.repeat(who, FAN_OUT), child.reshape(-1)
                who, node = who[node < below], node[node < below]
        point = self.order[node]
        by = np.lexsort((point, who))
        return who[by], point[by]
