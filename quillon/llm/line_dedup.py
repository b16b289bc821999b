r"""Line dedup by a segment-partition edit join.

Lines, trimmed of white space, are equal in kind when they are the same or, at
MIN_CHARS code points or more, when their edit distance is at most ``threshold``;
blank lines are left alone. A longer line is split into threshold
+ 1 segments, so a line within the threshold holds one of them unchanged. The
segments are indexed by line length, segment number and content; a line probes the
index of each length from its own down to threshold less with those of its
substrings that can stand at a segment's place when what comes before it and what
comes after it differ by no more than the threshold in all (multi-match-aware
selection). Pairs that meet are verified by the edit distance, banded and
bit-parallel: each diagonal of the band is a bit of a machine word, and one word
operation advances all diagonals of many pairs together.

Linked lines form classes. The first line of a class (smallest doc_id, then line
number) stays wherever it stands; all its other lines are removed.

Rows also carry 64 parity bits of the line's characters, of which an edit turns two
at most; lines of one group whose bits differ in more than 2 * threshold places
are no pair. A task drops repeats of a line before it sends segments, and equal
lines lie side by side in a group and are skipped there, so copies of a line cost
no pairs. A group of more than CROWD pairs gives each line's first partner only,
of probing and of indexed lines; when these have made classes, the group is gone through again for the partners in
other classes, so its pairs stay linear while no link between classes is lost.

Defined cases: a null text has no lines (n_lines 0); an empty text has one empty
line; repeated rows of a doc_id count once, the largest text for all; a null
doc_id is left out; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .documents import id_and_text, one_row_each
from .graph import components
from .membership import Membership
from .scratch import Scratch
from .words import mix, places

THRESHOLD = 2
MIN_CHARS = 20
#: Rows of one group that are held before repeats of a line are dropped.
HELD = 200_000
#: Pairs that a group gives at once.
CROWD = 64
#: Characters of text that are hashed at once; a longer text is hashed alone.
CHUNK = 1 << 19
_SPACE = " \t\n\x0b\x0c\r"
#: Whether a code point is white space; the last entry stands for all above.
_GAPS = np.array([chr(c) in _SPACE for c in range(34)])
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_UP = _DOWN = np.ones(1, U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of them at least."""
    global _UP, _DOWN
    if len(_UP) < n:
        size = max(n, CHUNK + 2)
        _UP, _DOWN = (np.concatenate([np.ones(1, U64), np.cumprod(np.full(size - 1, b, U64))]) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    return _UP, _DOWN


_SCRAMBLED: dict[int, np.ndarray] = {}


#: The salt of the groups of parity().
_PARITY = 303


def _scramble(c: np.ndarray, salt: int) -> np.ndarray:
    values = mix(c.astype(U64) + U64(salt))
    return U64(1) << (values >> U64(58)) if salt == _PARITY else values


def scrambled(c: np.ndarray, salt: int, wide: bool) -> np.ndarray:
    """A random value of each code point, or for _PARITY the bit of its group; from a table unless some are beyond the basic plane (``wide``)."""
    if wide:
        return _scramble(c, salt)
    if salt not in _SCRAMBLED:
        _SCRAMBLED[salt] = _scramble(np.arange(1 << 16), salt)
    return _SCRAMBLED[salt].take(c)


def codes(line: str) -> np.ndarray:
    return np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)


class Lines:
    """The lines of some texts of ``least`` characters or more, trimmed: row, number in its text, and place in the joined text."""

    def __init__(self, texts: list[str | None], least: int):
        known = [k for k, t in enumerate(texts) if t is not None]
        self.text = "\n".join([texts[k] for k in known])
        c = self.codes = codes(self.text)
        breaks = np.flatnonzero(c == 10)
        starts, ends = np.concatenate([[0], breaks + 1]), np.append(breaks, len(c))
        solid = np.flatnonzero(~_GAPS[np.minimum(c, 33)])
        at, past = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
        some = np.flatnonzero(past > at)
        s, e = solid[at[some]], solid[past[some] - 1] + 1
        long = e - s >= least
        self.start, self.end, line = s[long], e[long], some[long]
        sizes = np.array([len(texts[k]) for k in known], np.int64)
        begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) if len(known) else np.zeros(0, np.int64)
        first = np.searchsorted(starts, begins)  # each text's first line
        own = np.searchsorted(first, line, side="right") - 1
        self.row, self.number = np.array(known, np.int64)[own] if len(known) else own, line - first[own] if len(known) else line
        self._sums = self._down = self._odd = None
        self._wide = bool(len(c)) and int(c.max()) > 0xFFFF
        self._mixed: dict[int, np.ndarray] = {}
        self._lines: dict[int, np.ndarray] = {}

    def _values(self, salt: int) -> np.ndarray:
        if salt not in self._mixed:
            self._mixed[salt] = scrambled(self.codes, salt, self._wide)
        return self._mixed[salt]

    def part(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of substrings, by powers of a base: different ones that are equal cost a comparison of their lines."""
        if self._sums is None:
            self._sums = np.zeros(len(self.codes) + 1, U64)
            up, self._down = _powers(len(self.codes) + 1)
            np.cumsum(self._values(101) * up[: len(self.codes)], out=self._sums[1:])
        sums = self._sums
        return mix((sums[end] - sums[start]) * self._down[start] + (end - start).astype(U64))

    def hashes(self, which: int) -> np.ndarray:
        """Hashes of the lines; each place in a line has a random value of its own."""
        if which not in self._lines:
            size = self.end - self.start
            if self._odd is None:
                # each line's places count up from its start; what lies between lines counts for nothing
                cuts = np.concatenate([[0], self.start, [len(self.codes)]])
                at = np.arange(len(self.codes)) - np.repeat(cuts[:-1], np.diff(cuts))
                self._odd = places(np.minimum(at, size.max(initial=0)))
            sums = np.zeros(len(self.codes) + 1, U64)
            np.cumsum(self._values((101, 202)[which]) * self._odd, out=sums[1:])
            self._lines[which] = mix(sums[self.end] - sums[self.start] + size.astype(U64)).view(np.int64)
        return self._lines[which]

    def parity(self) -> np.ndarray:
        """64 bits a line: whether each of 64 groups of characters has an odd number in it."""
        odd = np.zeros(len(self.codes) + 1, U64)
        np.bitwise_xor.accumulate(self._values(_PARITY), out=odd[1:])
        return (odd[self.end] ^ odd[self.start]).view(np.int64)


def _runs(column: pa.Array, least: int = MIN_CHARS) -> Iterator[tuple[int, Lines]]:
    """(first row, lines) of runs of rows of about CHUNK characters."""
    texts, begin, size = column.to_pylist(), 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK:
            yield begin, Lines(texts[begin : k + 1], least)
            begin, size = k + 1, 0
    if begin < len(texts):
        yield begin, Lines(texts[begin:], least)


def segments(length: int, threshold: int) -> list[tuple[int, int]]:
    """(start, size) of threshold + 1 near-even segments, the shorter ones first."""
    parts = threshold + 1
    size, more = divmod(length, parts)
    out, at = [], 0
    for k in range(parts):
        n = size + (k >= parts - more)
        out.append((at, n))
        at += n
    return out


def probes(length: int, threshold: int) -> list[tuple[int, int, int, int]]:
    """(indexed length, segment number, start, size) of the substrings that a line of a length probes with.

    For segment k (from 0) with start p of a line shorter by d, a start s can
    matter if |s - p| is within k edits before it and within threshold - k
    after it, the shift by d included.
    """
    out = []
    for d in range(threshold + 1):
        for k, (p, n) in enumerate(segments(length - d, threshold)):
            low = max(p - k, p + d - (threshold - k), 0)
            high = min(p + k, p + d + (threshold - k), length - n)
            out += [(length - d, k, s, n) for s in range(low, high + 1)]
    return out


class _Probes:
    """Index and probe rows by length, one table behind the other: indexed length, segment number, start, size, side."""

    def __init__(self, threshold: int):
        self.threshold = threshold
        self._clear()

    def _clear(self) -> None:
        self._at: dict[int, tuple[int, int]] = {}
        self.rows, self._new, self._n = np.zeros((5, 0), np.int64), [], 0

    def _add(self, length: int) -> None:
        own = segments(length, self.threshold)
        rows = [(length, k, s, n, 0) for k, (s, n) in enumerate(own)]
        rows += [(*r, 1) for r in probes(length, self.threshold) if not (r[0] == length and (r[2], r[3]) == own[r[1]])]
        self._at[length] = (self._n, len(rows))
        self._new += rows
        self._n += len(rows)

    def of(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which length, row of the table) for all rows of some lengths."""
        if self._n > 1_000_000:
            self._clear()
        different, which = np.unique(lengths, return_inverse=True)
        for n in different.tolist():
            if n not in self._at:
                self._add(n)
        if self._new:
            self.rows, self._new = np.concatenate([self.rows, np.array(self._new, np.int64).T], axis=1), []
        at, count = (np.array(c, np.int64)[which] for c in zip(*(self._at[n] for n in different.tolist()), strict=True))
        ends = np.cumsum(count)
        return np.repeat(np.arange(len(lengths)), count), np.repeat(at - (ends - count), count) + np.arange(ends[-1])


#: ``key`` ends in the side: 0 for index rows, 1 for probe rows. One long is sorted by its digits, without comparisons.
_SEGMENT = "key long, line long, bits long"
_MET = "a long, b long, key long, bits long"


def _sent(threshold: int):
    """Index rows (side 0) and probe rows (side 1) of each run's different lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Probes(threshold)
        for batch in batches:
            for _, x in _runs(batch.column(1)):
                line, first = np.unique(x.hashes(0), return_index=True)
                start, bits = x.start[first], x.parity()[first]
                if not len(first):
                    continue
                own, row = table.of(x.end[first] - start)
                size, k, s, n, side = table.rows[:, row]
                at = start[own] + s
                key = mix(x.part(at, at + n) ^ (size * 16 + k).astype(U64)) & ~U64(1) | side.astype(U64)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(line[own]), pa.array(bits[own])], ["key", "line", "bits"])

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Of rows sorted by key, runs of whole groups of two rows or more, sorted by key and line; rows that repeat a line in its part are dropped."""
    kept: list[dict[str, np.ndarray]] = []

    def sorted_rows(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
        x = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
        group = x["key"] >> 1
        several = np.zeros(len(group), bool)
        several[1:] |= group[1:] == group[:-1]
        several[:-1] |= group[1:] == group[:-1]
        x = {c: v[several] for c, v in x.items()}
        order = np.lexsort((x["line"], x["key"]))
        x = {c: v[order] for c, v in x.items()}
        fresh = np.ones(len(order), bool)
        fresh[1:] = (x["key"][1:] != x["key"][:-1]) | (x["line"][1:] != x["line"][:-1])
        return {c: v[fresh] for c, v in x.items()}

    def whole(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
        x = sorted_rows(parts)
        return x | {"side": (x["key"] & 1).astype(np.int32), "key": x["key"] >> 1}

    for batch in batches:
        if not batch.num_rows:
            continue
        x = {c: batch.column(c).to_numpy() for c in batch.schema.names}
        group = x["key"] >> 1
        last = int(np.searchsorted(group, group[-1]))
        if last or (kept and kept[-1]["key"][-1] >> 1 != group[-1]):
            yield whole([*kept, {c: v[:last] for c, v in x.items()}])
            kept = []
        kept.append({c: v[last:] for c, v in x.items()})
        if len(kept) > 1 and sum(len(p["key"]) for p in kept[1:]) > max(HELD, len(kept[0]["key"])):  # a hot group keeps its different lines
            kept = [sorted_rows(kept)]
    if kept:
        yield whole(kept)


def _near(x: dict[str, np.ndarray], most: int, apart: np.ndarray | None = None):
    """(row, indexed row) of one group whose bits are close; ``apart``: labels that must differ. In blocks, by row."""
    indexed = np.flatnonzero(x["side"] == 0)
    if not len(indexed):
        return
    step = max(1, 2_000_000 // len(indexed))
    for at in range(0, len(x["key"]), step):
        rows = np.arange(at, min(at + step, len(x["key"])))
        far = np.bitwise_count(x["bits"][rows].view(U64)[:, None] ^ x["bits"][indexed].view(U64)[None, :])
        i, j = np.nonzero(far <= most)
        i, j = rows[i], indexed[j]
        keep = (x["line"][i] != x["line"][j]) & ((x["side"][i] == 1) | (i > j))
        if apart is not None:
            keep &= apart[i] != apart[j]
        yield i[keep], j[keep]


def _split(x: dict[str, np.ndarray]) -> Iterator[dict[str, np.ndarray]]:
    cuts = np.flatnonzero(np.diff(x["key"])) + 1
    for lo, hi in zip(np.concatenate([[0], cuts]), np.append(cuts, len(x["key"])), strict=True):
        if hi > lo and x["side"][lo] == 0:  # without an indexed line there is no pair
            yield {c: v[lo:hi] for c, v in x.items()}


def _first_partners(found: list[tuple[np.ndarray, np.ndarray]], rows: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of the pairs of a group, the first of each row on either side, so that no row with a partner is left out."""
    met, out = np.zeros(rows, bool), []
    for i, j in found:
        keep = np.zeros(len(i), bool)
        keep[np.unique(i, return_index=True)[1]] = True
        first = np.unique(j, return_index=True)[1]
        keep[first[~met[j[first]]]] = True
        met[j] = True
        out.append((i[keep], j[keep]))
    return out


def _met(threshold: int):
    """Pairs (a, b) of the groups; rows of crowded groups come along, with b null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "key", "bits"]
        for x in _groups(batches):
            a, b, crowds = [], [], []
            for g in _split(x):
                found = list(_near(g, 2 * threshold))
                if sum(len(i) for i, _ in found) > CROWD:
                    crowds.append(g)
                    found = _first_partners(found, len(g["key"]))
                a += [g["line"][i] for i, _ in found]
                b += [g["line"][j] for _, j in found]
            if a:
                pair = np.stack([np.concatenate(a), np.concatenate(b)])
                pair = np.unique(np.sort(pair, axis=0), axis=1)
                none = pa.nulls(pair.shape[1], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1]), none, none], names)
            for g in crowds:
                yield pa.RecordBatch.from_arrays([pa.array(g["line"]), pa.nulls(len(g["line"]), pa.int64()), pa.array(g["key"] << 1 | g["side"]), pa.array(g["bits"])], names)

    return run


def _met_again(threshold: int):
    """Pairs of crowded groups whose lines lie in different classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _groups(batches):
            for g in _split(x):
                for i, j in _near(g, 2 * threshold, g["label"]):
                    pair = np.unique(np.sort(np.stack([g["line"][i], g["line"][j]]), axis=0), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["a", "b"])

    return run


def banded_distance(a: list[np.ndarray], b: list[np.ndarray], most: int) -> np.ndarray:
    """Edit distance of each pair, or most + 1 where it is more; len(a) >= len(b), by most at the most.

    Vertical differences of the band are two words a pair: bit 63 stands for
    the diagonal ``most`` below the main one, and the word moves down a row with
    each column (Hyyro, 2003).
    """
    pairs = len(a)
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    top = int(max(la.max(initial=0), lb.max(initial=0)))
    wide_a, wide_b = np.full((pairs, top + 2 * most + 2), 0xFFFFFFFF, np.uint32), np.full((pairs, top + 1), 0xFFFFFFFE, np.uint32)
    for k in range(pairs):
        wide_a[k, most : most + la[k]] = a[k]
        wide_b[k, : lb[k]] = b[k]
    one, low = U64(1), U64(63 - 2 * most)
    vp = np.full(pairs, ((1 << (most + 1)) - 1) << (63 - most), U64)
    vn = np.zeros(pairs, U64)
    score = np.minimum(most, la).astype(np.int64)
    for j in range(top):
        x = np.zeros(pairs, U64)
        for k in range(2 * most + 1):
            x |= (wide_a[:, j + k] == wide_b[:, j]).astype(U64) << (low + U64(k))
        d0 = (((x & vp) + vp) ^ vp) | x | vn
        hp, hn = vn | ~(d0 | vp), d0 & vp
        live = j < lb
        down = live & (j < la - most)  # the band's lowest diagonal still has rows
        score += down & ((d0 >> U64(63)) == 0)
        along = live & ~down
        bit = np.clip(62 - (j - (la - most)), 0, 62).astype(U64)
        score += along * ((hp >> bit & one).astype(np.int64) - (hn >> bit & one).astype(np.int64))
        shifted = d0 >> one
        vp, vn = np.where(live, hn | ~(shifted | hp), vp), np.where(live, shifted & hp, vn)
    return np.minimum(score, most + 1)


def _texts_of(wanted: Membership):
    """(line, text) of the lines that the test passes, once a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in _runs(batch.column(1)):
                line, first = np.unique(x.hashes(0), return_index=True)
                may = wanted.may(line)
                texts = [x.text[s:e] for s, e in zip(x.start[first[may]], x.end[first[may]], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(line[may]), pa.array(texts, pa.string())], ["line", "text"])

    return run


def _verified(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.zeros(batch.num_rows, bool)
            a, b = ([codes(x) for x in batch.column(k).to_pylist()] for k in (2, 3))
            longer, shorter = zip(*((x, y) if len(x) >= len(y) else (y, x) for x, y in zip(a, b, strict=True)), strict=True) if a else ((), ())
            size = np.array([len(x) for x in longer])
            fit = np.flatnonzero(size - np.array([len(x) for x in shorter]) <= threshold) if a else np.zeros(0, int)
            fit = fit[np.argsort(size[fit], kind="stable")]
            for part in np.array_split(fit, max(1, len(fit) // 512)):
                if len(part):
                    near[part] = banded_distance([longer[k] for k in part], [shorter[k] for k in part], threshold) <= threshold
            yield batch.select([0, 1]).filter(pa.array(near))

    return run


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for first, x in _runs(batch.column(1), 1):
            yield pa.RecordBatch.from_arrays([pa.array(x.hashes(0)), pa.array(x.hashes(1)), pa.array(ids[first + x.row]), pa.array(x.number)], ["line", "line2", "doc_id", "at"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_lines, n_removed, kept = [], [], []
        for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            lines, gone = ([] if text is None else text.split("\n")), set(gone or ())
            left = [x for k, x in enumerate(lines) if k not in gone]
            n_lines.append(len(lines))
            n_removed.append(len(lines) - len(left))
            kept.append("\n".join(left))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_removed", "kept_text"])


def line_dedup(spark: SparkSession, docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_text for every document. ``threshold``: 1 to 4 edits."""
    if not 1 <= threshold <= 4:
        raise ValueError("threshold must be 1 to 4")
    scratch = Scratch(spark, "line-dedup")
    docs = id_and_text(docs)
    docs = one_row_each(docs, docs.select("doc_id"))
    sent = docs.mapInArrow(_sent(threshold), _SEGMENT)
    met = scratch.save(sent.repartition(F.shiftright("key", 1)).sortWithinPartitions("key").mapInArrow(_met(threshold), _MET), "met")
    scratch.release()

    # a line with any partner, on either side, is in a pair of the first round, so its text serves both rounds
    some = scratch.save(met.where("b is not null").select("a", "b").distinct(), "pairs")
    wanted = some.select("a").unionByName(some.select(F.col("b").alias("a"))).distinct()
    texts = docs.mapInArrow(_texts_of(Membership(spark, wanted)), "line long, text string").dropDuplicates(["line"])
    texts = scratch.save(texts, "texts")
    scratch.release()

    def near(pairs: DataFrame) -> DataFrame:
        left, right = (texts.select(F.col("line").alias(k), F.col("text").alias(f"text_{k}")).hint("merge") for k in "ab")
        rows = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
        return scratch.save(rows.mapInArrow(_verified(threshold), "a long, b long").select(F.col("a").alias("u"), F.col("b").alias("v")), "near")

    links = near(some)
    label = scratch.save(components(links, scratch), "labels")
    crowd = met.where("b is null").select("key", F.col("a").alias("line"), "bits")
    if crowd.limit(1).count():
        labelled = crowd.join(label.withColumnRenamed("id", "line"), "line", "left").select("key", "line", "bits", F.coalesce("component", "line").alias("label"))
        again = labelled.repartition(F.shiftright("key", 1)).sortWithinPartitions("key").mapInArrow(_met_again(threshold), "a long, b long")
        more = near(scratch.save(again.distinct().join(some, ["a", "b"], "left_anti"), "pairs"))
        label = scratch.save(components(links.unionByName(more), scratch), "labels")

    places = scratch.save(docs.mapInArrow(_occurrences, "line long, line2 long, doc_id long, at long"), "places")
    firsts = places.groupBy("line", "line2").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("n"))
    firsts = scratch.save(firsts.join(label.withColumnRenamed("id", "line"), "line", "left").withColumn("kind", F.coalesce("component", "line")).withColumn("kind2", F.when(F.col("component").isNull(), F.col("line2"))), "lines")
    scratch.release()
    heads = firsts.groupBy("kind", "kind2").agg(F.min("first").alias("head"), F.sum("n").alias("n")).where("n > 1")
    known = firsts.join(heads, (firsts["kind"] == heads["kind"]) & firsts["kind2"].eqNullSafe(heads["kind2"])).select("line", "line2", "head")
    gone = places.join(known, ["line", "line2"]).where("struct(doc_id, at) <> head").groupBy("doc_id").agg(F.collect_list("at").alias("gone"))
    # the narrow side is hashed, a partition's doc_ids at a time, so that texts needn't be sorted
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "gone").mapInArrow(_cut, "doc_id long, n_lines long, n_removed long, kept_text string")


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
