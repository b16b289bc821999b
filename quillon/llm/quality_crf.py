"""Document quality from a linear-chain conditional random field over lines.

Each line is labelled good or bad. Its score takes its own features and those of
the lines before and after it; a transition weight joins neighbouring labels.
Forward-backward gives each line's probability to be good, and their mean
weighted by line length, calibrated on the training documents, is the document's
score.

Features are shape only: lengths, shares of letter cases, digits and signs,
repetition. Each is cut into bins at quantiles of the training lines. Lines of a
training document carry its label. The model is fitted on at most TRAIN_ROWS
labelled documents, taken in the order of a hash of doc_id, by full-batch Adam on
the driver; scoring runs over all documents.

Defined cases: a null or empty text is one empty line and has a score; without
labels of both kinds every score is the share of good labels (0.5 without any);
repeated rows of a doc_id are scored each; of repeated labels of a doc_id the
lowest counts; a null doc_id is scored and not held out; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .documents import id_and_text, whole_row

TRAIN_ROWS = 4000
BINS = 8
STEPS = 150
THRESHOLD = 0.3
FOLDS = 5

_TABLE = W.byte_table(31, False)
_CLASSES = np.zeros((256, 5), bool)
_CLASSES[65:91, 0] = True
_CLASSES[97:123, 1] = _CLASSES[128:, 1] = True
_CLASSES[48:58, 2] = True
_CLASSES[[ord(c) for c in ".,;:'\"?()-"], 3] = True
_CLASSES[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"], 4] = True
N_FEATURES = 12


def line_features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, line lengths in bytes, first line of each document with the end)."""
    docs = len(off) - 1
    breaks = np.flatnonzero(raw == 10)
    owner = np.searchsorted(off, breaks, side="right") - 1
    starts = np.concatenate([off[:-1], breaks + 1])
    doc = np.concatenate([np.arange(docs), owner])
    order = np.lexsort((starts, doc))
    starts, doc = starts[order], doc[order]
    ends = np.empty_like(starts)
    first = np.searchsorted(doc, np.arange(docs + 1))
    ends[:-1] = starts[1:] - 1
    ends[first[1:] - 1] = off[1:]
    sums = np.zeros((len(raw) + 1, 5), np.int64)
    np.cumsum(_CLASSES[raw], axis=0, out=sums[1:])
    upper, lower, digit, stop, sign = (sums[ends] - sums[starts]).T
    length = ends - starts
    size = np.maximum(length, 1)
    w0, w1, _ = W.word_spans(raw, off)
    hashes = W.word_hashes(raw, w0, w1, _TABLE)
    line = np.searchsorted(starts, w0, side="right") - 1
    n_words = np.bincount(line, minlength=len(starts))
    short = np.bincount(line, w1 - w0 <= 3, minlength=len(starts))
    fresh = np.ones(len(w0), bool)
    by = np.lexsort((hashes, line))
    fresh[1:] = (hashes[by][1:] != hashes[by][:-1]) | (line[by][1:] != line[by][:-1])
    distinct = np.bincount(line[by][fresh], minlength=len(starts))
    # words that end in a sign, and lines seen before in the document
    signed = np.bincount(line, _CLASSES[raw[w1 - 1], 4] if len(w1) else None, minlength=len(starts))
    content = np.zeros(len(hashes) + 1, np.uint64)
    place = np.arange(len(hashes)) - np.repeat(np.searchsorted(line, np.arange(len(starts))), n_words)
    np.cumsum(W.mix(hashes ^ W.mix(place.astype(np.uint64))), out=content[1:])
    at = np.concatenate([[0], np.cumsum(n_words)])
    whole = content[at[1:]] - content[at[:-1]]
    again = np.zeros(len(starts), bool)
    by = np.lexsort((np.arange(len(starts)), whole, doc))
    again[by[1:]] = (whole[by][1:] == whole[by][:-1]) & (doc[by][1:] == doc[by][:-1]) & (n_words[by][1:] > 0)
    per = np.maximum(n_words, 1)
    last = np.where(length > 0, raw[np.maximum(ends - 1, 0)] if len(raw) else 0, 0)
    features = np.stack(
        [
            np.log1p(length),
            np.log1p(n_words),
            (length - n_words) / per,
            upper / np.maximum(upper + lower, 1),
            digit / size,
            sign / size,
            stop / per,
            np.isin(last, [46, 33, 63]),
            distinct / per,
            short / per,
            signed / per,
            again,
        ],
        axis=1,
    )
    return features, length, first


@dataclass
class Model:
    edges: np.ndarray  # (features, bins - 1)
    weights: np.ndarray  # (3, features, bins): of the line before, the line, the line after
    bias: float
    transition: np.ndarray  # (2, 2)
    slope: float
    shift: float
    constant: float | None = None

    def unary(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Score of "good" over "bad" for each line."""
        return self.bias + sum(self.weights[k][np.arange(features.shape[1]), b].sum(axis=1) * m for k, (b, m) in enumerate(_views(bins_of(features, self.edges), first)))

    def score(self, features: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(first) - 1, self.constant)
        good, _ = marginals(self.unary(features, first), first, self.transition)
        return _sigmoid(self.slope * quality_logit(good, length, first) + self.shift)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def bins_of(features: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(edges[k], features[:, k], side="right") for k in range(features.shape[1])], axis=1)


def _views(bins: np.ndarray, first: np.ndarray):
    """The bins of the line before, the line and the line after, each with where there is one."""
    n = len(bins)
    head, tail = np.ones(n, bool), np.ones(n, bool)
    head[first[:-1]] = False
    tail[first[1:] - 1] = False
    yield np.roll(bins, 1, axis=0), head
    yield bins, np.ones(n, bool)
    yield np.roll(bins, -1, axis=0), tail


def quality_logit(good: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
    weight = length + 1.0
    part = lambda v: np.add.reduceat(v, first[:-1]) if len(first) > 1 else np.zeros(0)
    q = np.clip(part(good * weight) / part(weight), 1e-4, 1 - 1e-4)
    return np.log(q / (1 - q))


def marginals(unary: np.ndarray, first: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability that each line is good, expected counts of label pairs) by forward-backward.

    Chains of like length run together, position by position.
    """
    good, pairs = np.zeros(len(unary)), np.zeros((2, 2))
    count = np.diff(first)
    order = np.argsort(count, kind="stable")
    step = np.exp(transition)
    at = 0
    while at < len(order):
        end = max(at + 1, int(np.searchsorted(count[order], max(8, 1.25 * count[order[at]]), side="right")))
        group = order[at:end]
        at = end
        n = count[group]
        top = int(n.max())
        u = np.zeros((top, len(group)))
        inside = np.arange(top)[:, None] < n
        index = np.minimum(first[group] + np.arange(top)[:, None], len(unary) - 1)
        u[inside] = unary[index][inside]
        e = np.stack([np.ones_like(u), np.exp(np.clip(u, -30, 30))], axis=2)
        forward, back = np.empty_like(e), np.ones_like(e)
        forward[0] = e[0] / e[0].sum(axis=1, keepdims=True)
        for t in range(1, top):
            v = (forward[t - 1] @ step) * e[t]
            forward[t] = np.where(inside[t][:, None], v / v.sum(axis=1, keepdims=True), forward[t - 1])
        for t in range(top - 2, -1, -1):
            v = (back[t + 1] * e[t + 1]) @ step.T
            back[t] = np.where(inside[t + 1][:, None], v / v.sum(axis=1, keepdims=True), 1.0)
        both = forward * back
        both /= both.sum(axis=2, keepdims=True)
        good[index[inside]] = both[:, :, 1][inside]
        if top > 1:
            joint = forward[:-1, :, :, None] * step * (e[1:] * back[1:])[:, :, None, :]
            joint /= joint.sum(axis=(2, 3), keepdims=True)
            pairs += joint[inside[1:]].sum(axis=0)
    return good, pairs


def fit(features: np.ndarray, length: np.ndarray, first: np.ndarray, labels: np.ndarray, steps: int = STEPS) -> Model:
    """``labels``: 0 or 1 for each document."""
    n_features = features.shape[1]
    edges = np.stack([np.quantile(features[:, k], np.arange(1, BINS) / BINS) for k in range(n_features)])
    model = Model(edges, np.zeros((3, n_features, BINS)), 0.0, np.zeros((2, 2)), 1.0, 0.0)
    y = np.repeat(labels, np.diff(first)).astype(float)
    views = list(_views(bins_of(features, edges), first))
    same = np.ones(len(y), bool)
    same[first[:-1]] = False
    seen = np.zeros((2, 2))
    for a in (0, 1):
        seen[a, a] = (same & (y == a)).sum()
    flat = [b + np.arange(n_features) * BINS for b, _ in views]
    size = 3 * n_features * BINS + 1 + 4
    theta, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    scale = 1.0 / len(y)
    for k in range(1, steps + 1):
        model.weights, model.bias, model.transition = theta[:-5].reshape(3, n_features, BINS), theta[-5], theta[-4:].reshape(2, 2)
        good, pairs = marginals(model.unary(features, first), first, model.transition)
        rest = y - good
        gradient = [np.bincount(f.reshape(-1), np.repeat(rest * mask, n_features), minlength=n_features * BINS) for f, (_, mask) in zip(flat, views, strict=True)]
        g = np.concatenate([*gradient, [rest.sum()], (seen - pairs).reshape(-1)]) * scale - 1e-4 * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    model.weights, model.bias, model.transition = theta[:-5].reshape(3, n_features, BINS), float(theta[-5]), theta[-4:].reshape(2, 2)
    good, _ = marginals(model.unary(features, first), first, model.transition)
    z = quality_logit(good, length, first)
    a, b = 1.0, 0.0
    for _ in range(200):  # Newton steps of the one-feature logistic calibration, with a small ridge
        p = _sigmoid(a * z + b)
        w = p * (1 - p) + 1e-6
        g = np.array([((labels - p) * z).sum() - 0.1 * (a - 0.5), (labels - p).sum()])
        h = np.array([[(w * z * z).sum() + 0.1, (w * z).sum()], [(w * z).sum(), w.sum()]])
        d = np.linalg.solve(h, g)
        a, b = a + np.clip(d[0], -1, 1), b + np.clip(d[1], -1, 1)
        if abs(d).max() < 1e-9:
            break
    model.slope, model.shift = float(a), float(b)
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r0, r1, raw, off in W.text_chunks(batch.column(0)):
            features, length, first = line_features(raw, off)
            blobs = [features[first[i] : first[i + 1]].astype(np.float32).tobytes() for i in range(r1 - r0)]
            sizes = [length[first[i] : first[i + 1]].tobytes() for i in range(r1 - r0)]
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(r0, r1 - r0), pa.array(blobs, pa.binary()), pa.array(sizes, pa.binary())], ["quality", "features", "length"])


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model from at most ``rows`` labelled documents outside the held-out fold."""
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("text", "quality", "doc_id")
    got = texts.mapInArrow(_features, "quality int, features binary, length binary").collect()
    got.sort(key=lambda r: (r.quality, r.features))  # the order of tasks has no say
    quality = np.array([r.quality for r in got])
    if len(set(quality)) < 2:
        share = float(quality.mean()) if len(quality) else 0.5
        return Model(np.zeros((N_FEATURES, BINS - 1)), np.zeros((3, N_FEATURES, BINS)), 0.0, np.zeros((2, 2)), 1.0, 0.0, share)
    features = np.concatenate([np.frombuffer(r.features, np.float32).reshape(-1, N_FEATURES) for r in got]).astype(float)
    length = np.concatenate([np.frombuffer(r.length, np.int64) for r in got])
    first = np.concatenate([[0], np.cumsum([len(r.length) // 8 for r in got])])
    return fit(features, length, first, quality)


def _scored(model: Model, place: int):
    """``place``: of the text in the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).flatten()[place].cast(pa.string())
            scores = [model.score(*line_features(raw, off)) for _, _, raw, off in W.text_chunks(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0))], ["row", "score"])

    return run


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(row, score): each row of ``docs`` as one struct, and its score."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    rows = docs.select(whole_row(docs).alias("row"))
    return rows.mapInArrow(_scored(model, docs.columns.index("text")), StructType([rows.schema["row"], StructField("score", DoubleType())]))


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    found = scored(id_and_text(docs, False), train(docs, labels, rows)).select("row.doc_id", "score")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
