"""A test of fixed size whether an id may be in a set: a map-side filter in place of a shuffle.

The set's size doesn't matter to the test's size (2**BITS bits, 8 MB), only to how
many other ids pass by chance; what passes is joined exactly afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .words import U64, mix

BITS = 26


def _places(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.view(U64) ^ U64(0x5DEECE66D)) >> U64(64 - BITS)).astype(np.int64)


#: Bits of a strip; a strip with few marks is sent as their places.
_STRIP = (1 << BITS) // 64
_FEW = _STRIP // 64


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's marks, by strips: their places (few) or the strip's bits."""
    found = [np.unique(_places(batch.column(0).to_numpy())) for batch in batches]
    places = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    cuts = np.searchsorted(places, np.arange(65) * _STRIP)
    for k in np.flatnonzero(np.diff(cuts)):
        own = (places[cuts[k] : cuts[k + 1]] - k * _STRIP).astype(np.uint32)
        few = len(own) <= _FEW
        yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([few]), pa.array([own.tobytes() if few else _bits(own).tobytes()], pa.binary())], ["strip", "few", "bits"])


def _bits(places: np.ndarray) -> np.ndarray:
    bits = np.zeros(_STRIP, bool)
    bits[places] = True
    return np.packbits(bits)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    strips: dict[int, np.ndarray] = {}
    for batch in batches:
        for strip, few, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            own = _bits(np.frombuffer(bits.as_buffer(), np.uint32)) if few else np.frombuffer(bits.as_buffer(), np.uint8)
            strips[strip] = strips[strip] | own if strip in strips else own
    if strips:
        yield pa.RecordBatch.from_arrays([pa.array(list(strips), pa.int64()), pa.array([x.tobytes() for x in strips.values()], pa.binary())], ["strip", "bits"])


class Membership:
    """Broadcast to the executors; ``may(ids)`` there gives a mask."""

    def __init__(self, spark: SparkSession, ids: DataFrame):
        """``ids``: one long column, without nulls."""
        strips = ids.mapInArrow(_marked, "strip long, few boolean, bits binary").repartition("strip").mapInArrow(_joined, "strip long, bits binary").collect()
        packed = np.zeros((64, (1 << BITS) // 512), np.uint8)
        for strip, bits in strips:
            packed[strip] = np.frombuffer(bits, np.uint8)
        self._held = spark.sparkContext.broadcast(packed.reshape(-1).tobytes())

    def may(self, ids: np.ndarray) -> np.ndarray:
        at = _places(np.ascontiguousarray(ids))
        return (np.frombuffer(self._held.value, np.uint8)[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
