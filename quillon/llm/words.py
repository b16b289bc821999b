"""Word hashes of whole Arrow batches, without a Python object per word.

A word is ``[^\\x20\\x09-\\x0D]+`` over the UTF-8 bytes of a text. Its hash is the
sum over its bytes of a random 64-bit value of the byte times a random odd one of
the place in the word, scrambled at the end. The places' values are independent,
not powers of a base, for which there are words that collide in any table. The sums
come from prefix sums, so a batch costs a few passes of NumPy over its bytes. Two seeds
give two independent hashes where 128 bits are wanted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once; a longer text is hashed alone.
CHUNK = 1 << 18
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True
#: The odd value of each place in a word, up to the longest word seen or _PLACES; those beyond are worked out each time.
_PLACES = 1 << 20
_odd = np.ones(0, U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def byte_table(seed: int, lower: bool) -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95) + U64(seed))
    return table[_LOWER] if lower else table


def places(at: np.ndarray) -> np.ndarray:
    """The odd values of places."""
    global _odd
    top = int(at.max(initial=0)) + 1
    if len(_odd) < min(top, _PLACES):
        _odd = mix(np.arange(1, 1 + min(_PLACES, 2 * max(top, 128)), dtype=U64) * U64(0xA0761D6478BD642F)) | U64(1)
    if top <= len(_odd):
        return _odd[at]
    return np.where(at < len(_odd), _odd[np.minimum(at, len(_odd) - 1)], mix((at.astype(U64) + U64(1)) * U64(0xA0761D6478BD642F)) | U64(1))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64: for sums over a few dozen hashes at the most, as longer ones can collide whatever the hashes are."""
    return tuple(np.concatenate([np.ones(1, U64), np.cumprod(np.full(n, b, U64))]) for b in (_BASE, pow(_BASE, -1, 1 << 64)))


def text_chunks(column: pa.Array, chunk: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, byte offset of each row and of the end) for runs of rows.

    A null text is an empty one.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(off, off[row] + chunk, side="right")) - 1)
        end = min(end, len(column))
        yield row, end, raw[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the index of each row's first word (with the end)."""
    solid = np.empty(len(raw) + 1, bool)
    solid[:-1] = ~_GAP[raw]
    solid[-1] = False
    new = np.zeros(len(raw) + 1, bool)  # a text starts here
    new[off] = True
    begins, ends = solid.copy(), solid[:-1].copy()
    begins[1:] &= ~solid[:-1] | new[1:]
    ends &= ~solid[1:] | new[1:]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, off)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, U64)
    begin = np.zeros(len(raw), np.int64)
    begin[starts] = starts
    np.maximum.accumulate(begin, out=begin)
    at = np.minimum(np.arange(len(raw)) - begin, (ends - starts).max())  # bytes of gaps count for nothing
    sums = np.empty(len(raw) + 1, U64)
    sums[0] = 0
    np.cumsum(table[raw] * places(at), out=sums[1:])
    return mix(sums[ends] - sums[starts] + (ends - starts).astype(U64))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words; n - 1 fewer than there are words."""
    if len(hashes) < n:
        return np.zeros(0, U64)
    out = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        out = out * U64(0x9FB21C651E98DF25) + hashes[k : len(hashes) - n + 1 + k]
    return mix(out)


def inside(first: np.ndarray, total: int, n: int) -> np.ndarray:
    """Which of the windows of n words over all rows stay in one row."""
    count = max(0, total - n + 1)
    ok = np.ones(count + n, bool)
    for k in range(1, n):
        at = first[1:-1] - k
        ok[at[at >= 0]] = False
    return ok[:count]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
