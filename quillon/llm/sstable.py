r"""Token ids in sorted-string-table shards.

A shard holds documents in ascending doc_id order:

    block*   entries: varint shared key bytes, varint other key bytes, varint value bytes, key bytes, value
    index    for each block: last key (8 bytes), offset and size (8 bytes each)
    filter   a Bloom filter over the keys, BITS_PER_KEY bits each
    footer   offsets and sizes of index and filter, blocks, entries, ids, id width, magic

A key is the doc_id as 8 big-endian bytes with the sign bit turned, so byte order
is number order; in a block a key keeps only what differs from the one before.
A value is the document's ids, little-endian, in the width that the vocabulary
needs. A look-up asks the filter, searches the index by halves, and reads one
block.

The documents are dealt by ranges of doc_id, so the shards in their order hold all
documents in order. A task writes its shard under a name of its own and renames
it, so a task that runs again does no harm. Files go to the folder that the
cluster shares, by the file system that its URI names.

Defined cases: a null or empty text has the end id alone; repeated rows of a
doc_id are entries of their own, in the order of their texts; rows with a null
doc_id have no key and are left out; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .documents import id_and_text
from .scratch import Scratch
from .tokens import ROWS, encoder, public_path

BLOCK_BYTES = 64 << 10
BITS_PER_KEY = 10
PROBES = 7
MAGIC = b"QSST0001"
_FOOTER = struct.Struct("<8Q8s")
_PLACE = struct.Struct("<2Q")


def key_of(doc_id: int) -> bytes:
    return struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int:
    return struct.unpack(">Q", key)[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        n |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return n, at


def _places(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x5BD1E995) | 1
    return [(a + k * b) % bits for k in range(PROBES)]


class ShardWriter:
    """Takes entries in ascending key order; ``out`` is an open binary file."""

    def __init__(self, out, width: int):
        self._out, self._width = out, width
        self._block, self._before, self._index, self._keys = bytearray(), b"", [], []
        self._at = self._ids = 0

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        while self._block and shared < 8 and key[shared] == self._before[shared]:
            shared += 1
        self._block += _varint(shared) + _varint(8 - shared) + _varint(len(value)) + key[shared:] + value
        self._before = key
        self._keys.append(key)
        self._ids += len(value) // self._width
        if len(self._block) >= BLOCK_BYTES:
            self._end_block()

    def _end_block(self) -> None:
        if self._block:
            self._out.write(bytes(self._block))
            self._index.append((self._before, self._at, len(self._block)))
            self._at += len(self._block)
            self._block = bytearray()

    def close(self) -> None:
        self._end_block()
        index = b"".join(key + _PLACE.pack(at, size) for key, at, size in self._index)
        bits = max(64, BITS_PER_KEY * len(self._keys))
        bloom = bytearray((bits + 7) // 8)
        for key in self._keys:
            for p in _places(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        self._out.write(index)
        self._out.write(bytes(bloom))
        self._out.write(_FOOTER.pack(self._at, len(index), self._at + len(index), bits, len(self._index), len(self._keys), self._ids, self._width, MAGIC))


class ShardReader:
    """``file``: an open binary file that can seek."""

    def __init__(self, file):
        self._file = file
        file.seek(0, 2)
        self._read_footer(file.tell())

    def _part(self, at: int, size: int) -> bytes:
        self._file.seek(at)
        return self._file.read(size)

    def _read_footer(self, end: int) -> None:
        at, size, bloom_at, self._bits, blocks, self.n_docs, self.n_ids, self.width, magic = _FOOTER.unpack(self._part(end - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        raw = self._part(at, size)
        self.index = [(raw[k : k + 8], *_PLACE.unpack(raw[k + 8 : k + 24])) for k in range(0, size, 24)]
        self._bloom_at = bloom_at
        self._bloom: bytes | None = None

    def _block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        _, offset, size = self.index[k]
        data, at, key = self._part(offset, size), 0, b""
        while at < size:
            shared, at = _read_varint(data, at)
            other, at = _read_varint(data, at)
            length, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + other]
            at += other
            yield key, data[at : at + length]
            at += length

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        for k in range(len(self.index)):
            for key, value in self._block(k):
                yield id_of(key), value

    def get(self, doc_id: int) -> bytes | None:
        """The ids of a document, the first of a repeated one; None if the shard lacks it."""
        key = key_of(doc_id)
        if self._bloom is None:
            self._bloom = self._part(self._bloom_at, (self._bits + 7) // 8)
        if not all(self._bloom[p >> 3] >> (p & 7) & 1 for p in _places(key, self._bits)):
            return None
        low, high = 0, len(self.index)
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if self.index[middle][0] < key else (low, middle)
        return next((v for k, v in self._block(low) if k == key), None) if low < len(self.index) else None


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


_SHARD = "shard int, path string, first_id long, n_docs long, n_ids long"


def _write(folder: str, tokenizer: str, end_id: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        column, kind = encoder(tokenizer).column, "<u2" if width == 2 else "<u4"
        end = int(end_id).to_bytes(width, "little")
        system, root = _file_system(folder)
        number = TaskContext.get().partitionId()
        final, own = f"{root}/shard-{number:06d}.sst", f"{root}/_{uuid.uuid4().hex}"
        n_docs = n_ids = 0
        first = out = writer = None
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            if writer is None and doc_ids:
                system.create_dir(root, recursive=True)
                out = system.open_output_stream(own, compression=None)
                writer, first = ShardWriter(out, width), doc_ids[0]
            for begin, last, made, at in column(batch.column(1)):
                ids = made.astype(kind)
                for k in range(begin, last):
                    value = ids[at[k - begin] : at[k - begin + 1]].tobytes() + end
                    writer.add(key_of(doc_ids[k]), value)
                    n_docs, n_ids = n_docs + 1, n_ids + len(value) // width
        if writer is not None:
            writer.close()
            out.close()
            system.move(own, final)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([f"{folder}/shard-{number:06d}.sst"]), pa.array([first]), pa.array([n_docs]), pa.array([n_ids])], ["shard", "path", "first_id", "n_docs", "n_ids"])

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    for batch in batches:
        for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            system, own = _file_system(path)
            with system.open_input_file(own) as file:
                shard, rows = ShardReader(file), []
                for doc_id, value in shard:
                    n = len(value) // shard.width
                    ids = value if shard.width == 4 else np.frombuffer(value, "<u2").astype("<u4").tobytes()
                    rows.append((doc_id, before, n, zlib.crc32(ids)))
                    before += n
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)


def write_shards(spark: SparkSession, docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, vocabulary: int = 50_257) -> DataFrame:
    """Writes the shards and returns their table: shard, path, first_id, n_docs, n_ids. It is to be saved: each run writes again."""
    width = 2 if vocabulary <= 1 << 16 else 4
    dealt = id_and_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return dealt.mapInArrow(_write(folder, tokenizer, end_id, width), _SHARD)


def read_shards(spark: SparkSession, shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files.

    The table of shards has a row a file, and its running sum is taken on the driver.
    """
    rows = shards.orderBy("shard").select("path", "n_ids").collect()
    listed, before = [], 0
    for path, n_ids in rows:
        listed.append((path, before))
        before += n_ids
    table = spark.createDataFrame(listed, "path string, before long")
    return table.repartition(max(1, len(listed))).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_shards(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    scratch = Scratch(spark, "sstable")
    folder = scratch.path("shards")
    shards = scratch.save(write_shards(spark, docs, folder, tokenizer or public_path("byte_bpe_50k.json"), end_id), "list", ROWS)
    return read_shards(spark, shards)
