"""Token ids in sorted-string-table shards.

A shard holds documents in ascending order of their key: blocks of entries whose keys leave
out what they share with the key before, a sparse index with the first key of each block, a
Bloom filter over all keys and a footer. A lookup reads the footer, asks the filter, finds
the block by binary search in the index and scans that block alone; nothing else of the file is read.

Layout, little-endian:
  block   entries, then crc32 of them (4 bytes)
          entry: shared key bytes (1), further key bytes (1), tokens (4), width (1), the
          further key bytes, the ids in width bytes each
  index   for each block: first key (9), offset (8), length (4), entries (4)
  filter  bits; number of hashes and of bits are in the footer
  footer  index offset, index blocks, filter offset, filter bits, filter hashes, entries,
          tokens, version, crc32 of index and filter, MAGIC: 9 x 8 bytes and 8 bytes
A key is a zero byte alone for no id, else a one and a signed 64-bit integer, big-endian with its sign
turned, so that bytes sort as numbers; it has nine bytes.

Texts are sorted by ranges of the key, as many as their bytes ask for. Each task encodes them and writes shards of at most `shard_bytes` and a block under a
temporary name and renames them, so that a task that runs again replaces its own files.

Defined results: a null or empty text is its end id alone; rows without an id come first and have none when read;
equal ids stand together, in order of a hash of their text; no rows give no shard.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow import ready
from .store import materialize, new_path
from .tokens import END_ID, shared_encoder, vocabulary_path

MAGIC = b"LSSTBL01"
VERSION = 2
BLOCK_BYTES, SHARD_BYTES, BITS_PER_KEY = 64 << 10, 16 << 20, 10
_ENTRY, _INDEX, _FOOTER = struct.Struct("<BBIB"), struct.Struct("<9sQII"), struct.Struct("<9Q8s")
_SIGN = 1 << 63
_KEY, RANGE_BYTES, LEAST_RANGE = 9, 32 << 20, 1 << 20


def key_bytes(doc_id: int | None) -> bytes:
    return bytes(_KEY) if doc_id is None else b"\1" + (doc_id + _SIGN).to_bytes(8, "big")


def key_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:], "big") - _SIGN if key[0] else None


def _spots(key: bytes, hashes: int, bits: int) -> list[int]:
    digest = hashlib.blake2b(key, digest_size=16).digest()
    a, b = int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little") | 1
    return [((a + i * b) & (2**64 - 1)) % bits for i in range(hashes)]


class ShardWriter:
    """Takes (id, ids as little-endian unsigned integers of `width` bytes) in ascending order; finish() gives the file."""

    def __init__(self, block_bytes: int = BLOCK_BYTES):
        self._most = block_bytes
        self._done: list[bytes] = []
        self.size = self.tokens = self.entries = 0
        self._index: list[tuple[bytes, int, int, int]] = []
        self._block: list[bytes] = []
        self._held = self._count = 0
        self._last = b""
        self._keys: list[bytes] = []

    def add(self, doc_id: int | None, ids: bytes, width: int = 4) -> None:
        key, shared = key_bytes(doc_id), 0
        if self._block:
            while shared < _KEY and key[shared] == self._last[shared]:
                shared += 1
        else:
            self._first = key
        n = len(ids) // width
        if width == 4 and (not n or (values := np.frombuffer(ids, "<u4")).max() < 65536):
            ids, width = values.astype("<u2").tobytes() if n else b"", 2
        entry = _ENTRY.pack(shared, _KEY - shared, n, width) + key[shared:] + ids
        self._block.append(entry)
        self._last = key
        if not self._keys or self._keys[-1] != key:
            self._keys.append(key)
        self._held += len(entry)
        self._count += 1
        self.tokens += n
        self.entries += 1
        if self._held >= self._most:
            self._close()

    def _close(self) -> None:
        if self._block:
            data = b"".join(self._block)
            data += struct.pack("<I", zlib.crc32(data))
            self._index.append((self._first, self.size, len(data), self._count))
            self._done.append(data)
            self.size += len(data)
            self._block, self._held, self._count = [], 0, 0

    def finish(self) -> bytes:
        self._close()
        bits, hashes = max(64, len(self._keys) * BITS_PER_KEY), 7
        bits += -bits % 8
        table = bytearray(bits // 8)
        for key in self._keys:
            for x in _spots(key, hashes, bits):
                table[x >> 3] |= 1 << (x & 7)
        index = b"".join(_INDEX.pack(*x) for x in self._index)
        foot = _FOOTER.pack(self.size, len(self._index), self.size + len(index), bits, hashes, self.entries, self.tokens, VERSION, zlib.crc32(bytes(table), zlib.crc32(index)), MAGIC)
        return b"".join([*self._done, index, bytes(table), foot])


class Shard:
    """Reads a shard: get(id) by binary search, items() in order. fetch(offset, length) gives its bytes; only what is asked for is fetched."""

    def __init__(self, fetch: Callable[[int, int], bytes], size: int):
        self._fetch = fetch
        if size < _FOOTER.size:
            raise ValueError("too short for a shard")
        index, blocks, bloom, self._bits, self._hashes, self.entries, self.tokens, version, crc, magic = _FOOTER.unpack(fetch(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a shard of this version")
        if index + blocks * _INDEX.size != bloom or bloom + self._bits // 8 + _FOOTER.size != size:
            raise ValueError("the footer is damaged")
        both = memoryview(fetch(index, bloom - index + self._bits // 8))
        raw, self._bloom = both[: bloom - index], both[bloom - index :]
        if zlib.crc32(both) != crc:
            raise ValueError("index or filter is damaged")
        self._index = [*_INDEX.iter_unpack(raw)]
        self._keys = [x[0] for x in self._index]

    @classmethod
    def of(cls, data: bytes) -> Shard:
        view = memoryview(data)
        return cls(lambda offset, length: view[offset : offset + length], len(data))

    @classmethod
    def open(cls, file) -> Shard:
        """Of a seekable file."""

        def fetch(offset, length):
            file.seek(offset)
            return file.read(length)

        return cls(fetch, file.size())

    def may_contain(self, doc_id: int | None) -> bool:
        return all(self._bloom[x >> 3] >> (x & 7) & 1 for x in _spots(key_bytes(doc_id), self._hashes, self._bits))

    def _block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        _, offset, length, count = self._index[k]
        data = memoryview(self._fetch(offset, length))
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError(f"block {k} is damaged")
        at, key = 0, b""
        for _ in range(count):
            shared, more, n, width = _ENTRY.unpack(data[at : at + _ENTRY.size])
            at += _ENTRY.size
            key = key[:shared] + bytes(data[at : at + more])
            at += more
            yield key, (bytes(data[at : at + n * width]), width)
            at += n * width

    def get(self, doc_id: int | None) -> list[int] | None:
        """The ids of the first document of this id, or None."""
        if not self.may_contain(doc_id):
            return None
        key = key_bytes(doc_id)
        k = max(0, bisect_right(self._keys, key) - 1)
        while k > 0 and self._keys[k] == key:  # equal ids may begin in the block before
            k -= 1
        for b in range(k, len(self._index)):
            if self._keys[b] > key:
                break
            for found, (raw, width) in self._block(b):
                if found == key:
                    return _wide(raw, width).tolist()
        return None

    def items(self) -> Iterator[tuple[int | None, object]]:
        """(id, ids as an array of unsigned 32-bit integers), in order."""
        for k in range(len(self._index)):
            for key, (raw, width) in self._block(k):
                yield key_of(key), _wide(raw, width)


def _wide(raw: bytes, width: int):
    return np.frombuffer(raw, f"<u{width}").astype("<u4")


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Writes shards to folder (file:, hdfs:, s3: or gs: as pyarrow reads them) and returns a written table of them: part, file, first_id, last_id, entries, tokens, bytes. Order of (part, file) is order of ids."""
    spark = docs.sparkSession
    ready(spark)
    home = spark._jvm.org.apache.hadoop.fs.Path(folder)
    home.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(home)
    path = path or vocabulary_path()
    rows = docs.select(docs[f"`{doc_id}`"].cast("long").alias("k"), docs[f"`{text}`"].alias("t")).withColumn("h", F.xxhash64("t"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("t"), F.lit(0)) + 8)).first()[0] or 0
    parts = max(-(-size // RANGE_BYTES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // LEAST_RANGE)), 1)
    ranged = rows.repartitionByRange(parts, F.col("k").asc_nulls_first(), "h").sortWithinPartitions(F.col("k").asc_nulls_first(), "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        encoder, part, number = shared_encoder(path), TaskContext.get().partitionId(), 0
        writer = first = last = None
        out = []

        def close():
            nonlocal writer, number
            data, (system, base) = writer.finish(), _filesystem(folder)
            system.create_dir(base, recursive=True)
            name = f"part-{part:06d}-{number:05d}.sst"
            hidden = f"{base}/_{uuid.uuid4().hex}"
            with system.open_output_stream(hidden) as f:
                f.write(data)
            system.move(hidden, f"{base}/{name}")
            out.append((part, name, first, last, writer.entries, writer.tokens, len(data)))
            writer, number = None, number + 1

        for batch in batches:
            ids, bounds = encoder.encode_all(batch.column(1), end_id)
            width = 2 if not len(ids) or ids.max() < 65536 else 4
            ids, bounds = ids.astype(f"<u{width}"), bounds.tolist()
            for k, low, high in zip(batch.column(0).to_pylist(), bounds, bounds[1:]):
                if writer is None:
                    writer, first = ShardWriter(block_bytes), k
                writer.add(k, ids[low:high].tobytes(), width)
                last = k
                if writer.size >= shard_bytes:
                    close()
        if writer is not None:
            close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out]), *(pa.array([x[i] for x in out], pa.int64()) for i in range(2, 7))], names=["part", "file", "first_id", "last_id", "entries", "tokens", "bytes"])

    made = ranged.select("k", "t").mapInArrow(run, "part int, file string, first_id long, last_id long, entries long, tokens long, bytes long")
    return materialize(made, "shards")


def read(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    """Every document of the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Totals of shards, a row each, give where a shard starts; they are summed in two steps,
    within a part and over parts, so that neither step has more rows than a part has files or
    there are parts.
    """
    ready(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.sst").load(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids, starts, counts, crcs, at = [], [], [], [], 0
                for doc_id, tokens in Shard.of(content.as_buffer()).items():
                    ids.append(doc_id)
                    starts.append(at)
                    counts.append(len(tokens))
                    crcs.append(zlib.crc32(tokens))
                    at += len(tokens)
                names = ["file", "doc_id", "inner", "n_tokens", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([pa.array([path.rsplit("/", 1)[-1]] * len(ids), pa.string()), *(pa.array(x, pa.int64()) for x in (ids, starts, counts, crcs))], names=names)

    rows = files.select("path", "content").mapInArrow(run, "file string, doc_id long, inner long, n_tokens long, ids_crc32 long")
    before = (Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("tokens").alias("t"))
    parts = parts.select("part", F.coalesce(F.sum("t").over(Window.orderBy("part").rowsBetween(*before)), F.lit(0)).alias("base"))
    starts = shards.join(parts, "part").select("file", (F.col("base") + F.coalesce(F.sum("tokens").over(Window.partitionBy("part").orderBy("file").rowsBetween(*before)), F.lit(0))).alias("from"))
    starts = materialize(starts, "starts")  # of known size: sent to the documents if it is small
    return rows.join(starts, "file").select("doc_id", (F.col("from") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, folder: str, shards: DataFrame, doc_id: int | None) -> list[int] | None:
    """The ids of one document (or of the first without an id): the table of shards gives the files whose ranges hold it; of each its footer, index and filter are read, and one block if the filter lets it."""
    system, base = _filesystem(folder)
    first, last = F.col("first_id"), F.col("last_id")
    inside = first.isNull() if doc_id is None else (first.isNull() | (first <= doc_id)) & (last >= doc_id)
    for row in shards.where(inside).orderBy("part", "file").toLocalIterator():
        with system.open_input_file(f"{base}/{row.file}") as f:
            found = Shard.open(f).get(doc_id)
        if found is not None:
            return found
    return None


def write_and_read(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Writes docs to shards in the shared folder and reads all of them back."""
    spark = docs.sparkSession
    folder = new_path(spark, "sst")
    return read(spark, folder, write(docs, folder, doc_id, text, path))
