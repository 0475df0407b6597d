"""Sorted-string-table shards of token ids.

Shards follow one another in ascending key order. A shard is a file of sections, each followed by one newline byte:

    block*   "B" + zstd frame of entries; an entry is: bytes of the key shared with the entry before (u8), further bytes
             of the key (u8), length of the value in bytes (u32), the further key bytes, the value. The first entry of a
             block shares nothing.
    index    "I" + for each block: first key (u8 length + bytes), last key (likewise), offset (u64), length (u32)
    bloom    "F" + number of hashes (u8) + bits
    footer   "S" + the struct FOOTER, so that a reader finds its way from the end of the file

Integers are little-endian. The key of an integer id is its eight big-endian bytes with the sign bit flipped, which
sort as the ids do; a null id has the empty key and comes first. A value is the ids, at 2 bytes each if all ids of the
shard are under 65,536 and at 4 otherwise.

Cases: null text is empty (the end id alone); equal ids follow one another in the order of their values; an empty
table gives no shards and no rows; other columns are not read.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.common import arrow_map, save, slices
from veilframe.llm.files import read_whole, write_sections
from veilframe.llm.tokens import encoder

#: shard number, documents, ids, bytes an id, index offset and length, bloom offset and length
FOOTER = struct.Struct("<QQQBQIQI8s")
MAGIC = b"VFSSTAB1"
ENTRY = struct.Struct("<BBI")
BLOCK_BYTES = 1 << 16
BLOOM_BITS, BLOOM_HASHES = 10, 7
SUFFIX = ".sst"


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - (1 << 63) if key else None


class ShardWriter:
    """Turns entries in ascending key order into sections. Holds a block, the index and the Bloom hashes."""

    def __init__(self, shard: int, width: int):
        self.shard, self.width, self.offset = shard, width, 0
        self.entries: list[bytes] = []
        self.size = self.docs = self.ids = 0
        self.first = self.last = b""
        self.index: list[bytes] = []
        self.hashes: list[int] = []
        self.squeeze = zstandard.ZstdCompressor(level=1)

    def _out(self, section: bytes) -> bytes:
        self.offset += len(section) + 1
        return section

    def add(self, key: bytes, value: bytes) -> Iterator[bytes]:
        shared = 0
        if self.entries:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        entry = ENTRY.pack(shared, len(key) - shared, len(value)) + key[shared:] + value
        self.entries.append(entry)
        self.last, self.size, self.docs, self.ids = key, self.size + len(entry), self.docs + 1, self.ids + len(value) // self.width
        self.hashes.append(xxhash.xxh64_intdigest(key))
        if self.size >= BLOCK_BYTES:
            yield self.block()

    def block(self) -> bytes:
        section, at = b"B" + self.squeeze.compress(b"".join(self.entries)), self.offset
        self.index.append(bytes([len(self.first)]) + self.first + bytes([len(self.last)]) + self.last + struct.pack("<QI", at, len(section)))
        self.entries, self.size = [], 0
        return self._out(section)

    def close(self) -> Iterator[bytes]:
        if self.entries:
            yield self.block()
        index = b"I" + b"".join(self.index)
        index_at = self.offset
        yield self._out(index)
        bits = np.zeros(max(64, BLOOM_BITS * len(self.hashes)) + 7 & ~7, np.uint8)
        h = np.array(self.hashes, np.uint64)
        for k in range(BLOOM_HASHES):
            bits[bloom_bit(h, k, len(bits))] = 1
        bloom, bloom_at = b"F" + bytes([BLOOM_HASHES]) + np.packbits(bits).tobytes(), self.offset
        yield self._out(bloom)
        yield self._out(b"S" + FOOTER.pack(self.shard, self.docs, self.ids, self.width, index_at, len(index), bloom_at, len(bloom), MAGIC))


def bloom_bit(h: np.ndarray, k: int, bits: int) -> np.ndarray:
    low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32)
    return ((low + np.uint64(k) * (high | np.uint64(1))) % np.uint64(bits)).astype(np.int64)


class Shard:
    """A shard in memory (or anything that can be sliced): lookups read the footer, the index, the filter and one block."""

    def __init__(self, data: bytes):
        end = len(data) - 1
        self.data = data
        self.number, self.docs, self.ids, self.width, at, n, bloom_at, bloom_n, magic = FOOTER.unpack(data[end - FOOTER.size : end])
        if magic != MAGIC or data[end - FOOTER.size - 1 : end - FOOTER.size] != b"S":
            raise ValueError("not a shard, or one cut short")
        self.blocks, index, i = [], data[at + 1 : at + n], 0
        while i < len(index):
            first = index[i + 1 : (i := i + 1 + index[i])]
            last = index[i + 1 : (i := i + 1 + index[i])]
            self.blocks.append((first, last, *struct.unpack_from("<QI", index, i)))
            i += 12
        self.lasts = [b[1] for b in self.blocks]
        self.hashes, self.bloom = data[bloom_at + 1], np.unpackbits(np.frombuffer(data[bloom_at + 2 : bloom_at + bloom_n], np.uint8))

    def entries(self, block: int) -> Iterator[tuple[bytes, bytes]]:
        _, _, at, n = self.blocks[block]
        raw, i, key = zstandard.ZstdDecompressor().decompress(self.data[at + 1 : at + n]), 0, b""
        while i < len(raw):
            shared, more, size = ENTRY.unpack_from(raw, i)
            i += ENTRY.size
            key = key[:shared] + raw[i : i + more]
            yield key, raw[i + more : i + more + size]
            i += more + size

    def wide(self, value: bytes) -> bytes:
        """The ids at four bytes each."""
        return value if self.width == 4 else np.frombuffer(value, "<u2").astype("<u4").tobytes()

    def get(self, key: bytes) -> list[bytes]:
        """Values of a key; mostly none or one."""
        h = np.array([xxhash.xxh64_intdigest(key)], np.uint64)
        if not all(self.bloom[bloom_bit(h, k, len(self.bloom))][0] for k in range(self.hashes)):
            return []
        out, b = [], bisect.bisect_left(self.lasts, key)
        while b < len(self.blocks) and self.blocks[b][0] <= key:
            out += [self.wide(v) for k, v in self.entries(b) if k == key]
            b += 1
        return out


def write(docs: DataFrame, path: str, *, tokenizer: str, kind: str, end_id: int, width: int = 2, text_col: str = "text", id_col: str = "doc_id", shard_bytes: int = 16 << 20) -> None:
    """Encode docs and write their shards under path. Texts are encoded where they are read; only ids are shuffled."""
    picked = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    total, n = picked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    shards = max(1, min(-(-total // shard_bytes), n))
    # cut points by id: shards of about as many documents each
    shares = [i / shards for i in range(1, shards)]
    bounds = np.array(sorted(set(picked.agg(F.percentile_approx("key", shares, max(10_000, 20 * shards))).first()[0] or [])) if shares else [], np.int64)
    end = end_id.to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer, kind)
        for b in slices(batches):
            ids = [own.encode(t or "") + end for t in b.column(1).to_pylist()]
            if width == 2:
                ids = [narrow(x) for x in ids]
            key = b.column(0)
            at = np.searchsorted(bounds, key.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), "left")
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), key, pa.array(ids, pa.binary())], ["shard", "key", "ids"])

    def narrow(x: bytes) -> bytes:
        wide = np.frombuffer(x, "<u4")
        if wide.max() > 0xFFFF:
            raise ValueError("an id needs more than two bytes: write with width=4")
        return wide.astype("<u2").tobytes()

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        as_batch = lambda xs: pa.RecordBatch.from_arrays([pa.array(xs, pa.binary())], ["section"])
        for b in slices(batches):
            for s, k, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                writer = writer or ShardWriter(s, width)
                for section in writer.add(key_of(k), v):
                    yield as_batch([section])
        if writer:
            yield as_batch(list(writer.close()))

    encoded = arrow_map(picked, encode, "shard int, key long, ids binary")
    ordered = encoded.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions(F.col("key").asc_nulls_first(), "ids")
    write_sections(arrow_map(ordered, shard, "section binary"), "section", path, "\n", SUFFIX)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every document from the files: shard, before (ids of the shard's earlier documents), key, ids (4 bytes each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                s, before = Shard(content.as_py()), 0
                for block in range(len(s.blocks)):
                    keys, at, ids = [], [], []
                    for k, v in s.entries(block):
                        keys.append(id_of(k))
                        at.append(before)
                        ids.append(s.wide(v))
                        before += len(v) // s.width
                    yield pa.RecordBatch.from_arrays([pa.array([s.number] * len(keys), pa.int32()), pa.array(at, pa.int64()), pa.array(keys, pa.int64()), pa.array(ids, pa.binary())], ["shard", "before", "key", "ids"])

    return arrow_map(read_whole(spark, path, SUFFIX).select("content"), run, "shard int, before long, key long, ids binary")


def lookup(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """key, ids of the given ids, by binary search in each shard whose filter lets them through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                s = Shard(content.as_py())
                found = [(k, v) for k in keys for v in s.get(key_of(k))]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([v for _, v in found], pa.binary())], ["key", "ids"])

    return arrow_map(read_whole(spark, path, SUFFIX).select("content"), run, "key long, ids binary")


class Remote:
    """A file of the shared file system that is read in the ranges asked for, so that a Shard over it reads its footer, its
    index, its filter and one block."""

    def __init__(self, spark: SparkSession, file):
        self.utils = spark.sparkContext._jvm.org.apache.commons.io.IOUtils
        fs = file.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self.size, self.stream, self.read = fs.getFileStatus(file).getLen(), fs.open(file), 0

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, at: int | slice):
        low, high, _ = (at if isinstance(at, slice) else slice(at, at + 1)).indices(self.size)
        self.stream.seek(low)
        got = bytes(self.utils.toByteArray(self.stream, max(0, high - low)))
        self.read += len(got)
        return got if isinstance(at, slice) else got[0]


def find(spark: SparkSession, path: str, key: int) -> list[bytes]:
    """The ids of one key, by seeking: for a few keys; lookup searches for many, on the executors."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    out = []
    for entry in fs.listStatus(folder):
        if entry.getPath().getName().endswith(SUFFIX) and entry.getLen():
            file = Remote(spark, entry.getPath())
            try:
                out += Shard(file).get(key_of(key))
            finally:
                file.stream.close()
    return out


def positions(spark: SparkSession, path: str) -> DataFrame:
    """key, start (ids of all documents before), n_tokens, ids_crc32 of every document in the files. The digests are taken
    where the files are read; no ids leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                s, before = Shard(content.as_py()), 0
                for block in range(len(s.blocks)):
                    keys, at, sizes, sums = [], [], [], []
                    for k, v in s.entries(block):
                        keys.append(id_of(k))
                        at.append(before)
                        sizes.append(len(v) // s.width)
                        sums.append(zlib.crc32(s.wide(v)))
                        before += sizes[-1]
                    yield pa.RecordBatch.from_arrays([pa.array([s.number] * len(keys), pa.int32()), *(pa.array(x, pa.int64()) for x in (at, keys, sizes, sums))], ["shard", "before", "key", "n_tokens", "ids_crc32"])

    rows = save(arrow_map(read_whole(spark, path, SUFFIX).select("content"), run, "shard int, before long, key long, n_tokens long, ids_crc32 long"), "positions")
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("total"))  # a row a shard
    totals = totals.selectExpr("shard as of_shard", "coalesce(sum(total) over (order by shard rows between unbounded preceding and 1 preceding), 0) as earlier")
    return rows.join(totals, F.col("shard") == F.col("of_shard")).select("key", (F.col("before") + F.col("earlier")).alias("start"), "n_tokens", "ids_crc32")
