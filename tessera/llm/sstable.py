"""Sorted-string-table shards of token ids.

A shard holds documents in key order. Layout, all integers little-endian:

    block*   zstd( entry* restart:u32* n_restarts:u32 ) crc32:u32
    index    zstd( n:u32, then per block: last key (8 bytes), offset:u64, size:u32 )
    bloom    n_probes:u32, bits of a Bloom filter over the keys
    footer   index offset:u64 size:u32, bloom offset:u64 size:u32, n_entries:u64, n_ids:u64, first key, last key, id width:u8, magic

An entry is shared:u8, kept:u8, value length:u32, key bytes after the shared prefix, value (packed ids); each 16th
entry is a restart with nothing shared, so a block is binary-searched too. Keys are doc_ids as 8 big-endian bytes with the sign
bit flipped, which sort as the numbers do. Shards are written to a name of the attempt and renamed once whole: a retried
or duplicated task leaves either the old or the new file, never part of one.

Defined results: a null text is empty and has its end id alone; very long texts are one entry; rows with one doc_id lie beside each other in the
order of a hash of their texts, those without a doc_id come first; an empty table has no shards; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_ids import END, PackedEncoder, small_batches
from .common import Workspace

MAGIC = b"TSST0001"
FOOTER = struct.Struct("<QIQIQQ8s8sB8s")
BLOCK = 1 << 17
RESTART = 16
PROBES = 7


NO_ID = b"\0" * 8  # the key of rows whose id is null; no other id has it unless it is -2**63


def key_of(doc_id: int | None) -> bytes:
    return NO_ID if doc_id is None else ((doc_id + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key == NO_ID else int.from_bytes(key, "big") - (1 << 63)


def _probes(key: bytes, bits: int) -> list[int]:
    h = zlib.crc32(key) | zlib.crc32(key, 0x9747B28C) << 32
    return [(h + i * ((h >> 33) | 1) * 0x9E3779B1) % bits for i in range(PROBES)]


class Writer:
    """Appends (key, ids) in key order to an open binary file."""

    def __init__(self, out, width: int = 2):
        self.out, self.width = out, width
        self.offset = self.n = self.n_ids = 0
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.pack = zstandard.ZstdCompressor(level=3)
        self.first = self.last = b"\0" * 8
        self._new()

    def _new(self) -> None:
        self.entries, self.size, self.restarts, self.in_block = [], 0, [], 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.n and key < self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.in_block % RESTART:
            while shared < 8 and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(self.size)
        value = ids.astype("<u2" if self.width == 2 else "<u4").tobytes()
        entry = struct.pack("<BBI", shared, 8 - shared, len(value)) + key[shared:] + value
        self.entries.append(entry)
        self.size += len(entry)
        self.in_block += 1
        if not self.n:
            self.first = key
        self.last = key
        self.keys.append(key)
        self.n += 1
        self.n_ids += len(ids)
        if self.size >= BLOCK:
            self._flush()

    def _put(self, data: bytes) -> tuple[int, int]:
        at = self.offset
        self.out.write(data)
        self.offset += len(data)
        return at, len(data)

    def _flush(self) -> None:
        if not self.entries:
            return
        body = self.pack.compress(b"".join(self.entries) + struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts)))
        self.index.append((self.last, *self._put(body + struct.pack("<I", zlib.crc32(body)))))
        self._new()

    def close(self) -> None:
        self._flush()
        index = self._put(self.pack.compress(struct.pack("<I", len(self.index)) + b"".join(k + struct.pack("<QI", o, s) for k, o, s in self.index)))
        bits = max(64, 10 * len(self.keys))
        bloom = np.zeros(bits, bool)
        for key in self.keys:
            bloom[_probes(key, bits)] = True
        filter_at = self._put(struct.pack("<II", PROBES, bits) + np.packbits(bloom).tobytes())
        self._put(FOOTER.pack(*index, *filter_at, self.n, self.n_ids, self.first, self.last, self.width, MAGIC))


class Reader:
    """Reads a shard from a seekable binary file: in order, or one key by binary search."""

    def __init__(self, file):
        self.file = file
        size = file.seek(0, 2)
        file.seek(size - FOOTER.size)
        index_at, index_size, bloom_at, bloom_size, self.n, self.n_ids, self.first, self.last, self.width, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        self.unpack = zstandard.ZstdDecompressor()
        raw = self.unpack.decompress(self._read(index_at, index_size))
        self.index = [(raw[p : p + 8], *struct.unpack_from("<QI", raw, p + 8)) for p in range(4, len(raw), 20)]
        self.bloom_at = bloom_at, bloom_size
        self._bloom: bytes | None = None

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def _block(self, at: int, size: int) -> tuple[bytes, list[int], int]:
        raw = self._read(at, size)
        if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("a block is damaged")
        body = self.unpack.decompress(raw[:-4])
        n = struct.unpack_from("<I", body, len(body) - 4)[0]
        end = len(body) - 4 - 4 * n
        return body, list(struct.unpack_from(f"<{n}I", body, end)), end

    def _entries(self, body: bytes, p: int, end: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while p < end:
            shared, kept, size = struct.unpack_from("<BBI", body, p)
            p += 6
            key = key[:shared] + body[p : p + kept]
            p += kept
            yield key, body[p : p + size]
            p += size

    def _ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, "<u2" if self.width == 2 else "<u4").astype("<u4")

    def scan(self) -> Iterator[tuple[int, np.ndarray]]:
        for _, at, size in self.index:
            body, _, end = self._block(at, size)
            for key, value in self._entries(body, 0, end):
                yield id_of(key), self._ids(value)

    def get(self, doc_id: int) -> np.ndarray | None:
        """The ids of one document (the first of several with its id), or None."""
        key = key_of(doc_id)
        if self._bloom is None:
            self._bloom = self._read(*self.bloom_at)
        bits = struct.unpack_from("<I", self._bloom, 4)[0]
        if not all(self._bloom[8 + (p >> 3)] >> (7 - (p & 7)) & 1 for p in _probes(key, bits)):
            return None
        at = bisect_left(self.index, key, key=lambda e: e[0])
        if at == len(self.index):
            return None
        body, restarts, end = self._block(*self.index[at][1:])
        whole = [body[r + 6 : r + 14] for r in restarts]
        for found, value in self._entries(body, restarts[max(0, bisect_left(whole, key) - 1)], end):
            if found >= key:
                return self._ids(value) if found == key else None
        return None


def _open(uri: str):
    """(file system, path) of a URI: the local disk, or any store that Arrow knows by its scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def write_shards(docs: DataFrame, folder: str, tokenizer: str, shard_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all texts (null: empty; every one with end id 0) as shards in ``folder``; returns the manifest, still to be run.

    The manifest has one row per shard: shard, path, n_docs, n_ids. Rows with the same id lie beside each other,
    in the order of a hash of their texts; an empty table has no shards.
    """
    spark = docs.sparkSession
    guess = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), guess // shard_bytes + 1 if guess < 1 << 60 else 1)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encoder = writer = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                store, base = _open(folder)
                store.create_dir(base, recursive=True)
                temporary = f"{base}/.{shard:06d}-{uuid.uuid4().hex}"
                out = store.open_output_stream(temporary)
                encoder = PackedEncoder(tokenizer)
                writer = Writer(out, 2 if encoder.tokenizer.get_vocab_size() <= 1 << 16 else 4)
            ids = batch.column(0).to_pylist()
            texts = batch.column(1).to_pylist()
            for first, part in small_batches(texts):
                for doc_id, raw in zip(ids[first : first + len(part)], encoder.encode(part), strict=True):
                    writer.add(key_of(doc_id), np.frombuffer(raw + END, "<u4"))
        if writer is not None:
            writer.close()
            out.close()
            name = f"{shard:06d}.sst"
            store.move(temporary, f"{base}/{name}")
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": pa.array([f"{folder}/{name}"]), "n_docs": pa.array([writer.n]), "n_ids": pa.array([writer.n_ids])})

    return ordered.mapInArrow(run, "shard int, path string, n_docs long, n_ids long")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Every document of the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The manifest has one row a shard and is brought to the driver to give each shard the ids before it.
    """
    spark = manifest.sparkSession
    shards, before = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r["shard"]):
        shards.append((r["path"], before))
        before += r["n_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, at = _open(path)
                rows = []
                with store.open_input_file(at) as file:
                    for doc_id, ids in Reader(file).scan():
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                        if len(rows) == 5000:
                            yield _rows(rows)
                            rows = []
                yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame(shards, "path string, start long").repartition(max(1, len(shards)))
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_to_shards(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write shards to a new folder of the shared root and read every document back from them."""
    ws = Workspace(docs.sparkSession, "sstable")
    return read_shards(ws.stage(write_shards(docs, f"{ws.path}/shards", tokenizer), "manifest"))
