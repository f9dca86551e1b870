"""Sorted-string-table shards of token ids.

A shard holds documents in ascending key order. File layout, all integers little-endian:

    data blocks   entries of (varint shared, varint unshared, varint value bytes, key
                  suffix, value), `shared` bytes of the key taken from the entry before;
                  the first entry of a block shares none; a crc32 ends the block
    index block   for each data block: varint key bytes, last key, offset u64, bytes u32
    Bloom filter  bits, ten a key, seven probes by double hashing
    footer        FOOTER, ending with the magic bytes

A lookup probes the filter, finds its block by binary search in the index and scans
that block alone.
"""

from __future__ import annotations

import bisect
import io
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs as pafs
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import held, materialize, scratch

MAGIC = b"QMSSTv1\n"
#: index offset, index bytes, filter offset, filter bytes, entries, ids, bytes an id.
FOOTER = struct.Struct("<QQQQQQI8s")
BLOCK_BYTES = 32 << 10
BLOOM_BITS, BLOOM_PROBES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    """Keys that sort as the ids do; a null id is the empty key and so comes first."""
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (2**64 - 1), h >> 64 | 1
    return [(a + i * b) % bits for i in range(BLOOM_PROBES)]


class Writer:
    """Writes entries in ascending key order; repeated keys are allowed and stay in order."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.block, self.last, self.index, self.keys = bytearray(), b"", [], []
        self.entries = self.ids = 0

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.block:
            if key < self.last:
                raise ValueError("keys must ascend")
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.entries += 1
        self.ids += len(value) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self._end_block()

    def _end_block(self) -> None:
        if self.block:
            data = bytes(self.block) + struct.pack("<I", zlib.crc32(self.block))
            self.index.append((self.last, self.at, len(data)))
            self.out.write(data)
            self.at += len(data)
            self.block.clear()

    def close(self) -> None:
        self._end_block()
        index = b"".join(_varint(len(k)) + k + struct.pack("<QI", at, n) for k, at, n in self.index)
        bits = max(64, len(self.keys) * BLOOM_BITS)
        bloom = np.zeros((bits + 7) // 8, np.uint8)
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        filter_ = struct.pack("<Q", bits) + bloom.tobytes()
        self.out.write(index)
        self.out.write(filter_)
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(filter_), self.entries, self.ids, self.width, MAGIC))


class Reader:
    """Reads a shard from a seekable binary file."""

    def __init__(self, file):
        self.file = file
        end = file.seek(0, io.SEEK_END)
        footer = self._at(end - FOOTER.size, FOOTER.size)
        at, n, fat, fn, self.entries, self.ids, self.width, magic = FOOTER.unpack(footer)
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        data, here = self._at(at, n), 0
        self.last_keys, self.blocks = [], []
        while here < n:
            size, here = _read_varint(data, here)
            self.last_keys.append(data[here : here + size])
            self.blocks.append(struct.unpack_from("<QI", data, here + size))
            here += size + 12
        filter_ = self._at(fat, fn)
        self.bits, self.bloom = struct.unpack_from("<Q", filter_)[0], filter_[8:]

    def _at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        at, n = self.blocks[i]
        data = self._at(at, n)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError(f"block {i} is damaged")
        here, key, end = 0, b"", n - 4
        while here < end:
            shared, here = _read_varint(data, here)
            more, here = _read_varint(data, here)
            size, here = _read_varint(data, here)
            key = key[:shared] + data[here : here + more]
            here += more
            yield key, data[here : here + size]
            here += size

    def may_have(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits))

    def get(self, key: bytes) -> list[bytes]:
        """The values of a key, in order."""
        if not self.may_have(key):
            return []
        out: list[bytes] = []
        for i in range(bisect.bisect_left(self.last_keys, key), len(self.blocks)):
            found = [v for k, v in self._block(i) if k == key]
            out += found
            if self.last_keys[i] > key or not found:
                break
        return out

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.blocks)):
            yield from self._block(i)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


class ChunkIds(dict):
    """Id bytes of white-space-free chunks, remembered up to a bound."""

    BOUND = 1_200_000
    #: Never within one match with an ASCII letter or digit before them. Others may decompose when
    #: the tokenizer normalises, and their last mark then stands in one match with what follows.
    TAIL = ".,;:!?%&$#*"

    def __init__(self, tokenizer: Tokenizer, dtype: str):
        self.tokenizer, self.dtype = tokenizer, dtype
        self.folds = tokenizer.normalizer is not None and tokenizer.normalizer.normalize_str("Aa") == "aa"

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.BOUND:
            self.clear()
        core = chunk.rstrip(self.TAIL)
        if core and core != chunk and core[-1].isascii() and core[-1].isalnum():
            value = self[core] + self[chunk[len(core) :]]
        elif chunk.isascii() and chunk.isalpha() and not chunk.islower() and self.folds:
            value = self[chunk.lower()]
        else:
            value = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, self.dtype).tobytes()
        self[chunk] = value
        return value

    def of(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def encoder(tokenizer_json: str, width: int, drops_blanks: bool) -> Callable[[str], bytes]:
    """text -> id bytes by the tokenizers library.

    `drops_blanks`: the tokenizer's pre-tokenizer drops white space and cuts there, so a
    text's ids are those of its chunks between blanks and line feeds, which are remembered.
    """
    dtype = f"<u{width}"
    if drops_blanks:
        name = f"chunks {xxhash.xxh3_64_hexdigest(tokenizer_json.encode())} {dtype}"
        return held(name, lambda: ChunkIds(Tokenizer.from_str(tokenizer_json), dtype)).of
    tokenizer = Tokenizer.from_str(tokenizer_json)
    return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype).tobytes()


def write_shards(docs: DataFrame, where: str, tokenizer: Broadcast, end_id: int, width: int = 2, drops_blanks: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every document and write shards under `where`; returns the manifest (one row a shard).

    Documents are range-partitioned by id and a hash of the text, so the shards' key ranges
    ascend and meet at most where rows repeat an id; such rows are ordered by that hash and
    the text, and many of them (or null ids) lie in several shards. A null id comes first; a null text counts as empty and holds the end id alone. `width`: bytes an id
    (2 or 4). A task writes a file of its own name, and only files that the manifest
    names count, so a task that runs again does no harm. Other columns are not read.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer.value, width, drops_blanks)
        end = end_id.to_bytes(width, "little")
        out = writer = None
        first = last = None
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if writer is None:
                    fs, folder = open_fs(where)
                    name = f"{uuid.uuid4().hex}.sst"
                    fs.create_dir(folder, recursive=True)
                    out = fs.open_output_stream(f"{folder}/{name}")
                    writer, first = Writer(out, width), key_of(doc_id)
                writer.add(key_of(doc_id), ids_of(text or "") + end)
                last = doc_id
        if writer:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "first_id": [id_of(first)], "last_id": [last], "n_docs": [writer.entries], "n_tokens": [writer.ids]}, schema=pa.schema([("file", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    ranged = docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text_").withColumn("by_text", F.xxhash64("text_")).repartitionByRange("doc_id", "by_text").sortWithinPartitions("doc_id", "by_text", "text_").drop("by_text")
    return materialize(ranged.mapInArrow(run, "file string, first_id long, last_id long, n_docs long, n_tokens long"), f"{where}/manifest")


def read_shards(manifest: DataFrame, where: str) -> DataFrame:
    """Every document of the shards: doc_id, start, n_tokens, ids_crc32, file.

    start: ids of all documents before it, in key order. The manifest has one row a
    shard, so its running total is formed on the driver.
    """
    spark = manifest.sparkSession
    shards = sorted(manifest.collect(), key=lambda r: (key_of(r.first_id), key_of(r.last_id), r.file))
    listed, at = [], 0
    for r in shards:
        listed.append((r.file, at))
        at += r.n_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, folder = open_fs(where)
                ids, starts, counts, crcs = [], [], [], []
                with fs.open_input_file(f"{folder}/{name}") as f:
                    table = Reader(f)
                    for key, value in table.scan():
                        wide = value if table.width == 4 else np.frombuffer(value, f"<u{table.width}").astype("<u4").tobytes()
                        ids.append(id_of(key))
                        starts.append(start)
                        counts.append(len(wide) // 4)
                        crcs.append(zlib.crc32(wide))
                        start += counts[-1]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64()), pa.array([name] * len(ids), pa.string())], names=["doc_id", "start", "n_tokens", "ids_crc32", "file"])

    listing = spark.createDataFrame(listed, "file string, start long").repartition(max(1, len(listed)))
    return listing.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, file string")


def lookup(manifest: DataFrame, where: str, doc_id: int | None) -> list[list[int]]:
    """The ids of one document, by binary search: manifest, then index, then one block."""
    m = manifest.filter(F.lit(doc_id).isNull() if doc_id is None else (F.coalesce("first_id", F.lit(-(2**63))) <= doc_id) & (F.col("last_id") >= doc_id))
    out = []
    for r in sorted(m.collect(), key=lambda r: (key_of(r.first_id), key_of(r.last_id), r.file)):
        fs, folder = open_fs(where)
        with fs.open_input_file(f"{folder}/{r.file}") as f:
            table = Reader(f)
            out += [np.frombuffer(v, f"<u{table.width}").tolist() for v in table.get(key_of(doc_id))]
    return out


def token_shards(docs: DataFrame, tokenizer: Broadcast, end_id: int, **options) -> DataFrame:
    """Write the shards to a new folder of the shared one and read them all back."""
    where = scratch(docs.sparkSession, "sst")
    return read_shards(write_shards(docs, where, tokenizer, end_id, **options), where)
