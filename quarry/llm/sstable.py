"""Token ids of documents in sorted-string-table shards.

A shard file holds documents in ascending order of id:

* data blocks: entries (shared key bytes, new key bytes, value length, key
  suffix, value), prefix-compressed against the key before, the whole block
  compressed by zstd;
* a sparse index: the first key, place and raw length of each block;
* a Bloom filter over the keys;
* a fixed footer with the places of index and filter, counts and a magic word.

A key is one byte (0 for a null id) and the id, big-endian with its sign bit
turned, so that keys sort as ids.  A value is the document's ids as little-endian
integers of 2 or 4 bytes.  Look-up asks the filter, then searches the index by
bisection and scans one block.

Each task writes files under names of its own; the manifest, a Parquet table
that Spark commits, names those of the attempts that succeeded.  A lost
executor therefore leaves at most files that no manifest names.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.arrow_map import bounded_batches, slices
from quarry.llm.ranges import MOST_RANGES, range_of, splitters, weighted_sample
from quarry.llm.storage import scratch, text_or_empty
from quarry.llm.tokens import pieces_for, with_end

MAGIC = b"QSSTBL01"
FOOTER = struct.Struct("<QQQQQQII8s")
BLOCK_BYTES = 256 << 10
BLOOM_BITS, BLOOM_HASHES = 10, 7
#: Text bytes of a shard, about.
SHARD_BYTES = 16 << 20
MANIFEST = "part int, file string, first_id long, last_id long, n_docs long, n_tokens long, n_bytes long"


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:], "big") - (1 << 63) if key[0] else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        at += 1
        n |= (byte & 127) << shift
        if byte < 128:
            return n, at
        shift += 7


def bloom_places(key: bytes, bits: int) -> Iterator[int]:
    a, b = zlib.crc32(key), zlib.adler32(key) * 0x9E3779B1 & 0xFFFFFFFF | 1
    return ((a + k * b + k * k) % bits for k in range(BLOOM_HASHES))


class Writer:
    """Writes one shard to an output stream; keys must come in order."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.block, self.size, self.last = [], 0, b""
        self.index: list[tuple[bytes, int, int, int]] = []
        self.first = b""
        self.keys: list[bytes] = []
        self.tokens = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        if self.block:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        value = ids.astype(f"<u{self.width}").tobytes()
        entry = varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.block.append(entry)
        self.size += len(entry)
        self.last = key
        self.keys.append(key)
        self.tokens += len(ids)
        if self.size >= BLOCK_BYTES:
            self.end_block()

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def end_block(self) -> None:
        if self.block:
            raw = b"".join(self.block)
            packed = pa.compress(raw, codec="zstd", asbytes=True)
            self.index.append((self.first, self.at, len(packed), len(raw)))
            self.write(packed)
            self.block, self.size = [], 0

    def close(self) -> None:
        self.end_block()
        index_at = self.at
        self.write(b"".join(k + struct.pack("<QII", *place) for k, *place in self.index))
        bloom_at, bits = self.at, max(64, BLOOM_BITS * len(self.keys))
        bloom = bytearray((bits + 7) // 8)
        for key in self.keys:
            for p in bloom_places(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        self.write(bytes(bloom))
        self.write(FOOTER.pack(index_at, len(self.index), bloom_at, bits, len(self.keys), self.tokens, self.width, 0, MAGIC))
        self.out.close()


class Reader:
    """Reads one shard from a file that can seek."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        tail = self.part(size - FOOTER.size, FOOTER.size)
        self.index_at, blocks, self.bloom_at, self.bits, self.n_docs, self.n_tokens, self.width, _, magic = FOOTER.unpack(tail)
        if magic != MAGIC:
            raise ValueError("not a shard of sorted token ids")
        entry = 9 + struct.calcsize("<QII")
        raw = self.part(self.index_at, blocks * entry)
        self.index = [(raw[i : i + 9], *struct.unpack_from("<QII", raw, i + 9)) for i in range(0, len(raw), entry)]
        self.bloom = None

    def part(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def entries(self, n: int) -> Iterator[tuple[bytes, np.ndarray]]:
        """(key, ids) of block ``n``."""
        _, at, packed, raw = self.index[n]
        data = pa.decompress(self.part(at, packed), decompressed_size=raw, codec="zstd", asbytes=True)
        place, key = 0, b""
        while place < len(data):
            shared, place = read_varint(data, place)
            new, place = read_varint(data, place)
            size, place = read_varint(data, place)
            key = key[:shared] + data[place : place + new]
            place += new
            yield key, np.frombuffer(data, f"<u{self.width}", size // self.width, place)
            place += size

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for n in range(len(self.index)):
            yield from self.entries(n)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of each document under ``doc_id``; more than one only if rows repeat it."""
        key = key_of(doc_id)
        if self.bloom is None:
            self.bloom = self.part(self.bloom_at, (self.bits + 7) // 8)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in bloom_places(key, self.bits)):
            return []
        firsts = [e[0] for e in self.index]
        low = max(0, bisect.bisect_left(firsts, key) - 1)
        high = bisect.bisect_right(firsts, key)
        return [ids.copy() for n in range(low, high) for k, ids in self.entries(n) if k == key]


def write_tokens(
    docs: DataFrame,
    tokenizer: str,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    end_id: int = 2,
    shard_bytes: int = SHARD_BYTES,
    special_tokens: bool = False,
) -> DataFrame:
    """Write all documents as shards below ``folder`` (a URI) and return the manifest.

    ``tokenizer`` is the content of a tokenizers JSON file.  Shards cover ranges
    of ids from weighted samples, so each holds about ``shard_bytes`` of text, or more
    where that would be over MOST_RANGES shards; one id's rows stay in one shard.  Null ids come first; null and empty texts are
    ``end_id`` alone; repeated rows are entries of their own.  With ``special_tokens``
    the string of a special token in a text is that token, otherwise ordinary
    text.  An empty table gives an empty manifest.  Very long texts are encoded whole;
    other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    sized = base.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("place"), (F.octet_length("text") + 1).alias("size"))
    total = sized.agg(F.sum("size")).first()[0] or 0
    parts = max(1, -(-total // shard_bytes), min(spark.sparkContext.defaultParallelism, total // (1 << 20)))
    parts = min(parts, MOST_RANGES)
    bounds = splitters(weighted_sample(sized, ["place"], "size", 32 * parts), parts)
    placed = base.withColumn("part", range_of([F.coalesce("doc_id", F.lit(-(1 << 63)))], bounds))
    ordered = placed.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", "doc_id", "text")
    sent = spark.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pieces_for(sent.value, special_tokens)
        top = max(end_id, encoder.tokenizer.get_vocab_size(with_added_tokens=True) - 1)
        width = 2 if top < 1 << 16 else 4
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        writer, part, name = None, None, ""

        def finish() -> pa.RecordBatch:
            writer.close()
            row = (part, name, id_of(writer.keys[0]), id_of(writer.keys[-1]), len(writer.keys), writer.tokens, writer.at)
            kinds = [pa.int32(), pa.string(), *[pa.int64()] * 5]
            names = [c.split()[0] for c in MANIFEST.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)

        for batch in batches:
            for piece in slices(batch, 4 << 20):
                ids, texts, parts_ = (piece.column(k) for k in (0, 1, 2))
                tokens, starts = with_end(*encoder.encode_column(texts), end_id)
                places = zip(ids.to_pylist(), parts_.to_pylist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True)
                for doc_id, p, start, stop in places:
                    if p != part:
                        if writer is not None:
                            yield finish()
                        part, name = p, f"shard-{p:07d}-{uuid.uuid4().hex}.sst"
                        writer = Writer(store.open_output_stream(f"{root}/{name}"), width)
                    writer.add(key_of(doc_id), tokens[start:stop])
        if writer is not None:
            yield finish()

    bounded_batches(spark)
    ordered.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_tokens(spark: SparkSession, folder: str, *, with_ids: bool = False) -> DataFrame:
    """Read all shards back: (doc_id, start, n_tokens, ids_crc32[, ids]) per document.

    ``start`` counts the ids of all documents before it in the order of the files.
    """
    shards = manifest(spark, folder)
    # A row per shard, each tens of MB of text: small whatever the corpus.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    listed = shards.select("part", "file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))
    rows = shards.count()
    dealt = listed.repartitionById(max(1, rows), "part")
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                start = row["start"]
                with store.open_input_file(f"{root}/{row['file']}") as source:
                    shard = Reader(source)
                    for n in range(len(shard.index)):
                        out = []
                        for key, ids in shard.entries(n):
                            wide = ids.astype("<u4")
                            out.append((id_of(key), start, len(ids), zlib.crc32(wide.tobytes()), wide.astype("i4")))
                            start += len(ids)
                        columns = list(zip(*out, strict=True))
                        arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=False)]
                        yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return dealt.mapInArrow(run, schema)


def look_up(spark: SparkSession, folder: str, doc_id: int) -> list[list[int]]:
    """Ids of one document by its identifier, from the shard that can hold it."""
    store, root = fs.FileSystem.from_uri(folder)
    may = manifest(spark, folder).filter(F.lit(doc_id).between(F.coalesce("first_id", F.lit(-(1 << 63))), F.col("last_id")))
    out = []
    for row in may.select("file").collect():  # ranges don't overlap: one shard
        with store.open_input_file(f"{root}/{row.file}") as source:
            out += [ids.tolist() for ids in Reader(source).get(doc_id)]
    return out


def tokens_through_files(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write ``docs`` to shards in the shared folder and read them back; see read_tokens()."""
    spark = docs.sparkSession
    folder = scratch(spark, "tokens")
    write_tokens(docs, tokenizer, folder, **options)
    return read_tokens(spark, folder)
