"""Token ids in binary files: fixed-width bit packing with block offsets.

A file is a row of blocks and an index, in ascending doc_id order; files follow each other by the two numbers in their
names, that of the partition and that of the file in it:

* block: the ids of up to ``BLOCK_IDS`` tokens, each in the least bits that hold every id of the vocabulary, lowest
  bit first, then zero bits up to the next byte, then one line feed;
* index block: per document doc_id (8 bytes signed, the lowest number for null), start in the file (8), tokens (8);
  then one line feed;
* footer: magic, bits, ids per block, tokens, documents and the index's place, each 8 bytes; then one line feed.

Block k starts at ``k * (BLOCK_IDS * bits / 8 + 1)``: any token is found by a division, and a run of tokens is
unpacked by numpy without touching the rest.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import checkpointed, parts_for, read_raw, text_or_empty, write_raw
from tidemark.llm.word_ids import word_ids

MAGIC = 0x3153444942  # "BIDS1" as a number
BLOCK_IDS = 1 << 16
NO_ID = -(1 << 63)
FOOTER = "<6q"


def bits_for(vocabulary: int) -> int:
    """The least bits that hold the ids 0 to ``vocabulary - 1``."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Lowest bit first. Widths of whole machine words are the same bytes as a plain array."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flat = (ids.astype("<u4")[:, None] >> np.arange(bits, dtype="<u4")) & 1
    return np.packbits(flat.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack_bits(data: bytes | memoryview, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype("<u4")
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return (flat.astype("<u4") << np.arange(bits, dtype="<u4")).sum(axis=1, dtype="<u4")


class TokenFile:
    """Random access to a file's content."""

    def __init__(self, content: bytes | memoryview):
        self.view = memoryview(content)
        magic, self.bits, self.block_ids, self.tokens, self.documents, at = struct.unpack_from(FOOTER, self.view, len(self.view) - struct.calcsize(FOOTER) - 1)
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.index = np.frombuffer(self.view, "<i8", 3 * self.documents, at).reshape(-1, 3)

    def block(self, k: int) -> np.ndarray:
        count = min(self.block_ids, self.tokens - k * self.block_ids)
        step = self.block_ids * self.bits // 8 + 1
        return unpack_bits(self.view[k * step : k * step + -(-count * self.bits // 8)], self.bits, count)

    def ids(self, start: int, count: int) -> np.ndarray:
        """The ``count`` ids from place ``start``; only their blocks are unpacked."""
        if not count:
            return np.zeros(0, "<u4")
        first, last = start // self.block_ids, (start + count - 1) // self.block_ids
        some = self.block(first) if first == last else np.concatenate([self.block(k) for k in range(first, last + 1)])
        return some[start - first * self.block_ids :][:count]

    def blocks(self) -> Iterator[np.ndarray]:
        for k in range(-(-self.tokens // self.block_ids)):
            yield self.block(k)


def _encode(tokenizer_path: str, end_id: int, bits: int, file_ids: int):
    """A partition's files, one per row and without their last byte, the line feed that the writer adds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = word_ids(tokenizer_path, spaced=True), end_id.to_bytes(4, "little")
        index, tokens, blocks, waiting, size = [], 0, [], [], 0

        def packed(data: bytes | memoryview) -> bytes:
            some = np.frombuffer(data, "<u4")
            if len(some) and int(some.max()) >> bits:
                raise ValueError(f"an id needs more than {bits} bits")
            return pack_bits(some, bits)

        def file() -> pa.RecordBatch:
            place = len(blocks) * (BLOCK_IDS * bits // 8 + 1)
            last = packed(b"".join(waiting))
            place += len(last) + 1 if last else 0
            parts = [*blocks, *([last] if last else []), np.array(index, "<i8").tobytes(), struct.pack(FOOTER, MAGIC, bits, BLOCK_IDS, tokens, len(index), place)]
            return pa.RecordBatch.from_arrays([pa.array([b"\n".join(parts)], pa.binary())], ["bytes"])

        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), ids.many(batch.column(1))):
                data += end
                index.append((NO_ID if name is None else name, tokens, len(data) // 4))
                tokens += len(data) // 4
                waiting.append(data)
                size += len(data)
                if size >= 4 * BLOCK_IDS:
                    joined = memoryview(b"".join(waiting))
                    whole = size // (4 * BLOCK_IDS) * 4 * BLOCK_IDS
                    blocks += [packed(joined[at : at + 4 * BLOCK_IDS]) for at in range(0, whole, 4 * BLOCK_IDS)]
                    waiting, size = [bytes(joined[whole:])], size - whole
                if tokens >= file_ids:
                    yield file()
                    index, tokens, blocks, waiting, size = [], 0, [], [], 0
        if index:
            yield file()

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, vocabulary: int, end_id: int = 0, part_chars: int = 24_000_000, file_ids: int = 1 << 23) -> None:
    """Writes the ids of every whole text of ``docs`` (doc_id, text) and ``end_id`` after each.

    Documents are dealt out by ranges of doc_id and of a hash of their texts, about ``part_chars`` characters a task,
    so ascending order needs no single task, nor do many rows of one doc_id. A file is closed when it has ``file_ids``
    ids, so it is larger by one document at most. A null text is an empty one. A null doc_id comes first; equal doc_ids
    follow each other in the order of that hash, then of their texts, so repeated rows give the same files in any run.
    An empty table gives no file. Other columns are ignored. An id that the vocabulary's bits can't hold is an error.
    """
    text = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash"))
    parts = parts_for(rows.agg(F.coalesce(F.sum(F.length("text") + 1), F.lit(0))).first()[0], part_chars)
    ordered = rows.repartitionByRange(parts, "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")
    write_raw(ordered.mapInArrow(_encode(tokenizer_path, end_id, bits_for(vocabulary), file_ids), "bytes binary"), "bytes", "\n", path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            if not (data := content.as_buffer()).size:
                continue
            file = TokenFile(memoryview(data))
            crcs, at, k, block = [], 0, -1, None
            for _, start, count in file.index.tolist():
                crc = 0
                while count:
                    if start // file.block_ids != k:
                        k = start // file.block_ids
                        block = file.block(k)
                    some = block[start - k * file.block_ids :][:count]
                    crc = zlib.crc32(some.tobytes(), crc)
                    start, count = start + len(some), count - len(some)
                crcs.append(crc)
            names = [None if x == NO_ID else x for x in file.index[:, 0].tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([path.as_py()] * len(names)), pa.array(names, pa.int64()), pa.array(file.index[:, 1]), pa.array(file.index[:, 2]), pa.array(crcs, pa.int64())],
                ["file", "doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: file, doc_id, start (in all files), n_tokens, ids_crc32.

    A file's first place in the whole is the sum of the files before it, by the numbers in their names: one row per
    file goes through one task. A folder without files gives no rows; null doc_ids come back as null, repeated ones as
    often as they were written. A file that isn't one of these fails the read.
    """
    content = read_raw(spark, path).select("path", "content")
    found = checkpointed(content.mapInArrow(_documents, "file string, doc_id long, start long, n_tokens long, ids_crc32 long"))
    number = lambda pattern: F.regexp_extract("file", pattern, 1).cast("long")
    sums = found.groupBy("file").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy(number(r"part-(\d+)-[^/]*$"), number(r"-c(\d+)[^/-]*$")).rowsBetween(Window.unboundedPreceding, -1)
    first = sums.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("first"))
    return found.join(first, "file").select("doc_id", (F.col("first") + F.col("start")).alias("start"), "n_tokens", "ids_crc32", "file")
