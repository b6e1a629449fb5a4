"""Exact deduplication by recipes of content-defined chunks.

1. Every text, without white space, is cut where a rolling hash of its last 32 bytes says so, so equal passages give
   equal chunks wherever they stand. A chunk's name is a hash of its bytes.
2. Each chunk's bytes move once, to be deduplicated by value. Where two different chunks have one name, a number is
   put after it: names become verified identifiers.
3. A document's recipe is its list of identifiers in order. Equal recipes are equal texts; from here on only recipes
   move, 16 bytes a chunk, however long the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import checkpointed, join_groups, text_or_empty

#: White space that the comparison ignores.
IGNORED = b" \t\n\x0b\x0c\r"
SMALLEST, MEAN_BITS, LARGEST = 512, 11, 16_384
WINDOW = 32
#: A number for each byte value, from a rule.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 7) for b in range(256)], np.uint32)
SCHEMA = "uid long, doc_id long, text_hash long, n_chars long, text_sha256 string, names array<binary>"


def name_of(chunk: bytes) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


def cut_points(data: bytes) -> list[int]:
    """Where chunks end. The hash at a byte is the sum of the numbers of the last 32 bytes, each shifted by its age."""
    ends, at, n = [], 0, len(data)
    if n <= SMALLEST:
        return [n] if n else []
    # in stretches, so that a very long text needs little memory beside itself
    marks, stretch = [], 1 << 20
    for begin in range(0, n, stretch):
        own = np.frombuffer(data, np.uint8, min(stretch, n - begin) + min(begin, WINDOW - 1), begin - min(begin, WINDOW - 1))
        h, span = GEAR[own], 1
        while span < WINDOW:  # of twice as many bytes each time
            h[span:] += h[:-span] << np.uint32(span)
            span *= 2
        marks.append(np.flatnonzero(h[min(begin, WINDOW - 1) :] >> np.uint32(32 - MEAN_BITS) == 0) + begin + 1)
    for mark in np.concatenate(marks).tolist():
        while mark - at > LARGEST:
            at += LARGEST
            ends.append(at)
        if mark - at >= SMALLEST:
            at = mark
            ends.append(at)
    while n - at > LARGEST:
        at += LARGEST
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def _chunked(batches: Iterator[pa.RecordBatch], name: Callable[[bytes], bytes]) -> Iterator[tuple]:
    for batch in batches:
        uids, ids = batch.column("uid").to_pylist(), batch.column("doc_id").to_pylist()
        for i, text in enumerate(batch.column("text").to_pylist()):
            data = text.encode().translate(None, IGNORED)
            ends = cut_points(data)
            chunks = [data[a:b] for a, b in zip([0, *ends], ends)]
            yield uids[i], ids[i], len(text), data, chunks, [name(c) for c in chunks]


def _recipes(name: Callable[[bytes], bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n_chars, hashlib.sha256(data).hexdigest(), names) for _, _, n_chars, data, _, names in _chunked(iter([batch]), name)]
            if rows:
                n_chars, digests, names = zip(*rows)
                own = [batch.column(c) for c in ("uid", "doc_id", "text_hash")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n_chars, pa.int64()), pa.array(digests), pa.array(names, pa.list_(pa.binary()))], ["uid", "doc_id", "text_hash", "n_chars", "text_sha256", "names"])

    return run


def _chunks(name: Callable[[bytes], bytes]):
    """Each of a partition's chunks with its name; those just seen in this batch of rows are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        names_out, chunks_out, size = [], [], 0
        for _, _, _, _, chunks, names in _chunked(batches, name):
            for key, chunk in zip(names, chunks):
                if chunk not in seen:
                    seen.add(chunk)
                    names_out.append(key)
                    chunks_out.append(chunk)
                    size += len(chunk)
                if size > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(names_out, pa.binary()), pa.array(chunks_out, pa.binary())], ["name", "chunk"])
                    names_out, chunks_out, size = [], [], 0
                    seen.clear()
        if names_out:
            yield pa.RecordBatch.from_arrays([pa.array(names_out, pa.binary()), pa.array(chunks_out, pa.binary())], ["name", "chunk"])

    return run


def _verified(rows: DataFrame, recipes: DataFrame, name: Callable[[bytes], bytes]) -> DataFrame:
    """Recipes in which no identifier stands for two different chunks."""
    distinct = rows.select("uid", "doc_id", "text").mapInArrow(_chunks(name), "name binary, chunk binary").groupBy("name", "chunk").count()
    shared = distinct.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1").select("name")
    if not shared.count():  # nothing to keep: a checkpoint would be an empty file for each partition
        return recipes.withColumn("recipe", F.col("names"))
    shared = checkpointed(shared)
    # rare: texts with such a chunk get identifiers anew, from the chunks' bytes; a text is told by its two hashes, as
    # the rows are read again
    numbers = distinct.join(shared, "name", "left_semi").withColumn("number", F.row_number().over(Window.partitionBy("name").orderBy("chunk")))
    places = recipes.select("text_hash", "text_sha256", F.explode("names").alias("name"))
    affected = places.join(shared, "name", "left_semi").select("text_hash", "text_sha256").distinct()

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uid, _, _, data, chunks, names in _chunked(batches, name):
            n, digest = len(names), hashlib.sha256(data).hexdigest()
            columns = [pa.array([uid] * n, pa.int64()), pa.array([digest] * n), pa.array(range(n), pa.int32()), pa.array(names, pa.binary()), pa.array(chunks, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["text_hash", "text_sha256", "at", "name", "chunk"])

    some = rows.join(affected.select("text_hash").distinct(), "text_hash", "left_semi").dropDuplicates(["text_hash", "text"])
    parts = some.select(F.col("text_hash").alias("uid"), "doc_id", "text").mapInArrow(contents, "text_hash long, text_sha256 string, at int, name binary, chunk binary")
    parts = parts.join(numbers.select("name", "chunk", "number"), ["name", "chunk"], "left")
    named = F.when(F.col("number") > 1, F.concat("name", F.encode(F.col("number").cast("string"), "utf-8"))).otherwise(F.col("name"))
    listed = F.array_sort(F.collect_set(F.struct("at", named.alias("id"))))
    anew = parts.groupBy("text_hash", "text_sha256").agg(F.transform(listed, lambda x: x["id"]).alias("anew"))
    return recipes.join(anew, ["text_hash", "text_sha256"], "left").withColumn("recipe", F.coalesce("anew", "names")).drop("anew")


def dedup_exact(docs: DataFrame, name: Callable[[bytes], bytes] = name_of) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, the number of
    chunks and text_hash (xxhash64 of the text as it is).

    Texts are equal when identical without white space; a null text is an empty one. Of equal texts the row with the
    most code points in its text stays, then that with the smallest doc_id (null last), then the first of repeated
    rows, so exactly one. An empty table gives no rows. Other columns are ignored.

    ``name`` names a chunk; however bad a hash it is, only equal texts get equal recipes. A group of equal texts,
    however large, is one row of an aggregate that is combined before the shuffle; the rows of large groups then stay
    where they are and get that row by a broadcast.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), text_or_empty().alias("text"))
    recipes = checkpointed(rows.mapInArrow(_recipes(name), SCHEMA))
    found = _verified(rows, recipes, name).withColumn("recipe", F.array_join(F.transform("recipe", F.hex), ",")).withColumn("n_chunks", F.size("names")).drop("names")
    best = F.min(F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.col("doc_id").alias("id"), F.col("uid").alias("row")))
    groups = found.groupBy("recipe").agg(best.alias("best"), F.count("*").alias("group_size"))  # of recipes only: cheaper than files
    out = join_groups(found, groups, "recipe", "group_size")
    return out.select("doc_id", F.col("best.id").alias("keep_id"), "group_size", (F.col("uid") == F.col("best.row")).alias("kept"), "text_sha256", "n_chunks", "text_hash")
