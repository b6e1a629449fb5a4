"""Best-fit packing of documents into sequences of a fixed length, by hierarchical residual packing.

1. Every partition tokenises its documents, cuts those above the length into pieces and packs the pieces best-fit,
   longest first, into bins.
2. Bins that are full but for a small rest are done. The others are items of the next round: they are dealt to fewer
   partitions and packed best-fit again, as wholes, until a round has one partition or joins hardly anything.

A round's rows are bins (two numbers each), not texts. A task never gets more than about ``bins_per_task`` bins, so
the last round is several tasks where many bins stay half full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import checkpointed, text_or_empty
from tidemark.llm.word_ids import word_ids

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long"


def _bin(step: int, part: int, number: int) -> int:
    """A bin's number that no other round, partition or bin has: 5, 25 and 33 bits."""
    return step << 58 | part << 33 | number


def best_fit(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """For each item, in the given order: the number of its bin and its offset there.

    An item goes where it leaves the smallest rest; of equal rests, to the bin that got it last. The rests at hand are
    the set bits of one integer, so the smallest that is large enough is found in a step.
    """
    by_rest: dict[int, list[int]] = {}
    at_hand, placed, bins = 0, [], 0
    for n in lengths:
        above = at_hand >> n
        if above:
            rest = n + ((above & -above).bit_length() - 1)
            stack = by_rest[rest]
            b = stack.pop()
            if not stack:
                at_hand &= ~(1 << rest)
        else:
            rest, b = capacity, bins
            bins += 1
        placed.append((b, capacity - rest))
        if (left := rest - n) > 0:
            by_rest.setdefault(left, []).append(b)
            at_hand |= 1 << left
    return placed


def _pieces(tokenizer_path: str, end_id: int, capacity: int):
    """A partition's documents as pieces in bins of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(tokenizer_path, spaced=False)
        end, part, rows = end_id.to_bytes(4, "little"), None, []
        for batch in batches:
            part = batch.column(2)[0].as_py() if batch.num_rows and part is None else part
            for name, data in zip(batch.column(0).to_pylist(), ids.many(batch.column(1))):
                data += end
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    one = data[at : at + 4 * capacity]
                    rows.append((name, piece, at // 4, len(one) // 4, zlib.crc32(one)))
        rows.sort(key=lambda r: -r[3])
        placed = best_fit([r[3] for r in rows], capacity)
        for at in range(0, len(rows), 10_000):
            some = list(zip(*rows[at : at + 10_000]))
            where = placed[at : at + 10_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some[0], pa.int64()), pa.array(some[1], pa.int32()), *(pa.array(c, pa.int64()) for c in some[2:]), pa.array([_bin(0, part, b) for b, _ in where], pa.int64()), pa.array([o for _, o in where], pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset"],
            )

    return run


def _repack(capacity: int, step: int):
    """Bins of a partition as items: where each goes, with the new bin's fill."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, part = [], None
        for batch in batches:
            names, fills, parts = (batch.column(i).to_pylist() for i in range(3))
            part = parts[0] if parts and part is None else part
            rows += zip(names, fills)
        rows.sort(key=lambda r: (-r[1], r[0]))
        placed = best_fit([r[1] for r in rows], capacity)
        fill: dict[int, int] = {}
        for (_, n), (b, _) in zip(rows, placed):
            fill[b] = fill.get(b, 0) + n
        for at in range(0, len(rows), 10_000):
            some, where = rows[at : at + 10_000], placed[at : at + 10_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in some], pa.int64()), pa.array([_bin(step, part, b) for b, _ in where], pa.int64()), pa.array([o for _, o in where], pa.int64()), pa.array([fill[b] for b, _ in where], pa.int64())],
                ["bin", "into", "shift", "fill"],
            )

    return run


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, nearly_full: int = 16, bins_per_task: int = 200_000, fan_in: int = 8, most_rounds: int = 6
) -> DataFrame:
    """Places every token of ``docs`` (doc_id, text) in sequences of at most ``capacity`` tokens.

    A document's tokens are its text's ids and ``end_id``; only documents of more than ``capacity`` tokens are cut,
    into pieces of that length, the last possibly shorter. Returns per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset.

    A null text is an empty one and gives a piece of one token. Null and repeated doc_ids are documents of their own;
    equal rows are packed as often as they come. An empty table gives no rows. Other columns are ignored, whatever
    their names. Ties between bins don't change how many sequences come out.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"), F.spark_partition_id().alias("part"))
    pieces = checkpointed(rows.mapInArrow(_pieces(tokenizer_path, end_id, capacity), PIECES))
    bins = pieces.groupBy("bin").agg(F.sum("length").alias("fill"))
    # `moved` has, for every bin that a round took on: the bin it is part of now, and how far in
    moved, waiting = None, checkpointed(bins.filter(F.col("fill") < capacity - nearly_full))
    n, parts = waiting.count(), waiting.rdd.getNumPartitions()
    for step in range(most_rounds):
        if not n:
            break
        parts = max(-(-n // bins_per_task), parts // fan_in, 1)
        dealt = waiting.repartition(parts, F.xxhash64("bin", F.lit(step))).withColumn("part", F.spark_partition_id())
        placed = checkpointed(dealt.mapInArrow(_repack(capacity, step + 1), "bin long, into long, shift long, fill long"))
        if moved is None:
            moved = placed.select("bin", "into", "shift")
        else:
            onward = placed.select(F.col("bin").alias("into"), F.col("into").alias("next"), F.col("shift").alias("more"))
            moved = moved.join(onward, "into", "left").select("bin", F.coalesce("next", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
        waiting = placed.filter(F.col("fill") < capacity - nearly_full).select(F.col("into").alias("bin"), "fill").distinct()
        left = waiting.count()
        if parts == 1 or left > 0.995 * n and parts <= -(-n // bins_per_task):
            break
        n = left
    if moved is not None:
        pieces = pieces.join(moved, "bin", "left").select(*pieces.drop("bin", "offset").columns, F.coalesce("into", "bin").alias("bin"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
    return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
