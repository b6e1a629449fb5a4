"""SimHash near-duplicates by Golay-code fuzzy hashing.

1. Every document gets its fingerprint of 64 bits; distinct fingerprints go on, with their documents counted in.
2. A fingerprint is three segments of 23, 23 and 18 bits. Of at most three differing bits, two segments have at most
   one each, and only both first segments can need one each. Keys are pairs of codeword indices: a fingerprint stands
   under the pairs of its own indices, and is looked up under all pairs that such an error can lead to.
3. Fingerprints that meet under a key are compared. A key's links are thinned to a spanning forest there, so a large
   group of near copies gives as many links as it has members and not as many as it has pairs.
4. Components are found by alternating large-star and small-star steps over the links, all as joins and aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import golay
from tidemark.llm.shared import checkpointed, join_groups, text_or_empty

SEED = 42
SEGMENTS = ((0, 23), (23, 23), (46, 18))


def fingerprint(text: str, shingle: int = 3) -> int:
    """Lower-cased A-Z, words between white space, word shingles with repeats; a bit is set if in over half of them."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(p, SEED) for p in parts), np.uint64, max(1, len(words) - shingle + 1))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        some = hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t) for t in batch.column(3).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found)], ["uid", "doc_id", "text_hash", "fp"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp, own): under its own pairs of indices with own true, under those of errors with own false.

    A row with own true also answers look-ups, so it isn't repeated.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, 20_000):
            signed = batch.column(0).slice(at, 20_000).to_numpy(zero_copy_only=False)
            fps = signed.view(np.uint64)
            near, many = zip(*(golay.keys((fps >> np.uint64(a)) & np.uint64((1 << n) - 1)) for a, n in SEGMENTS))
            key, of, own = [], [], []
            for pair, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
                for a in range(6):
                    for b in range(6):
                        if pair and a and b:
                            continue  # one error in each of two segments is left to the first pair
                        rows = np.flatnonzero((a < many[i]) & (b < many[j]))
                        key.append(np.int64(pair << 24) | near[i][rows, a].astype(np.int64) << 12 | near[j][rows, b].astype(np.int64))
                        of.append(signed[rows])
                        own.append(np.full(len(rows), not a and not b))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key)), pa.array(np.concatenate(of)), pa.array(np.concatenate(own))], ["key", "fp", "own"])


def forest(fps: np.ndarray, most_bits: int) -> Iterator[tuple[int, int]]:
    """Links of at most ``most_bits`` bits that connect all that such links connect, one fewer than each part's members.

    Whoever is reached isn't compared again, so close groups cost little more than their size.
    """
    left = fps
    while len(left):
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            one = reached.pop()
            near = np.bitwise_count(left ^ one) <= most_bits
            if near.any():
                found, left = left[near], left[~near]
                reached.extend(found)
                for other in found.tolist():
                    yield int(one), other


def _links(most_bits: int):
    """Of a partition's rows sorted by key; only one key's fingerprints are held at a time beside a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def groups(key: np.ndarray, fp: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(starts, len(key)))
            owned = np.add.reduceat(own.astype(np.int64), starts) > 0
            fps = fp.view(np.uint64)
            two = starts[owned & (sizes == 2)]
            two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= most_bits]
            pairs = [np.stack([fps[two], fps[two + 1]], axis=1)]
            more = owned & (sizes > 2)
            for s, n in zip(starts[more].tolist(), sizes[more].tolist()):
                if some := list(forest(fps[s : s + n], most_bits)):
                    pairs.append(np.array(some, np.uint64))
            found = np.concatenate(pairs).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], ["u", "v"])

        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now)]
            if not len(now[0]):
                continue
            cut = int(np.searchsorted(now[0], now[0][-1]))  # the last key may go on in the next batch
            if cut:
                yield groups(*(x[:cut] for x in now))
            rest = [x[cut:].copy() for x in now]
        if rest is not None and len(rest[0]):
            yield groups(*rest)

    return run


def fingerprint_links(distinct: DataFrame, most_bits: int = 3) -> DataFrame:
    """``distinct`` (fp long): links (u, v) that connect all fingerprints which differ in at most ``most_bits`` bits.

    Fingerprints are to be distinct and not null. None give no links. Other columns are ignored.
    """
    if not 0 <= most_bits <= 3:
        raise ValueError("the keys find up to three differing bits")
    keys = distinct.select("fp").mapInArrow(_keys, "key long, fp long, own boolean")
    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(_links(most_bits), "u long, v long")


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, root) for each node of ``links`` (u, v); root is the smallest node of its component.

    Alternates large-star (neighbours above a node go to the smallest neighbour) and small-star (those below it do)
    until nothing changes. A node's neighbours are never gathered: each step is an aggregate and a join. Links may
    repeat and go either way; one of a node with itself, or with a null, is left out. No links give no rows.
    """
    edges = checkpointed(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct())
    before = None
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        edges = checkpointed(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").union(small.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
    raise RuntimeError(f"components not settled after {most_rounds} rounds")


def near_duplicates(docs: DataFrame, most_bits: int = 3) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hexadecimal digits), component_id, first and
    text_hash (xxhash64 of the text as it is).

    component_id is the smallest doc_id of all documents that links reach, directly or by others; ``first`` is true
    for one row of each component. A null text is an empty one; documents without words have fingerprint zero and
    link like any other. A null doc_id counts as above all others; of repeated rows one is first. An empty table
    gives no rows. Other columns are ignored. Rows of one fingerprint, however many, don't go to one task.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), text_or_empty().alias("text"))
    prints = checkpointed(rows.mapInArrow(_fingerprints, "uid long, doc_id long, text_hash long, fp long"))
    links = fingerprint_links(prints.select("fp").distinct(), most_bits)
    root = components(links)
    best = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), F.col("uid").alias("row")))
    by_print = prints.groupBy("fp").agg(best.alias("best"), F.count("*").alias("n"))
    joined = checkpointed(by_print.join(root, by_print["fp"] == root["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), F.col("best").alias("own"), "n"))
    groups = checkpointed(joined.groupBy("root").agg(F.min("own").alias("best"), F.count("*").alias("members")))
    of_print = checkpointed(join_groups(joined, groups, "root", "members").select("fp", "best", "n"))
    return join_groups(prints, of_print, "fp", "n").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("best.id").alias("component_id"), (F.col("uid") == F.col("best.row")).alias("first"), "text_hash"
    )
