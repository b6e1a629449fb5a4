"""Vector search by inverted lists, and links between near vectors.

Centroids are fitted on a bounded sample, every row goes to the list of its nearest centroid, and lists lie in blocks of rows
in the shared folder. A query is put to its nearest lists first. A list's radius bounds what its other rows can score, so a second
round asks only the lists that may still hold one of the first ``k``: results are those of a full scan. Without that round
they are approximate. Queries and rows meet by block; no side is broadcast, and the centroids are a bounded array.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import checkpointed, shipped

#: At most so many lists, and rows in the sample that their centroids are fitted on; rows and bytes from which a group of blocks ends.
MOST_LISTS, SAMPLE, BLOCK = 1024, 20_000, 1024
GROUP, GROUP_BYTES = 8192, 1 << 23


@dataclass
class Lists:
    """``blocks``: list, block, ids, xs (doubles in bytes); ``radius``: per list the largest distance of a row to its centroid."""

    centroids: np.ndarray
    radius: np.ndarray
    blocks: DataFrame


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def fitted_centroids(sample: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """k-means on the sample's rows, from its first ``k``; an empty cluster keeps its centroid."""
    centroids = sample[:k].copy()
    for _ in range(rounds):
        of = _nearest(sample, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, sample)
        n = np.bincount(of, minlength=len(centroids))
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids * centroids).sum(axis=1)[None] - 2.0 * x @ centroids.T).argmin(axis=1)


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(2))
            of = _nearest(x, centroids)
            gap = np.sqrt(((x - centroids[of]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of.astype(np.int32)), pa.array(gap)], ["part", "id", "vector", "list", "gap"])

    return run


def _blocks(size: int):
    """Runs of a sorted partition with equal part and list, ``size`` rows at most together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def row(parts):
            of = parts[0]
            ids = np.concatenate([p.column(1).to_numpy(zero_copy_only=False) for p in parts])
            x, gap = np.concatenate([_matrix(p.column(2)) for p in parts]), np.concatenate([p.column(4).to_numpy(zero_copy_only=False) for p in parts])
            arrays = [of.column(0).slice(0, 1), of.column(3).slice(0, 1), pa.array([gap.max()]), pa.array([ids], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["part", "list", "gap", "ids", "xs"])

        for batch in batches:
            at, part, of = 0, batch.column(0), batch.column(3).to_numpy(zero_copy_only=False)
            code = part.dictionary_encode().indices.to_numpy(zero_copy_only=False) if batch.num_rows else np.zeros(0)
            while at < batch.num_rows:
                if held and (held[0].column(0)[0] != part[at] or held[0].column(3)[0].as_py() != of[at] or sum(h.num_rows for h in held) == size):
                    yield row(held)
                    held = []
                differ = np.flatnonzero((of[at:] != of[at]) | (code[at:] != code[at]))
                end = min(at + (int(differ[0]) if len(differ) else batch.num_rows - at), at + size - sum(h.num_rows for h in held))
                held.append(batch.slice(at, end - at))
                at = end
        if held:
            yield row(held)

    return run


def _in_blocks(rows: DataFrame, lists: int | None) -> tuple[np.ndarray, DataFrame] | None:
    """``rows`` (part string, id, vector): the centroids, and blocks (part, list, gap, ids, xs, block), checkpointed."""
    shipped(rows.sparkSession)
    rows = checkpointed(rows.select("part", "id", F.col("vector").cast("array<double>").alias("vector")))
    n = rows.count()
    if not n:
        return None
    k = min(MOST_LISTS, lists or max(1, int(n**0.5) // 2))
    sample = np.array([r.vector for r in rows.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(min(SAMPLE, 64 * k)).collect()])
    centroids = fitted_centroids(sample, min(k, len(sample)))
    keyed = checkpointed(rows.mapInArrow(_assigned(centroids), "part string, id long, vector array<double>, list int, gap double"))
    order = ("part", "list", "id")
    blocks = keyed.repartitionByRange(1 + n // (8 * BLOCK), *order).sortWithinPartitions(*order).mapInArrow(_blocks(BLOCK), "part string, list int, gap double, ids array<long>, xs binary")
    return centroids, checkpointed(blocks.withColumn("block", F.monotonically_increasing_id()))


def inverted_lists(rows: DataFrame, lists: int | None = None) -> Lists | None:
    """``rows`` (id long, vector of one length, no nulls): every row in the list of its nearest centroid. None without rows."""
    made = _in_blocks(rows.select(F.lit("").alias("part"), "id", "vector"), lists)
    if made is None:
        return None
    centroids, blocks = made
    radius = np.zeros(len(centroids))
    for r in blocks.groupBy("list").agg(F.max("gap").alias("gap")).collect():  # MOST_LISTS rows at most
        radius[r.list] = r.gap
    return Lists(centroids, radius, blocks)


def _asked(lists: Lists, probes: int, slack: float, again: bool):
    """query_id, q, list: the lists put to each query; the second time those beyond its first that may reach its ``least``."""
    centroids, radius = lists.centroids, lists.radius

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _matrix(batch.column(1))
            near = q @ centroids.T
            rank = np.argsort(np.argsort(-near, axis=1, kind="stable"), axis=1)
            wanted = rank < probes
            if again:
                least = batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
                bound = near + np.sqrt((q * q).sum(axis=1))[:, None] * radius[None] + slack
                wanted = ~wanted & ((bound >= least[:, None]) | np.isnan(least)[:, None])
            i, j = np.nonzero(wanted)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i)), batch.column(1).take(pa.array(i)), pa.array(j.astype(np.int32))], ["query_id", "q", "list"])

    return run


def first_of_each(value: np.ndarray, k: int) -> np.ndarray:
    """True for each row's ``k`` largest values, of equal ones those further left; values of minus infinity are none."""
    if value.shape[1] <= k:
        return value > -np.inf
    bar = np.partition(value, -k, axis=1)[:, -k, None]
    above, equal = value > bar, value == bar
    return (value > -np.inf) & (above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1)[:, None])))


def _scored(k: int, digits: int):
    def run(asked: pa.Table, blocks: pa.Table) -> pa.Table:
        out = []
        for at in range(blocks.num_rows if asked.num_rows else 0):
            ids = blocks.column("ids")[at].values.to_numpy(zero_copy_only=False)
            x = np.frombuffer(blocks.column("xs")[at].as_py()).reshape(len(ids), -1)
            order = np.argsort(ids, kind="stable")
            for s in range(0, asked.num_rows, 1024):
                some = asked.slice(s, 1024).combine_chunks()
                score = np.round(_matrix(some.column("q").chunk(0)) @ x[order].T, digits)
                i, j = np.nonzero(first_of_each(score, k))
                out.append((some.column("query_id").to_numpy()[i], ids[order][j], score[i, j]))
        arrays = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("query_id", "id", "score"), map(pa.array, arrays))))

    return run


def nearest(lists: Lists, queries: DataFrame, k: int, probes: int = 8, digits: int = 6, exact: bool = True) -> DataFrame:
    """``queries`` (query_id long, q): query_id, id, score, place of the ``k`` rows with the largest inner products.

    Scores are rounded to ``digits``; ties go by id. If not ``exact``, only rows in the ``probes`` nearest lists are found.
    Query ids are to be distinct.
    """
    queries = checkpointed(queries.select("query_id", F.col("q").cast("array<double>").alias("q")))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    held = lists.blocks.select("list", "block", "ids", "xs")

    def scan(asked: DataFrame) -> DataFrame:
        by_block = asked.join(held.select("list", F.col("block").alias("to")), "list").select("to", "query_id", "q")
        return by_block.groupBy("to").cogroup(held.drop("list").groupBy("block")).applyInArrow(_scored(k, digits), "query_id long, id long, score double")

    asks = "query_id long, q array<double>, list int"
    found = scan(queries.mapInArrow(_asked(lists, probes, 0.0, False), asks)).withColumn("place", place).filter(F.col("place") <= k)
    if not exact:
        return found
    found = checkpointed(found)
    bar = found.filter(F.col("place") == k).select("query_id", F.col("score").alias("least"))
    more = queries.join(bar, "query_id", "left").select("query_id", "q", "least")
    rest = scan(more.mapInArrow(_asked(lists, probes, 10.0**-digits, True), asks))
    return found.drop("place").unionByName(rest).withColumn("place", place).filter(F.col("place") <= k)


def _groups(rows: int, size: int):
    """Runs of a partition's blocks (part, block, ids, xs) of one part, until they have ``rows`` rows or ``size`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = TaskContext.get().partitionId() << 32, []

        def flush() -> pa.RecordBatch:
            ids = np.concatenate([np.asarray(h["ids"], np.int64) for h in held])
            arrays = [pa.array([group]), pa.array([[h["block"] for h in held]], pa.list_(pa.int64())), pa.array([ids], pa.list_(pa.int64())), pa.array([b"".join(h["xs"] for h in held)], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["group", "blocks", "ids", "xs"])

        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at].as_py() for c in ("part", "block", "xs")} | {"ids": batch.column("ids")[at].values.to_numpy(zero_copy_only=False)}
                if held and (held[0]["part"] != row["part"] or sum(len(h["ids"]) for h in held) >= rows or sum(len(h["xs"]) for h in held) >= size):
                    yield flush()
                    group, held = group + 1, []
                held.append(row)
        if held:
            yield flush()

    return run


def _linked(least: float, digits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                ids = [batch.column(c)[at].values.to_numpy(zero_copy_only=False) for c in ("ids", "ids_")]
                x, y = (np.frombuffer(batch.column(c)[at].as_py()).reshape(len(i), -1) for c, i in zip(("xs", "xs_"), ids))
                same = batch.column("group")[at] == batch.column("group_")[at]
                for s in range(0, len(x), BLOCK):
                    score = np.round(x[s : s + BLOCK] @ y.T, digits)
                    near = score >= least
                    i, j = np.nonzero(np.triu(near, 1 + s) if same else near)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[0][s + i]), pa.array(ids[1][j]), pa.array(score[i, j])], ["a", "b", "score"])

    return run


def links_within(rows: DataFrame, part: str, least: float, digits: int = 6, lists: int | None = None) -> DataFrame:
    """``rows`` (id, vector, part): all pairs (a, b, score) of rows of one part with an inner product of at least ``least``, once each.

    Groups of neighbouring blocks of one part are compared in pairs, those only with blocks whose centroids and radii allow the
    product; a group moves once for each of its pairs. Rows without a vector have no links; vectors are of one length.
    """
    made = _in_blocks(rows.filter(F.col("vector").isNotNull()).select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), "id", "vector"), lists)
    if made is None:
        return rows.sparkSession.createDataFrame([], "a long, b long, score double")
    centroids, blocks = made
    about = rows.sparkSession.createDataFrame([(i, c.tolist(), float(np.sqrt(c @ c))) for i, c in enumerate(centroids)], "list int, c array<double>, norm double")
    thin = blocks.select("part", "list", "gap", "block").join(F.broadcast(about), "list")
    other = thin.select(*(F.col(c).alias(c + "_" if c != "part" else c) for c in thin.columns))
    product = F.aggregate(F.zip_with("c", "c_", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    bound = product + F.col("gap") * F.col("norm_") + F.col("gap_") * F.col("norm") + F.col("gap") * F.col("gap_")
    groups = checkpointed(blocks.select("part", "block", "ids", "xs").mapInArrow(_groups(GROUP, GROUP_BYTES), "group long, blocks array<long>, ids array<long>, xs binary"))
    of = lambda end: groups.select(F.explode("blocks").alias(f"block{end}"), F.col("group").alias(f"group{end}"))
    allowed = thin.join(other, "part").filter(F.col("block") <= F.col("block_")).filter(bound + 10.0**-digits >= least).select("block", "block_")
    met = allowed.join(of(""), "block").join(of("_"), "block_")
    pairs = checkpointed(met.select(F.least("group", "group_").alias("group"), F.greatest("group", "group_").alias("group_")).distinct())
    left, right = groups.select("group", "ids", "xs"), groups.select(F.col("group").alias("group_"), F.col("ids").alias("ids_"), F.col("xs").alias("xs_"))
    return pairs.join(left, "group").join(right, "group_").select("group", "group_", "ids", "xs", "ids_", "xs_").mapInArrow(_linked(least, digits), "a long, b long, score double")
