"""Hard negatives by one-dimensional distance keys.

Inner products become distances: with M the largest norm, vectors get one more component, sqrt(M^2 - |x|^2), and queries
a zero, so that all vectors have norm M and the score of x under q is (|q|^2 + M^2 - d(q, x)^2) / 2. A vector's key is
its nearest pivot and its distance to that. Vectors lie sorted by key in the shared folder, in blocks of rows; a cell is
a run of blocks of one pivot. By the triangle inequality a query's distance to a pivot bounds its distance to a cell.

A search scans for each query the cells around its own keys first, then goes outward, interval by interval, until its
k-th score can't be reached by what remains: rounds of a join of packs of queries with blocks. A scan of a block compares
all of its vectors with a pack as two matrices, by exact integer products. Bands of scores cut the annuli on both sides.
The pivots are a bounded sample, and the directory has a row for each cell, some thousands at most; vectors, queries and
results stay in tables, and no key gathers more than a block and a pack.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import checkpointed
from tidemark.llm.vectors import integers, matrix, products, usable

MOST_PIVOTS, MOST_PARTITIONS = 64, 2048
#: Vectors to a block, queries to a pack, cells that the first interval of a query has, and how many times more the next has.
BLOCK, PACK, FIRST_CELLS, WIDER = 1024, 128, 8, 8
#: Scores are above this: components are 2^27 at most.
NONE = -(1 << 62)
NO_ID = (1 << 63) - 1
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass
class Geometry:
    """What a task needs to know of the whole: pivots, the square of the largest norm, and the cells."""

    pivots: np.ndarray
    most: int
    cells: list[tuple[int, int, float, float, int]] = ()  # cell, pivot, least and largest key, blocks

    @property
    def width(self) -> int:
        return self.pivots.shape[1]

    def keys(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest pivot and the distance to it."""
        more = lambda v: np.sqrt(np.maximum(self.most - (v * v).sum(axis=1), 0).astype(np.float64))
        square = 2.0 * self.most - 2.0 * (products(x, self.pivots) + more(x)[:, None] * more(self.pivots)[None])
        pivot = square.argmin(axis=1)
        return pivot.astype(np.int32), np.sqrt(np.maximum(square[np.arange(len(x)), pivot], 0.0))

    def bounds(self, q: np.ndarray, pivot: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per query and cell the largest and the least score that a vector with such a key can have, with room for rounding."""
        both = ((q * q).sum(axis=1) + self.most).astype(np.float64)
        to_pivot = np.sqrt(np.maximum(both[:, None] - 2.0 * products(q, self.pivots), 0.0))[:, pivot]
        room = 1e-9 * (to_pivot + high)
        near = np.maximum(np.maximum(low - to_pivot, to_pivot - high) - room, 0.0)
        far = high + to_pivot + room
        slack = 1.0 + 1e-9 * both[:, None]
        return (both[:, None] - near * near) / 2 + slack, (both[:, None] - far * far) / 2 - slack


def _keyed(geometry: Geometry):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivot, key = geometry.keys(matrix(batch.column(3), geometry.width))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot), pa.array(key)], ["uid", "id", "label", "x", "anchor", "pivot", "key"])

    return run


def _runs(geometry: Geometry, size: int, by_pivot: bool):
    """A sorted partition's rows, ``size`` together: cell, block, pivot, least and largest key, uids, ids, labels, vectors in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cell, block, last = [], TaskContext.get().partitionId() << 20, 0, None

        def row(parts):
            uid, id_, label, x, pivot, key = (np.concatenate(p) for p in zip(*parts))
            lists = [pa.array([v], pa.list_(pa.int64())) for v in (uid, id_, label.astype(np.int64))]
            plain = [pa.array([cell], pa.int64()), pa.array([block], pa.int32()), pa.array(pivot[:1]), pa.array([key.min()]), pa.array([key.max()])]
            return pa.RecordBatch.from_arrays([*plain, *lists, pa.array([np.ascontiguousarray(x, "<i4").tobytes()], pa.binary())], ["cell", "block", "pivot", "low", "high", "uids", "ids", "labels", "xs"])

        for batch in batches:
            uid, id_, label, pivot, key = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 5, 6))
            x, at = matrix(batch.column(3), geometry.width), 0
            while at < len(uid):
                if by_pivot and last is not None and pivot[at] != last:
                    if held:
                        yield row(held)
                    held, cell, block = [], cell + 1, 0
                last = pivot[at]
                end = min(len(uid), at + size - sum(len(p[0]) for p in held))
                if by_pivot:
                    end = min(end, at + int(np.searchsorted(pivot[at:], last, "right")))
                held.append((uid[at:end], id_[at:end], label[at:end], x[at:end], pivot[at:end], key[at:end]))
                at = end
                if sum(len(p[0]) for p in held) == size:
                    yield row(held)
                    held, block = [], block + 1
        if held:
            yield row(held)

    return run


_RUN = "cell long, block int, pivot int, low double, high double, uids array<long>, ids array<long>, labels array<long>, xs binary"


def _vectors(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, "<i4").reshape(-1, width).astype(np.int64)


def build_index(rows: DataFrame, partitions: int | None = None) -> tuple[Geometry, DataFrame, DataFrame] | None:
    """``rows`` (uid, id, label, x, anchor), checkpointed: the geometry, blocks of all rows and packs of the anchors; None without rows."""
    square = F.aggregate("x", F.lit(0).cast("long"), lambda s, v: s + v.cast("long") * v)
    n, most, width, anchors = rows.agg(F.count("*"), F.max(square), F.max(F.size("x")), F.count_if("anchor")).first()
    if not n:
        return None
    sample = rows.select("x").orderBy(F.xxhash64("uid")).limit(min(MOST_PIVOTS, 1 + n // 4096)).collect()
    pivots = np.zeros((len(sample), max(1, width)), np.int64)
    for i, r in enumerate(sample):
        pivots[i, : len(r.x)] = r.x
    geometry = Geometry(pivots, most)
    keyed = checkpointed(rows.mapInArrow(_keyed(geometry), "uid long, id long, label int, x array<int>, anchor boolean, pivot int, key double"))
    order = ("pivot", "key", "uid")
    parts = partitions or min(MOST_PARTITIONS, 1 + n // 2048)
    blocks = checkpointed(keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_runs(geometry, BLOCK, True), _RUN))
    cells = blocks.groupBy("cell").agg(F.first("pivot"), F.min("low"), F.max("high"), F.count("*")).orderBy("cell").collect()  # parts + pivots at most
    geometry.cells = [tuple(r) for r in cells]
    queries = keyed.filter("anchor").repartitionByRange(1 + anchors // (4 * PACK), *order).sortWithinPartitions(*order)
    packs = queries.mapInArrow(_runs(geometry, PACK, False), _RUN)
    return geometry, blocks, checkpointed(packs.select((F.col("cell") * (1 << 20) + F.col("block")).alias("pack"), "uids", "labels", "xs"))


def _lists(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name)[0].values.to_numpy(zero_copy_only=False)


def _advanced(geometry: Geometry, k: int):
    """Takes in each query's k-th scores, and moves its frontier on: a cell that may reach the frontier is scanned.

    While a band lacks rows the frontier takes WIDER times as many cells as before; then it goes to the least k-th score, or
    the band's end, and the search is over. ``reach``: cells so far, zero for a query that is done.
    """
    _, pivot, low, high, _ = (np.array(c) for c in zip(*geometry.cells))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(whole.num_rows):
                batch = whole.slice(at, 1)
                q = _vectors(batch.column("xs")[0].as_py(), geometry.width)
                lows, highs, kth = (_lists(batch, c).reshape(len(q), -1) for c in ("lows", "highs", "kth"))
                kth, frontier, reach = kth.copy(), _lists(batch, "frontier"), _lists(batch, "reach").copy()
                place = {u: i for i, u in enumerate(_lists(batch, "uids").tolist())}
                for x in batch.column("news")[0].as_py() or ():
                    kth[place[x["uid"]], x["band"]] = x["score"]
                upper, lower = geometry.bounds(q, pivot, low, high)
                real = lows <= highs
                most, least = np.where(real, highs, NONE).max(axis=1), np.where(real, lows, NO_ID).min(axis=1)
                useful = (lower <= most[:, None]) & (upper >= least[:, None])
                # what is still wanted of a band: anything down to its k-th score, or to its end
                wanted = np.where(real, np.maximum(lows, kth), NO_ID).min(axis=1).astype(np.float64)
                full = (~real | (kth > NONE)).all(axis=1)
                ranked = -np.sort(-np.where(useful, upper, -np.inf), axis=1)
                goal = np.where(reach <= 0, FIRST_CELLS, reach * WIDER)
                target = np.where(goal >= len(pivot), -np.inf, ranked[np.arange(len(q)), np.minimum(goal, len(pivot)) - 1])
                target = np.where(full, wanted, np.maximum(target, wanted))
                open_ = (useful & (upper < frontier[:, None]) & (upper >= target[:, None])).any(axis=1)
                over = (frontier <= wanted) | ~((useful & (upper < frontier[:, None]) & (upper >= wanted[:, None])).any(axis=1))
                target = np.where(over, frontier, np.where(open_, target, wanted))
                reach = np.where(over, -1, np.maximum(goal, 1))
                new = {"before": frontier, "frontier": target, "reach": reach.astype(np.int64), "kth": kth.ravel()}
                kept = [batch.column(c) for c in ("pack", "uids", "labels", "xs", "lows", "highs")]
                arrays = [pa.array([v.tolist()], pa.list_(pa.float64() if v.dtype == float else pa.int64())) for v in new.values()]
                yield pa.RecordBatch.from_arrays([*kept, *arrays], ["pack", "uids", "labels", "xs", "lows", "highs", *new])

    return run


_STATE = "pack long, uids array<long>, labels array<long>, xs binary, lows array<long>, highs array<long>, before array<double>, frontier array<double>, reach array<long>, kth array<long>"


def _wanted(geometry: Geometry, q: np.ndarray, batch: pa.RecordBatch, pivot: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Per query and cell whether it lies between the query's old and new frontier."""
    lows, highs = (_lists(batch, c).reshape(len(q), -1) for c in ("lows", "highs"))
    before, frontier = _lists(batch, "before")[:, None], _lists(batch, "frontier")[:, None]
    upper, lower = geometry.bounds(q, pivot, low, high)
    real = lows <= highs
    most, least = np.where(real, highs, NONE).max(axis=1)[:, None], np.where(real, lows, NO_ID).min(axis=1)[:, None]
    return (upper < before) & (upper >= frontier) & (lower <= most) & (upper >= least)


def _intervals(geometry: Geometry):
    """pack, cell, blocks: the cells that any query of a pack scans in this round."""
    cell, pivot, low, high, blocks = (np.array(c) for c in zip(*geometry.cells))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(whole.num_rows):
                batch = whole.slice(at, 1)
                q = _vectors(batch.column("xs")[0].as_py(), geometry.width)
                some = np.flatnonzero(_wanted(geometry, q, batch, pivot, low, high).any(axis=0))
                pack = np.full(len(some), batch.column("pack")[0].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pack), pa.array(cell[some]), pa.array(blocks[some].astype(np.int64))], ["pack", "cell", "blocks"])

    return run


def _scanned(geometry: Geometry, k: int, same: bool):
    """Of a pack and a block the first k of each query and band: pack, query, band, score, id, uid."""
    about = {c[0]: c for c in geometry.cells}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(whole.num_rows):
                batch = whole.slice(at, 1)
                q = _vectors(batch.column("xs")[0].as_py(), geometry.width)
                _, pivot, low, high, _ = about[batch.column("cell")[0].as_py()]
                on = np.flatnonzero(_wanted(geometry, q, batch, np.array([pivot]), np.array([low]), np.array([high]))[:, 0])
                uid, id_ = _lists(batch, "b_uids"), _lists(batch, "b_ids")
                order = np.lexsort((uid, id_))
                uid, id_, label = uid[order], id_[order], _lists(batch, "b_labels")[order]
                score = products(q[on], _vectors(batch.column("b_xs")[0].as_py(), geometry.width)[order])
                alike = label[None] == _lists(batch, "labels")[on][:, None]
                fits = alike & (uid[None] != _lists(batch, "uids")[on][:, None]) if same else ~alike
                lows, highs, kth = (_lists(batch, c).reshape(len(q), -1)[on] for c in ("lows", "highs", "kth"))
                out = []
                for band in range(lows.shape[1]):
                    inside = fits & (score >= np.maximum(lows, kth)[:, band, None]) & (score <= highs[:, band, None])
                    value = np.where(inside, score, NONE)
                    if len(id_) > k:  # of equal scores the smaller ids: columns are in the order of ids
                        bar = np.partition(value, -k, axis=1)[:, -k, None]
                        above, equal = value > bar, value == bar
                        value = np.where(above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1)[:, None])), value, NONE)
                    i, j = np.nonzero(value > NONE)
                    out.append((_lists(batch, "uids")[on][i], np.full(len(i), band), value[i, j], id_[j], uid[j]))
                query, band, value, found, row = (np.concatenate(c).astype(np.int64) for c in zip(*out))
                pack = np.full(len(query), batch.column("pack")[0].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays(list(map(pa.array, (pack, query, band, value, found, row))), ["pack", "query", "band", "score", "id", "uid"])

    return run


_HIT = "pack long, query long, band long, score long, id long, uid long"


def search(geometry: Geometry, blocks: DataFrame, packs: DataFrame, k: int, same: bool) -> DataFrame:
    """``packs`` (pack, uids, labels, xs, lows, highs): per query and band the first ``k`` rows with a score from low to high.

    Of rows with the query's label and not the query itself if ``same``, else of rows with other labels. Higher scores come
    first, ties by id, then uid. Returns pack, query, band, score, id, uid, place.
    """
    spark = blocks.sparkSession
    wide = lambda c, value, kind: F.transform(c, lambda x: F.lit(value).cast(kind))
    state = packs.withColumns({"before": wide("uids", float("inf"), "double"), "frontier": wide("uids", float("inf"), "double"), "reach": wide("uids", 0, "long"), "kth": wide("lows", NONE, "long")})
    news = spark.createDataFrame([], "pack long, news array<struct<uid:long,band:long,score:long>>")
    found = spark.createDataFrame([], _HIT + ", place int")
    place = F.row_number().over(Window.partitionBy("query", "band").orderBy(F.desc("score"), "id", "uid"))
    side = blocks.select("cell", "block", *(F.col(c).alias(f"b_{c}") for c in ("uids", "ids", "labels", "xs")))
    while True:
        state = checkpointed(state.join(news, "pack", "left").mapInArrow(_advanced(geometry, k), _STATE))
        going = state.filter(F.exists("reach", lambda r: r > 0))
        if going.isEmpty():
            return found
        cells = going.mapInArrow(_intervals(geometry), "pack long, cell long, blocks long")
        pairs = cells.select("pack", "cell", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("block"))
        hits = pairs.join(going.hint("shuffle_hash"), "pack").join(side.hint("shuffle_hash"), ["cell", "block"]).mapInArrow(_scanned(geometry, k, same), _HIT)
        found = checkpointed(found.drop("place").unionByName(hits).withColumn("place", place).filter(F.col("place") <= k))
        last = found.filter(F.col("place") == k)
        news = last.groupBy("pack").agg(F.collect_list(F.struct(F.col("query").alias("uid"), "band", "score")).alias("news"))  # PACK x bands at most


def _banded(news: bool, positives: int, least: int, most: int):
    """lows and highs of a pack's queries: all scores, or for each positive those from ``least`` to ``most`` per cent of its score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(whole.num_rows):
                batch = whole.slice(at, 1)
                uids = _lists(batch, "uids").tolist()
                low, high = [[NONE + 1]] * len(uids), [[-NONE]] * len(uids)
                if news:
                    low, high = [[0] * positives for _ in uids], [[-1] * positives for _ in uids]
                    place = {u: i for i, u in enumerate(uids)}
                    for x in batch.column("news")[0].as_py() or ():
                        low[place[x["uid"]]][x["band"]] = -(-least * x["score"] // 100)
                        high[place[x["uid"]]][x["band"]] = most * x["score"] // 100
                flat = [pa.array([sum(v, [])], pa.list_(pa.int64())) for v in (low, high)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("pack", "uids", "labels", "xs")), *flat], ["pack", "uids", "labels", "xs", "lows", "highs"])

    return run


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, scale: int = 256) -> DataFrame:
    """Per anchor and positive the first negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: vec_id, embedding, label. Rows with a null label or vector, or with a null or non-finite component, take no
    part. Components become floor(scale * x), between -2^27 and 2^27; a shorter vector counts as filled up with zeros. Scores
    are inner products; higher ones come first, ties by vec_id, null last, then rows equal in both by their order.
    Positives are an anchor's first other rows of its label; repeated rows are rows of their own. Negatives have another label
    and a score from ``least`` to ``most`` per cent of the positive's. An anchor without positives, or a positive without
    such negatives, gives no row; an empty table gives none. Other columns are ignored. A vec_id of 2^63 - 1 counts as null.
    """
    spark = rows.sparkSession
    whole = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    whole = whole.filter(F.col("label").isNotNull() & usable(F.col("vector"))).select(F.monotonically_increasing_id().alias("uid"), F.coalesce("id", F.lit(NO_ID)).alias("id"), "label", integers(F.col("vector"), scale).alias("x"), "anchor")
    kept = checkpointed(whole)
    index = build_index(kept)
    if index is None:
        return spark.createDataFrame([], RESULT)
    geometry, blocks, packs = index
    banded = "pack long, uids array<long>, labels array<long>, xs binary, lows array<long>, highs array<long>"
    first = search(geometry, blocks, packs.mapInArrow(_banded(False, positives, least, most), banded), positives, True)
    of_pack = first.groupBy("pack").agg(F.collect_list(F.struct(F.col("query").alias("uid"), (F.col("place") - 1).cast("long").alias("band"), "score")).alias("news"))
    second = search(geometry, blocks, packs.join(of_pack, "pack", "left").mapInArrow(_banded(True, positives, least, most), banded), negatives, False)
    both = second.select("query", "band", F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    both = both.join(first.select("query", (F.col("place") - 1).cast("long").alias("band"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), ["query", "band"])
    both = both.join(kept.filter("anchor").select(F.col("uid").alias("query"), F.col("id").alias("anchor_id")), "query")
    known: Callable[[str], Column] = lambda c: F.nullif(F.col(c), F.lit(NO_ID)).alias(c)
    return both.select(known("anchor_id"), known("positive_id"), "rank", known("negative_id"), "positive_score", "negative_score")
