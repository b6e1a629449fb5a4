"""Joins, ranks, pages and merges as DataFrame operators. Ties are broken by key; empty tables give empty results."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranks import exact_quantiles
from tidemark.session import checkpointed, shipped


def aggregates_on_dimension(dimension: DataFrame, key: str, parts: Sequence[DataFrame]) -> DataFrame:
    """The dimension with the values of ``parts``, aggregates of one row per key; 0 where a part has none."""
    joined = reduce(lambda a, b: a.join(b, key, "left"), parts, dimension)
    return joined.na.fill(0, [c for p in parts for c in p.columns if c != key])


def updated_from(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``rows`` with the values of ``changes``, of the same columns, where its key is there and its value isn't null.

    ``fate`` says ``updated`` or ``kept``. Keys of ``changes`` are unique; those not in ``rows`` are left out.
    """
    values = [c for c in rows.columns if c != key]
    a, b = rows.alias("a"), changes.select(key, F.struct(*(c for c in changes.columns if c != key)).alias("new")).alias("b")
    joined = a.join(b, F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")), "left")
    pick = [F.coalesce(F.col(f"b.new.{c}"), F.col(f"a.{c}")).alias(c) for c in values if c in changes.columns]
    rest = [F.col(f"a.{c}") for c in values if c not in changes.columns]
    return joined.select(F.col(f"a.{key}").alias(key), *pick, *rest, F.when(F.col("b.new").isNotNull(), "updated").otherwise("kept").alias("fate"))


def percentiles_by_rank(rows: DataFrame, key: str, value: str, between: Mapping[str, float], nearest: Mapping[str, float]) -> DataFrame:
    """Per key percentiles of ``value``: ``between`` with linear interpolation, ``nearest`` at the rank below. Nulls are left out.

    By selection: ranges are counted and refined, so no key is sorted in one task.
    """
    shares = sorted({*between.values(), *nearest.values()})
    found = exact_quantiles(rows, key, value, shares)
    of = lambda p, c: F.max(F.when(F.col("share") == p, c))
    out = []
    for name, p in between.items():
        place = F.lit(p) * (F.col("n") - 1)
        out.append(F.round(of(p, F.col("low") + (F.col("high") - F.col("low")) * (place - F.floor(place))), 6).alias(name))
    out += [of(p, F.col("low")).alias(name) for name, p in nearest.items()]
    return found.groupBy(key).agg(*out)


def page(rows: DataFrame, limit: int, offset: int, *order: Column) -> DataFrame:
    """A page of the rows in order, with ``total``, the number of all."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))


def page_after(rows: DataFrame, value: str, key: str, last_value: object, last_key: object, limit: int) -> DataFrame:
    """The next page by ``value`` descending, then ``key``, after the last row that was seen: no offset is counted."""
    v, k = F.col(value), F.col(key)
    return rows.filter((v < last_value) | ((v == last_value) & (k > last_key))).orderBy(v.desc(), k).limit(limit)


def most_common(rows: DataFrame, value: str, seen: str, n: int) -> DataFrame:
    """The ``n`` most frequent values with their number and ``first``, the least of ``seen``, by which ties go."""
    return rows.groupBy(value).agg(F.count("*").alias("n"), F.min(seen).alias("first")).orderBy(F.desc("n"), "first").limit(n)


def merged_by_priority(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """Tables of the same columns as one, a row per key, from the first table that has it; null keys are one key."""
    marked = reduce(lambda a, b: a.unionByName(b), (t.select(F.struct(*t.columns).alias("row"), F.lit(i).alias("priority")) for i, t in enumerate(tables)))
    first = marked.groupBy(F.col(f"row.{key}").alias("key")).agg(F.min(F.struct("priority", "row")).alias("m"))
    return first.select("m.row.*")


def without_subsets(rows: DataFrame, group: str, item: str) -> DataFrame:
    """Groups whose sets of items are no proper part of another's: ``group`` (the least of equal sets) and its items, joined.

    ``rows``: a row per group and item. A set meets only sets that have its rarest item, not all others.
    """
    sets = rows.groupBy(group).agg(F.sort_array(F.collect_set(item)).alias("items")).groupBy("items").agg(F.min(group).alias(group))
    spread = sets.select(group, "items", F.explode("items").alias("item"))
    common = spread.groupBy("item").agg(F.count("*").alias("n"))
    rarest = spread.join(common, "item").groupBy(group).agg(F.min_by("item", F.struct("n", "item")).alias("item"))
    asked = sets.join(rarest, group)
    larger = spread.select("item", F.col("items").alias("more"))
    inside = asked.join(larger, "item").filter((F.size("more") > F.size("items")) & (F.size(F.array_except("items", "more")) == 0)).select(group).distinct()
    return sets.join(inside, group, "left_anti").select(group, F.array_join("items", ",").alias(f"{item}s" if item != "item" else "types"))


def filled_up(primary: DataFrame, others: DataFrame, key: str, least: int, *order: Column) -> DataFrame:
    """All rows of ``primary`` and as many of ``others`` with other keys (case aside) as make ``least``, in order.

    ``p`` is 0 or 1 by origin. One row per candidate is ranked in one task, so ``others`` is a table of aggregates.
    """
    mine = primary.withColumn("p", F.lit(0))
    known = primary.select(F.lower(key).alias("known")).distinct()
    more = others.join(known, F.lower(F.col(key)) == F.col("known"), "left_anti").withColumn("p", F.lit(1))
    n = primary.agg(F.count("*").alias("have"))
    ranked = more.withColumn("place", F.row_number().over(Window.partitionBy("p").orderBy(*order, F.asc(key))))
    some = ranked.join(F.broadcast(n)).filter(F.col("place") + F.col("have") <= least).drop("place", "have")
    return mine.unionByName(some)


def blended(texts: DataFrame, vectors: DataFrame, key: str, text: str, semantic: str, weight: float) -> DataFrame:
    """``key`` and ``score`` of either table's rows: weight x semantic + (1 - weight) x text where both are above 0, else the one that is."""
    both = texts.join(vectors, key, "full")
    t, s = F.coalesce(F.col(text), F.lit(0.0)), F.coalesce(F.col(semantic), F.lit(0.0))
    return both.select(key, F.when((t > 0) & (s > 0), s * weight + t * (1 - weight)).otherwise(F.greatest(s, t)).alias("score"))


def _alike_blocks(seconds: int, least: float):
    """Of pairs of blocks (ids, at, xs and ids_, at_, xs_; same: whether both are one) the pairs of rows near in time and alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                value = lambda c: batch.column(c)[k].values.to_numpy(zero_copy_only=False)
                ids, other, at, at_ = value("ids"), value("ids_"), value("at"), value("at_")
                x, y = value("xs").astype(np.float64).reshape(len(ids), -1), value("xs_").astype(np.float64).reshape(len(other), -1)
                near = (np.abs(at[:, None] - at_[None]) <= seconds) & (ids[:, None] != other[None])
                near &= ~(np.round(x @ y.T, 6) < least)  # not a number is more than any
                i, j = np.nonzero(np.triu(near, 1) if batch.column("same")[k].as_py() else near)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], other[j])), pa.array(np.maximum(ids[i], other[j]))], ["a", "b"])

    return run


def alike_in_time(rows: DataFrame, key: str, time: str, vector: str, seconds: int, least: float, block: int = 1024) -> DataFrame:
    """Pairs (a, b), a the smaller key, at most ``seconds`` apart, whose unit vectors have a cosine of at least ``least``.

    A row meets those of its own time bucket and of the next, so work grows with the rows of a bucket, not of the table. They
    meet in pairs of blocks of about ``block`` rows, each a product of matrices, so a full bucket is many tasks' work. Rows
    without key, time or vector, or with a null in it, have no pair, nor have two rows of one key.
    """
    shipped(rows.sparkSession)
    s = F.unix_seconds(F.col(time).cast("timestamp"))
    base = rows.select(F.col(key).cast("long").alias("id"), s.alias("s"), F.col(vector).alias("v"), F.floor(s / seconds).alias("bucket"), F.size(vector).alias("width"))
    base = base.filter(F.col("id").isNotNull() & F.col("s").isNotNull() & (F.col("width") > 0) & ~F.exists("v", lambda x: x.isNull()))
    counts = base.groupBy("bucket", "width").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    dealt = base.join(counts, ["bucket", "width"]).withColumn("side", F.pmod(F.xxhash64("id", "s"), F.col("parts")).cast("int"))
    listed = dealt.groupBy("bucket", "width", "side").agg(F.collect_list(F.struct("id", "s", "v")).alias("r"))
    blocks = listed.select("bucket", "width", "side", F.col("r.id").alias("ids"), F.col("r.s").alias("at"), F.flatten("r.v").alias("xs"))
    blocks = checkpointed(blocks)
    left = blocks.select("width", "ids", "at", "xs", F.col("side").alias("own_side"), F.col("bucket").alias("own"), F.explode(F.array("bucket", F.col("bucket") + 1)).alias("bucket"))
    right = blocks.select("bucket", "width", "side", *(F.col(c).alias(c + "_") for c in ("ids", "at", "xs")))
    pairs = left.join(right, ["bucket", "width"]).filter((F.col("own") < F.col("bucket")) | (F.col("own_side") <= F.col("side")))
    same = ((F.col("own") == F.col("bucket")) & (F.col("own_side") == F.col("side"))).alias("same")
    return pairs.select("ids", "at", "xs", "ids_", "at_", "xs_", same).mapInArrow(_alike_blocks(seconds, least), "a long, b long")
