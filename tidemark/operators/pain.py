"""Clusters of pain points, many reports at once: links by likeness and keywords, a search for the threshold, caps and minimum.

Items of a report are linked if they share a keyword with its first item, or if their TF-IDF vectors (words and pairs of
words, a report's ``features`` most frequent) have a cosine of at least the threshold. Of the thresholds that give a
number of clusters within bounds, the one with fewest clusters counts, then the lowest; if there is none, keywords alone do.
Clusters beyond the most are added to the smallest ones; with too few, the largest are cut in half.

A report's items meet in pairs of blocks, each a product of matrices, which gives per threshold one link an item at most: those to
the first of its component in the pair, as components are all that links are for. What is folded in one row is the list of a
report's cluster sizes. Items without a description are left out; ids are distinct longs. A null report is the empty one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.graph import components
from tidemark.session import checkpointed, shipped

#: Thresholds in the order in which they are tried.
THRESHOLDS = (0.35, 0.45, 0.55, 0.65, 0.25)
_NODE = 8  # thresholds and the keywords alone, to a node
#: Items in a block, about.
BLOCK = 1024


def _words(text: Column, pattern: str, stop: Sequence[str]) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)), lambda w: ~w.isin(list(stop)))


def features(items: DataFrame, stop: Sequence[str], most: int) -> DataFrame:
    """id, report, feature, w, place: unit TF-IDF vectors over a report's ``most`` most frequent words and pairs, ties by name."""
    words = _words(F.col("document"), r"[\p{L}\p{N}_]{2,}", stop)
    pairs = F.when(F.size("words") > 1, F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words")), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    flat = items.select("id", "report", words.alias("words")).select("id", "report", F.explode(F.concat("words", pairs)).alias("feature"))
    tf = checkpointed(flat.groupBy("id", "report", "feature").agg(F.count("*").alias("tf")))
    sums = tf.groupBy("report", "feature").agg(F.sum("tf").alias("all"), F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("report").orderBy(F.desc("all"), "feature"))
    kept = sums.withColumn("place", place).filter(F.col("place") <= most).select("report", "feature", "df", "place")
    n = items.groupBy("report").agg(F.count("*").alias("n"))
    weighted = tf.join(kept, ["report", "feature"]).join(n, "report").withColumn("w", F.col("tf") * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1))
    norm = weighted.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(norm, "id").select("id", "report", "feature", (F.col("w") / F.col("norm")).alias("w"), "place")


def _stars(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links between rows and columns, each row's and each column's component by the number of its first row; -1 without a link."""
    rows, columns = np.full(near.shape[0], -1), np.full(near.shape[1], -1)
    for first in np.flatnonzero(near.any(axis=1)).tolist():
        if rows[first] >= 0:
            continue
        new = np.array([first])
        while len(new):
            rows[new] = first
            reached = np.flatnonzero(near[new].any(axis=0) & (columns < 0))
            columns[reached] = first
            new = np.flatnonzero(near[:, reached].any(axis=1) & (rows < 0))
    return rows, columns


def _block_links(thresholds: Sequence[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                value = lambda c: batch.column(c)[k].values.to_numpy(zero_copy_only=False)
                ids, other = value("ids"), value("ids_")
                cosine = np.round(value("xs").reshape(len(ids), -1) @ value("xs_").reshape(len(other), -1).T, 6)
                for t, bar in enumerate(thresholds):
                    rows, columns = _stars(cosine >= bar)
                    i, j = np.flatnonzero(rows >= 0), np.flatnonzero(columns >= 0)
                    a, b = ids[np.concatenate([rows[i], columns[j]])], np.concatenate([ids[i], other[j]])
                    yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b]), pa.array(np.full(int((a != b).sum()), t, np.int32))], ["a", "b", "t"])

    return run


def threshold_links(vectors: DataFrame, most: int, thresholds: Sequence[float], block: int | None = None) -> DataFrame:
    """``vectors`` (id, report, place from 1 to ``most``, w), each id's of norm one: links (a, b, t) of one report.

    The components of a ``t`` are those of all pairs with a cosine, rounded to six places, of at least threshold ``t``, over 0.
    """
    shipped(vectors.sparkSession)
    at = F.map_from_entries(F.collect_list(F.struct("place", "w")))
    dense = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda i: F.coalesce(F.try_element_at("at", i), F.lit(0.0)))
    rows = vectors.groupBy("id", "report").agg(at.alias("at")).select("id", "report", dense.alias("x"))
    counts = rows.groupBy("report").agg(F.ceil(F.count("*") / (block or BLOCK)).cast("int").alias("parts"))
    dealt = rows.join(counts, "report").withColumn("side", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    listed = dealt.groupBy("report", "side").agg(F.collect_list(F.struct("id", "x")).alias("r"))
    blocks = checkpointed(listed.select("report", "side", F.col("r.id").alias("ids"), F.flatten("r.x").alias("xs")))
    other = blocks.select("report", F.col("side").alias("side_"), F.col("ids").alias("ids_"), F.col("xs").alias("xs_"))
    pairs = blocks.join(other, "report").filter("side <= side_").select("ids", "xs", "ids_", "xs_")
    return pairs.mapInArrow(_block_links(thresholds), "a long, b long, t int")


def keyword_links(items: DataFrame, stop: Sequence[str]) -> DataFrame:
    """Links (a, b) of a report's first item with a keyword of its description to the others; keywords have five letters or more."""
    words = F.array_distinct(F.filter(_words(F.col("description"), "[a-z]{4,}", stop), lambda w: F.length(w) >= 5))
    flat = items.select("id", "report", F.explode(words).alias("keyword"))
    first = flat.groupBy("report", "keyword").agg(F.min("id").alias("a"))
    return flat.join(first, ["report", "keyword"]).filter("a <> id").select("a", F.col("id").alias("b")).distinct()


def _balanced(sizes: Column, most: int) -> Column:
    """Of cluster sizes, largest first, the number of the cluster that each goes to: itself, or the smallest by then of the first ``most``."""

    def step(state: Column, size: Column) -> Column:
        k = F.size(state["to"])
        small = F.array_position(state["n"], F.array_min(state["n"])).cast("int") - 1
        to = F.when(k < most, k).otherwise(small)
        grown = F.when(k < most, F.concat(state["n"], F.array(size))).otherwise(F.transform(state["n"], lambda n, i: F.when(i == small, n + size).otherwise(n)))
        return F.struct(grown.alias("n"), F.concat(state["to"], F.array(to)).alias("to"))

    none = F.struct(F.array().cast("array<bigint>").alias("n"), F.array().cast("array<int>").alias("to"))
    return F.aggregate(sizes, none, step, lambda s: s["to"])


def _halved(sizes: Column, least: Column, most_cuts: int) -> Column:
    """Segments (cluster, low, high) of clusters, the first largest one cut in half until there are ``least``, or none has two items."""
    whole = F.transform(sizes, lambda n, i: F.struct(i.alias("cluster"), F.lit(0).cast("bigint").alias("low"), n.alias("high")))

    def step(parts: Column, _: Column) -> Column:
        length = F.transform(parts, lambda p: p["high"] - p["low"])
        at = F.array_position(length, F.array_max(length)).cast("int")
        p = F.element_at(parts, at)
        middle = p["low"] + F.floor((p["high"] - p["low"]) / 2)
        left = F.transform(parts, lambda x, i: F.when(i == at - 1, F.struct(x["cluster"].alias("cluster"), x["low"].alias("low"), middle.alias("high"))).otherwise(x))
        right = F.array(F.struct(p["cluster"].alias("cluster"), middle.alias("low"), p["high"].alias("high")))
        return F.when((F.size(parts) < least) & (F.array_max(length) > 1), F.concat(left, right)).otherwise(parts)

    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, most_cuts))), whole, step)


def clustered(items: DataFrame, stop: Sequence[str], least: int = 2, most: int = 5, most_features: int = 80) -> tuple[DataFrame, DataFrame]:
    """``items`` (report, id, description, document): (report, id, cluster), clusters numbered from 0, and the items' features."""
    items = checkpointed(items.filter(F.length(F.trim(F.coalesce("description", F.lit("")))) > 0).select(F.coalesce("report", F.lit("")).alias("report"), "id", "description", F.coalesce("document", "description").alias("document")))
    vectors = checkpointed(features(items, stop, most_features))
    keys = keyword_links(items, stop)
    by_cosine = threshold_links(vectors, most_features, THRESHOLDS)
    by_word = keys.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(len(THRESHOLDS)))))
    node = lambda c: F.col(c) * _NODE + F.col("t")
    links = checkpointed(by_cosine.unionByName(by_word).select(node("a").alias("a"), node("b").alias("b")))
    tried = items.select("report", "id", F.explode(F.sequence(F.lit(0), F.lit(len(THRESHOLDS)))).alias("t"))
    root = components(tried.select(node("id").alias("id")), links).withColumnRenamed("id", "node")
    of = checkpointed(tried.withColumn("node", node("id")).join(root, "node").select("report", "id", "t", F.floor(F.col("root") / _NODE).alias("root")))

    counts = of.groupBy("report", "t").agg(F.countDistinct("root").alias("clusters"), F.count("*").alias("n"))
    bars = F.element_at(F.array(*(F.lit(x) for x in (*THRESHOLDS, 2.0))), F.col("t") + 1)
    lowest, highest = F.greatest(F.lit(1), F.least(F.lit(least), "n")), F.greatest(F.greatest(F.lit(1), F.least(F.lit(least), "n")), F.least(F.lit(most), "n"))
    has = vectors.select("report").distinct().withColumn("has", F.lit(True))
    marked = counts.join(has, "report", "left").select("report", "t", "clusters", "n", F.coalesce("has", F.lit(False)).alias("has"), bars.alias("bar"))
    fits = F.col("has") & (F.col("t") < len(THRESHOLDS)) & F.col("clusters").between(lowest, highest)
    best = marked.groupBy("report").agg(F.min(F.when(fits, F.struct("clusters", "bar", "t"))).alias("m"), F.max("n").alias("n")).select("report", F.coalesce("m.t", F.lit(len(THRESHOLDS))).alias("t"), F.col("n").alias("of_n"))
    chosen = checkpointed(of.join(best, ["report", "t"]).select("report", "id", "root", "of_n"))

    sizes = chosen.groupBy("report", "of_n", "root").agg(F.count("*").alias("size"))
    listed = sizes.groupBy("report", "of_n").agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("order"), "root", "size"))).alias("c"))
    to = _balanced(F.transform("c", lambda x: x["size"]), most)
    merged = listed.select("report", F.inline(F.arrays_zip(F.transform("c", lambda x: x["root"]).alias("root"), to.alias("to"))))
    joined = chosen.join(merged, ["report", "root"]).select("report", "id", "of_n", "to")
    joined = checkpointed(joined.withColumn("rank", F.row_number().over(Window.partitionBy("report", "to").orderBy("id")) - 1))
    again = joined.groupBy("report", "of_n", "to").agg(F.count("*").alias("size")).groupBy("report", "of_n").agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("order"), "to", "size"))).alias("c"))
    parts = _halved(F.transform("c", lambda x: x["size"]), F.least(F.lit(least), F.col("of_n")), least)
    cut = again.select("report", F.transform("c", lambda x: x["to"]).alias("names"), F.posexplode(parts).alias("cluster", "p"))
    cut = cut.select("report", F.element_at("names", F.col("p.cluster") + 1).alias("to"), "p.low", "p.high", "cluster")
    out = joined.join(cut, ["report", "to"]).filter((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return checkpointed(out.select("report", "id", "cluster")), vectors


def pain_clusters(items: DataFrame, stop: Sequence[str], least: int = 2, most: int = 5, most_features: int = 80) -> DataFrame:
    """``items`` (report, id, description, document, frequency, sentiment, community): report, topic, items, negative_mean, communities, first_id, place.

    ``topic`` is the feature with the largest sum of weights, of equal ones the last by name, else the first three words of the
    first description. Clusters of a report come by frequency (of all items, or their number if that is zero), then by mood.
    """
    of, vectors = clustered(items, stop, least, most, most_features)
    rows = of.join(items.select("id", "description", "frequency", "sentiment", "community"), "id")
    weights = of.select("id", "cluster").join(vectors, "id").groupBy("report", "cluster", "feature").agg(F.round(F.sum("w"), 9).alias("w"))
    topic = weights.groupBy("report", "cluster").agg(F.max(F.struct("w", "feature")).alias("m")).select("report", "cluster", F.col("m.feature").alias("feature"))
    community = F.nullif(F.trim(F.coalesce("community", F.lit(""))), F.lit(""))
    sums = rows.groupBy("report", "cluster").agg(
        F.count("*").alias("items"), F.sum(F.coalesce("frequency", F.lit(0))).alias("f"), F.round(F.avg(F.coalesce("sentiment", F.lit(0.0))), 2).alias("negative_mean"),
        F.countDistinct(community).alias("communities"), F.min("id").alias("first_id"), F.min_by("description", "id").alias("first"),
    )
    joined = sums.join(topic, ["report", "cluster"], "left")
    words = F.array_join(F.slice(F.filter(F.split("first", r"\s+"), lambda w: (w != "") & ~F.lower(w).isin(list(stop))), 1, 3), " ")
    total = F.when(F.col("f") == 0, F.col("items")).otherwise(F.col("f"))
    place = F.row_number().over(Window.partitionBy("report").orderBy(F.desc(total), "negative_mean", "first_id"))
    return joined.select("report", F.coalesce("feature", F.nullif(words, F.lit("")), F.left("first", F.lit(50))).alias("topic"), "items", total.alias("total_frequency"), "negative_mean", "communities", "first_id", place.alias("place"))


def with_fallback(found: DataFrame, other: DataFrame, status: tuple[str, str] = ("db_labels", "tfidf_fallback")) -> DataFrame:
    """Clusters of ``found`` where a report has any, else those of ``other``; ``source`` says which."""
    rest = other.join(found.select("report").distinct(), "report", "left_anti")
    return found.withColumn("source", F.lit(status[0])).unionByName(rest.withColumn("source", F.lit(status[1])))
