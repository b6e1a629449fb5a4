"""Samples and keywords of aspects, statistics of candidates, matching of names, fit to a description, caps, alerts and audits."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X


def aspect_clusters(rows: DataFrame, samples: int, keywords: int, least: int = 20) -> DataFrame:
    """``rows`` (aspect, id, text, score): per aspect its best ``samples`` texts of over ``least`` characters, as ids, and their most frequent words.

    Samples by score, then id; words of three letters or more by their number, then name. Aspects without such texts have no row.
    """
    place = F.row_number().over(Window.partitionBy("aspect").orderBy(F.desc("score"), "id"))
    best = rows.filter(F.length("text") > least).withColumn("place", place).filter(F.col("place") <= samples)
    listed = best.groupBy("aspect").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"].cast("string")), ",").alias("samples"))
    words = best.select("aspect", F.explode(X.tokens(F.col("text"), 3)).alias("word")).groupBy("aspect", "word").agg(F.count("*").alias("c"))
    rank = F.row_number().over(Window.partitionBy("aspect").orderBy(F.desc("c"), "word"))
    top = words.withColumn("rank", rank).filter(F.col("rank") <= keywords).groupBy("aspect").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]), ",").alias("keywords"))
    return listed.join(top, "aspect", "left").na.fill("", ["keywords"])


def candidate_stats(rows: DataFrame, least: int, confident: float, spread: int) -> DataFrame:
    """``rows`` (term, confidence, community, author): per term frequency, best confidence, different communities and authors, and whether it is approved.

    Approved without a look are terms of ``least`` rows, a confidence of ``confident`` and ``spread`` communities or more.
    """
    sums = rows.groupBy("term").agg(F.count("*").alias("frequency"), F.max("confidence").alias("confidence"), F.countDistinct("community").alias("communities"), F.countDistinct("author").alias("authors"))
    fine = (F.col("frequency") >= least) & (F.col("confidence") >= confident) & (F.col("communities") >= spread)
    return sums.withColumn("approved", F.coalesce(fine, F.lit(False)))


def best_matches(names: DataFrame, canonical: DataFrame, least: float) -> DataFrame:
    """``names`` and ``canonical`` (id, text): per name the entry with the largest Jaccard index of their words, of at least ``least``; ties by id.

    Names meet entries by shared words, so those without any aren't compared. ``confidence`` is the index, to six places.
    """
    words = lambda rows, as_: rows.select(F.col("id").alias(as_), F.explode(F.array_distinct(X.tokens(F.coalesce("text", F.lit(""))))).alias("w"))
    size = lambda rows, as_: rows.select(F.col("id").alias(as_), F.size(F.array_distinct(X.tokens(F.coalesce("text", F.lit(""))))).alias(f"n_{as_}"))
    shared = words(names, "name").join(words(canonical, "entry"), "w").groupBy("name", "entry").agg(F.count("*").alias("c"))
    both = shared.join(size(names, "name"), "name").join(size(canonical, "entry"), "entry")
    rated = both.withColumn("confidence", F.round(F.col("c") / (F.col("n_name") + F.col("n_entry") - F.col("c")), 6)).filter(F.col("confidence") >= least)
    best = rated.groupBy("name").agg(F.max_by(F.struct("entry", "confidence"), F.struct("confidence", -F.col("entry"))).alias("m"))
    return best.select("name", "m.entry", "m.confidence")


def fit_to_description(rows: DataFrame, community: str, description: str, top: int) -> DataFrame:
    """Communities by the TF-IDF cosine of all of their texts (community, text) to a description: the ``top`` of them with one over 0."""
    tf = rows.select(community, F.explode(X.tokens(F.coalesce("text", F.lit("")), 3)).alias("w")).groupBy(community, "w").agg(F.count("*").alias("tf"))
    n = rows.select(community).distinct().count()
    df = tf.groupBy("w").agg(F.count("*").alias("df"))
    weighted = tf.join(df, "w").withColumn("x", F.col("tf") * (F.log(F.lit(n + 1) / (F.col("df") + 1)) + 1))
    asked: dict[str, int] = {}
    for w in re.findall("[a-z0-9]{3,}", description.lower()):
        asked[w] = asked.get(w, 0) + 1
    query = rows.sparkSession.createDataFrame(list(asked.items()) or [("", 0)], "w string, q long")
    sums = weighted.join(F.broadcast(query), "w", "left").withColumn("y", F.coalesce("q", F.lit(0)) * (F.log(F.lit(n + 1) / (F.col("df") + 1)) + 1))
    dot = sums.groupBy(community).agg(F.sum(F.col("x") * F.col("y")).alias("dot"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    known = df.join(F.broadcast(query), "w", "right").withColumn("y", F.col("q") * (F.log(F.lit(n + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1))
    length = known.agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("length"))
    cosine = F.when((F.col("norm") > 0) & (F.col("length") > 0), F.round(F.col("dot") / (F.col("norm") * F.col("length")), 6)).otherwise(0.0)
    return dot.join(F.broadcast(length)).select(community, cosine.alias("cosine")).filter("cosine > 0").orderBy(F.desc("cosine"), community).limit(top)


def caps_of(total: Column, shares: Mapping[str, float]) -> list[Column]:
    """A cap for each share of a total, rounded up, one at least."""
    return [F.greatest(F.lit(1), F.ceil(F.round(total * F.lit(float(s)), 9))).cast("long").alias(name) for name, s in shares.items()]


def primary_of(rows: DataFrame, key: str, community: str, time: str) -> DataFrame:
    """Per key its most frequent community, of equal ones the one with the newest row, then the first by name."""
    sums = rows.groupBy(key, community).agg(F.count("*").alias("n"), F.max(time).alias("latest"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), F.desc("latest"), community))
    return sums.withColumn("place", place).filter("place = 1").select(key, community, "n")


def alerts(health: DataFrame, limits: Sequence[tuple[str, float, str]]) -> DataFrame:
    """``health`` (contract, n and counts): a row for each count whose share of n is over its limit: (column, limit, severity)."""
    row = lambda c, limit, severity: F.when(F.col(c) / F.col("n") > limit, F.struct(F.lit(c).alias("what"), F.round(F.col(c) / F.col("n"), 6).alias("share"), F.lit(severity).alias("severity")))
    return health.select("contract", F.explode(F.array_compact(F.array(*(row(*x) for x in limits)))).alias("a")).select("contract", "a.*")


def coherence(items: DataFrame, least: int) -> DataFrame:
    """``items`` (suggestion, id, anchor): per suggestion its items, the anchors that ``least`` of them or more share, and the share of items with one."""
    n = items.groupBy("suggestion").agg(F.countDistinct("id").alias("n"))
    strong = items.groupBy("suggestion", "anchor").agg(F.countDistinct("id").alias("c")).filter(F.col("c") >= least)
    held = items.join(strong.select("suggestion", "anchor"), ["suggestion", "anchor"]).groupBy("suggestion").agg(F.countDistinct("anchor").alias("anchors"), F.countDistinct("id").alias("held"))
    whole = n.join(held, "suggestion", "left").na.fill(0, ["anchors", "held"])
    return whole.select("suggestion", "n", "anchors", F.round(F.col("held") / F.col("n"), 6).alias("coherence"))
