"""Probes, feeds and reports: candidates by evidence, boards of the best, splits that add up, streaks without long runs.

Ties go by key. Empty tables give empty results. Limits are what the feature asks for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def probe_posts(rows: DataFrame, since: Column, least_score: float, least_comments: int, spam: Column) -> DataFrame:
    """``rows`` (id, community, ts, score, comments): one of each id, not too old, with score or comments enough, no spam.

    Adds ``evidence``, score + 2 x comments, rounded down.
    """
    order = [F.desc(c) for c in ("score", "comments", "ts")]
    once = rows.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(*order))).filter("place = 1").drop("place")
    s, c = F.coalesce(F.col("score"), F.lit(0)), F.coalesce(F.col("comments"), F.lit(0))
    kept = once.filter((F.col("ts").isNull() | (F.col("ts") >= since)) & ((s >= least_score) | (c >= least_comments)) & ~F.coalesce(spam, F.lit(False)))
    return kept.withColumn("evidence", F.floor(s + c * 2).cast("long"))


def probe_search(scored: DataFrame, per_community: int, most: int) -> DataFrame:
    """The best ``most`` posts with at most ``per_community`` of one: as a cap is each community's own, ranks within it give
    the same as filling up in order."""
    within = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("evidence"), F.desc("ts"), "id"))
    return scored.withColumn("of_community", within).filter(F.col("of_community") <= per_community).drop("of_community").orderBy(F.desc("evidence"), F.desc("ts"), F.desc("community"), "id").limit(most)


def community_totals(posts: DataFrame, most: int) -> DataFrame:
    """The ``most`` communities by their summed evidence, then by name, the later first."""
    return posts.groupBy("community").agg(F.sum("evidence").alias("total")).orderBy(F.desc("total"), F.desc("community")).limit(most)


def probe_hot(scored: DataFrame, communities: int, per_community: int, most: int) -> DataFrame:
    """The best posts of the communities with the largest totals."""
    top = community_totals(scored, communities).select("community")
    within = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("evidence"), F.desc("ts"), "id"))
    kept = scored.join(F.broadcast(top), "community", "left_semi").withColumn("of_community", within).filter(F.col("of_community") <= per_community)
    return kept.drop("of_community").orderBy(F.desc("evidence"), F.desc("ts"), "id").limit(most)


def retry_delay(count: Column, batch: int, base: int, most: int) -> Column:
    """Seconds to wait: ``base`` for each full batch before this one, at most ``most``; 0 of none."""
    index = F.greatest(F.lit(0), F.floor((count - 1) / batch))
    return F.when(F.coalesce(count, F.lit(0)) <= 0, 0).otherwise(F.least(index * base, F.lit(most))).cast("long")


def percent_split(rows: DataFrame, key: str, n: str) -> DataFrame:
    """Whole percentages that add up to 100 at most: rounded, and what is over is taken from the largest."""
    everyone = Window.partitionBy(F.lit(1))
    share = rows.withColumn("percent", F.coalesce(F.round(F.try_divide(F.col(n) * 100, F.sum(n).over(everyone))), F.lit(0)).cast("long"))
    over = F.greatest(F.lit(0), F.sum("percent").over(everyone) - 100)
    place = F.row_number().over(everyone.orderBy(F.desc(n), key))
    return share.withColumn("over", F.when(place == 1, over).otherwise(0)).withColumn("percent", F.col("percent") - F.col("over")).drop("over")


def layers_over_caps(cards: DataFrame, release: str, order: Sequence[Column], front: int, cap: int, topic: str) -> DataFrame:
    """Topics with more than ``cap`` cards among the first ``front`` or the rest of each release: release, layer, topic, n."""
    place = F.row_number().over(Window.partitionBy(release).orderBy(*order))
    layer = F.when(place <= front, "front").otherwise("rest")
    return cards.withColumn("layer", layer).groupBy(release, "layer", topic).agg(F.count("*").alias("n")).filter(F.col("n") > cap)


def streak_to_now(rows: DataFrame, key: str, time: str, good: Column) -> DataFrame:
    """Per key how many of its last rows in a row are good."""
    w = Window.partitionBy(key).orderBy(F.desc(time))
    broken = F.sum(F.when(F.coalesce(good, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("broken", broken).groupBy(key).agg(F.count_if(F.col("broken") == 0).alias("streak"))


def cooldown_breaks(rows: DataFrame, topic: str, time: str, seconds: int) -> DataFrame:
    """Rows that come less than ``seconds`` after the last of their topic, with ``gap``."""
    t = F.unix_timestamp(F.col(time).cast("timestamp"))
    gap = t - F.lag(t).over(Window.partitionBy(topic).orderBy(time))
    return rows.withColumn("gap", gap).filter(F.col("gap") < seconds)


def without_long_runs(rows: DataFrame, lane: str, order: Sequence[Column], most: int) -> DataFrame:
    """Rows with ``slot``: lanes take turns in blocks of ``most``, by the order within each, so no lane has a longer run
    while another has rows left."""
    place = F.row_number().over(Window.partitionBy(lane).orderBy(*order)) - 1
    return rows.withColumn("slot", F.floor(place / most).cast("long"))


def leaderboard(wide: DataFrame, kinds: Sequence[str], n: int) -> DataFrame:
    """The ``n`` best of all names over several columns of numbers: kind, name, score."""
    long = wide.unpivot(["name"], list(kinds), "kind", "score").filter("score is not null")
    return long.orderBy(F.desc("score"), "kind", "name").limit(n)
