"""Communities: metrics, tiers, ranking, saturation by brand, recommendations.

Operators take tables of posts, comments, labels and mentions with the columns they name, and a time anchor; they read
no clock. A community without rows in one of the tables gets 0 there. Nulls in a flag or number count as false or 0.
Empty tables give empty results. Ties are broken by name.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scoring as S


def removal_ratio(rows: DataFrame, community: str, removed: Column) -> DataFrame:
    """Per community the share of removed rows and its friendliness, 100 x (1 - share), rounded."""
    share = F.avg(F.coalesce(removed, F.lit(False)).cast("double"))
    sums = rows.groupBy(community).agg(share.alias("share"))
    return sums.select(community, F.round("share", 6).alias("removal_ratio"), F.round((1 - F.col("share")) * 100).cast("long").alias("friendliness"))


def penetration_by_brand(posts: DataFrame, mentions: DataFrame, community: str, brand: str, post: str) -> DataFrame:
    """Per community and brand: its posts, those that mention the brand, and their share. Brands that no post of it mentions have no row."""
    total = posts.groupBy(community).agg(F.count("*").alias("posts"))
    named = mentions.groupBy(community, brand).agg(F.countDistinct(post).alias("branded_posts"))
    return named.join(total, community).withColumn("penetration", F.round(F.col("branded_posts") / F.greatest("posts", F.lit(1)), 6))


def brand_penetration(posts: DataFrame, mentions: DataFrame, community: str = "community", post: str = "post") -> DataFrame:
    """Per community: posts, posts that mention a brand, and their share.

    Mentions are reduced to one row a post first, in part before the shuffle.
    """
    branded = mentions.select(post).distinct().withColumn("branded", F.lit(1))
    joined = posts.select(community, post).join(branded, post, "left")
    sums = joined.groupBy(community).agg(F.count("*").alias("posts"), F.count("branded").alias("branded_posts"))
    return sums.withColumn("penetration", F.round(F.col("branded_posts") / F.greatest(F.col("posts"), F.lit(1)), 6))


def growth_by_window(rows: DataFrame, community: str, time: str, anchor: Column, days: int = 7) -> DataFrame:
    """Rows in the last ``days`` against the ``days`` before: recent, previous, growth (1 without a past but a present)."""
    age = F.datediff(anchor, F.col(time))
    sums = rows.groupBy(community).agg(F.count_if(age.between(0, days - 1)).alias("recent"), F.count_if(age.between(days, 2 * days - 1)).alias("previous"))
    growth = F.when(F.col("previous") > 0, F.round(F.col("recent") / F.col("previous"), 6)).when(F.col("recent") > 0, 1.0).otherwise(0.0)
    return sums.withColumn("growth", growth)


def growth_week_over_month(rows: DataFrame, community: str, time: str, anchor: Column) -> DataFrame:
    """Rows of the last 7 days over a quarter of those of the last 30; 0 without any."""
    age = F.datediff(anchor, F.col(time))
    sums = rows.groupBy(community).agg(F.count_if(age.between(0, 6)).alias("week"), F.count_if(age.between(0, 29)).alias("month"))
    return sums.withColumn("growth", F.round(F.coalesce(F.try_divide(F.col("week"), F.col("month") / 4.0), F.lit(0.0)), 6))


def title_diversity(rows: DataFrame, community: str, title: str) -> DataFrame:
    """Per community: different words of its titles over all of them, 0 without words."""
    words = rows.select(community, F.explode(F.filter(F.split(S.plain(F.col(title)), r"\s+"), lambda w: w != "")).alias("word"))
    sums = words.groupBy(community, "word").agg(F.count("*").alias("n")).groupBy(community).agg(F.count("*").alias("different"), F.sum("n").alias("words"))
    every = rows.select(community).distinct().join(sums, community, "left")
    return every.select(community, F.round(F.coalesce(F.try_divide("different", "words"), F.lit(0.0)), 6).alias("diversity"))


def is_spam_title(title: Column) -> Column:
    """Three words or fewer, or fewer than half of them different."""
    words = F.filter(F.split(S.plain(title), r"\s+"), lambda w: w != "")
    return (F.size(words) <= 3) | (F.size(F.array_distinct(words)) < 0.5 * F.size(words))


def daily_trend(rows: DataFrame, community: str, time: str, anchor: Column, days: int, flag: Column | None = None) -> DataFrame:
    """Per community an array of its last ``days`` days, oldest first: rows, or with ``flag`` the share of rows that have it.

    A day is a bucket of an aggregate; an array has ``days`` entries, however many rows there are.
    """
    age = F.datediff(anchor, F.col(time))
    daily = rows.select(F.col(community), age.alias("age"), *([] if flag is None else [flag.alias("flag")])).filter(F.col("age").between(0, days - 1))
    value = F.count("*").cast("double") if flag is None else F.avg(F.coalesce(F.col("flag"), F.lit(False)).cast("double"))
    sums = daily.groupBy(community, "age").agg(value.alias("v")).groupBy(community).agg(F.map_from_entries(F.collect_list(F.struct("age", "v"))).alias("m"))
    listed = F.array(*(F.round(F.coalesce(F.try_element_at("m", F.lit(days - 1 - d)), F.lit(0.0)), 6) for d in range(days)))
    return sums.select(community, listed.alias("trend"))


def has_surge(trend: Column, factor: float = 2.0) -> Column:
    """Is the last value at least ``factor`` times the mean, and the mean above 0? False of an empty array."""
    mean = F.aggregate(trend, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(trend), F.lit(1))
    return (mean > 0) & (F.coalesce(F.try_element_at(trend, F.lit(-1)), F.lit(0.0)) >= mean * factor)


def crawl_priority(posts_per_day: Column, pain_density: Column, surge: Column) -> Column:
    score = F.coalesce(posts_per_day, F.lit(0.0)) * 0.3 + F.coalesce(pain_density, F.lit(0.0)) * 0.7
    return F.round(F.when(surge, score * 1.2).otherwise(score), 4)


def community_metrics(posts: DataFrame, comments: DataFrame, days: int, anchor: Column) -> DataFrame:
    """Measures of each community in the last ``days`` days.

    ``posts``: community, ts, title, score, comments, pain, solution, labelled (booleans), brands (number of mentions),
    feature (boolean). ``comments``: community, ts. One pass over the posts but for the titles' words.
    """
    span = max(1, days)
    inside = lambda rows: rows.filter(F.datediff(anchor, F.col("ts")).between(0, span - 1))
    recent = inside(posts)
    yes = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    own = recent.groupBy("community").agg(
        F.count("*").alias("n"), yes("pain").alias("pains"), yes("solution").alias("solutions"), yes("labelled").alias("labelled"), yes("feature").alias("features"), F.sum(F.coalesce("brands", F.lit(0))).alias("brand_mentions"),
        F.count_if(is_spam_title(F.col("title"))).alias("spam"), F.avg(F.coalesce("score", F.lit(0)) + F.coalesce("comments", F.lit(0))).alias("engagement"),
    )
    others = inside(comments).groupBy("community").agg(F.count("*").alias("n_comments"))
    growth = growth_by_window(posts, "community", "ts", anchor).select("community", "growth")
    both = own.join(others, "community", "left").join(growth, "community", "left").join(title_diversity(recent, "community", "title"), "community", "left")
    n, c = F.col("n"), F.coalesce("n_comments", F.lit(0))
    mood = F.coalesce(F.try_divide(F.col("solutions") - F.col("pains"), F.col("solutions") + F.col("pains")), F.lit(0.0))
    return both.select(
        "community", F.round(n / span, 2).alias("posts_per_day"), F.round(c / span, 2).alias("comments_per_day"), F.round(F.col("pains") / (n + c), 3).alias("pain_density"), F.col("brand_mentions").cast("long").alias("brand_mentions"),
        F.round(F.col("features") / n, 3).alias("feature_coverage"), F.round(mood, 3).alias("sentiment"), F.round(F.coalesce("growth", F.lit(0.0)), 3).alias("growth_rate"), F.round(F.coalesce("diversity", F.lit(0.0)), 3).alias("diversity"),
        F.round(F.col("labelled") / n, 3).alias("labeling_coverage"), F.round(F.col("spam") / n, 3).alias("spam_ratio"), F.round("engagement", 2).alias("avg_engagement"),
    )


@dataclass(frozen=True)
class TierRule:
    """Least values for a promotion."""

    posts_per_day: float
    pain_density: float
    quality: float
    labeling_coverage: float
    growth_rate: float


@dataclass(frozen=True)
class TierRules:
    first: TierRule = TierRule(100, 0.2, 0.7, 0.8, 1.1)
    second: TierRule = TierRule(40, 0.1, 0.5, 0.6, 0.9)
    #: Below any of these: third.
    third_posts: float = 20
    third_pain: float = 0.05
    third_labeling: float = 0.4
    third_growth: float = 0.7
    #: Beyond any of these: out of the pool.
    remove_posts: float = 1
    remove_spam: float = 0.6
    remove_labeling: float = 0.1


def recommended_tier(tier: Column, quality: Column, rules: TierRules) -> Column:
    """REMOVE, T1, T2, T3 or the current tier, in that order of tests, of the columns of ``community_metrics``."""
    m = F.col
    remove = (m("posts_per_day") < rules.remove_posts) | (m("spam_ratio") > rules.remove_spam) | (m("labeling_coverage") < rules.remove_labeling)
    q = F.coalesce(quality, F.lit(0.0))
    reaches = lambda r: (m("posts_per_day") >= r.posts_per_day) & (m("pain_density") >= r.pain_density) & (q >= r.quality) & (m("labeling_coverage") >= r.labeling_coverage) & (m("growth_rate") >= r.growth_rate)
    low = (m("posts_per_day") < rules.third_posts) | (m("pain_density") < rules.third_pain) | (m("labeling_coverage") < rules.third_labeling) | (m("growth_rate") < rules.third_growth)
    keep = F.when(tier.isin("T1", "T2", "T3"), tier).otherwise("T3")
    return F.when(remove, "REMOVE").when(reaches(rules.first), "T1").when(reaches(rules.second), "T2").when(low, "T3").otherwise(keep)


def _rank(tier: Column, otherwise: int) -> Column:
    return F.when(tier == "T1", 3).when(tier == "T2", 2).when(tier == "T3", 1).when(tier == "REMOVE", 0).otherwise(otherwise)


def tier_confidence(tier: Column, suggested: Column, rules: TierRules) -> Column:
    """How far the metrics are beyond the suggested tier's rule, at most 1; four fifths of it over a gap of two tiers.

    0.5 of a removal.
    """
    part = lambda c: F.least(c, F.lit(2.0)) / 2.0
    m = F.col
    up = lambda r: (part(m("posts_per_day") / r.posts_per_day) + part(m("pain_density") / r.pain_density) + part(m("labeling_coverage") / r.labeling_coverage)) / 3.0
    down = (part(F.lit(rules.third_posts) / F.greatest(m("posts_per_day"), F.lit(1e-6))) + part(F.lit(rules.third_pain) / F.greatest(m("pain_density"), F.lit(1e-3))) + part(m("labeling_coverage") / rules.third_labeling)) / 3.0
    base = F.when(suggested == "T1", up(rules.first)).when(suggested == "T2", up(rules.second)).otherwise(down)
    gap = F.abs(_rank(tier, 1) - _rank(suggested, 1))
    scaled = F.when(gap > 1, base * 0.8).otherwise(base)
    return F.when(suggested == "REMOVE", 0.5).otherwise(F.round(F.least(scaled, F.lit(1.0)), 2))


def community_health() -> Column:
    m = F.col
    critical = (m("posts_per_day") < 10) | (m("spam_ratio") > 0.5) | (m("labeling_coverage") < 0.3)
    warning = (m("posts_per_day") < 30) | (m("growth_rate") < 0.8) | (m("labeling_coverage") < 0.6)
    return F.when(critical, "critical").when(warning, "warning").otherwise("healthy")


def tier_priority(confidence: Column, health: Column, quality: Column) -> Column:
    p = F.col("posts_per_day")
    by_posts = F.when(p > 100, 30).when(p > 50, 20).when(p < 10, 25).otherwise(0)
    by_health = F.when(health == "critical", 20).when(health == "warning", 10).otherwise(0)
    return (F.floor(confidence * 50) + by_posts + by_health + F.when(F.coalesce(quality, F.lit(0.0)) >= 0.8, 5).otherwise(0)).cast("long")


def tier_reasons(tier: Column, suggested: Column, rules: TierRules) -> Column:
    """Names of the reasons for a change of tier, in a fixed order; none for a removal."""
    m = F.col
    rising = _rank(suggested, 0) > _rank(tier, 0)
    need = lambda c: F.when(suggested == "T1", getattr(rules.first, c)).when(suggested == "T2", getattr(rules.second, c))
    up = [(m("posts_per_day") >= need("posts_per_day"), "many posts"), (m("pain_density") >= need("pain_density"), "dense pain"), (m("growth_rate") > 1.1, "growing"), (m("labeling_coverage") >= 0.9, "well labelled")]
    third = suggested == "T3"
    down = [(third & (m("posts_per_day") < rules.third_posts), "few posts"), (third & (m("pain_density") < rules.third_pain), "little pain"), (m("growth_rate") < 0.8, "shrinking"), (m("spam_ratio") > 0.3, "spam")]
    listed = lambda pairs: F.array_compact(F.array(*(F.when(c, F.lit(text)) for c, text in pairs)))
    return F.when(suggested == "REMOVE", F.array().cast("array<string>")).when(rising, listed(up)).otherwise(listed(down))


def signal_density(communities: DataFrame, tokens: Sequence[str]) -> Column:
    """The ranking score of a community of columns community, hits, posts, ratio, density and penetration.

    .3 hits / (posts + 10), .3 a token of three letters or more in the name, .2 pain (.7 ratio to 2, .3 density to .5),
    .1 log10(hits + 1) / 3, .1 brands; each part at most 1.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    name = F.regexp_replace(F.lower("community"), "r/", "")
    dense = F.least(zero("hits") / (zero("posts") + 10.0), F.lit(1.0))
    named = S.points(S.any_of(name, [t.lower() for t in tokens if len(t) > 2]), 1.0)
    pain = F.least(zero("ratio"), F.lit(2.0)) / 2.0 * 0.7 + F.least(zero("density"), F.lit(0.5)) / 0.5 * 0.3
    volume = F.least(F.log10(zero("hits") + 1), F.lit(3.0)) / 3.0
    return F.round(0.3 * dense + 0.3 * named + 0.2 * pain + 0.1 * volume + 0.1 * F.least(zero("penetration"), F.lit(1.0)), 6)


def saturation_matrix(posts: DataFrame, mentions: DataFrame, high: float = 0.8, middle: float = 0.4) -> DataFrame:
    """Per community and brand that is mentioned anywhere: posts, mentions (posts that mention it), saturation and class.

    ``posts``: community, post; ``mentions``: post, brand. The grid is communities by brands, two small dimensions: the
    brands are sent to the communities as one array.
    """
    brands = mentions.select("brand").filter("brand is not null").distinct().agg(F.sort_array(F.collect_set("brand")).alias("brands"))
    totals = posts.groupBy("community").agg(F.count("*").alias("posts"))
    counts = posts.join(mentions.select("post", "brand").distinct(), "post").groupBy("community", "brand").agg(F.count("*").alias("mentions"))
    grid = totals.join(F.broadcast(brands)).select("community", "posts", F.explode("brands").alias("brand"))
    found = grid.join(counts, ["community", "brand"], "left").withColumn("mentions", F.coalesce("mentions", F.lit(0)))
    share = F.least(F.lit(1.0), F.col("mentions") / F.greatest(F.col("posts"), F.lit(1)))
    return found.withColumn("saturation", F.round(share, 6)).withColumn("class", F.when(share >= high, "high").when(share >= middle, "middle").otherwise("open"))


def overall_saturation(matrix: DataFrame, top: int = 5) -> DataFrame:
    """Per community the sum of its ``top`` largest saturations, at most 1, and its most saturated brand."""
    place = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("saturation"), "brand"))
    best = matrix.withColumn("place", place).filter(F.col("place") <= top)
    return best.groupBy("community").agg(F.round(F.least(F.lit(1.0), F.sum("saturation")), 6).alias("overall"), F.min_by("brand", "place").alias("top_brand"))


def opportunity_windows(matrix: DataFrame, below: float, top: int) -> DataFrame:
    """Per brand the ``top`` communities with a saturation under ``below``: the least saturated, then those with most posts."""
    low = matrix.filter((F.col("saturation") < below) & (F.col("posts") > 0))
    place = F.row_number().over(Window.partitionBy("brand").orderBy("saturation", F.desc("posts"), "community"))
    return low.withColumn("place", place.cast("long")).filter(F.col("place") <= top).select("brand", "community", "saturation", "posts", "place")


#: Weights and caps of the recommendation score: (column, weight, cap).
RECOMMENDATION_WEIGHTS = (("recent", 2.0, 30.0), ("historical", 0.1, 20.0), ("observations", 0.5, 15.0), ("labels", 0.2, 10.0), ("entities", 0.2, 10.0), ("quality", 10.0, 10.0))
STATUS_BONUS = {"READY": 20.0, "HISTORICAL": 8.0, "WATCHING": 0.0}


def recommendation(generic: Column, weights: Sequence[tuple[str, float, float]] = RECOMMENDATION_WEIGHTS, bonus: Mapping[str, float] = STATUS_BONUS, generic_factor: float = 0.6) -> tuple[Column, Column]:
    """(status, score) of a community of columns recent, historical, observations, labels, entities, quality."""
    status = S.recommendation_status(F.col("recent"), F.col("historical"), F.col("observations"), F.col("labels") + F.col("entities"))
    extra = S.total([S.points(status == name, value) for name, value in bonus.items()])
    score = extra + S.capped_sum([(F.col(c), w, cap) for c, w, cap in weights])
    return status, F.round(F.when(generic, score * generic_factor).otherwise(score), 4)


def with_generic_cap(ranked: DataFrame, generic: Column, limit: int, share: float, *order: Column) -> DataFrame:
    """The first ``limit`` in order, at most ``share`` of ``limit`` (rounded down, one at least) of them generic."""
    most = max(1, int(limit * share))
    of_role = F.row_number().over(Window.partitionBy(generic).orderBy(*order))
    kept = ranked.withColumn("of_role", of_role).filter(~generic | (F.col("of_role") <= most)).drop("of_role")
    return kept.orderBy(*order).limit(limit)


def merged_snapshots(signals: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``signals`` (community, recent, latest) with the larger recent and later latest of ``snapshots``, by lower-case name."""
    key = lambda c: F.regexp_replace(F.lower(F.trim(F.col(c))), "^r/", "")
    newer = snapshots.select(key("community").alias("key"), F.col("recent").alias("new_recent"), F.col("latest").alias("new_latest")).groupBy("key").agg(F.max("new_recent").alias("new_recent"), F.max("new_latest").alias("new_latest"))
    joined = signals.withColumn("key", key("community")).join(newer, "key", "left")
    return joined.select("community", F.greatest("recent", "new_recent").alias("recent"), F.greatest("latest", "new_latest").alias("latest"))


def value_score(evidence: Column, candidates: Column, drafts: Column, published: Column, duplicates: Column, rejects: Column, topics: Column, tagged: Column) -> Column:
    """0 to 100: 4 a candidate, 8 a draft, 15 a published one, 5 for each of three topics, -6 a duplicate or reject, 10 for tags or -10."""
    raw = candidates * 4 + drafts * 8 + published * 15 + F.least(topics, F.lit(3)) * 5 - duplicates * 6 - rejects * 6 + F.when(tagged, 10).otherwise(-10)
    return F.when(evidence <= 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), raw))).cast("long")


def archetype(posts_per_day: Column, engagement: Column) -> Column:
    """How often and how much: firehose, steady, gem or quiet."""
    return F.when((posts_per_day >= 20) & (engagement >= 10), "firehose").when(posts_per_day >= 20, "steady").when(engagement >= 10, "gem").otherwise("quiet")
