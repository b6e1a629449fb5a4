"""Registered queries on communities, with their SQL: metrics, tiers, ranking, saturation, recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scoring as S
from tidemark.operators import analytics as A
from tidemark.operators import community as C
from tidemark.plans.catalogue import register
from tidemark.plans.posts import MENTIONS, POSTS, mentions, order_posts, posts, sql_any
from tidemark.session import table

DAY = "2024-01-31"


def _now():
    return F.lit(DAY).cast("date")


@register("removal_ratio", "SELECT community, round(avg(CASE WHEN status = 'F' THEN 1.0 ELSE 0.0 END), 6) AS removal_ratio, CAST(round((1 - avg(CASE WHEN status = 'F' THEN 1.0 ELSE 0.0 END)) * 100) AS BIGINT) AS friendliness FROM (WITH " + MENTIONS + " SELECT * FROM order_posts) GROUP BY community")
def removal_ratio(spark, folder):
    return C.removal_ratio(order_posts(spark, folder), "community", F.col("status") == "F")


@register(
    "brand_penetration",
    f"WITH {MENTIONS} SELECT community, brand, n AS posts, count(DISTINCT post) AS branded_posts, round(count(DISTINCT post) / greatest(n, 1), 6) AS penetration FROM mentions JOIN (SELECT community, count(*) AS n FROM order_posts GROUP BY 1) USING (community) GROUP BY community, brand, n",
)
def brand_penetration(spark, folder):
    return C.penetration_by_brand(order_posts(spark, folder), mentions(spark, folder), "community", "brand", "post")


GROWTH = f"""SELECT event_type, count(*) FILTER (WHERE age BETWEEN 0 AND 6) AS recent, count(*) FILTER (WHERE age BETWEEN 7 AND 13) AS previous FROM (SELECT event_type, date_diff('day', CAST(ts AS DATE), DATE '{DAY}') AS age FROM events) GROUP BY event_type"""


@register("growth_by_window", f"SELECT event_type, recent, previous, CASE WHEN previous > 0 THEN round(recent / previous, 6) WHEN recent > 0 THEN 1.0 ELSE 0.0 END AS growth FROM ({GROWTH})")
def growth_by_window(spark, folder):
    return C.growth_by_window(table(spark, folder, "events"), "event_type", "ts", _now())


@register(
    "growth_week_over_month",
    f"""SELECT user_id, week, month, round(coalesce(week / nullif(month / 4.0::DOUBLE, 0), 0), 6) AS growth FROM (SELECT user_id, count(*) FILTER (WHERE age BETWEEN 0 AND 6) AS week, count(*) FILTER (WHERE age BETWEEN 0 AND 29) AS month
FROM (SELECT user_id, date_diff('day', CAST(ts AS DATE), DATE '{DAY}') AS age FROM events) GROUP BY user_id)""",
)
def growth_week_over_month(spark, folder):
    return C.growth_week_over_month(table(spark, folder, "events"), "user_id", "ts", _now())


WORDS = r"list_filter(regexp_split_to_array(lower(title), '[ \t\n\r]+'), lambda w: w <> '')"


@register("title_diversity", f"WITH {POSTS}, w AS (SELECT source, unnest({WORDS}) AS w FROM posts) SELECT source, round(coalesce(count(DISTINCT w) / nullif(count(w), 0), 0), 6) AS diversity FROM (SELECT DISTINCT source FROM posts) LEFT JOIN w USING (source) GROUP BY source")
def title_diversity(spark, folder):
    return C.title_diversity(posts(spark, folder), "source", "title")


SPAM_TITLE = f"len({WORDS}) <= 3 OR len(list_distinct({WORDS})) < 0.5 * len({WORDS})"


@register("spam_ratio", f"WITH {POSTS} SELECT source, round(avg(CASE WHEN {SPAM_TITLE} THEN 1.0 ELSE 0.0 END), 6) AS spam_ratio, round(avg(coalesce(score, 0) + coalesce(comments, 0)), 4) AS engagement FROM posts GROUP BY source")
def spam_ratio(spark, folder):
    return posts(spark, folder).groupBy("source").agg(
        F.round(F.avg(C.is_spam_title(F.col("title")).cast("int")), 6).alias("spam_ratio"), F.round(F.avg(F.coalesce("score", F.lit(0)) + F.coalesce("comments", F.lit(0))), 4).alias("engagement")
    )


TREND = f"""SELECT event_type, d, coalesce(n, 0) AS n, coalesce(p, 0) AS p FROM (SELECT DISTINCT event_type FROM events) CROSS JOIN (SELECT unnest(range(7)) AS d) LEFT JOIN
(SELECT event_type, date_diff('day', CAST(ts AS DATE), DATE '{DAY}') AS d, count(*) AS n, avg(CASE WHEN value > 40 THEN 1.0 ELSE 0.0 END) AS p FROM events GROUP BY 1, 2) USING (event_type, d)"""


@register("daily_trend", f"SELECT event_type, array_to_string(list(CAST(n AS BIGINT) ORDER BY d DESC), ',') AS trend, array_to_string(list(CAST(round(p * 1000000) AS BIGINT) ORDER BY d DESC), ',') AS density FROM ({TREND}) GROUP BY event_type")
def daily_trend(spark, folder):
    events = table(spark, folder, "events")
    counts = C.daily_trend(events, "event_type", "ts", _now(), 7)
    dense = C.daily_trend(events, "event_type", "ts", _now(), 7, F.col("value") > 40).withColumnRenamed("trend", "dense")
    listed = lambda c, k: F.array_join(F.transform(c, lambda x: F.round(x * k).cast("long").cast("string")), ",")
    return counts.join(dense, "event_type").select("event_type", listed("trend", 1).alias("trend"), listed("dense", 1_000_000).alias("density"))


@register(
    "crawl_priority",
    f"""WITH t AS ({TREND}), s AS (SELECT event_type, avg(n) AS mean_n, avg(round(p, 6)) AS mean_p, max(round(p, 6)) FILTER (WHERE d = 0) AS last_p, sum(n) AS n FROM t GROUP BY event_type)
SELECT event_type, mean_p > 0 AND last_p >= 1.05::DOUBLE * mean_p AS surge, round((mean_n * 0.3 + mean_p * 0.7) * CASE WHEN mean_p > 0 AND last_p >= 1.05::DOUBLE * mean_p THEN 1.2::DOUBLE ELSE 1.0 END, 4) AS priority FROM s""",
)
def crawl_priority(spark, folder):
    events = table(spark, folder, "events")
    counts, dense = C.daily_trend(events, "event_type", "ts", _now(), 7), C.daily_trend(events, "event_type", "ts", _now(), 7, F.col("value") > 40).withColumnRenamed("trend", "dense")
    mean = lambda c: F.aggregate(F.col(c), F.lit(0.0), lambda s, x: s + x) / 7
    rows = counts.join(dense, "event_type").select("event_type", C.has_surge(F.col("dense"), 1.05).alias("surge"), mean("trend").alias("n"), mean("dense").alias("p"))
    return rows.select("event_type", "surge", C.crawl_priority(F.col("n"), F.col("p"), F.col("surge")).alias("priority"))


#: Posts of a community: events by type, a document of the same number as title where there is one.
METRIC_POSTS = """p AS (SELECT event_type AS community, ts, coalesce(split_part(text, chr(10), 1), event_type) AS title, value AS score, CAST(json_extract(props, '$.k') AS BIGINT) AS comments, coalesce(quality = 0, false) AS pain, coalesce(quality = 1, false) AS solution,
quality IS NOT NULL OR user_id % 3 = 0 AS labelled, user_id % 2 AS brands, value > 40 AS feature FROM events LEFT JOIN documents ON doc_id = event_id LEFT JOIN labels USING (doc_id)),
c AS (SELECT event_type AS community, ts FROM events)"""
METRICS = f"""{METRIC_POSTS}, a AS (SELECT *, date_diff('day', CAST(ts AS DATE), DATE '{DAY}') AS age, {WORDS} AS w FROM p),
g AS (SELECT community, count(*) FILTER (WHERE age BETWEEN 0 AND 6) AS r, count(*) FILTER (WHERE age BETWEEN 7 AND 13) AS q FROM a GROUP BY community),
d AS (SELECT community, count(DISTINCT x) AS different, count(x) AS words FROM (SELECT community, unnest(w) AS x FROM a WHERE age BETWEEN 0 AND 29) GROUP BY community),
n AS (SELECT community, count(*) AS n_comments FROM c WHERE date_diff('day', CAST(ts AS DATE), DATE '{DAY}') BETWEEN 0 AND 29 GROUP BY community),
s AS (SELECT community, count(*) AS n, count(*) FILTER (WHERE pain) AS pains, count(*) FILTER (WHERE solution) AS solutions, count(*) FILTER (WHERE labelled) AS labelled, count(*) FILTER (WHERE feature) AS features, sum(brands) AS brands,
  count(*) FILTER (WHERE len(w) <= 3 OR len(list_distinct(w)) < 0.5 * len(w)) AS spam, avg(score + comments) AS engagement FROM a WHERE age BETWEEN 0 AND 29 GROUP BY community),
m AS (SELECT community, round(n / 30, 2) AS posts_per_day, round(coalesce(n_comments, 0) / 30, 2) AS comments_per_day, round(pains / (n + coalesce(n_comments, 0)), 3) AS pain_density, CAST(brands AS BIGINT) AS brand_mentions, round(features / n, 3) AS feature_coverage,
  round(coalesce((solutions - pains) / nullif(solutions + pains, 0), 0), 3) AS sentiment, round(CASE WHEN q > 0 THEN r / q WHEN r > 0 THEN 1.0 ELSE 0.0 END, 3) AS growth_rate, round(coalesce(different / nullif(words, 0), 0), 3) AS diversity,
  round(labelled / n, 3) AS labeling_coverage, round(spam / n, 3) AS spam_ratio, round(engagement, 2) AS avg_engagement FROM s LEFT JOIN n USING (community) LEFT JOIN g USING (community) LEFT JOIN d USING (community))"""


def _metrics(spark, folder):
    events, docs, labels = (table(spark, folder, t) for t in ("events", "documents", "labels"))
    rows = events.join(docs.select("doc_id", "text"), F.col("event_id") == F.col("doc_id"), "left").join(labels, "doc_id", "left")
    known = lambda c: F.coalesce(c, F.lit(False))
    p = rows.select(
        F.col("event_type").alias("community"), "ts", F.coalesce(F.substring_index("text", "\n", 1), "event_type").alias("title"), F.col("value").alias("score"), F.get_json_object("props", "$.k").cast("long").alias("comments"), known(F.col("quality") == 0).alias("pain"),
        known(F.col("quality") == 1).alias("solution"), (F.col("quality").isNotNull() | (F.col("user_id") % 3 == 0)).alias("labelled"), (F.col("user_id") % 2).alias("brands"), (F.col("value") > 40).alias("feature"),
    )
    c = events.select(F.col("event_type").alias("community"), "ts")
    return C.community_metrics(p, c, 30, _now())


@register("community_metrics", f"WITH {METRICS} SELECT * FROM m")
def community_metrics(spark, folder):
    return _metrics(spark, folder)


R = C.TierRules(C.TierRule(100, 0.001, 0.7, 0.3, 0.9), C.TierRule(20, 0.001, 0.3, 0.3, 0.8), 15, 0.001, 0.2, 0.7, 1, 0.999, 0.1)
_REACH = lambda r: f"posts_per_day >= {r.posts_per_day} AND pain_density >= {r.pain_density} AND quality >= {r.quality} AND labeling_coverage >= {r.labeling_coverage} AND growth_rate >= {r.growth_rate}"
_UP = lambda r: f"(least(posts_per_day / {r.posts_per_day}::DOUBLE, 2.0) / 2 + least(pain_density / {r.pain_density}::DOUBLE, 2.0) / 2 + least(labeling_coverage / {r.labeling_coverage}::DOUBLE, 2.0) / 2) / 3"
_RANKED = "CASE {} WHEN 'T1' THEN 3 WHEN 'T2' THEN 2 WHEN 'T3' THEN 1 WHEN 'REMOVE' THEN 0 ELSE {} END"
TIERS = f"""{METRICS}, q AS (SELECT *, CASE community WHEN 'view' THEN 'T1' WHEN 'click' THEN 'T2' WHEN 'error' THEN 'T9' ELSE 'T3' END AS tier, CASE community WHEN 'view' THEN 0.9 WHEN 'click' THEN 0.5 ELSE 0.2 END AS quality FROM m),
t AS (SELECT *, CASE WHEN posts_per_day < {R.remove_posts} OR spam_ratio > {R.remove_spam} OR labeling_coverage < {R.remove_labeling} THEN 'REMOVE' WHEN {_REACH(R.first)} THEN 'T1' WHEN {_REACH(R.second)} THEN 'T2'
  WHEN posts_per_day < {R.third_posts} OR pain_density < {R.third_pain} OR labeling_coverage < {R.third_labeling} OR growth_rate < {R.third_growth} THEN 'T3' WHEN tier IN ('T1', 'T2', 'T3') THEN tier ELSE 'T3' END AS suggested,
  CASE WHEN posts_per_day < 10 OR spam_ratio > 0.5 OR labeling_coverage < 0.3 THEN 'critical' WHEN posts_per_day < 30 OR growth_rate < 0.8 OR labeling_coverage < 0.6 THEN 'warning' ELSE 'healthy' END AS health FROM q),
b AS (SELECT *, CASE suggested WHEN 'T1' THEN {_UP(R.first)} WHEN 'T2' THEN {_UP(R.second)}
  ELSE (least({R.third_posts} / greatest(posts_per_day, 0.000001::DOUBLE), 2.0) / 2 + least({R.third_pain}::DOUBLE / greatest(pain_density, 0.001::DOUBLE), 2.0) / 2 + least(labeling_coverage / {R.third_labeling}::DOUBLE, 2.0) / 2) / 3 END AS base FROM t),
f AS (SELECT *, CASE WHEN suggested = 'REMOVE' THEN 0.5 ELSE round(least(CASE WHEN abs({_RANKED.format('tier', 1)} - {_RANKED.format('suggested', 1)}) > 1 THEN base * 0.8::DOUBLE ELSE base END, 1.0), 2) END AS confidence FROM b),
r AS (SELECT *, {_RANKED.format('suggested', 0)} > {_RANKED.format('tier', 0)} AS rising FROM f)"""


@register(
    "tier_suggestions",
    f"""WITH {TIERS} SELECT community, tier, suggested, confidence, health,
CAST(floor(confidence * 50) + CASE WHEN posts_per_day > 100 THEN 30 WHEN posts_per_day > 50 THEN 20 WHEN posts_per_day < 10 THEN 25 ELSE 0 END + CASE health WHEN 'critical' THEN 20 WHEN 'warning' THEN 10 ELSE 0 END + CASE WHEN quality >= 0.8 THEN 5 ELSE 0 END AS BIGINT) AS priority,
array_to_string(list_filter(CASE WHEN suggested = 'REMOVE' THEN [] WHEN rising THEN [
  CASE WHEN suggested = 'T1' AND posts_per_day >= {R.first.posts_per_day} OR suggested = 'T2' AND posts_per_day >= {R.second.posts_per_day} THEN 'many posts' END,
  CASE WHEN suggested = 'T1' AND pain_density >= {R.first.pain_density} OR suggested = 'T2' AND pain_density >= {R.second.pain_density} THEN 'dense pain' END, CASE WHEN growth_rate > 1.1 THEN 'growing' END, CASE WHEN labeling_coverage >= 0.9 THEN 'well labelled' END]
ELSE [CASE WHEN suggested = 'T3' AND posts_per_day < {R.third_posts} THEN 'few posts' END, CASE WHEN suggested = 'T3' AND pain_density < {R.third_pain} THEN 'little pain' END, CASE WHEN growth_rate < 0.8 THEN 'shrinking' END, CASE WHEN spam_ratio > 0.3 THEN 'spam' END] END, lambda x: x IS NOT NULL), ',') AS reasons FROM r""",
)
def tier_suggestions(spark, folder):
    c = F.col("community")
    tier = F.when(c == "view", "T1").when(c == "click", "T2").when(c == "error", "T9").otherwise("T3")
    quality = F.when(c == "view", 0.9).when(c == "click", 0.5).otherwise(0.2)
    rows = _metrics(spark, folder).withColumns({"tier": tier, "quality": quality})
    rows = rows.withColumn("suggested", C.recommended_tier(F.col("tier"), F.col("quality"), R)).withColumn("health", C.community_health())
    rows = rows.withColumn("confidence", C.tier_confidence(F.col("tier"), F.col("suggested"), R))
    reasons = F.array_join(C.tier_reasons(F.col("tier"), F.col("suggested"), R), ",")
    return rows.select("community", "tier", "suggested", "confidence", "health", C.tier_priority(F.col("confidence"), F.col("health"), F.col("quality")).alias("priority"), reasons.alias("reasons"))


@register(
    "community_ranking",
    f"""WITH {POSTS}, h AS (SELECT source AS community, count(*) AS posts, count(*) FILTER (WHERE {sql_any('lower(text)', ['thatin', 'hehely'])}) AS hits, count(*) FILTER (WHERE contains(text, '%')) / count(*) AS penetration FROM posts GROUP BY source),
r AS (SELECT source AS community, count(*) FILTER (WHERE quality = 0) AS p, count(*) FILTER (WHERE quality = 1) AS s, avg(CASE WHEN quality = 0 THEN 1.0 ELSE 0.0 END) AS d FROM documents JOIN labels USING (doc_id) GROUP BY source)
SELECT community, round(0.3::DOUBLE * least(hits / (posts + 10.0::DOUBLE), 1.0) + 0.3::DOUBLE * CASE WHEN contains(lower(community), 'src1') THEN 1.0::DOUBLE ELSE 0.0 END
+ 0.2::DOUBLE * (least(coalesce(round(p / greatest(s, 1), 6), 0), 2.0) / 2 * 0.7::DOUBLE + least(coalesce(round(d, 6), 0), 0.5) / 0.5::DOUBLE * 0.3::DOUBLE) + 0.1::DOUBLE * (least(log10(hits + 1), 3.0) / 3) + 0.1::DOUBLE * least(penetration, 1.0), 6) AS score FROM h LEFT JOIN r USING (community)""",
)
def community_ranking(spark, folder):
    rows = posts(spark, folder)
    hits = rows.groupBy(F.col("source").alias("community")).agg(F.count("*").alias("posts"), F.count_if(S.any_of(F.lower("text"), ["thatin", "hehely"])).alias("hits"), (F.count_if(F.col("text").contains("%")) / F.count("*")).alias("penetration"))
    labelled = table(spark, folder, "documents").select("doc_id", F.col("source").alias("community")).join(table(spark, folder, "labels"), "doc_id")
    pain = A.ratio_by(labelled, "community", F.col("quality"), 0, 1).join(A.density(labelled, "community", F.col("quality") == 0, "density"), "community")
    joined = hits.join(pain, "community", "left")
    return joined.select("community", C.signal_density(joined, ["src1", "x"]).alias("score"))


MATRIX = f"""{MENTIONS}, t AS (SELECT community, count(*) AS posts FROM order_posts GROUP BY community), k AS (SELECT community, brand, count(DISTINCT post) AS mentions FROM mentions GROUP BY 1, 2),
x AS (SELECT community, brand, posts, coalesce(mentions, 0) AS mentions, least(1.0, coalesce(mentions, 0) / greatest(posts, 1)) AS share FROM t CROSS JOIN (SELECT DISTINCT brand FROM mentions) LEFT JOIN k USING (community, brand)),
matrix AS (SELECT community, brand, posts, mentions, round(share, 6) AS saturation, CASE WHEN share >= 0.25 THEN 'high' WHEN share >= 0.15 THEN 'middle' ELSE 'open' END AS class FROM x)"""


def _matrix(spark, folder):
    return C.saturation_matrix(order_posts(spark, folder), mentions(spark, folder), 0.25, 0.15)


@register("saturation_matrix", f"WITH {MATRIX} SELECT * FROM matrix")
def saturation_matrix(spark, folder):
    return _matrix(spark, folder)


@register("overall_saturation", f"WITH {MATRIX}, b AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY saturation DESC, brand) AS k FROM matrix) SELECT community, round(least(1.0, sum(saturation)), 6) AS overall, arg_min(brand, k) AS top_brand FROM b WHERE k <= 5 GROUP BY community")
def overall_saturation(spark, folder):
    return C.overall_saturation(_matrix(spark, folder))


@register("opportunity_windows", f"WITH {MATRIX} SELECT brand, community, saturation, posts, place FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY saturation, posts DESC, community) AS place FROM matrix WHERE saturation < 0.2 AND posts > 0) WHERE place <= 5")
def opportunity_windows(spark, folder):
    return C.opportunity_windows(_matrix(spark, folder), 0.2, 5)


SIGNALS = f"""s AS (SELECT user_id AS community, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-16') AS recent, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-16' AND event_type = 'view') AS historical, count(*) FILTER (WHERE event_type = 'purchase') AS observations,
count(*) FILTER (WHERE event_type = 'error') AS labels, count(*) FILTER (WHERE event_type = 'signup') AS entities, avg(value) / 100 AS quality FROM events GROUP BY user_id),
r AS (SELECT *, CASE WHEN recent > 0 AND observations + historical + (labels + entities) > 0 THEN 'READY' WHEN historical > 0 OR observations > 0 THEN 'HISTORICAL' ELSE 'WATCHING' END AS status FROM s),
scored AS (SELECT community, status, round((CASE status WHEN 'READY' THEN 20.0::DOUBLE WHEN 'HISTORICAL' THEN 8.0 ELSE 0.0 END + ({' + '.join(f"least(greatest(coalesce({c}, 0), 0) * {w}::DOUBLE, {cap})" for c, w, cap in C.RECOMMENDATION_WEIGHTS)})) * CASE WHEN community % 4 = 0 THEN 0.6::DOUBLE ELSE 1.0 END, 4) AS score FROM r)"""


def _recommended(spark, folder):
    kind = lambda k: F.count_if(F.col("event_type") == k)
    late = F.col("ts") >= F.expr("timestamp_ntz'2024-01-16'")
    rows = table(spark, folder, "events").groupBy(F.col("user_id").alias("community")).agg(
        F.count_if(late).alias("recent"), F.count_if(~late & (F.col("event_type") == "view")).alias("historical"), kind("purchase").alias("observations"), kind("error").alias("labels"), kind("signup").alias("entities"), (F.avg("value") / 100).alias("quality")
    )
    status, score = C.recommendation(F.col("community") % 4 == 0)
    return rows.select("community", status.alias("status"), score.alias("score"))


@register("recommendation_scores", f"WITH {SIGNALS} SELECT * FROM scored")
def recommendation_scores(spark, folder):
    return _recommended(spark, folder)


@register("recommendations_with_cap", f"WITH {SIGNALS}, g AS (SELECT *, row_number() OVER (PARTITION BY community % 4 = 0 ORDER BY score DESC, community) AS k FROM scored) SELECT community, status, score FROM g WHERE community % 4 <> 0 OR k <= 3 ORDER BY score DESC, community LIMIT 30")
def recommendations_with_cap(spark, folder):
    return C.with_generic_cap(_recommended(spark, folder), F.col("community") % 4 == 0, 30, 0.1, F.desc("score"), F.asc("community"))


@register(
    "merged_snapshots",
    """WITH s AS (SELECT n_name AS community, count(*) AS recent, max(o_orderdate) AS latest FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus <> 'F' GROUP BY 1),
n AS (SELECT lower(n_name) AS key, count(*) AS recent, max(o_orderdate) AS latest FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT community, greatest(s.recent, n.recent) AS recent, CAST(epoch_us(greatest(s.latest, n.latest)) AS BIGINT) AS latest FROM s LEFT JOIN n ON lower(community) = key""",
)
def merged_snapshots(spark, folder):
    rows = order_posts(spark, folder)
    sums = lambda of: rows.filter(of).groupBy("community").agg(F.count("*").alias("recent"), F.max("ts").alias("latest"))
    found = C.merged_snapshots(sums("status <> 'F'"), sums("status = 'F'").withColumn("community", F.concat(F.lit("r/"), F.lower("community"))))
    return found.withColumn("latest", F.unix_micros(F.col("latest").cast("timestamp")))


@register(
    "community_value",
    """SELECT user_id, CASE WHEN n <= 0 THEN 0 ELSE greatest(0, least(100, c * 4 + d * 8 + p * 15 + least(t, 3) * 5 - e * 6 - s * 6 + CASE WHEN user_id % 2 = 0 THEN 10 ELSE -10 END)) END::BIGINT AS value FROM (
SELECT user_id, count(*) FILTER (WHERE event_type IN ('click', 'purchase')) AS n, count(*) FILTER (WHERE event_type = 'click') AS c, count(*) FILTER (WHERE event_type = 'view') AS d, count(*) FILTER (WHERE event_type = 'purchase') AS p, count(*) FILTER (WHERE event_type = 'error') AS e,
count(*) FILTER (WHERE event_type = 'signup') AS s, count(DISTINCT event_type) AS t FROM events GROUP BY user_id)""",
)
def community_value(spark, folder):
    kind = lambda k: F.count_if(F.col("event_type") == k)
    sums = table(spark, folder, "events").groupBy("user_id").agg(
        F.count_if(F.col("event_type").isin("click", "purchase")).alias("n"), kind("click").alias("c"), kind("view").alias("d"), kind("purchase").alias("p"), kind("error").alias("e"), kind("signup").alias("s"), F.countDistinct("event_type").alias("t")
    )
    return sums.select("user_id", C.value_score(*map(F.col, "ncdpest"), F.col("user_id") % 2 == 0).alias("value"))


@register(
    "crawl_archetypes",
    """SELECT user_id, f AS posts_per_day, e AS engagement, CASE WHEN f >= 2 AND e >= 70 THEN 'firehose' WHEN f >= 2 THEN 'steady' WHEN e >= 70 THEN 'gem' ELSE 'quiet' END AS archetype, CASE WHEN r > 0.9 THEN 4 WHEN r < 0.7 THEN 1 ELSE 2 END AS hours,
CASE WHEN user_id % 7 = 0 THEN 'blacklisted' WHEN n <= 0 THEN 'no_data' WHEN n > 70 THEN 'tier1' WHEN n > 55 THEN 'tier2' ELSE 'tier3' END AS tier FROM (
SELECT user_id, count(*) AS n, round(count(*) / 30, 1) AS f, round(avg(value + CAST(json_extract(props, '$.k') AS BIGINT)), 1) AS e, avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) AS r FROM events GROUP BY user_id)""",
)
def crawl_archetypes(spark, folder):
    engagement = F.col("value") + F.get_json_object("props", "$.k").cast("long")
    # to nine places first: a sum of doubles is off by its order, which would decide an average halfway between two tenths
    average, rate = F.round(F.round(F.avg(engagement), 9), 1), F.avg(F.coalesce(F.col("event_type") != "error", F.lit(False)).cast("int"))
    sums = table(spark, folder, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.count("*") / 30, 1).alias("f"), average.alias("e"), rate.alias("r"))
    kind = F.when((F.col("f") >= 2) & (F.col("e") >= 70), "firehose").when(F.col("f") >= 2, "steady").when(F.col("e") >= 70, "gem").otherwise("quiet")
    return sums.select("user_id", F.col("f").alias("posts_per_day"), F.col("e").alias("engagement"), kind.alias("archetype"), S.crawl_interval_hours(F.col("r")).alias("hours"), S.tier_by_valid_posts(F.col("n"), F.lit(True), F.col("user_id") % 7 == 0, 70, 55).alias("tier"))
