"""Registered queries on probes, feeds and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import analytics as A
from tidemark.operators import feeds as D
from tidemark.plans.catalogue import register
from tidemark.session import table

_P = """e AS (SELECT event_id // 2 AS id, user_id AS community, ts, value AS score, CAST(json_extract(props, '$.k') AS BIGINT) AS comments FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, comments DESC, ts DESC) AS k FROM e),
s AS (SELECT id, community, ts, CAST(floor(coalesce(score, 0) + coalesce(comments, 0) * 2) AS BIGINT) AS evidence FROM o WHERE k = 1 AND ts >= TIMESTAMP '2024-01-04' AND (score >= 30 OR comments >= 60) AND community % 10 <> 3)"""


def _probe(spark, folder):
    rows = table(spark, folder, "events").select(F.floor(F.col("event_id") / 2).alias("id"), F.col("user_id").alias("community"), "ts", F.col("value").alias("score"), F.get_json_object("props", "$.k").cast("long").alias("comments"))
    return D.probe_posts(rows, F.expr("timestamp_ntz'2024-01-04'"), 30, 60, F.col("community") % 10 == 3)


@register("probe_posts", f"WITH {_P} SELECT id, community, evidence FROM s")
def probe_posts(spark, folder):
    return _probe(spark, folder).select("id", "community", "evidence")


_SEARCH = f"{_P}, r AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY evidence DESC, ts DESC, id) AS j FROM s), f AS (SELECT * FROM r WHERE j <= 2 ORDER BY evidence DESC, ts DESC, community DESC, id LIMIT 80)"


@register("probe_search", f"WITH {_SEARCH} SELECT id, community, evidence FROM f")
def probe_search(spark, folder):
    return D.probe_search(_probe(spark, folder), 2, 80).select("id", "community", "evidence")


@register("probe_communities", f"WITH {_SEARCH} SELECT community, CAST(sum(evidence) AS BIGINT) AS total FROM f GROUP BY 1 ORDER BY total DESC, community DESC LIMIT 15")
def probe_communities(spark, folder):
    return D.community_totals(D.probe_search(_probe(spark, folder), 2, 80), 15)


@register("probe_hot", f"WITH {_P}, t AS (SELECT community FROM s GROUP BY 1 ORDER BY sum(evidence) DESC, community DESC LIMIT 20), r AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY evidence DESC, ts DESC, id) AS j FROM s WHERE community IN (SELECT community FROM t)) SELECT id, community, evidence FROM r WHERE j <= 3 ORDER BY evidence DESC, ts DESC, id LIMIT 40")
def probe_hot(spark, folder):
    return D.probe_hot(_probe(spark, folder), 20, 3, 40).select("id", "community", "evidence")


@register("retry_delays", "SELECT user_id, n, CASE WHEN n <= 0 THEN 0 ELSE least((n - 1) // 5 * 30, 120) END AS delay FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS n FROM events GROUP BY 1)")
def retry_delays(spark, folder):
    sums = table(spark, folder, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("n"))
    return sums.withColumn("delay", D.retry_delay(F.col("n"), 5, 30, 120))


@register("percent_split", "WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), p AS (SELECT *, CAST(round(n * 100 / sum(n) OVER ()) AS BIGINT) AS p FROM c) SELECT event_type, n, p - CASE WHEN row_number() OVER (ORDER BY n DESC, event_type) = 1 THEN greatest(0, sum(p) OVER () - 100) ELSE 0 END AS percent FROM p")
def percent_split(spark, folder):
    return D.percent_split(table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n")), "event_type", "n").withColumn("percent", F.col("percent").cast("long"))


@register("layers_over_caps", "WITH r AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, CASE WHEN row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY value DESC, event_id) <= 30 THEN 'front' ELSE 'rest' END AS layer FROM events) SELECT day, layer, event_type, count(*) AS n FROM r GROUP BY 1, 2, 3 HAVING count(*) > 9")
def layers_over_caps(spark, folder):
    cards = table(spark, folder, "events").select(F.to_date("ts").cast("string").alias("day"), "event_type", "value", "event_id")
    return D.layers_over_caps(cards, "day", [F.desc("value"), F.asc("event_id")], 30, 9, "event_type")


@register("stable_streaks", "WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) >= 20 AS good FROM events GROUP BY 1, 2), b AS (SELECT event_type, sum(CASE WHEN good THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY day DESC) AS broken FROM d) SELECT event_type, count(*) FILTER (WHERE broken = 0) AS streak FROM b GROUP BY 1")
def stable_streaks(spark, folder):
    daily = table(spark, folder, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg((F.count("*") >= 20).alias("good"))
    return D.streak_to_now(daily, "event_type", "day", F.col("good"))


@register("cooldown_breaks", "SELECT event_id, gap FROM (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) - lag(CAST(floor(epoch(ts)) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events) WHERE gap < 1800")
def cooldown_breaks(spark, folder):
    return D.cooldown_breaks(table(spark, folder, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 1800).select("event_id", "gap")


@register("lane_slots", "SELECT event_id, event_type, (row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) - 1) // 3 AS slot FROM events")
def lane_slots(spark, folder):
    return D.without_long_runs(table(spark, folder, "events").select("event_id", "event_type", "value"), "event_type", [F.desc("value"), F.asc("event_id")], 3).drop("value")


@register("entity_leaderboard", "WITH w AS (SELECT p_brand AS name, count(*) FILTER (WHERE p_size < 10) AS small, count(*) FILTER (WHERE p_size BETWEEN 10 AND 30) AS middle, count(*) FILTER (WHERE p_size > 30) AS large FROM part GROUP BY 1) SELECT kind, name, score FROM (SELECT 'small' AS kind, name, small AS score FROM w UNION ALL SELECT 'middle', name, middle FROM w UNION ALL SELECT 'large', name, large FROM w) ORDER BY score DESC, kind, name LIMIT 20")
def entity_leaderboard(spark, folder):
    size = F.col("p_size")
    wide = table(spark, folder, "part").groupBy(F.col("p_brand").alias("name")).agg(F.count_if(size < 10).alias("small"), F.count_if(size.between(10, 30)).alias("middle"), F.count_if(size > 30).alias("large"))
    return D.leaderboard(wide, ["small", "middle", "large"], 20)


@register("sentiment_totals", "SELECT source, count(*) AS n, count(*) FILTER (WHERE s > 0.05) AS positive, count(*) FILTER (WHERE s < -0.05) AS negative, count(*) - count(*) FILTER (WHERE s > 0.05) - count(*) FILTER (WHERE s < -0.05) AS neutral FROM (SELECT source, CASE WHEN toxic = 1 THEN -0.5 WHEN quality = 1 THEN 0.3 ELSE 0 END AS s FROM documents JOIN labels USING (doc_id)) GROUP BY source")
def sentiment_totals(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "source").join(table(spark, folder, "labels"), "doc_id")
    s = F.when(F.col("toxic") == 1, -0.5).when(F.col("quality") == 1, 0.3).otherwise(0.0)
    sums = rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if(s > 0.05).alias("positive"), F.count_if(s < -0.05).alias("negative"))
    return sums.withColumn("neutral", F.greatest(F.lit(0), F.col("n") - F.col("positive") - F.col("negative")))


@register("discovery_audit", "SELECT user_id, count(*) AS candidates, count(*) FILTER (WHERE event_type = 'view') AS drafts, count(*) FILTER (WHERE event_type = 'purchase') AS published, count(*) FILTER (WHERE event_type = 'error') AS rejected, count(DISTINCT event_type) AS topics, count(*) - count(DISTINCT floor(value)) AS repeats FROM events GROUP BY user_id")
def discovery_audit(spark, folder):
    kind = lambda k: F.count_if(F.col("event_type") == k)
    return table(spark, folder, "events").groupBy("user_id").agg(F.count("*").alias("candidates"), kind("view").alias("drafts"), kind("purchase").alias("published"), kind("error").alias("rejected"), F.countDistinct("event_type").alias("topics"), (F.count("*") - F.countDistinct(F.floor("value"))).alias("repeats"))


@register("coverage_against_registry", "SELECT n_name, coalesce(n, 0) AS n, coalesce(n, 0) = 0 AS uncovered, round(coalesce(n, 0) / (SELECT count(*) FROM supplier), 6) AS share FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey")
def coverage_against_registry(spark, folder):
    supplier = table(spark, folder, "supplier")
    counts = supplier.groupBy("s_nationkey").agg(F.count("*").alias("n"))
    rows = table(spark, folder, "nation").join(counts, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(F.broadcast(supplier.agg(F.count("*").alias("all"))))
    n = F.coalesce("n", F.lit(0))
    return rows.select("n_name", n.alias("n"), (n == 0).alias("uncovered"), F.round(n / F.col("all"), 6).alias("share"))


@register("window_dedupe", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY value DESC, event_id) AS k FROM events) WHERE k = 1")
def window_dedupe(spark, folder):
    rows = table(spark, folder, "events").select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"), "value")
    return A.latest_per_key(rows, ["user_id", "event_type", "day"], F.desc("value"), F.asc("event_id")).select("event_id")


@register("grouped_candidates", "SELECT event_type, day, n, best FROM (SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, arg_max(event_id, value) AS best FROM events GROUP BY 1, 2) WHERE n >= 3")
def grouped_candidates(spark, folder):
    rows = table(spark, folder, "events").groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"), F.max_by("event_id", "value").alias("best"))
    return rows.filter("n >= 3")


@register("title_terms", r"WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(split_part(coalesce(text, ''), chr(10), 1)), '[a-z0-9]{4,}')) AS w, regexp_extract_all(lower(split_part(coalesce(text, ''), chr(10), 1)), '[a-z0-9]{4,}') AS a FROM documents) SELECT doc_id, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i)[1:5], ',') AS terms FROM t")
def title_terms(spark, folder):
    from tidemark.functions import text as X

    words = F.array_distinct(X.tokens(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1), 4))
    return table(spark, folder, "documents").select("doc_id", F.array_join(F.slice(words, 1, 5), ",").alias("terms"))


@register("gain_before_after", "SELECT event_type, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-16') AS before, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-16') AS after, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-16') - count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-16') AS gain FROM events GROUP BY 1")
def gain_before_after(spark, folder):
    late = F.col("ts") >= F.expr("timestamp_ntz'2024-01-16'")
    sums = table(spark, folder, "events").groupBy("event_type").agg(F.count_if(~late).alias("before"), F.count_if(late).alias("after"))
    return sums.withColumn("gain", F.col("after") - F.col("before"))


@register("scope_mix", "WITH l AS (SELECT event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 200) SELECT t.event_type, count(l.event_type) AS n FROM (SELECT DISTINCT event_type FROM events) t LEFT JOIN l ON l.event_type = t.event_type GROUP BY 1")
def scope_mix(spark, folder):
    events = table(spark, folder, "events").select("event_type", "ts", "event_id")
    recent = events.orderBy(F.desc("ts"), F.desc("event_id")).limit(200).groupBy("event_type").agg(F.count("*").alias("n"))
    return events.select("event_type").distinct().join(recent, "event_type", "left").select("event_type", F.coalesce("n", F.lit(0)).alias("n"))


@register("top_drivers", "SELECT label, CAST(sum(greatest(k, 1)) AS BIGINT) AS weight FROM (SELECT CASE WHEN event_type = 'error' THEN 'reliability' WHEN value > 50 THEN 'price' WHEN event_type IN ('click', 'view') THEN 'usability' ELSE 'other' END AS label, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1 ORDER BY weight DESC, label LIMIT 3")
def top_drivers(spark, folder):
    label = F.when(F.col("event_type") == "error", "reliability").when(F.col("value") > 50, "price").when(F.col("event_type").isin("click", "view"), "usability").otherwise("other")
    weight = F.sum(F.greatest(F.get_json_object("props", "$.k").cast("long"), F.lit(1)))
    return table(spark, folder, "events").groupBy(label.alias("label")).agg(weight.alias("weight")).orderBy(F.desc("weight"), "label").limit(3)


def _topics(spark, folder):
    """Topics of the users' days."""
    return table(spark, folder, "events").select(F.col("event_type").alias("topic"), (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("user_id")).distinct()


@register("pair_groups", "WITH u AS (SELECT DISTINCT event_type AS topic, user_id * 100 + day(ts) AS user_id FROM events) SELECT a.topic AS a, b.topic AS b, count(*) AS common FROM u a JOIN u b ON a.user_id = b.user_id AND a.topic < b.topic GROUP BY 1, 2")
def pair_groups(spark, folder):
    """Topics by shared users: a user has few topics, so pairs are bounded by those."""
    u = _topics(spark, folder)
    pairs = u.withColumnRenamed("topic", "a").join(u.withColumnRenamed("topic", "b"), "user_id").filter("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("common"))


@register("overlap_audit", "WITH u AS (SELECT DISTINCT event_type AS topic, user_id * 100 + day(ts) AS user_id FROM events), n AS (SELECT topic, count(*) AS n FROM u GROUP BY 1), p AS (SELECT a.topic AS a, b.topic AS b, count(*) AS common FROM u a JOIN u b ON a.user_id = b.user_id AND a.topic < b.topic GROUP BY 1, 2) SELECT a, b, round(common / (x.n + y.n - common), 6) AS jaccard, common / (x.n + y.n - common) >= 0.3 AS over FROM p JOIN n x ON x.topic = a JOIN n y ON y.topic = b")
def overlap_audit(spark, folder):
    u = _topics(spark, folder)
    sizes = u.groupBy("topic").agg(F.count("*").alias("n"))
    both = pair_groups(spark, folder)
    side = lambda name: sizes.select(F.col("topic").alias(name), F.col("n").alias(f"n{name}"))
    share = F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))
    return both.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.round(share, 6).alias("jaccard"), (share >= 0.3).alias("over"))
