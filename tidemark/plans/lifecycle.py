"""Registered queries on versions, merges, expiry, views and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scoring as S
from tidemark.operators import lifecycle as L
from tidemark.plans.catalogue import register
from tidemark.plans.posts import COMMENTS, POSTS, comments, posts
from tidemark.session import table
from tidemark.streaming import events as E

SPLIT = "2024-01-16"
_EARLY = f"ts < TIMESTAMP '{SPLIT}'"


def _micros(c="ts"):
    return F.unix_micros(F.col(c).cast("timestamp"))


def _halves(spark, folder):
    events = table(spark, folder, "events")
    early = F.expr(f"coalesce(ts < timestamp_ntz'{SPLIT}', false)")
    return events.filter(early), events.filter(~early)


@register(
    "versioned_upsert",
    f"""WITH e AS (SELECT *, CAST(epoch_us(ts) AS BIGINT) AS t FROM events), old AS (SELECT user_id, arg_max(event_type, t) AS event_type, max(t) AS t FROM e WHERE {_EARLY} GROUP BY 1), new AS (SELECT user_id, arg_max(event_type, t) AS event_type, max(t) AS t FROM e WHERE NOT {_EARLY} GROUP BY 1)
SELECT o.user_id, o.event_type, 1 AS version, o.t AS valid_from, CASE WHEN n.event_type = o.event_type THEN n.t ELSE o.t END AS fetched, n.user_id IS NULL OR n.event_type = o.event_type AS is_current FROM old o LEFT JOIN new n USING (user_id)
UNION ALL SELECT n.user_id, n.event_type, CASE WHEN o.user_id IS NULL THEN 1 ELSE 2 END, n.t, n.t, true FROM new n LEFT JOIN old o USING (user_id) WHERE o.user_id IS NULL OR o.event_type <> n.event_type""",
)
def versioned_upsert(spark, folder):
    old, new = _halves(spark, folder)
    stored = old.groupBy("user_id").agg(F.max_by("event_type", "ts").alias("event_type"), F.max(_micros()).alias("valid_from"))
    stored = stored.select("user_id", "event_type", F.lit(1).alias("version"), "valid_from", F.col("valid_from").alias("fetched"), F.lit(True).alias("is_current"))
    return L.versioned_upsert(stored, new.select("user_id", "event_type", _micros().alias("t")), ["user_id"], "t", ["event_type"])


@register("last_write_wins", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def last_write_wins(spark, folder):
    old, new = (rows.select("user_id", "event_id", "event_type", "ts") for rows in _halves(spark, folder))
    return L.last_write_wins(old, new, ["user_id"], "ts").select("user_id", "event_id", "event_type")


@register("insert_if_absent", f"SELECT user_id, event_type, hour(ts) AS hour, first(event_id ORDER BY event_id NULLS FIRST) AS event_id FROM events GROUP BY ALL HAVING count(*) FILTER ({_EARLY}) = 0")
def insert_if_absent(spark, folder):
    """The later events' first by user, type and hour of the day, where no earlier event has these."""
    old, new = (rows.select("user_id", "event_type", F.hour("ts").cast("long").alias("hour"), "event_id") for rows in _halves(spark, folder))
    return L.insert_if_absent(old, new, ["user_id", "event_type", "hour"])


@register("insert_absent_documents", "SELECT doc_id, first(source ORDER BY source NULLS FIRST) AS source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id IS NOT DISTINCT FROM d.doc_id) GROUP BY doc_id")
def insert_absent_documents(spark, folder):
    """Documents that the labels don't have yet."""
    return L.insert_if_absent(table(spark, folder, "labels").select("doc_id"), table(spark, folder, "documents").select("doc_id", "source"), "doc_id")


_VERSIONS = "v AS (SELECT user_id, event_id, event_type, value, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM events)"


def _versions(spark, folder):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, folder, "events").select("user_id", "event_id", "event_type", "value", "ts", F.row_number().over(w).cast("long").alias("version"))


@register("closed_versions", f"WITH {_VERSIONS} SELECT event_id, version, CAST(epoch_us(lead(ts) OVER w) AS BIGINT) AS valid_to, lead(ts) OVER w IS NULL AS is_current FROM v WINDOW w AS (PARTITION BY user_id ORDER BY ts, version)")
def closed_versions(spark, folder):
    found = L.closed_versions(_versions(spark, folder), ["user_id"], "ts", "version")
    return found.select("event_id", "version", _micros("valid_to").alias("valid_to"), "is_current")


@register("archived_versions", f"""WITH {_VERSIONS}, l AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, version) IS NULL AS is_current FROM v)
SELECT '{{"event_id":' || event_id || ',"event_type":"' || event_type || '","version":' || version || '}}' AS payload FROM l WHERE NOT is_current AND ts < TIMESTAMP '2024-01-11'""")
def archived_versions(spark, folder):
    rows = L.closed_versions(_versions(spark, folder), ["user_id"], "ts", "version")
    current, time = F.col("is_current"), F.col("ts")
    narrow = L.archived(rows, current, time, F.expr("timestamp_ntz'2024-01-11'"))
    fields = F.from_json("payload", "event_id bigint, event_type string, version bigint")
    return narrow.select(F.to_json(fields).alias("payload"))


@register("quarantine", f"WITH {POSTS} SELECT id, CASE WHEN source = 'src9' THEN 'community_unmapped' WHEN body IN ('[deleted]', '[removed]') OR title = '' THEN 'ghost_content' WHEN length(title || ' ' || body) < 40 THEN 'short_content' END AS reject_reason FROM posts")
def quarantine(spark, folder):
    full = F.concat("title", F.lit(" "), "body")
    reasons = [(F.col("source") == "src9", "community_unmapped"), (F.col("body").isin("[deleted]", "[removed]") | (F.col("title") == ""), "ghost_content"), (F.length(full) < 40, "short_content")]
    return L.quarantined(posts(spark, folder), reasons).select("id", "reject_reason")


_EXPIRES = "CASE WHEN v >= 8 THEN NULL ELSE t + 86400000000 * CASE WHEN v <= 2 THEN 30 WHEN value > 100 THEN 365 WHEN value > 10 THEN 180 ELSE 90 END END"
_VALUED = "(SELECT *, CASE WHEN k % 5 = 0 THEN NULL ELSE k % 11 END AS v FROM (SELECT event_id, value, CAST(epoch_us(ts) AS BIGINT) AS t, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events))"


def _valued(spark, folder):
    rows = table(spark, folder, "events").select("event_id", "value", _micros().alias("t"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    return rows.withColumn("v", F.when(F.col("k") % 5 != 0, F.col("k") % 11))


@register("comment_expiry", f"SELECT event_id, {_EXPIRES} AS expires FROM {_VALUED}")
def comment_expiry(spark, folder):
    return _valued(spark, folder).select("event_id", L.tiered_expiry(F.col("v"), F.col("value"), F.col("t")).alias("expires"))


NOW = 1706659200000000


@register(
    "expiry_after_change",
    f"""SELECT event_id, CASE WHEN n IS NOT DISTINCT FROM v THEN e WHEN n >= 8 THEN NULL WHEN n <= 2 THEN least(t + 86400000000 * 30, {NOW} + 86400000000 * 7) ELSE coalesce(e, t + 86400000000 * 180) END AS expires,
CASE WHEN n IS DISTINCT FROM v THEN CASE WHEN n >= 8 THEN 'core' WHEN n <= 2 THEN 'noise' ELSE 'lab' END END AS pool FROM (SELECT *, {_EXPIRES} AS e, CASE WHEN k % 3 = 0 THEN v ELSE k % 10 END AS n FROM {_VALUED})""",
)
def expiry_after_change(spark, folder):
    rows = _valued(spark, folder).withColumn("e", L.tiered_expiry(F.col("v"), F.col("value"), F.col("t"))).withColumn("n", F.when(F.col("k") % 3 == 0, F.col("v")).otherwise(F.col("k") % 10))
    found = L.retiered(F.col("v"), F.col("n"), F.col("e"), F.col("t"), F.lit(NOW))
    return rows.select("event_id", found.alias("r")).select("event_id", "r.expires", "r.pool")


@register("unexpired_rows", f"SELECT event_id FROM {_VALUED} WHERE t + 86400000000 * 14 >= {NOW}")
def unexpired_rows(spark, folder):
    return _valued(spark, folder).filter(F.col("t") + F.lit(86_400_000_000) * 14 >= NOW).select("event_id")


@register("backfill_floor", "SELECT event_type, min(CAST(epoch_us(ts) AS BIGINT)) AS floor FROM events GROUP BY 1")
def backfill_floor(spark, folder):
    old, new = (rows.select("event_type", _micros().alias("floor")) for rows in _halves(spark, folder))
    return L.moved_floor(new.groupBy("event_type").agg(F.min("floor").alias("floor")), old, "event_type", "floor")


@register(
    "waterline_ignores_backfill",
    """WITH w AS (SELECT event_type, max(ts) FILTER (value <= 100) AS line FROM events GROUP BY 1)
SELECT event_type, CAST(epoch_us(line) AS BIGINT) AS waterline, CAST(epoch_us(min(ts)) AS BIGINT) AS floor, count(*) AS stored, count(*) FILTER (value > 100 AND (line IS NULL OR ts > line)) AS beyond FROM events JOIN w USING (event_type) GROUP BY event_type, line""",
)
def waterline_ignores_backfill(spark, folder):
    """Events of a value over 100 come by the backfill track: they are stored and move the floor, but only the others move the line."""
    rows = table(spark, folder, "events").select("event_type", _micros().alias("time"), (F.col("value") > 100).alias("backfill"))
    return L.two_tracks(rows, "event_type", "time", F.coalesce("backfill", F.lit(False)))


@register("backfill_states", "SELECT user_id, CASE WHEN months IS NULL THEN 'ERROR' WHEN user_id % 13 = 0 THEN 'DONE_CAPPED' WHEN months >= 20 AND n >= 60 THEN 'DONE_12M' ELSE 'NEEDS' END AS status FROM (SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS months, count(*) AS n FROM events GROUP BY 1)")
def backfill_states(spark, folder):
    sums = table(spark, folder, "events").groupBy("user_id").agg(F.countDistinct(F.to_date("ts")).alias("months"), F.count("*").alias("n"))
    return sums.select("user_id", L.backfill_status(F.col("months"), F.col("n"), F.col("user_id") % 13 == 0, 20, 60).alias("status"))


@register("recrawl_candidates", "SELECT user_id, last, n FROM (SELECT user_id, CAST(epoch_us(max(ts)) AS BIGINT) AS last, count(*) AS n FROM events GROUP BY 1) WHERE last < 1706486400000000 OR n < 60 ORDER BY last NULLS FIRST, user_id LIMIT 40")
def recrawl_candidates(spark, folder):
    sums = table(spark, folder, "events").groupBy("user_id").agg(F.max(_micros()).alias("last"), F.count("*").alias("n"))
    return sums.filter((F.col("last") < 1_706_486_400_000_000) | (F.col("n") < 60)).orderBy(F.asc_nulls_first("last"), "user_id").limit(40)


@register("view_freshness", "SELECT event_type, CAST(floor(1706659200 - epoch(max(ts))) AS BIGINT) AS age, floor(1706659200 - epoch(max(ts))) > 86400 AS stale FROM events GROUP BY 1")
def view_freshness(spark, folder):
    age = F.lit(1_706_659_200) - F.max(F.unix_timestamp(F.col("ts").cast("timestamp")))
    rows = table(spark, folder, "events").groupBy("event_type").agg(F.ceil(F.max(_micros()) / 1_000_000).alias("up"), age.alias("down"))
    exact = F.lit(1_706_659_200) - F.col("up")
    return rows.select("event_type", exact.cast("long").alias("age"), (exact > 86_400).alias("stale"))


_SCORES = "s AS (SELECT user_id, event_id, CASE WHEN event_type IN ('view', 'click') THEN 'rule_v2' ELSE 'llm_v1' END AS rule, value, ts FROM events)"


@register("score_latest_view", f"WITH {_SCORES}, p AS (SELECT * FROM s WHERE rule = 'rule_v2' OR NOT EXISTS (SELECT 1 FROM s WHERE rule = 'rule_v2')), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, rule DESC) AS k FROM p) SELECT user_id, event_id, CASE WHEN user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING max(value) > 200) THEN 'noise' ELSE 'lab' END AS pool FROM r WHERE k = 1")
def score_latest_view(spark, folder):
    events = table(spark, folder, "events")
    scores = events.select("user_id", "event_id", F.when(F.col("event_type").isin("view", "click"), "rule_v2").otherwise("llm_v1").alias("rule"), "value", "ts")
    noise = events.groupBy("user_id").agg(F.max("value").alias("m")).filter("m > 200").select("user_id")
    return L.latest_scores(scores, "user_id", "rule", "ts", "rule_v2", noise).select("user_id", "event_id", "pool")


@register("core_lab_comments", f"WITH {COMMENTS} SELECT id, coalesce(CASE WHEN score >= 400 THEN 'core' WHEN score < 20 THEN 'noise' END, 'lab') AS pool FROM comments WHERE coalesce(CASE WHEN score >= 400 THEN 'core' WHEN score < 20 THEN 'noise' END, 'lab') IN ('core', 'lab')")
def core_lab_comments(spark, folder):
    rows = comments(spark, folder)
    scores = rows.filter("score >= 400 or score < 20").select(F.col("id").alias("scored"), F.when(F.col("score") >= 400, "core").otherwise("noise").alias("scored_pool"))
    joined = rows.select("id").join(scores, F.col("id") == F.col("scored"), "left").select("id", F.coalesce("scored_pool", F.lit("lab")).alias("pool"))
    return joined.filter(F.col("pool").isin("core", "lab"))


@register("semantic_task_view", f"WITH {POSTS} SELECT id, left(title, 40) AS title, length(left(body, 1200)) AS chars, CASE WHEN score >= 50 THEN 'high' WHEN score >= 10 THEN 'medium' ELSE 'low' END AS band, coalesce(n_name, 'none') AS role FROM posts LEFT JOIN nation ON n_nationkey = author")
def semantic_task_view(spark, folder):
    nation = F.broadcast(table(spark, folder, "nation").select("n_nationkey", "n_name"))
    band = F.when(F.col("score") >= 50, "high").when(F.col("score") >= 10, "medium").otherwise("low")
    rows = posts(spark, folder).join(nation, F.col("n_nationkey") == F.col("author"), "left")
    return rows.select("id", F.substring("title", 1, 40).alias("title"), F.length(F.substring("body", 1, 1200)).cast("long").alias("chars"), band.alias("band"), F.coalesce("n_name", F.lit("none")).alias("role"))


@register("semantic_main_view", f"WITH {POSTS}, {COMMENTS}, l AS (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1), n AS (SELECT post_id, count(*) AS n FROM comments GROUP BY 1) SELECT 'post' AS kind, id, coalesce(l.n, 0) AS labels, coalesce(n.n, 0) AS replies FROM posts LEFT JOIN l ON doc_id = id LEFT JOIN n ON post_id = id UNION ALL SELECT 'comment', id, 0, 0 FROM comments")
def semantic_main_view(spark, folder):
    labels = table(spark, folder, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("labels"))
    said = comments(spark, folder)
    replies = said.groupBy(F.col("post_id").alias("id")).agg(F.count("*").alias("replies"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    p = posts(spark, folder).select("id").join(labels, "id", "left").join(replies, "id", "left").select(F.lit("post").alias("kind"), "id", zero("labels"), zero("replies"))
    return p.unionByName(said.select(F.lit("comment").alias("kind"), "id", F.lit(0).cast("long").alias("labels"), F.lit(0).cast("long").alias("replies")))


@register("decision_units", f"WITH {POSTS} SELECT id, round(score, 2) AS score FROM posts WHERE score > 20 AND comments BETWEEN 20 AND 80 AND length(body) > 100 AND lang IN ('en', 'de', 'fr', 'es')")
def decision_units(spark, folder):
    rows = posts(spark, folder).filter((F.col("score") > 20) & F.col("comments").between(20, 80) & (F.length("body") > 100) & F.col("lang").isin("en", "de", "fr", "es"))
    return rows.select("id", F.round("score", 2).alias("score"))


@register("hit_rate_trailing", "WITH b AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, count(*) AS n, count(*) FILTER (WHERE event_type <> 'error') AS hits FROM events GROUP BY 1) SELECT hour, n, round(sum(hits) OVER w / sum(n) OVER w, 6) AS rate FROM b WINDOW w AS (ORDER BY hour RANGE BETWEEN 5 PRECEDING AND CURRENT ROW)")
def hit_rate_trailing(spark, folder):
    """Hourly buckets, and the hit rate of each hour with the five before; one row per hour goes through one task."""
    from pyspark.sql import Window

    b = table(spark, folder, "events").groupBy(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).alias("hour")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") != "error").alias("hits"))
    w = Window.orderBy("hour").rangeBetween(-5, 0)
    return b.select("hour", "n", F.round(F.sum("hits").over(w) / F.sum("n").over(w), 6).alias("rate"))


@register("stream_late_rows", "SELECT CAST(floor(epoch(date_trunc('day', ts))) AS BIGINT) AS started, event_type, count(*) AS n FROM events WHERE event_id % 20 <> 0 GROUP BY 1, 2")
def stream_late_rows(spark, folder):
    """Every twentieth event comes in a last batch, later than the watermark allows, and is left out of all windows."""
    return E.run_batches(E.late_batches(spark, folder), lambda s: E.window_counts(s, "event_type", "1 day", "1 hour"), "append")


@register("stream_repeated_rows", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_repeated_rows(spark, folder):
    """Each event comes twice, in batches of its day and of the day after; state keeps the first of both."""
    found = E.run_batches(E.repeated_batches(spark, folder), lambda s: E.once(s, "event_id", "3 days"), "append")
    return found.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@register("stream_join_within_hour", "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR")
def stream_join_within_hour(spark, folder):
    """Clicks joined to purchases of the same user up to an hour later, both as streams; state goes behind the watermarks."""
    clicks = E.read_events(spark, folder).filter("event_type = 'click'").select(F.col("event_id").alias("a"), F.col("user_id").alias("ua"), F.col("ts").alias("ta")).withWatermark("ta", "2 hours")
    bought = E.read_events(spark, folder).filter("event_type = 'purchase'").select(F.col("event_id").alias("b"), F.col("user_id").alias("ub"), F.col("ts").alias("tb")).withWatermark("tb", "2 hours")
    joined = clicks.join(bought, F.expr("ua = ub and tb >= ta and tb <= ta + interval 1 hour"))
    return E.run_to_end(joined.select("a", "b"), "append")


@register("stream_floor", "SELECT event_type, min(CAST(epoch_us(ts) AS BIGINT)) AS floor FROM events GROUP BY 1")
def stream_floor(spark, folder):
    return E.run_to_end(E.read_events(spark, folder).groupBy("event_type").agg(F.min(F.unix_micros("ts")).alias("floor")), "complete")


@register("dual_write_counts", "SELECT 'cold' AS target, count(*) AS n FROM events UNION ALL SELECT 'hot', count(DISTINCT user_id) FROM events")
def dual_write_counts(spark, folder):
    """A stream written to two tables in one pass of each batch: all rows, and the last of each user."""
    cold, hot = E.dual_write(E.read_events(spark, folder), "user_id", "event_id")
    return cold.agg(F.count("*").alias("n")).select(F.lit("cold").alias("target"), "n").unionByName(hot.agg(F.count("*").alias("n")).select(F.lit("hot").alias("target"), "n"))


@register("adaptive_intervals", "SELECT user_id, CASE WHEN r > 0.9 THEN 4 WHEN r < 0.7 THEN 1 ELSE 2 END AS hours FROM (SELECT user_id, avg(CASE WHEN event_type IN ('error', 'signup') THEN 0.0 ELSE 1.0 END) AS r FROM events GROUP BY 1)")
def adaptive_intervals(spark, folder):
    rows = table(spark, folder, "events").groupBy("user_id").agg(F.avg((~F.col("event_type").isin("error", "signup")).cast("int")).alias("r"))
    return rows.select("user_id", S.crawl_interval_hours(F.col("r")).alias("hours"))
