"""Registered queries on samples, quotas, gates and alerts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import evaluation as V
from tidemark.plans.catalogue import register
from tidemark.plans.posts import POSTS, posts, sql_any
from tidemark.functions import scoring as S
from tidemark.session import table

WEIGHTS = {"high": 0.4, "middle": 0.35, "low": 0.25}


@register(
    "stratified_sample",
    f"""WITH {POSTS}, b AS (SELECT id, source, CASE WHEN score >= 40 THEN 'high' WHEN score >= 10 THEN 'middle' ELSE 'low' END AS bucket, md5(CAST(id AS VARCHAR)) AS h FROM posts), c AS (SELECT bucket, count(*) AS n FROM b GROUP BY 1),
t AS (SELECT bucket, n, least(CAST(floor(120 * w) AS BIGINT), n) AS first, w FROM c JOIN (VALUES ('high', 0.4), ('middle', 0.35), ('low', 0.25)) x(bucket, w) USING (bucket)),
u AS (SELECT bucket, first + greatest(0, least(n - first, 120 - sum(first) OVER () - coalesce(sum(n - first) OVER (ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS target FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket, source ORDER BY h, id) AS turn FROM b), p AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY turn, h, id) AS place FROM r) SELECT id, bucket, place FROM p JOIN u USING (bucket) WHERE place <= target""",
)
def stratified_sample(spark, folder):
    bucket = F.when(F.col("score") >= 40, "high").when(F.col("score") >= 10, "middle").otherwise("low")
    return V.stratified_sample(posts(spark, folder).select("id", "source", "score"), "id", bucket, "source", 120, WEIGHTS).select("id", "bucket", "place")


@register("capped_quotas", "SELECT source, n, w, least(n, 3) AS quota FROM (SELECT source, count(*) AS n, count(DISTINCT lang) AS w FROM documents GROUP BY 1) WHERE (SELECT sum(least(n, 3)) FROM (SELECT count(*) AS n FROM documents GROUP BY source)) = (SELECT 3 * count(DISTINCT source) FROM documents)")
def capped_quotas(spark, folder):
    """A target that is what the base quotas give."""
    counts = table(spark, folder, "documents").groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("lang").alias("w"))
    return V.capped_quotas(counts, "source", "n", "w", 60, 3)


@register(
    "quotas_by_weight",
    """WITH c AS (SELECT event_type, count(*) AS n, min(length(event_type)) AS w FROM events GROUP BY 1), s AS (SELECT *, (207 - 5 * 10)::DOUBLE * w / sum(w) OVER () AS share FROM c),
f AS (SELECT *, CAST(floor(share) AS BIGINT) AS e, share - floor(share) AS r FROM s) SELECT event_type, n, w, 10 + e + CASE WHEN row_number() OVER (ORDER BY round(r, 9) DESC, event_type) <= 157 - sum(e) OVER () THEN 1 ELSE 0 END AS quota FROM f""",
)
def quotas_by_weight(spark, folder):
    counts = table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min(F.length("event_type")).alias("w"))
    return V.capped_quotas(counts, "event_type", "n", "w", 207, 10)


_TURNS = "t AS (SELECT conv_id AS post, conv_id * 1000 + turn AS id, CASE WHEN turn % 3 = 0 THEN NULL ELSE conv_id * 1000 + turn - turn % 3 END AS parent, turn % 3 AS depth, length(coalesce(text, '')) AS score, turn AS created FROM conversations)"


@register(
    "shallow_comments",
    f"""WITH {_TURNS}, b AS (SELECT *, row_number() OVER (PARTITION BY post ORDER BY score DESC, created DESC, id) AS k, row_number() OVER (PARTITION BY post ORDER BY created DESC, id) AS j FROM t WHERE depth = 0),
r AS (SELECT t.post, t.id, row_number() OVER (PARTITION BY t.post, t.parent ORDER BY t.score DESC, t.created DESC, t.id) AS k FROM t JOIN b ON b.id = t.parent AND b.k <= 1 WHERE t.depth > 0),
u AS (SELECT post, id, 0 AS p, 'top' AS origin FROM b WHERE k <= 2 UNION ALL SELECT post, id, 1, 'reply' FROM r WHERE k <= 1 UNION ALL SELECT post, id, 2, 'new' FROM b WHERE j <= 2) SELECT post, id, arg_min(origin, p) AS origin FROM u GROUP BY 1, 2""",
)
def shallow_comments(spark, folder):
    third = (F.col("turn") % 3).cast("int")
    ident = F.col("conv_id") * 1000 + F.col("turn")
    rows = table(spark, folder, "conversations").select(F.col("conv_id").alias("post"), ident.alias("id"), F.when(third != 0, ident - third).alias("parent"), third.alias("depth"), F.length(F.coalesce("text", F.lit(""))).alias("score"), F.col("turn").alias("created"))
    return V.shallow_comments(rows, 2, 2, 1, 1)


_DAILY = "d AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS valid, round(avg(CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END), 6) AS hit_rate, round(1 - count(DISTINCT user_id) / count(*), 6) AS repeats, round(avg(value), 9) AS mean FROM events GROUP BY 1)"


def _daily(spark, folder):
    day = F.to_date("ts").cast("string").alias("day")
    return table(spark, folder, "events").groupBy(day).agg(
        F.count("*").alias("valid"), F.round(F.avg((F.col("event_type") != "error").cast("int")), 6).alias("hit_rate"), F.round(1 - F.countDistinct("user_id") / F.count("*"), 6).alias("repeats"), F.round(F.avg("value"), 9).alias("mean")
    )


@register("daily_metrics", f"WITH {_DAILY} SELECT * FROM d")
def daily_metrics(spark, folder):
    return _daily(spark, folder)


RULES = [("valid", "below", 340), ("hit_rate", "below", 0.94), ("repeats", "above", 0.62), ("mean", "below", 28)]


@register("red_lines", f"WITH {_DAILY} " + " UNION ALL ".join(f"SELECT day, '{c}' AS metric, '{s}' AS side, {c}::DOUBLE AS value, {float(x)}::DOUBLE AS \"limit\" FROM d WHERE {c} {'<' if s == 'below' else '>'} {x}" for c, s, x in RULES))
def red_lines(spark, folder):
    return V.red_lines(_daily(spark, folder), RULES)


FLAGS = [("topic_mismatch", "on_topic", 0.35), ("pains_low", "pains", 2), ("coverage_low", "coverage", 0.3), ("authors_low", "authors", 20)]


@register(
    "quality_gate",
    f"""WITH {POSTS}, g AS (SELECT source, avg(CASE WHEN {sql_any('lower(text)', ['thatin', 'sich', 'que'])} THEN 1.0 ELSE 0.0 END) AS on_topic, count(*) FILTER (WHERE quality = 0) AS pains, count(quality) / count(*) AS coverage, count(DISTINCT author) AS authors FROM posts LEFT JOIN labels ON doc_id = id GROUP BY source),
f AS (SELECT *, list_filter([{', '.join(f"CASE WHEN {c} < {x} THEN '{n}' END" for n, c, x in FLAGS)}], lambda x: x IS NOT NULL) AS flags FROM g)
SELECT source, round(on_topic, 6) AS on_topic, array_to_string(flags, ',') AS flags, CASE WHEN list_contains(flags, 'topic_mismatch') THEN 'X' WHEN len(flags) = 0 THEN 'A' WHEN len(flags) = 1 THEN 'B' ELSE 'C' END AS tier FROM f""",
)
def quality_gate(spark, folder):
    rows = posts(spark, folder).join(table(spark, folder, "labels"), F.col("doc_id") == F.col("id"), "left")
    on = S.any_of(F.lower("text"), ["thatin", "sich", "que"])
    sums = rows.groupBy("source").agg(F.avg(on.cast("int")).alias("on_topic"), F.count_if(F.col("quality") == 0).alias("pains"), (F.count("quality") / F.count("*")).alias("coverage"), F.countDistinct("author").alias("authors"))
    flags, tier = V.quality_gate({c: F.col(c) for c in ("on_topic", "pains", "coverage", "authors")}, FLAGS)
    return sums.select("source", F.round("on_topic", 6).alias("on_topic"), F.array_join(flags, ",").alias("flags"), tier.alias("tier"))


@register("label_validation", "SELECT count(*) AS n, count(*) FILTER (WHERE quality NOT IN (0, 1) OR toxic NOT IN (0, 1)) AS bad, count(*) - count(DISTINCT doc_id) AS repeats, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS lost, count(*) >= 100 AS enough FROM labels")
def label_validation(spark, folder):
    labels = table(spark, folder, "labels")
    known = table(spark, folder, "documents").select(F.col("doc_id").alias("known"))
    rows = labels.join(known, F.col("doc_id") == F.col("known"), "left")
    bad = ~F.col("quality").isin(0, 1) | ~F.col("toxic").isin(0, 1)
    return rows.agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"), (F.count("*") - F.countDistinct("doc_id")).alias("repeats"), F.count_if(F.col("known").isNull()).alias("lost"), (F.count("*") >= 100).alias("enough"))


@register("sample_floor", "SELECT source, hot, cold, hot + cold AS n, greatest(0, 60 - hot - cold) AS missing FROM (SELECT source, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) AS hot, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND lang <> 'en') AS cold FROM documents GROUP BY 1)")
def sample_floor(spark, folder):
    known = table(spark, folder, "labels").select("doc_id").distinct().withColumn("hot", F.lit(True))
    rows = table(spark, folder, "documents").select("doc_id", "source", "lang").join(known, "doc_id", "left")
    sums = rows.groupBy("source").agg(F.count_if(F.col("hot")).alias("hot"), F.count_if(F.col("hot").isNull() & (F.col("lang") != "en")).alias("cold"))
    return sums.select("source", "hot", "cold", (F.col("hot") + F.col("cold")).alias("n"), F.greatest(F.lit(0), 60 - F.col("hot") - F.col("cold")).alias("missing"))


@register("score_split", "WITH r AS (SELECT event_id, CASE WHEN value >= 60 THEN 'high' WHEN value >= 20 THEN 'mid' ELSE 'low' END AS band, row_number() OVER (PARTITION BY CASE WHEN value >= 60 THEN 'high' WHEN value >= 20 THEN 'mid' ELSE 'low' END ORDER BY ts DESC, event_id) AS k FROM events) SELECT event_id, band FROM r WHERE k <= CASE band WHEN 'high' THEN 50 WHEN 'mid' THEN 30 ELSE 20 END")
def score_split(spark, folder):
    from tidemark.operators import analytics as A

    band = F.when(F.col("value") >= 60, "high").when(F.col("value") >= 20, "mid").otherwise("low")
    rows = table(spark, folder, "events").withColumn("band", band)
    return A.capped(rows.select("event_id", "band", "ts"), "band", {"high": 50, "mid": 30}, 20, F.desc("ts"), F.asc("event_id")).select("event_id", "band")
