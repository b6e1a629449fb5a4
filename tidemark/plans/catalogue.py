"""All registered queries of the community analytics, with their SQL for a second engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import analytics as A
from tidemark.operators import relational as R
from tidemark.operators import vectors as V
from tidemark.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
ANCHOR = "2024-01-31 00:00:00"
TERMS = ["thatin", "ononst", "inoran", "hehely", "orantion"]


def register(name: str, sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "source", "lang").join(table(spark, folder, "labels"), "doc_id")


def _day(column: str = "ts"):
    return F.to_date(F.col(column))


@register(
    "ps_ratio_by_source",
    """SELECT source, CAST(count(*) FILTER (WHERE quality = 0) AS BIGINT) AS problems, CAST(count(*) FILTER (WHERE quality = 1) AS BIGINT) AS solutions,
       CASE WHEN count(*) > 0 THEN round(count(*) FILTER (WHERE quality = 0) / greatest(count(*) FILTER (WHERE quality = 1), 1), 6) ELSE 0.0 END AS ratio
FROM documents JOIN labels USING (doc_id) GROUP BY source""",
)
def ps_ratio_by_source(spark, folder):
    return A.ratio_by(_labelled(spark, folder), "source", F.col("quality"), 0, 1)


@register("pain_density", "SELECT source, round(avg(CASE WHEN quality = 0 THEN 1 ELSE 0 END), 6) AS density FROM documents JOIN labels USING (doc_id) GROUP BY source")
def pain_density(spark, folder):
    return A.density(_labelled(spark, folder), "source", F.col("quality") == 0, "density")


@register(
    "label_coverage_full_outer",
    """SELECT coalesce(a.source, b.source) AS source, coalesce(n_docs, 0) AS n_docs, coalesce(n_labels, 0) AS n_labels
FROM (SELECT source, count(*) AS n_docs FROM documents GROUP BY source) a
FULL JOIN (SELECT source, count(*) AS n_labels FROM documents JOIN labels USING (doc_id) GROUP BY source) b ON a.source = b.source""",
)
def label_coverage(spark, folder):
    docs = table(spark, folder, "documents").groupBy("source").agg(F.count("*").alias("n_docs"))
    labels = _labelled(spark, folder).groupBy("source").agg(F.count("*").alias("n_labels"))
    return docs.join(labels, "source", "full").na.fill(0, ["n_docs", "n_labels"])


@register("semi_labeled_docs", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_labeled(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "source").join(table(spark, folder, "labels"), "doc_id", "left_semi")


@register("anti_unlabeled_docs", "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_unlabeled(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "source").join(table(spark, folder, "labels"), "doc_id", "left_anti")


@register(
    "double_anti_by_hash",
    """WITH h AS (SELECT doc_id, md5(lower(regexp_replace(trim(text), '\\s+', ' ', 'g'))) AS body_hash FROM documents)
SELECT doc_id, body_hash FROM h WHERE doc_id NOT IN (SELECT doc_id FROM labels)
AND body_hash NOT IN (SELECT body_hash FROM h JOIN labels USING (doc_id))""",
)
def double_anti(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", X.body_hash(F.col("text")).alias("body_hash"))
    labels = table(spark, folder, "labels").select("doc_id")
    return docs.join(labels, "doc_id", "left_anti").join(docs.join(labels, "doc_id", "left_semi").select("body_hash"), "body_hash", "left_anti").select("doc_id", "body_hash")


@register(
    "count_filter_recent",
    f"""SELECT event_type, count(*) AS n, count(*) FILTER (WHERE ts >= TIMESTAMP '{ANCHOR}' - INTERVAL 7 DAY) AS recent FROM events GROUP BY event_type""",
)
def count_recent(spark, folder):
    recent = F.col("ts") >= F.expr(f"timestamp_ntz'{ANCHOR}' - interval 7 days")
    return table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(recent).alias("recent"))


@register("distinct_users_by_type", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def distinct_users(spark, folder):
    return table(spark, folder, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))


@register("listagg_types", "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM events GROUP BY user_id")
def listagg_types(spark, folder):
    return table(spark, folder, "events").groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("types"))


@register("bool_or_toxic", "SELECT source, bool_or(toxic = 1) AS any_toxic, bool_and(quality = 1) AS all_good FROM documents JOIN labels USING (doc_id) GROUP BY source")
def bool_or_toxic(spark, folder):
    return _labelled(spark, folder).groupBy("source").agg(F.bool_or(F.col("toxic") == 1).alias("any_toxic"), F.bool_and(F.col("quality") == 1).alias("all_good"))


@register(
    "latency_percentiles",
    "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type",
)
def percentiles(spark, folder):
    return R.percentiles_by_rank(table(spark, folder, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95}, {})


@register(
    "pearson_by_type",
    "SELECT event_type, round(corr(value, CAST(json_extract(props, '$.k') AS DOUBLE)), 6) AS r FROM events GROUP BY event_type",
)
def pearson(spark, folder):
    return table(spark, folder, "events").groupBy("event_type").agg(F.round(F.corr("value", F.get_json_object("props", "$.k").cast("double")), 6).alias("r"))


@register(
    "having_min_mentions",
    "SELECT p_brand, count(*) AS mentions, count(DISTINCT l_orderkey) AS orders FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand HAVING count(*) >= 200",
)
def having_mentions(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", "p_brand")
    rows = table(spark, folder, "lineitem").select("l_partkey", "l_orderkey").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("p_brand").agg(F.count("*").alias("mentions"), F.countDistinct("l_orderkey").alias("orders")).filter("mentions >= 200")


@register(
    "brand_type_cooccurrence",
    """SELECT a.p_brand, b.p_type, count(*) AS n FROM
(SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey) a JOIN
(SELECT DISTINCT l_orderkey, p_type FROM lineitem JOIN part ON l_partkey = p_partkey) b USING (l_orderkey) GROUP BY 1, 2 HAVING count(*) >= 5""",
)
def brand_type(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, folder, "part").select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return A.co_occurrence(rows, rows, "l_orderkey", "p_brand", "p_type", 5)


@register(
    "row_number_body_hash",
    """SELECT doc_id, body_hash FROM (SELECT doc_id, body_hash, row_number() OVER (PARTITION BY body_hash ORDER BY n_chars DESC, doc_id) AS k
FROM (SELECT doc_id, n_chars, md5(lower(regexp_replace(trim(text), '\\s+', ' ', 'g'))) AS body_hash FROM documents)) WHERE k = 1""",
)
def row_number_hash(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "n_chars", X.body_hash(F.col("text")).alias("body_hash"))
    return A.latest_per_key(docs, ["body_hash"], F.desc("n_chars"), F.asc("doc_id")).select("doc_id", "body_hash")


@register(
    "latest_event_per_user",
    "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
)
def latest_event(spark, folder):
    return A.latest_per_key(table(spark, folder, "events"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type", "value")


@register(
    "daily_lag_velocity",
    """SELECT CAST(day AS VARCHAR) AS day, n, lag(n) OVER (ORDER BY day) AS previous, n - lag(n) OVER (ORDER BY day) AS velocity
FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)""",
)
def daily_velocity(spark, folder):
    series = table(spark, folder, "events").groupBy(_day().alias("day")).agg(F.count("*").alias("n"))
    return A.velocity(series, "day", "n").withColumn("day", F.col("day").cast("string"))


@register(
    "trend_growth_label",
    """SELECT event_type, CAST(week AS VARCHAR) AS week, n, CASE WHEN p IS NULL OR p = 0 THEN 'new' WHEN (n - p) / p >= 0.2 THEN 'rising' WHEN (n - p) / p <= -0.2 THEN 'falling' ELSE 'stable' END AS label
FROM (SELECT *, lag(n) OVER (PARTITION BY event_type ORDER BY week) AS p FROM
(SELECT event_type, CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS n FROM events GROUP BY 1, 2))""",
)
def trend_label(spark, folder):
    weekly = table(spark, folder, "events").groupBy("event_type", F.to_date(F.date_trunc("week", F.col("ts").cast("timestamp"))).alias("week")).agg(F.count("*").alias("n"))
    before = F.lag("n").over(Window.partitionBy("event_type").orderBy("week"))
    return weekly.select("event_type", F.col("week").cast("string").alias("week"), "n", A.growth_label(F.col("n"), before).alias("label"))


@register(
    "daily_counts_zero_filled",
    """SELECT CAST(day AS VARCHAR) AS day, coalesce(n, 0) AS n FROM (SELECT CAST(unnest(generate_series(DATE '2023-12-25', DATE '2024-02-05', INTERVAL 1 DAY)) AS DATE) AS day)
LEFT JOIN (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) USING (day)""",
)
def zero_filled(spark, folder):
    counts = table(spark, folder, "events").filter("event_type = 'error'").groupBy(_day().alias("day")).agg(F.count("*").alias("n"))
    return A.zero_filled(counts, "day", "n", "2023-12-25", "2024-02-05").withColumn("day", F.col("day").cast("string"))


@register("topk_brands", "SELECT p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 10")
def topk_brands(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_partkey").join(table(spark, folder, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand").limit(10)


INTERLEAVED = "SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS turn FROM events"


@register("interleave_all_by_type", INTERLEAVED)
@register("interleave_by_type", INTERLEAVED)
def interleave(spark, folder):
    rows = table(spark, folder, "events").select("event_id", "event_type", "value")
    return A.interleaved_in_buckets(rows, "event_type", F.floor("value"), F.desc("value"), F.asc("event_id")).drop("value")


@register(
    "capped_roles",
    """SELECT conv_id, turn, role, place FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY role ORDER BY length(coalesce(text, '')) DESC, conv_id, turn) AS place FROM conversations)
WHERE place <= CASE role WHEN 'system' THEN 5 WHEN 'user' THEN 10 ELSE 20 END""",
)
def capped_roles(spark, folder):
    rows = table(spark, folder, "conversations").withColumn("n", F.length(F.coalesce("text", F.lit(""))))
    return A.capped(rows, "role", {"system": 5, "user": 10}, 20, F.desc("n"), F.asc("conv_id"), F.asc("turn")).select("conv_id", "turn", "role", "place")


@register(
    "union_posts_comments",
    """SELECT kind, count(*) AS n, CAST(sum(chars) AS BIGINT) AS chars FROM (
SELECT 'post' AS kind, length(coalesce(text, '')) AS chars FROM documents UNION ALL SELECT 'comment', length(coalesce(text, '')) FROM conversations) GROUP BY kind""",
)
def union_both(spark, folder):
    chars = F.length(F.coalesce("text", F.lit(""))).alias("chars")
    rows = table(spark, folder, "documents").select(F.lit("post").alias("kind"), chars).unionByName(table(spark, folder, "conversations").select(F.lit("comment").alias("kind"), chars))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))


@register(
    "content_duplicates",
    """SELECT doc_id, first_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY source, md5(lower(regexp_replace(trim(text), '\\s+', ' ', 'g')))) AS first_id FROM documents) WHERE doc_id <> first_id""",
)
def content_duplicates(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", X.body_hash(F.col("text")).alias("h"))
    firsts = docs.groupBy("source", "h").agg(F.min("doc_id").alias("first_id"))
    return docs.join(firsts, ["source", "h"]).filter("doc_id <> first_id").select("doc_id", "first_id")


@register(
    "keyword_any_match",
    r"SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '\b(orantion|hehely|inoran|ononst|thatin)\b')",
)
def keyword_any(spark, folder):
    return table(spark, folder, "documents").filter(X.mentions(F.col("text"), TERMS)).select("doc_id")


@register(
    "term_occurrences",
    "SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), 'tion', ''))) // 4 AS BIGINT) AS n FROM documents",
)
def term_occurrences(spark, folder):
    return table(spark, folder, "documents").select("doc_id", X.occurrences(F.col("text"), "tion").cast("long").alias("n"))


@register(
    "top_tokens_by_lang",
    """SELECT lang, token, n, place FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS place FROM (
SELECT lang, token, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z0-9]{6,}')) AS token FROM documents) GROUP BY 1, 2)) WHERE place <= 10""",
)
def top_tokens(spark, folder):
    rows = table(spark, folder, "documents").select("lang", F.explode(X.tokens(F.col("text"), 6)).alias("token"))
    return A.top_per_key(rows.groupBy("lang", "token").agg(F.count("*").alias("n")), ["lang"], 10, F.desc("n"), F.asc("token"))


@register(
    "sentence_stats",
    r"""SELECT doc_id, count(*) AS sentences, CAST(max(length(s)) AS BIGINT) AS longest FROM (
SELECT doc_id, trim(unnest(regexp_split_to_array(text, '[.!?\n]+'))) AS s FROM documents) WHERE s <> '' GROUP BY doc_id""",
)
def sentence_stats(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", F.explode(X.sentences(F.col("text"))).alias("s"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.max(F.length("s")).cast("long").alias("longest"))


@register(
    "cosine_topk",
    """SELECT vec_id, label, round(score, 4) AS score FROM (SELECT a.vec_id, a.label, list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score
FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) b) ORDER BY round(score, 4) DESC, vec_id LIMIT 25""",
)
def cosine_topk(spark, folder):
    vectors = table(spark, folder, "embeddings")
    query = vectors.agg(F.min_by("embedding", "vec_id").alias("q"))
    scored = vectors.join(F.broadcast(query)).select("vec_id", "label", F.round(X.cosine(F.col("embedding"), F.col("q")), 4).alias("score"))
    return scored.orderBy(F.desc("score"), "vec_id").limit(25)


@register(
    "cosine_topk_each",
    """SELECT query_id, vec_id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM (
SELECT b.vec_id AS query_id, a.vec_id, round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS score
FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0)) WHERE place <= 25""",
)
def cosine_topk_each(spark, folder):
    """By inverted lists; the second round makes it what a full scan gives."""
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = vectors.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("q"))
    lists = V.inverted_lists(vectors)
    if lists is None:
        return spark.createDataFrame([], "query_id long, vec_id long, score double, place int")
    return V.nearest(lists, asked, 25, digits=4).withColumnRenamed("id", "vec_id")


@register(
    "same_user_within_hour",
    """SELECT a.event_id AS a, b.event_id AS b, a.user_id FROM events a JOIN events b ON a.user_id = b.user_id
WHERE epoch(b.ts)::BIGINT - epoch(a.ts)::BIGINT BETWEEN 0 AND 3600 AND (date_trunc('second', b.ts) > date_trunc('second', a.ts) OR b.event_id > a.event_id)
AND date_trunc('second', b.ts) >= date_trunc('second', a.ts) AND floor(epoch(b.ts)) - floor(epoch(a.ts)) <= 3600 AND a.event_id <> b.event_id""",
)
def near_events(spark, folder):
    return A.hour_neighbours(table(spark, folder, "events").withColumn("id", F.col("event_id")), "user_id", "ts", 1)


@register(
    "asof_purchase_before_error",
    """SELECT e.event_id, p.value AS last_purchase FROM (SELECT * FROM events WHERE event_type = 'error') e
ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts >= p.ts""",
)
def asof_purchase(spark, folder):
    events = table(spark, folder, "events")
    errors = events.filter("event_type = 'error'").select("event_id", "user_id", "ts")
    purchases = events.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("last_purchase"))
    return A.as_of(errors, purchases, "user_id", "ts", "last_purchase").select("event_id", "last_purchase")


@register(
    "scd2_event_type_history",
    """WITH c AS (SELECT user_id, event_type, ts, lag(event_type) OVER w AS was FROM (SELECT user_id, ts, min(event_type) AS event_type FROM events GROUP BY 1, 2) WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
k AS (SELECT * FROM c WHERE was IS NULL OR was <> event_type)
SELECT user_id, event_type, CAST(row_number() OVER w AS INTEGER) AS version, CAST(epoch_us(ts) AS BIGINT) AS valid_from, lead(ts) OVER w IS NULL AS is_current FROM k WINDOW w AS (PARTITION BY user_id ORDER BY ts)""",
)
def scd2_history(spark, folder):
    rows = table(spark, folder, "events").groupBy("user_id", "ts").agg(F.min("event_type").alias("event_type"))
    found = A.scd2(rows, ["user_id"], "ts", "event_type")
    return found.select("user_id", "event_type", "version", F.unix_micros(F.col("valid_from").cast("timestamp")).alias("valid_from"), "is_current")


UPSERTED = """WITH o AS (SELECT user_id, max(value) AS top, min(event_type) AS kind FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1),
n AS (SELECT user_id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE max(value) END AS top, min(event_type) AS kind FROM events WHERE (ts < TIMESTAMP '2024-01-16') IS NOT TRUE GROUP BY 1)
SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.top, o.top) AS top, coalesce(n.kind, o.kind) AS kind FROM o FULL JOIN n ON o.user_id IS NOT DISTINCT FROM n.user_id"""


@register("upsert_later_over_earlier", UPSERTED)
@register("upsert_keeps_old_nonnull", UPSERTED)
def upsert_by_time(spark, folder):
    events = table(spark, folder, "events")
    early = F.expr("coalesce(ts < timestamp_ntz'2024-01-16', false)")
    per_user = lambda which: events.filter(which).groupBy("user_id").agg(F.max("value").alias("top"), F.min("event_type").alias("kind"))
    new = per_user(~early).withColumn("top", F.when(F.coalesce(F.col("user_id") % 3, F.lit(1)) != 0, F.col("top")))
    return A.upserted(per_user(early), new, ["user_id"])


@register("rollup_lang_source", "SELECT lang, source, count(*) AS n, grouping_id(lang, source) AS level FROM documents GROUP BY ROLLUP (lang, source)")
def rollup(spark, folder):
    """``level`` tells a subtotal from a key that is null."""
    return table(spark, folder, "documents").rollup("lang", "source").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@register("except_and_intersect", "SELECT c_nationkey AS k, 'both' AS side FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier UNION ALL (SELECT n_nationkey, 'none' FROM nation EXCEPT SELECT c_nationkey, 'none' FROM customer)")
def set_ops(spark, folder):
    c, s, n = (table(spark, folder, t).select(F.col(k).alias("k")) for t, k in (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey")))
    return c.intersect(s).withColumn("side", F.lit("both")).unionByName(n.exceptAll(c.distinct()).withColumn("side", F.lit("none")))


@register(
    "rank_family",
    """SELECT s_suppkey, rank() OVER w AS rnk, dense_rank() OVER w AS dense, ntile(4) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS quarter,
lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS next_key FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal)""",
)
def rank_family(spark, folder):
    w, total = Window.partitionBy("s_nationkey").orderBy("s_acctbal"), Window.partitionBy("s_nationkey").orderBy("s_acctbal", "s_suppkey")
    return table(spark, folder, "supplier").select("s_suppkey", F.rank().over(w).cast("long").alias("rnk"), F.dense_rank().over(w).cast("long").alias("dense"), F.ntile(4).over(total).cast("long").alias("quarter"), F.lead("s_suppkey").over(total).alias("next_key"))


@register(
    "left_join_nulls_first",
    """SELECT c_custkey, n FROM (SELECT c_custkey, o.n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) o ON c_custkey = o_custkey)
ORDER BY n NULLS FIRST, c_custkey LIMIT 40""",
)
def nulls_first(spark, folder):
    orders = table(spark, folder, "orders").filter("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    rows = table(spark, folder, "customer").select("c_custkey").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.orderBy(F.asc_nulls_first("n"), "c_custkey").select("c_custkey", "n").limit(40)


@register(
    "saturation_by_source",
    r"""SELECT source, round(share, 6) AS share, CASE WHEN share >= 0.6 THEN 'high' WHEN share >= 0.2 THEN 'medium' ELSE 'low' END AS class
FROM (SELECT source, avg(CASE WHEN regexp_matches(lower(text), '\b(orantion|hehely|inoran|ononst|thatin)\b') THEN 1.0 ELSE 0.0 END) AS share FROM documents GROUP BY source)""",
)
def saturation(spark, folder):
    rows = table(spark, folder, "documents").groupBy("source").agg(F.avg(F.coalesce(X.mentions(F.col("text"), TERMS), F.lit(False)).cast("int")).alias("s"))
    return rows.select("source", F.round("s", 6).alias("share"), A.saturation(F.col("s")).alias("class"))


@register(
    "comment_score_rules",
    """SELECT conv_id, turn, least(5, CASE WHEN length(t) > 200 THEN 2 WHEN length(t) > 50 THEN 1 ELSE 0 END + CASE WHEN contains(t, '?') THEN 1 ELSE 0 END
+ CASE WHEN contains(t, chr(10)) THEN 1 ELSE 0 END + CASE WHEN role = 'assistant' THEN 2 ELSE 0 END) AS score FROM (SELECT *, coalesce(text, '') AS t FROM conversations)""",
)
def comment_score(spark, folder):
    t = F.coalesce("text", F.lit(""))
    add = lambda c, n: F.when(c, n).otherwise(0)
    score = F.when(F.length(t) > 200, 2).when(F.length(t) > 50, 1).otherwise(0) + add(t.contains("?"), 1) + add(t.contains("\n"), 1) + add(F.col("role") == "assistant", 2)
    return table(spark, folder, "conversations").select("conv_id", "turn", F.least(F.lit(5), score).alias("score"))


@register(
    "session_windows",
    """SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS started, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM
(SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""",
)
def sessions(spark, folder):
    rows = table(spark, folder, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    found = rows.groupBy("user_id", F.session_window("ts", "2 hours").alias("s")).agg(F.count("*").alias("n"))
    return found.select("user_id", F.unix_timestamp("s.start").alias("started"), "n")
