"""Registered queries on quotas, evaluation, recency, streaks, terms and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import analytics as A
from tidemark.operators import selection as S
from tidemark.plans.catalogue import ANCHOR, ORACLE_SQL, register, sentence_stats, term_occurrences
from tidemark.session import table
from tidemark.streaming import events as E

SCORED = "SELECT doc_id, quality, least(1.0::DOUBLE, n_chars / 2000.0::DOUBLE) AS score FROM documents JOIN labels USING (doc_id)"
GRID = [0.1, 0.25, 0.5, 0.75, 0.9]
GRID_SQL = f"""SELECT threshold, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM (SELECT threshold, count(*) FILTER (WHERE score >= threshold AND quality = 1) AS tp,
count(*) FILTER (WHERE score >= threshold AND quality <> 1) AS fp, count(*) FILTER (WHERE score < threshold AND quality = 1) AS fn
FROM ({SCORED}), (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in GRID)}]) AS threshold) GROUP BY threshold)"""


def _scored(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / F.lit(2000.0)).alias("score"))
    return docs.join(table(spark, folder, "labels").select("doc_id", "quality"), "doc_id")


@register("threshold_grid", GRID_SQL)
def threshold_grid(spark, folder):
    return S.threshold_grid(_scored(spark, folder), "score", "quality", GRID)


@register("best_threshold", f"SELECT * FROM ({GRID_SQL}) WHERE precision >= 0.5 ORDER BY f1 DESC, threshold LIMIT 1")
def best_threshold(spark, folder):
    return S.best_threshold(S.threshold_grid(_scored(spark, folder), "score", "quality", GRID), 0.5)


@register("precision_at_50", f"SELECT count(*) AS n, round(avg(CASE WHEN quality = 1 THEN 1 ELSE 0 END), 6) AS precision FROM (SELECT * FROM ({SCORED}) ORDER BY score DESC, doc_id LIMIT 50)")
def precision_at(spark, folder):
    return S.precision_at(_scored(spark, folder), "doc_id", "score", "quality", 50)


@register(
    "quota_by_source",
    """SELECT source, n, q + CASE WHEN row_number() OVER (ORDER BY r DESC, source) <= 101 - sum(q) OVER () THEN 1 ELSE 0 END AS quota
FROM (SELECT source, n, n * 101 // s AS q, n * 101 % s AS r FROM (SELECT source, n, CAST(sum(n) OVER () AS BIGINT) AS s FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)))""",
)
def quota_by_source(spark, folder):
    return S.largest_remainder(table(spark, folder, "documents").groupBy("source").agg(F.count("*").alias("n")), "source", "n", 101)


@register(
    "sample_by_lang",
    "SELECT doc_id, lang, place FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS place FROM documents) WHERE place <= 15",
)
def sample_by_lang(spark, folder):
    return S.sample_by_hash(table(spark, folder, "documents").select("doc_id", "lang"), "lang", 15, "doc_id")


@register(
    "type_streaks",
    """SELECT user_id, streak, min(event_type) AS event_type, count(*) AS n FROM (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM
(SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, streak""",
)
def type_streaks(spark, folder):
    return S.streaks(table(spark, folder, "events").select("user_id", "event_type", "ts", "event_id"), "user_id", "event_type", "ts", "event_id")


@register(
    "tf_idf_keywords",
    """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{5,}')) AS token FROM documents),
tf AS (SELECT doc_id, token, count(*) AS tf FROM t GROUP BY 1, 2), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM documents)
SELECT doc_id, token, tf, weight, place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, token) AS place FROM
(SELECT doc_id, token, tf, round(tf * (ln((n + 1) / (df + 1)) + 1), 6) AS weight FROM tf JOIN df USING (token), n)) WHERE place <= 3""",
)
def tf_idf_keywords(spark, folder):
    docs = table(spark, folder, "documents")
    tokens = docs.select("doc_id", F.explode(X.tokens(F.col("text"), 5)).alias("token"))
    return A.top_per_key(S.tf_idf(tokens, "doc_id", "token", docs.select("doc_id")), ["doc_id"], 3, F.desc("weight"), F.asc("token"))


#: Engines differ on where words with other letters end, so here they end at any character but ASCII letters, digits and _.
@register(
    "capitalised_terms",
    r"""SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs, round(0.4 + 0.35 * least(1.0, count(*) / 10), 6) AS confidence FROM
(SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS term FROM documents) WHERE regexp_full_match(term, '[A-Z][a-z]{3,}') GROUP BY term HAVING count(*) >= 3""",
)
def capitalised_terms(spark, folder):
    pattern = r"(?<![A-Za-z0-9_])[A-Z][a-z]{3,}(?![A-Za-z0-9_])"
    rows = table(spark, folder, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("term"))
    found = rows.groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs")).filter("n >= 3")
    return found.withColumn("confidence", F.round(0.4 + 0.35 * F.least(F.lit(1.0), F.col("n") / 10), 6))


@register(
    "longest_quote",
    r"""SELECT doc_id, quote FROM (SELECT doc_id, s AS quote, row_number() OVER (PARTITION BY doc_id ORDER BY length(s) DESC, s) AS k FROM
(SELECT doc_id, trim(unnest(regexp_split_to_array(text, '[.!?\n]+'))) AS s FROM documents) WHERE length(s) BETWEEN 50 AND 150) WHERE k = 1""",
)
def longest_quote(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", F.explode(X.sentences(F.col("text"))).alias("quote")).filter(F.length("quote").between(50, 150))
    return A.latest_per_key(rows, ["doc_id"], F.desc(F.length("quote")), F.asc("quote"))


#: Second names of queries that once read English documents only.
for _query in (tf_idf_keywords, capitalised_terms, longest_quote, term_occurrences, sentence_stats):
    register(f"{_query.__name__}_all_languages", ORACLE_SQL[_query.__name__])(_query)


@register(
    "tiered_expiry",
    "SELECT event_id, CAST(epoch_us(ts) AS BIGINT) + 86400000000 * CASE WHEN value >= 300 THEN 365 WHEN value >= 100 THEN 180 ELSE 30 END AS expires FROM events",
)
def tiered_expiry(spark, folder):
    days = F.when(F.col("value") >= 300, 365).when(F.col("value") >= 100, 180).otherwise(30)
    return table(spark, folder, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) + F.lit(86_400_000_000) * days).alias("expires"))


@register(
    "recency_windows",
    "SELECT event_type, " + ", ".join(f"count(*) FILTER (WHERE ts >= TIMESTAMP '{ANCHOR}' - INTERVAL {d} DAY AND ts < TIMESTAMP '{ANCHOR}') AS last_{d}" for d in (7, 15, 30)) + " FROM events GROUP BY event_type",
)
def recency_windows(spark, folder):
    within = lambda d: F.expr(f"ts >= timestamp_ntz'{ANCHOR}' - interval {d} days and ts < timestamp_ntz'{ANCHOR}'")
    return table(spark, folder, "events").groupBy("event_type").agg(*(F.count_if(within(d)).alias(f"last_{d}") for d in (7, 15, 30)))


@register(
    "repeat_within_day",
    """SELECT event_id FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS p FROM events) WHERE ts - p < INTERVAL 24 HOUR""",
)
def repeat_within_day(spark, folder):
    before = F.lag("ts").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    return table(spark, folder, "events").withColumn("p", before).filter("ts - p < interval 24 hours").select("event_id")


@register(
    "capped_then_ranked",
    """SELECT doc_id, source FROM (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k <= 3 ORDER BY n_chars DESC, doc_id LIMIT 30""",
)
def capped_then_ranked(spark, folder):
    rows = A.top_per_key(table(spark, folder, "documents").select("doc_id", "source", "n_chars"), ["source"], 3, F.desc("n_chars"), F.asc("doc_id"))
    return rows.orderBy(F.desc("n_chars"), "doc_id").select("doc_id", "source").limit(30)


@register(
    "stream_daily_counts",
    "SELECT CAST(floor(epoch(date_trunc('day', ts))) AS BIGINT) AS started, event_type, count(*) AS n FROM events GROUP BY 1, 2",
)
def stream_daily_counts(spark, folder):
    return E.run_to_end(E.window_counts(E.read_events(spark, folder), "event_type", "1 day", "60 days"), "complete")


@register(
    "stream_waterline",
    "SELECT event_type, event_id AS last_id, CAST(epoch_us(ts) AS BIGINT) AS last_ts FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
)
def stream_waterline(spark, folder):
    return E.run_to_end(E.waterline(E.read_events(spark, folder), "event_type", "event_id"), "complete")


@register("stream_once_per_key", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT event_id, user_id, event_type FROM events) GROUP BY 1, 2")
def stream_once_per_key(spark, folder):
    found = E.run_to_end(E.once(E.read_events(spark, folder), "event_id", "1 day"), "append")
    return found.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
