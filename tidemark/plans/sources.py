"""Registered queries on comment trees, JSON lines, dictionaries and capped selection, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import capped, dictionary
from tidemark.plans.catalogue import register
from tidemark.session import checkpointed, scratch, shipped, table
from tidemark.sources import comments as K
from tidemark.sources import json_lines as J


@register(
    "comment_trees",
    """WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations)
SELECT conv_id AS listing, k AS place, CAST(k AS INTEGER) AS depth, CAST(conv_id * 1000 + turn AS VARCHAR) AS id, role AS author, coalesce(text, '') AS body, length(coalesce(text, '')) AS score,
       '/' || string_agg(CAST(conv_id * 1000 + turn AS VARCHAR), '/') OVER (PARTITION BY conv_id ORDER BY turn) AS path FROM c""",
)
def comment_trees(spark, folder):
    """Conversations as trees in which each turn answers the one before, read back into rows."""
    shipped(spark)
    turns = table(spark, folder, "conversations").select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("body"), F.col("role").alias("author"))
    listings = K.nested(turns.withColumn("score", F.length("body")), "conv_id", "turn")
    return K.comment_rows(listings).select("listing", "place", "depth", "id", "author", "body", "score", "path")


SINCE, UNTIL = 1_705_000_000, 1_706_000_000


def _lines(spark, folder):
    """A folder of lines: events as posts, labels, which have no time, and addresses of pages, which aren't JSON."""
    path = scratch(spark, "lines")
    time = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    posts = table(spark, folder, "events").select(F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("title"), F.col("props").alias("selftext"), F.floor("value").alias("score"), time.alias("created_utc"))).alias("value"))
    labels = table(spark, folder, "labels").select(F.to_json(F.struct("doc_id", "quality")).alias("value"))
    pages = table(spark, folder, "pages").select(F.coalesce("url", F.lit("")).alias("value"))
    posts.unionByName(labels).unionByName(pages).write.text(path)
    return J.read_lines(spark, path)


@register(
    "jsonl_backfill",
    f"""WITH e AS (SELECT CAST(event_id AS VARCHAR) AS id, event_type AS title, props AS body, CAST(floor(value) AS BIGINT) AS score, epoch_us(ts) / 1000000.0::DOUBLE AS created FROM events)
SELECT CASE WHEN created < {SINCE} OR created >= {UNTIL} THEN 'outside' END AS reason, id, title, body, score, CAST(round(created * 1000000) AS BIGINT) AS micros FROM e
UNION ALL SELECT 'no_time', NULL, NULL, NULL, -1, -1 FROM labels UNION ALL SELECT CASE WHEN trim(coalesce(url, '')) = '' THEN 'blank' ELSE 'broken' END, NULL, NULL, NULL, -1, -1 FROM pages""",
)
def jsonl_backfill(spark, folder):
    rows = J.backfill_rows(_lines(spark, folder), SINCE, UNTIL)
    return rows.select("reason", "id", "title", "body", F.coalesce("score", F.lit(-1)).alias("score"), F.coalesce(F.round(F.col("created") * 1_000_000).cast("long"), F.lit(-1)).alias("micros"))


@register(
    "jsonl_watermarks",
    f"""WITH e AS (SELECT CAST(event_id AS VARCHAR) AS id, epoch_us(ts) AS t FROM events WHERE epoch_us(ts) >= {SINCE}000000 AND epoch_us(ts) < {UNTIL}000000)
SELECT count(*) AS n, CAST(min(t) AS BIGINT) AS floor, CAST(max(t) AS BIGINT) AS last_time, min(id) FILTER (t = (SELECT max(t) FROM e)) AS last_id FROM e""",
)
def jsonl_watermarks(spark, folder):
    marks = J.watermarks(J.backfill_rows(_lines(spark, folder), SINCE, UNTIL))
    micros = lambda c: F.round(F.col(c) * 1_000_000).cast("long").alias(c)
    return marks.select("n", micros("floor"), micros("last_time"), "last_id")


@register(
    "dictionary_runs",
    """WITH b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM benchmark), r AS (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b),
t AS (SELECT array_to_string(w[i:i + 3], ' ') AS term, min(lpad(CAST(item_id AS VARCHAR), 6, '0')) AS category FROM r GROUP BY 1),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents), p AS (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM d),
g AS (SELECT doc_id, i - 1 AS start, array_to_string(w[i:i + 3], ' ') AS term FROM p)
SELECT doc_id AS id, start, term, category FROM g JOIN t USING (term)""",
)
def dictionary_runs(spark, folder):
    """Where documents have runs of four words of the benchmark's items."""
    words = table(spark, folder, "benchmark").select(F.lpad(F.col("item_id").cast("string"), 6, "0").alias("category"), X.tokens(F.coalesce("text", F.lit(""))).alias("w"))
    places = F.when(F.size("w") >= 5, F.sequence(F.lit(1), F.size("w") - 4)).otherwise(F.array().cast("array<int>"))
    terms = words.select("category", F.col("category").alias("canonical"), F.explode(F.transform(places, lambda i: F.array_join(F.slice("w", i, 4), " "))).alias("term"))
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    return dictionary.matches(docs, terms, overlapping=True).select("id", F.col("start").cast("long").alias("start"), "term", "category")


@register("capped_inventory")
def capped_inventory(spark, folder):
    """By value, at most 10 views, 20 clicks and 30 of each other type, two of a user and five of a day.

    No SQL: the second engine's recursion takes a minute over 10,000 rows; tested against the plain loop.
    """
    rows = table(spark, folder, "events").select("event_id", "event_type", "user_id", F.to_date("ts").alias("day"), "value")
    cap = F.when(F.col("event_type") == "view", 10).when(F.col("event_type") == "click", 20).otherwise(30)
    found = capped.admitted(rows, [F.desc("value"), F.asc("event_id")], {"event_type": cap, "user_id": 2, "day": 5})
    return found.filter("taken").select("event_id")
