"""Registered queries on aspects, candidates, names, caps, alerts and audits, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import capped
from tidemark.operators import governance as G
from tidemark.plans import further
from tidemark.plans.catalogue import ORACLE_SQL, register
from tidemark.plans.posts import COMMENTS, POSTS, comments, posts, quoted
from tidemark.session import scratch, table


@register("aspect_clusters", f"""WITH {COMMENTS}, r AS (SELECT author AS aspect, id, body, row_number() OVER (PARTITION BY author ORDER BY score DESC, id) AS k FROM comments WHERE length(body) > 20), s AS (SELECT * FROM r WHERE k <= 5),
w AS (SELECT aspect, unnest(regexp_extract_all(lower(body), '[a-z0-9]{{3,}}')) AS word FROM s), c AS (SELECT aspect, word, row_number() OVER (PARTITION BY aspect ORDER BY count(*) DESC, word) AS k FROM w GROUP BY 1, 2), t AS (SELECT aspect, string_agg(word, ',' ORDER BY k) AS keywords FROM c WHERE k <= 8 GROUP BY 1)
SELECT aspect, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY s.k) AS samples, coalesce(any_value(keywords), '') AS keywords FROM s LEFT JOIN t USING (aspect) GROUP BY aspect""")
def aspect_clusters(spark, folder):
    return G.aspect_clusters(comments(spark, folder).select(F.col("author").alias("aspect"), "id", F.col("body").alias("text"), "score"), 5, 8)


@register("candidate_stats", "WITH s AS (SELECT event_type || floor(value / 50)::BIGINT AS term, count(*) AS frequency, max(value) AS confidence, count(DISTINCT CAST(json_extract(props, '$.k') AS BIGINT)) AS communities, count(DISTINCT user_id) AS authors FROM events GROUP BY 1) SELECT *, frequency >= 100 AND confidence >= 40 AND communities >= 10 AS approved FROM s")
def candidate_stats(spark, folder):
    term = F.concat("event_type", F.floor(F.col("value") / 50).cast("string"))
    rows = table(spark, folder, "events").select(term.alias("term"), F.col("value").alias("confidence"), F.get_json_object("props", "$.k").cast("long").alias("community"), F.col("user_id").alias("author"))
    return G.candidate_stats(rows, 100, 40.0, 10)


@register("best_matches", f"""WITH {POSTS}, a AS (SELECT id AS name, list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+')) AS t FROM posts), b AS (SELECT item_id AS entry, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS t FROM benchmark),
x AS (SELECT name, len(t) AS n, unnest(t) AS w FROM a), y AS (SELECT entry, len(t) AS m, unnest(t) AS w FROM b), j AS (SELECT name, entry, round(count(*) / (n + m - count(*)), 6) AS confidence FROM x JOIN y USING (w) GROUP BY name, entry, n, m)
SELECT name, entry, confidence FROM j WHERE confidence >= 0.05 QUALIFY row_number() OVER (PARTITION BY name ORDER BY confidence DESC, entry) = 1""")
def best_matches(spark, folder):
    names = posts(spark, folder).select("id", F.col("title").alias("text"))
    return G.best_matches(names, table(spark, folder, "benchmark").select(F.col("item_id").alias("id"), "text"), 0.05)


_DESCRIPTION = "the thatin of that der que zzzz the"
_ASKED = {w: _DESCRIPTION.split().count(w) for w in dict.fromkeys(_DESCRIPTION.split()) if len(w) > 2}


@register("fit_to_description", f"""WITH t AS (SELECT source, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{{3,}}')) AS w FROM documents), f AS (SELECT source, w, count(*) AS tf FROM t GROUP BY 1, 2), d AS (SELECT w, count(*) AS df FROM f GROUP BY 1), s AS (SELECT count(DISTINCT source) AS n FROM documents),
q(w, q) AS (VALUES {', '.join(f"({quoted(w)}, {n})" for w, n in _ASKED.items())}), i AS (SELECT w, ln(CAST(n + 1 AS DOUBLE) / (df + 1)) + 1 AS idf FROM d, s), l AS (SELECT sqrt(sum(pow(q * coalesce(idf, ln(CAST(n + 1 AS DOUBLE)) + 1), 2))) AS len FROM q LEFT JOIN i USING (w), s),
c AS (SELECT source, sum(tf * idf * coalesce(q, 0) * idf) AS dot, sqrt(sum(tf * idf * tf * idf)) AS norm FROM f JOIN i USING (w) LEFT JOIN q USING (w) GROUP BY 1) SELECT source, round(dot / (norm * len), 6) AS cosine FROM c, l WHERE round(dot / (norm * len), 6) > 0 ORDER BY cosine DESC, source LIMIT 8""")
def fit_to_description(spark, folder):
    return G.fit_to_description(table(spark, folder, "documents").select("source", "text"), "source", _DESCRIPTION, 8)


@register("inventory_caps", "SELECT event_type, count(*) AS n, greatest(1, CAST(ceil(round(count(*) * 0.3::DOUBLE, 9)) AS BIGINT)) AS scope, greatest(1, CAST(ceil(round(count(*) * 0.12::DOUBLE, 9)) AS BIGINT)) AS pack, greatest(1, CAST(ceil(round(count(*) * 0.0001::DOUBLE, 9)) AS BIGINT)) AS community FROM events GROUP BY 1")
def inventory_caps(spark, folder):
    sums = table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return sums.select("event_type", "n", *G.caps_of(F.col("n"), {"scope": 0.3, "pack": 0.12, "community": 0.0001}))


@register("publish_plan")
def publish_plan(spark, folder):
    """A day's lanes, by value: at most 8 of a lane and day, 20 of a user, 400 together. No SQL, as ``capped_inventory``."""
    rows = table(spark, folder, "events").select("event_id", F.concat_ws("/", "event_type", F.to_date("ts").cast("string")).alias("lane"), "user_id", "value")
    return capped.admitted(rows, [F.desc("value"), F.asc("event_id")], {"lane": 8, "user_id": 20}, most=400).filter("taken").select("event_id", "lane")


@register("record_window", "SELECT event_id, ts >= TIMESTAMP '2024-01-24' AS recent FROM events WHERE ts >= TIMESTAMP '2024-01-17' AND ts < TIMESTAMP '2024-01-31'")
def record_window(spark, folder):
    t = lambda d: F.expr(f"timestamp_ntz'{d}'")
    rows = table(spark, folder, "events").filter((F.col("ts") >= t("2024-01-17")) & (F.col("ts") < t("2024-01-31")))
    return rows.select("event_id", (F.col("ts") >= t("2024-01-24")).alias("recent"))


@register("primary_community", "SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, max(ts) DESC, event_type) AS k FROM events GROUP BY 1, 2) WHERE k = 1")
def primary_community(spark, folder):
    return G.primary_of(table(spark, folder, "events").select("user_id", "event_type", "ts"), "user_id", "event_type", "ts")


@register("contract_alerts", "WITH h AS (" + ORACLE_SQL["contract_health"] + ") SELECT contract, 'broken' AS what, round(broken / n, 6) AS share, 'high' AS severity FROM h WHERE broken / n > 0.1::DOUBLE UNION ALL SELECT contract, 'incomplete', round(incomplete / n, 6), 'low' FROM h WHERE incomplete / n > 0.5::DOUBLE")
def contract_alerts(spark, folder):
    return G.alerts(further.contract_health(spark, folder), [("broken", 0.1, "high"), ("incomplete", 0.5, "low")])


@register("truth_counts", "SELECT 'documents' AS name, count(*) AS n, count(DISTINCT doc_id) AS ids FROM documents UNION ALL SELECT 'labels', count(*), count(DISTINCT doc_id) FROM labels UNION ALL SELECT 'embeddings', count(*), count(DISTINCT vec_id) FROM embeddings UNION ALL SELECT 'labelled', count(*), count(DISTINCT doc_id) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT 'embedded', count(*), count(DISTINCT doc_id) FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)")
def truth_counts(spark, folder):
    docs, labels, vectors = table(spark, folder, "documents").select("doc_id"), table(spark, folder, "labels").select("doc_id"), table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"))
    count = lambda name, rows: rows.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"))
    parts = [count("documents", docs), count("labels", labels), count("embeddings", vectors), count("labelled", docs.join(labels, "doc_id", "left_semi")), count("embedded", docs.join(vectors, "doc_id", "left_semi"))]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


@register("suggestion_coherence", "WITH i AS (SELECT event_type AS suggestion, event_id AS id, user_id AS anchor FROM events), n AS (SELECT suggestion, count(DISTINCT id) AS n FROM i GROUP BY 1), s AS (SELECT suggestion, anchor FROM i GROUP BY 1, 2 HAVING count(DISTINCT id) >= 20), h AS (SELECT suggestion, count(DISTINCT anchor) AS anchors, count(DISTINCT id) AS held FROM i JOIN s USING (suggestion, anchor) GROUP BY 1) SELECT suggestion, n, coalesce(anchors, 0) AS anchors, round(coalesce(held, 0) / n, 6) AS coherence FROM n LEFT JOIN h USING (suggestion)")
def suggestion_coherence(spark, folder):
    rows = table(spark, folder, "events").select(F.col("event_type").alias("suggestion"), F.col("event_id").alias("id"), F.col("user_id").alias("anchor"))
    return G.coherence(rows, 20)


@register("labels_by_lines", "SELECT doc_id, quality, toxic FROM labels")
def labels_by_lines(spark, folder):
    """Labels as files of JSON lines, read back by their schema."""
    path = scratch(spark, "labels")
    table(spark, folder, "labels").select("doc_id", "quality", "toxic").write.json(path)
    return spark.read.schema("doc_id long, quality int, toxic int").json(path)


@register("samples_by_csv", "SELECT item_id, text FROM benchmark UNION ALL SELECT doc_id, coalesce(text, '') FROM documents")
def samples_by_csv(spark, folder):
    """Texts with commas, quotes and line ends as CSV, read back whole; an empty text is written as a quoted one."""
    path = scratch(spark, "samples")
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    table(spark, folder, "benchmark").select("item_id", "text").unionByName(docs).write.option("quoteAll", True).option("escape", '"').option("lineSep", "\n").csv(path)
    return spark.read.schema("item_id long, text string").option("multiLine", True).option("escape", '"').option("emptyValue", "").option("maxCharsPerColumn", -1).csv(path)
