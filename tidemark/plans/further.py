"""Registered queries that complete rows of other modules: writes, counts, mixes, plans and functions of tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scoring as S
from tidemark.operators import evaluation as V
from tidemark.operators import rollups as W
from tidemark.plans import extraction, scoring
from tidemark.plans.catalogue import ORACLE_SQL, register
from tidemark.plans.posts import COMMENTS, MENTIONS, POSTS, comments, mentions, order_posts, posts, quoted
from tidemark.session import table


@register("like_and_not_ilike", "SELECT p_partkey FROM part WHERE p_name LIKE '%e%' AND p_name NOT ILIKE '%RED%'")
def like_and_not_ilike(spark, folder):
    part = table(spark, folder, "part")
    return part.filter(F.col("p_name").like("%e%") & ~F.col("p_name").ilike("%RED%")).select("p_partkey")


@register("authors_of_batches", "SELECT role AS author, min(conv_id) AS first_seen, max(conv_id) AS last_seen FROM conversations WHERE role IS NOT NULL GROUP BY 1")
def authors_of_batches(spark, folder):
    """Authors after two batches of comments: first answers, then the rest."""
    rows = table(spark, folder, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("author"), F.col("conv_id").alias("at"), F.col("text").alias("body"), F.length("text").alias("score"), "turn")
    none, nobody = rows.limit(0).drop("turn"), spark.createDataFrame([], "author string, first_seen long, last_seen long")
    stored, authors = W.comments_with_authors(none, nobody, rows.filter("turn > 0").drop("turn"))
    return W.comments_with_authors(stored, authors, rows.filter("turn <= 0").drop("turn"))[1]


@register("labels_written_again", "SELECT doc_id, quality AS category, CASE WHEN toxic = 1 THEN 'llm' ELSE 'rule' END AS source, 0 AS created FROM labels UNION ALL SELECT doc_id, NULL, lang, 1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def labels_written_again(spark, folder):
    """Labels, written once for all documents without a category, and then for the labelled ones: fields are replaced, the first writer's source stays."""
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("category"), F.when(F.col("toxic") == 1, "llm").otherwise("rule").alias("source"), F.lit(0).alias("created"))
    docs = table(spark, folder, "documents").select("doc_id", F.lit(None).cast("int").alias("category"), F.col("lang").alias("source"), F.lit(1).alias("created"))
    stored = W.labels_upserted(labels, docs.join(labels.select("doc_id"), "doc_id", "left_anti"), ["doc_id"], ["category"], ["source", "created"])
    return W.labels_upserted(stored, labels.withColumn("source", F.lit("again")), ["doc_id"], ["category"], ["source", "created"])


@register("term_frequency_replaced", "SELECT p_brand AS term, count(*) AS frequency, min(p_size) AS first FROM part GROUP BY 1")
def term_frequency_replaced(spark, folder):
    """A term's frequency is that of the last count, of all parts, not the sum with the one of the small parts before it."""
    part = table(spark, folder, "part")
    count = lambda rows: rows.groupBy(F.col("p_brand").alias("term")).agg(F.count("*").alias("frequency"), F.min("p_size").alias("first"))
    return W.labels_upserted(count(part.filter("p_size < 20")), count(part), ["term"], ["frequency"], ["first"])


@register("aspect_breakdown", f"WITH {MENTIONS} SELECT aspect, count(*) AS pain, count(*) AS total, count(DISTINCT post) AS posts FROM mentions GROUP BY 1")
def aspect_breakdown(spark, folder):
    """``pain`` and ``total`` are the same count, as where the rows are pains already."""
    return mentions(spark, folder).groupBy("aspect").agg(F.count("*").alias("pain"), F.count("*").alias("total"), F.countDistinct("post").alias("posts"))


@register("mood_shares", f"WITH {POSTS}, m AS (SELECT source, round(x / sqrt(x * x + 15.0::DOUBLE), 6) AS mood FROM (SELECT source, coalesce({scoring.MOOD_SQL.format('text')}, 0.0::DOUBLE) AS x FROM posts)), s AS (SELECT source, count(*) AS n, count(*) FILTER (mood > 0.05::DOUBLE) AS u, count(*) FILTER (mood < -0.05::DOUBLE) AS d FROM m GROUP BY 1) SELECT source, n, round(u / n, 6) AS positive, round(d / n, 6) AS negative, round(1 - u / n - d / n, 6) AS neutral FROM s")
def mood_shares(spark, folder):
    rows = posts(spark, folder).select("source", S.sentiment(F.col("text"), scoring.MOOD).alias("mood"))
    return W.mood_shares(rows, "source", F.col("mood"))


_NAMED = [r"\b(?:the|der|que) ([a-z]{4,})\b", r"\b([a-z]{5,}) (?:and|und|les)\b", r"\b(?:from|von|los) ([a-z]{4,})\b"]


@register("named_by_patterns", f"WITH d AS (SELECT doc_id AS id, coalesce(text, '') AS t FROM documents), n AS (SELECT id, unnest(list_distinct(list_transform(list_concat({', '.join(f'regexp_extract_all(t, {quoted(p)}, 1)' for p in _NAMED)}), lambda x: lower(trim(x))))) AS name FROM d) SELECT name, count(*) AS n FROM n WHERE name <> '' GROUP BY 1 ORDER BY n DESC, name LIMIT 5")
def named_by_patterns(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    edge = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
    return W.named_by_patterns(docs, [p.replace(r"\b", edge) for p in _NAMED], 5)


_KINDS = {"pain": ("pain_points", "key", 15), "competitor": ("competitors", "name", 12), "opportunity": ("opportunities", "key", 10), "solution": ("solutions_first_pass", "key", 8)}


@register("full_extraction", "WITH " + ", ".join(f"{k} AS (SELECT '{k}' AS kind, CAST({c} AS VARCHAR) AS key, CAST(relevance AS DOUBLE) AS relevance FROM ({ORACLE_SQL[q]}) ORDER BY relevance DESC, key LIMIT {n})" for k, (q, c, n) in _KINDS.items()) + f", u AS ({' UNION ALL '.join(f'SELECT * FROM {k}' for k in _KINDS)}) SELECT *, CAST(row_number() OVER (PARTITION BY kind ORDER BY relevance DESC, key) AS INTEGER) AS place FROM u")
def full_extraction(spark, folder):
    """Pains, competitors, opportunities and solutions together, the best of each."""
    return W.first_of_kinds({k: (getattr(extraction, q)(spark, folder), c, "relevance", n) for k, (q, c, n) in _KINDS.items()})


@register("battlefields", f"WITH {MENTIONS} SELECT brand, count(*) FILTER (status = 'F') AS pains, count(*) AS mentions FROM mentions JOIN order_posts USING (post) GROUP BY 1 ORDER BY pains DESC, mentions DESC, brand LIMIT 10")
def battlefields(spark, folder):
    rows = mentions(spark, folder).select("post", "brand").join(order_posts(spark, folder).select("post", "status"), "post")
    return rows.groupBy("brand").agg(F.count_if(F.col("status") == "F").alias("pains"), F.count("*").alias("mentions")).orderBy(F.desc("pains"), F.desc("mentions"), "brand").limit(10)


@register("gap_priorities", "WITH d AS (SELECT c_nationkey AS k, count(*) AS demand FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS supply FROM supplier GROUP BY 1) SELECT n_name, coalesce(demand, 0) AS demand, coalesce(supply, 0) AS supply, round(CASE WHEN coalesce(demand, 0) + coalesce(supply, 0) > 0 THEN coalesce(demand, 0) / (coalesce(demand, 0) + coalesce(supply, 0)) ELSE 0.0 END, 6) AS gap FROM nation LEFT JOIN d ON d.k = n_nationkey LEFT JOIN s ON s.k = n_nationkey ORDER BY gap DESC, n_name")
def gap_priorities(spark, folder):
    count = lambda name, key, out: table(spark, folder, name).groupBy(F.col(key).alias("n_nationkey")).agg(F.count("*").alias(out))
    rows = table(spark, folder, "nation").join(count("customer", "c_nationkey", "demand"), "n_nationkey", "left").join(count("supplier", "s_nationkey", "supply"), "n_nationkey", "left").na.fill(0, ["demand", "supply"])
    return rows.select("n_name", "demand", "supply", F.round(W.gap_scores(rows, "demand", "supply"), 6).alias("gap")).orderBy(F.desc("gap"), "n_name")


@register("brand_pains", f"""WITH {MENTIONS}, m AS (SELECT brand, aspect AS pain, post AS id, community AS author, score FROM mentions JOIN (SELECT post, score FROM order_posts) USING (post)), s AS (SELECT brand, pain, count(DISTINCT id) AS mentions, count(DISTINCT author) AS authors FROM m GROUP BY 1, 2),
b AS (SELECT brand, pain, id, row_number() OVER (PARTITION BY brand, pain ORDER BY max(score) DESC, id) AS k FROM m GROUP BY 1, 2, 3), e AS (SELECT brand, pain, string_agg(CAST(id AS VARCHAR), ',' ORDER BY k) AS evidence FROM b WHERE k <= 3 GROUP BY 1, 2)
SELECT *, CASE WHEN mentions < 400 THEN 'too_few_mentions' WHEN authors < 25 THEN 'too_few_authors' ELSE 'ok' END AS status FROM s JOIN e USING (brand, pain)""")
def brand_pains(spark, folder):
    rows = mentions(spark, folder).select("post", "brand", F.col("aspect").alias("pain"), F.col("community").alias("author"))
    scored = rows.join(order_posts(spark, folder).select("post", "score"), "post").withColumnRenamed("post", "id")
    return W.brand_pains(scored, 400, 25, 3)


@register("breakdown_groups", "WITH i AS (SELECT o_orderkey AS id, o_orderstatus AS s, o_orderpriority AS p, strftime(o_orderdate, '%Y') AS f FROM orders), u AS (SELECT 'scope' AS kind, s AS name, count(DISTINCT id) AS n FROM i WHERE s IS NOT NULL GROUP BY 2 UNION ALL SELECT 'pack', s || '/' || p, count(DISTINCT id) FROM i WHERE s IS NOT NULL AND p IS NOT NULL GROUP BY 2 UNION ALL SELECT 'focus', s || '/' || p || '/' || f, count(DISTINCT id) FROM i WHERE s IS NOT NULL AND p IS NOT NULL AND f IS NOT NULL GROUP BY 2) SELECT * FROM u WHERE n >= 140")
def breakdown_groups(spark, folder):
    items = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"), F.date_format("o_orderdate", "yyyy").alias("f"))
    return W.breakdown(items, "s", "p", "f", 140)


_TERMS = {"thatin": "phrase", "The": "exact", "by the": "phrase"}
_LOW = lambda k: "" if _TERMS[k] == "exact" else "(?i)"
_BODY = lambda k: _LOW(k) + "\\b" + "\\s+".join(k.split()) + "\\b"


@register("term_places", "WITH d AS (SELECT doc_id AS id, coalesce(text, '') AS t FROM documents), u AS (" + " UNION ALL ".join(f"SELECT id, '{k}' AS term, len(regexp_extract_all(t, '{_BODY(k)}')) AS n, length(string_split_regex(t, '{_BODY(k)}')[1]) AS first FROM d" for k in _TERMS) + ") SELECT * FROM u WHERE n > 0")
def term_places(spark, folder):
    return W.term_places(table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text"), _TERMS)


@register("release_trend", "WITH c AS (SELECT strftime(o_orderdate, '%Y') AS release, min(o_orderdate) AS t, o_orderpriority AS layer, count(*) AS n FROM orders GROUP BY 1, 3), r AS (SELECT release, min(t) AS t FROM c GROUP BY 1) SELECT CAST(dense_rank() OVER (ORDER BY r.t, release) AS INTEGER) AS place, release, layer, n, n - lag(n) OVER (PARTITION BY layer ORDER BY r.t, release) AS change, coalesce(n > CASE layer WHEN '1-URGENT' THEN 450 WHEN '2-HIGH' THEN 400 END, false) AS over FROM c JOIN r USING (release)")
def release_trend(spark, folder):
    orders = table(spark, folder, "orders").select(F.date_format("o_orderdate", "yyyy").alias("release"), F.col("o_orderpriority").alias("layer"), "o_orderdate")
    at = orders.groupBy("release").agg(F.min("o_orderdate").alias("at"))
    counts = orders.groupBy("release", "layer").agg(F.count("*").alias("n")).join(at, "release")
    return W.release_trend(counts, {"1-URGENT": 450, "2-HIGH": 400})


@register("tiers_by_mean", "WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) FILTER (event_type <> 'error') AS n FROM events GROUP BY 1, 2), a AS (SELECT user_id, avg(n) AS average, count(*) AS days FROM d GROUP BY 1) SELECT user_id, CASE WHEN days > 20 THEN CASE WHEN user_id IN (SELECT user_id FROM events WHERE value > 450) THEN 'blacklisted' WHEN average <= 0 THEN 'no_data' WHEN average > 2.2 THEN 'tier1' WHEN average > 1.9 THEN 'tier2' ELSE 'tier3' END END AS tier FROM a")
def tiers_by_mean(spark, folder):
    """By the mean of valid events a day; users of few days aren't active, those with a value over 450 are blocked."""
    events = table(spark, folder, "events")
    day = events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") != "error").alias("n"))
    mean = day.groupBy("user_id").agg(F.avg("n").alias("average"), F.count("*").alias("days"))
    blocked = events.groupBy("user_id").agg((F.max("value") > 450).alias("blocked"))
    tier = S.tier_by_valid_posts(F.col("average"), F.col("days") > 20, F.col("blocked"), 2.2, 1.9)
    return mean.join(blocked, "user_id").select("user_id", tier.alias("tier"))


@register("batch_plans", "WITH n AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT event_type, k AS batch, CASE WHEN k = 0 THEN least(n, 300) ELSE least(500, n - 300 - 500 * (k - 1)) END AS size FROM n, LATERAL (SELECT unnest(range(0, 1 + CAST(ceil(greatest(n - 300, 0) / 500.0::DOUBLE) AS BIGINT))) AS k)")
def batch_plans(spark, folder):
    """Per event type a first batch of 300, then ones of 500; a row of counts for each type comes to the driver."""
    counts = table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n")).collect()
    rows = [(r.event_type, k, size) for r in counts for k, size in enumerate(V.batch_plan(r.n, 300, 500))]
    return spark.createDataFrame(rows, "event_type string, batch long, size long")


@register("lateral_in_stats", "SELECT s_suppkey, n, late FROM supplier LEFT JOIN LATERAL (SELECT count(*) AS n, count(*) FILTER (l_shipdate > TIMESTAMP '2000-01-01') AS late FROM lineitem WHERE l_suppkey = s_suppkey) ON true")
def lateral_in_stats(spark, folder):
    supplier, lines = table(spark, folder, "supplier"), table(spark, folder, "lineitem")
    of = spark.sql(
        "SELECT s_suppkey, n, late FROM {s} s LEFT JOIN LATERAL (SELECT count(*) AS n, count_if(l_shipdate > timestamp_ntz'2000-01-01') AS late FROM {l} l WHERE l.l_suppkey = s.s_suppkey) ON true", s=supplier, l=lines
    )
    return of


@register("nation_summary", "SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def nation_summary(spark, folder):
    """Through a function that returns a table, called for each row of another."""
    table(spark, folder, "customer").select("c_nationkey", "c_acctbal").createOrReplaceTempView("tidemark_customers")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tidemark_of_nation(k INT) RETURNS TABLE(customers BIGINT, balance DOUBLE) RETURN SELECT count(*), round(sum(c_acctbal), 2) FROM tidemark_customers WHERE c_nationkey = k")
    rows = spark.sql("SELECT n_name, f.customers, f.balance FROM {n} n, LATERAL tidemark_of_nation(n.n_nationkey) f", n=table(spark, folder, "nation"))
    return rows.filter("customers > 0")


@register("plugged_scores", f"WITH {POSTS} SELECT id, CAST(length(text) % 7 AS DOUBLE) AS length_score, CASE WHEN contains(lower(text), 'thatin') THEN 1.0 ELSE 0.0 END::DOUBLE AS term_score FROM posts")
def plugged_scores(spark, folder):
    scorers = {"length_score": lambda t: (F.length(t) % 7).cast("double"), "term_score": lambda t: S.points(S.any_of(S.plain(t), ["thatin"]), 1.0)}
    return W.scored(posts(spark, folder).select("id", "text"), scorers).drop("text")


@register("contract_health", "WITH d AS (SELECT event_type AS contract, props AS body, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events UNION ALL SELECT 'pages', coalesce(url, ''), NULL FROM pages UNION ALL SELECT 'labels', CAST(to_json({doc: doc_id}) AS VARCHAR), NULL FROM labels) SELECT contract, count(*) AS n, count(*) FILTER (contract = 'pages') AS broken, count(*) FILTER (contract <> 'pages' AND k IS NULL) AS incomplete, min(k) AS least, max(k) AS most FROM d GROUP BY 1")
def contract_health(spark, folder):
    """Properties of events as documents of a contract by type; addresses of pages aren't JSON, labels lack the field."""
    events = table(spark, folder, "events").select(F.col("event_type").alias("contract"), F.col("props").alias("body"))
    pages = table(spark, folder, "pages").select(F.lit("pages").alias("contract"), F.coalesce("url", F.lit("")).alias("body"))
    labels = table(spark, folder, "labels").select(F.lit("labels").alias("contract"), F.to_json(F.struct(F.col("doc_id").alias("doc"))).alias("body"))
    return W.health(events.unionByName(pages).unionByName(labels), "k bigint", ["k"], "k")


@register("community_index", f"WITH {COMMENTS} SELECT author AS community, count(*) AS cards, count(DISTINCT post_id) AS threads, min(id) AS first_id FROM comments GROUP BY 1")
def community_index(spark, folder):
    return comments(spark, folder).groupBy(F.col("author").alias("community")).agg(F.count("*").alias("cards"), F.countDistinct("post_id").alias("threads"), F.min("id").alias("first_id"))


@register("merged_topics", "SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS topics, array_to_string(list_sort(list(DISTINCT CAST(json_extract(props, '$.k') AS BIGINT))), ',') AS clusters FROM events GROUP BY 1")
def merged_topics(spark, folder):
    """Each different topic and cluster of a user's items once; their numbers are bounded by the lists of both."""
    k = F.get_json_object("props", "$.k").cast("long")
    sets = table(spark, folder, "events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("t"), F.sort_array(F.collect_set(k)).alias("c"))
    return sets.select("user_id", F.array_join("t", ",").alias("topics"), F.array_join(F.col("c").cast("array<string>"), ",").alias("clusters"))


@register("top_signals", "WITH s AS (" + ORACLE_SQL["signal_scores"] + ") SELECT *, CAST(row_number() OVER (ORDER BY signal_score DESC, id) AS INTEGER) AS place FROM s ORDER BY signal_score DESC, id LIMIT 20")
def top_signals(spark, folder):
    """The posts with the highest signal scores, as the list of a report has them."""
    from pyspark.sql import Window

    best = scoring.signal_scores(spark, folder).orderBy(F.desc("signal_score"), "id").limit(20)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("signal_score"), "id")))
