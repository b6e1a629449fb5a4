"""Registered queries on topics, tags, evidence, activity and state, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scoring as S
from tidemark.functions import text as X
from tidemark.operators import postings as I
from tidemark.operators import search as Q
from tidemark.operators import topics as T
from tidemark.operators.views import RefreshedView
from tidemark.plans.catalogue import register
from tidemark.plans.posts import COMMENTS, POSTS, comments, posts, quoted, sql_any, sql_sum
from tidemark.plans.scoring import MOOD, NEED_SQL, _needs
from tidemark.session import scratch, table
from tidemark.streaming import cursor
from tidemark.streaming import events as E

_PADDED = "' ' || array_to_string(regexp_extract_all(lower({}), '[a-z0-9]+'), ' ') || ' '"
_HAS = lambda t: f"(contains({t}, ' thatin ') AND contains({t}, ' the ')) AND NOT contains({t}, ' of and ')"


@register(
    "topic_relevance",
    f"""WITH {POSTS}, {COMMENTS}, d AS (SELECT id, lower(source) AS c, {_PADDED.format('text')} AS s FROM posts), e AS (SELECT p.c, {_PADDED.format('body')} AS s FROM comments JOIN d p ON p.id = post_id),
v AS (SELECT vec_id, list_inner_product(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) AS x FROM embeddings, (SELECT arg_min(embedding, vec_id) AS q FROM embeddings)),
u AS (SELECT c FROM d WHERE {_HAS('s')} UNION ALL SELECT c FROM d JOIN v ON vec_id = id WHERE 1 - round(x, 6) < 0.9::DOUBLE UNION ALL SELECT c FROM e WHERE {_HAS('s')})
SELECT c AS community, count(*) AS n FROM u GROUP BY 1 HAVING count(*) >= 4""",
)
def topic_relevance(spark, folder):
    """Hits of posts' texts, posts' vectors and comments' texts by community, of four or more together."""
    rows = posts(spark, folder).select("id", "text", F.col("source").alias("community"))
    told = comments(spark, folder).select("id", F.col("body").alias("text"), "post_id").join(rows.select(F.col("id").alias("post_id"), "community"), "post_id")
    hits = lambda t: t.select("id", "community").join(I.search(I.build(t.select("id", "text"), stemmed=False), [["thatin", "the"]], ["of and"]), "id").select("community")
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    near = Q.within_distance(vectors, "id", "embedding", vectors.groupBy().agg(F.min_by("embedding", "id").alias("q")), 0.9)
    return T.relevance([hits(rows), rows.join(near, "id").select("community"), hits(told)], "community", 4)


@register("source_range", f"WITH {COMMENTS} SELECT (SELECT count(*) FROM documents) AS posts, (SELECT count(*) FROM comments) AS comments, (SELECT count(DISTINCT doc_id) FROM documents) AS unique_posts, (SELECT count(DISTINCT id) FROM comments) AS unique_comments, (SELECT count(DISTINCT c) FROM (SELECT lower(source) AS c FROM documents UNION ALL SELECT lower(author) FROM comments) WHERE c <> '') AS communities")
def source_range(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("community"))
    return T.source_range(docs, comments(spark, folder).select("id", F.col("author").alias("community")), "id", "community")


_RESONANCE = ["thatin", "inoran", "the on"]


@register("resonance_counts", f"WITH {COMMENTS} SELECT post_id, count(*) AS comments, count(*) FILTER ({sql_any('lower(body)', _RESONANCE)}) AS resonance FROM comments GROUP BY 1")
def resonance_counts(spark, folder):
    return comments(spark, folder).groupBy("post_id").agg(F.count("*").alias("comments"), F.count_if(S.any_of(S.plain(F.col("body")), _RESONANCE)).alias("resonance"))


@register("least_sentence_sentiment", f"""WITH {POSTS}, p AS (SELECT id, string_split(regexp_replace(trim(text, ' '), '([.!?])[ \\t\\n\\v\\f\\r]+', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM posts), s AS (SELECT id, unnest(parts) AS s FROM p),
x AS (SELECT id, coalesce(list_sum(list_transform(regexp_extract_all(lower(s), '[a-z]+'), lambda w: CASE w {' '.join(f"WHEN {quoted(k)} THEN {v}::DOUBLE" for k, v in MOOD.items())} ELSE 0.0::DOUBLE END)), 0.0::DOUBLE) AS x FROM s WHERE length(s) > 5)
SELECT p.id, coalesce((SELECT min(round(x / sqrt(x * x + 15.0::DOUBLE), 6)) FROM x WHERE x.id = p.id), 0.0) AS mood FROM p""")
def least_sentence_sentiment(spark, folder):
    return posts(spark, folder).select("id", S.least_sentiment(F.col("text"), MOOD).alias("mood"))


_KEYWORDS = ["the", "thatin", "der", "zzzz"]


@register(
    "community_fit",
    f"""WITH {POSTS}, {COMMENTS}, w AS (SELECT source, unnest(regexp_extract_all(lower(title), '[a-z0-9]+')) AS w FROM posts), k AS (SELECT source, count(DISTINCT w) AS hits FROM w WHERE w IN ({', '.join(map(quoted, _KEYWORDS))}) GROUP BY 1),
n AS (SELECT source, count(*) AS n FROM posts GROUP BY 1), c AS (SELECT source, avg(comments.score) AS len FROM comments JOIN posts ON posts.id = post_id GROUP BY 1)
SELECT source, round(coalesce(hits, 0) / 4.0::DOUBLE * 0.4::DOUBLE + least(n / 7.0::DOUBLE / 200.0::DOUBLE, 1.0) * 0.3::DOUBLE + least(coalesce(len, 0.0) / 120.0::DOUBLE, 1.0) * 0.3::DOUBLE, 6) AS fit FROM n LEFT JOIN k USING (source) LEFT JOIN c USING (source)""",
)
def community_fit(spark, folder):
    rows = posts(spark, folder).select("id", "source", "title")
    n = rows.groupBy("source").agg(F.count("*").alias("n"))
    words = rows.select("source", F.explode(X.tokens(F.col("title"))).alias("w")).filter(F.col("w").isin(_KEYWORDS)).groupBy("source").agg(F.countDistinct("w").alias("hits"))
    length = comments(spark, folder).select("post_id", "score").join(rows.select(F.col("id").alias("post_id"), "source"), "post_id").groupBy("source").agg(F.avg("score").alias("len"))
    whole = n.join(words, "source", "left").join(length, "source", "left").na.fill(0, ["hits"]).na.fill(0.0, ["len"])
    return whole.select("source", F.round(T.community_fit(F.col("hits"), 4, F.col("n") / 7.0, F.col("len")), 6).alias("fit"))


_WHY = "CASE WHEN contains(t, 'that') THEN 'because of the inoran' ELSE '' END"


@register("focused_scores", f"WITH {POSTS}, p AS (SELECT id, lower(text) AS t FROM posts) SELECT id, round({sql_sum('t', [('thatin', 2.0), ('the', 2.0)])} + {sql_sum('t', [('erre', 1.5)])} + {sql_sum('t', [('que', 0.5), ('der', 0.5)])} + CASE WHEN contains(t, 'that') THEN 0.25::DOUBLE ELSE 0.0 END, 6) AS score FROM p")
def focused_scores(spark, folder):
    why = F.when(F.contains(F.lower("text"), F.lit("that")), "because of the inoran").otherwise("")
    score = T.focused_score(F.col("text"), why, ["thatin", "the"], ["erre"], ["que", "der"], T.weights_of({"query": 2.0, "intent": 1.5, "domain": 0.5, "why": 0.25}))
    return posts(spark, folder).select("id", F.round(score, 6).alias("score"))


_SIGNALS = """s AS (SELECT n_name AS community, list_distinct(list(c_mktsegment)) AS categories, count(*) AS n, avg(c_acctbal) AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
t AS (SELECT n_name AS community, count(*) AS suppliers, sum(s_acctbal) AS bal FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1),
g AS (SELECT s.community, categories, CASE WHEN n > 60 THEN 'READY' WHEN coalesce(suppliers, 0) > 3 THEN 'HISTORICAL' ELSE 'WATCHING' END AS status, round(n + coalesce(suppliers, 0), 4) AS score, coalesce(suppliers, 0) > 2 AS evidence FROM s LEFT JOIN t USING (community))"""
#: Tags: category_keys, keyword_keys, semantic_keys, source_refs, by_ref.
_TAGS = [
    ("travel", ["AUTOMOBILE"], ["NATION_1", "nation"], [], [], False), ("home", ["household", "FURNITURE"], ["nation_2"], ["build"], [], False), ("build", [], [], ["BUILDING"], ["many"], True),
    ("named", [], ["nation_7", "nation_11"], [], [], False), ("empty", ["BUILDING"], ["zz"], [], ["many"], False),
]
_TAG_SCHEMA = "tag string, category_keys array<string>, keyword_keys array<string>, semantic_keys array<string>, source_refs array<string>, by_ref boolean"


def _signals(spark, folder):
    nation = table(spark, folder, "nation").select("n_nationkey", F.col("n_name").alias("community"))
    customers = table(spark, folder, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("community").agg(F.collect_set("c_mktsegment").alias("categories"), F.count("*").alias("n"))
    suppliers = table(spark, folder, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("community").agg(F.count("*").alias("suppliers"))
    rows = customers.join(suppliers, "community", "left").na.fill(0, ["suppliers"])
    status = F.when(F.col("n") > 60, "READY").when(F.col("suppliers") > 3, "HISTORICAL").otherwise("WATCHING")
    top = F.when(F.col("n") > 55, F.array(F.lit("builder"), F.lit("buildings"))).otherwise(F.array(F.lit("b")))
    refs = F.when(F.col("suppliers") > 4, F.array(F.lit("many"))).otherwise(F.array().cast("array<string>"))
    return rows.select("community", "categories", F.array(F.col("community")).alias("keywords"), top.alias("semantic_terms"), refs.alias("refs"), (F.col("suppliers") > 2).alias("evidence"), status.alias("status"), (F.col("n") + F.col("suppliers")).cast("double").alias("score"))


def _tag_sql() -> str:
    """The rule of each tag written out; keys of five letters stand for what begins with them."""
    return f"""{_SIGNALS.replace("coalesce(suppliers, 0) > 2 AS evidence", "coalesce(suppliers, 0) > 2 AS evidence, n, coalesce(suppliers, 0) AS sup")},
k AS (SELECT *, regexp_extract_all(lower(community), '[a-z0-9]+') AS w, list_transform(categories, lambda x: lower(x)) AS c FROM g),
h AS (SELECT *, len(list_filter(w, lambda x: x LIKE 'nation%')) > 0 AS nation FROM k),
m AS (SELECT community, status, score, 'travel' AS tag FROM h WHERE (list_contains(c, 'automobile') AND nation) OR (lower(community) IN ('nation_1', 'nation') AND evidence)
UNION ALL SELECT community, status, score, 'home' FROM h WHERE n > 55 OR (lower(community) = 'nation_2' AND evidence)
UNION ALL SELECT community, status, score, 'build' FROM h WHERE n > 55 OR (sup > 4 AND evidence)
UNION ALL SELECT community, status, score, 'named' FROM h WHERE lower(community) IN ('nation_7', 'nation_11') AND evidence)"""


@register("tag_matches", f"WITH {_tag_sql()} SELECT tag, community FROM m")
def tag_matches(spark, folder):
    return T.matched_tags(_signals(spark, folder), spark.createDataFrame(_TAGS, _TAG_SCHEMA))


_GENERIC = "community IN ('NATION_1', 'NATION_3', 'NATION_5', 'NATION_7')"


@register("capability_tags", f"WITH {_tag_sql()}, d(tag) AS (VALUES ('travel'), ('home'), ('build'), ('named'), ('empty')), r AS (SELECT tag, count(m.community) AS communities, count(*) FILTER (status = 'READY') AS ready, count(*) FILTER (status = 'HISTORICAL') AS historical, count(*) FILTER (status = 'WATCHING') AS watching, count(*) FILTER ({_GENERIC}) AS generic FROM d LEFT JOIN m USING (tag) GROUP BY tag) SELECT *, CASE WHEN ready > 0 THEN 'READY' WHEN historical > 0 THEN 'HISTORICAL' ELSE 'WATCHING' END AS status, communities - generic AS longtail FROM r")
def capability_tags(spark, folder):
    signals, tags = _signals(spark, folder), spark.createDataFrame(_TAGS, _TAG_SCHEMA)
    return T.capability_tags(T.matched_tags(signals, tags), signals, tags, F.expr(_GENERIC))


@register("tag_recommendations", f"""WITH {_tag_sql()}, o AS (SELECT *, {_GENERIC} AS generic, CASE status WHEN 'READY' THEN 2 WHEN 'HISTORICAL' THEN 1 ELSE 0 END AS r FROM m), a AS (SELECT *, row_number() OVER (PARTITION BY tag, generic ORDER BY r DESC, score DESC, community) AS k FROM o),
p AS (SELECT tag, community, status, score, row_number() OVER (PARTITION BY tag ORDER BY r DESC, generic, score DESC, community) AS place FROM a WHERE NOT generic OR k <= 1) SELECT tag, community, status, CAST(score AS DOUBLE) AS score, CAST(place AS INTEGER) AS place FROM p WHERE place <= 6""")
def tag_recommendations(spark, folder):
    signals, tags = _signals(spark, folder), spark.createDataFrame(_TAGS, _TAG_SCHEMA)
    return T.recommended(T.matched_tags(signals, tags), signals, F.expr(_GENERIC), 6, 0.2)


@register("compare_matrix", "WITH s AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'click') AS left_n, count(*) FILTER (event_type = 'view') AS right_n, count(DISTINCT CAST(ts AS DATE)) AS threads FROM events GROUP BY 1), r AS (SELECT *, CASE WHEN left_n < 2 OR right_n < 2 THEN 'compare_sides_incomplete' WHEN threads < 3 THEN 'compare_threads_below_threshold' END AS reason FROM s) SELECT *, CASE WHEN reason IS NULL THEN 'compare' ELSE 'insufficient_evidence' END AS mode FROM r")
def compare_matrix(spark, folder):
    cards = table(spark, folder, "events").select("user_id", "event_type", F.to_date("ts").alias("day"))
    return T.compared(cards, "user_id", "event_type", "day", "CLICK", "View")


@register("community_activity", "WITH l AS (SELECT user_id AS key, event_type AS lane, count(*) AS n, CAST(epoch_us(max(ts)) AS BIGINT) AS t FROM events GROUP BY 1, 2), r AS (SELECT key, CAST(sum(n) AS BIGINT) AS cards, string_agg(lane || ':' || n, ',' ORDER BY lane) AS lanes, max(t) AS latest FROM l GROUP BY 1), k AS (SELECT key FROM r UNION SELECT c_custkey FROM customer UNION SELECT s_suppkey FROM supplier) SELECT key, coalesce(cards, 0) AS cards, coalesce(lanes, '') AS lanes, coalesce(latest, -1) AS latest, key IN (SELECT c_custkey FROM customer) AS in_pool, key IN (SELECT s_suppkey FROM supplier) AS in_supply FROM k LEFT JOIN r USING (key)")
def community_activity(spark, folder):
    cards = table(spark, folder, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("lane"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    found = T.activity(cards, table(spark, folder, "customer").select(F.col("c_custkey").alias("key")), table(spark, folder, "supplier").select(F.col("s_suppkey").alias("key")))
    return found.na.fill(-1, ["latest"])


@register("value_density", f"WITH {NEED_SQL} SELECT source, count(*) AS posts, count(*) FILTER (first IN ('Survival', 'Efficiency', 'Growth')) AS valued, round(count(*) FILTER (first IN ('Survival', 'Efficiency', 'Growth')) / count(*), 6) AS density, CASE WHEN count(*) FILTER (first IN ('Survival', 'Efficiency', 'Growth')) / count(*) >= 0.3 THEN 'approved' ELSE 'rejected' END AS status FROM tagged GROUP BY source")
def value_density(spark, folder):
    return T.value_density(_needs(spark, folder), "source", S.primary_need(F.col("n")), ["Survival", "Efficiency", "Growth"], 0.3)


_TOKENS = r"list_distinct(list_concat(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9][a-z0-9+\-_/]{{2,}}'), regexp_extract_all(coalesce({0}, ''), '[\x{{4e00}}-\x{{9fff}}]{{2,16}}')))"


@register(
    "evidence_ledger",
    f"""WITH {COMMENTS}, a AS (SELECT item_id AS anchor, {_TOKENS.format('text')} AS t FROM benchmark), c AS (SELECT id, body, {_TOKENS.format('body')} AS t FROM comments),
x AS (SELECT anchor, unnest(t) AS w FROM a), y AS (SELECT id, unnest(t) AS w FROM c), n AS (SELECT anchor, id, count(*) AS n FROM x JOIN y USING (w) GROUP BY 1, 2),
l1 AS (SELECT i.item_id AS anchor, 1 AS level, d.doc_id AS p, 0 AS q, trim(split_part(coalesce(d.text, ''), chr(10), 1), ' ') AS title, 'doc:' || d.doc_id AS url FROM labels b JOIN documents d USING (doc_id) JOIN benchmark i ON i.item_id = d.doc_id WHERE b.toxic = 1),
l2 AS (SELECT anchor, 2 AS level, -n AS p, id AS q, trim(body, ' ') AS title, '' AS url FROM n JOIN c USING (id)), u AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2),
o AS (SELECT * FROM u WHERE title <> '' QUALIFY row_number() OVER (PARTITION BY anchor, level, CASE WHEN url = '' THEN title ELSE url END ORDER BY p, q) = 1), b AS (SELECT *, min(level) OVER (PARTITION BY anchor) AS best FROM o)
SELECT anchor, level, substr(title, 1, 120) AS title, url, CAST(row_number() OVER (PARTITION BY anchor ORDER BY p, q) AS INTEGER) AS place FROM b WHERE level = best QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY p, q) <= 2""",
)
def evidence_ledger(spark, folder):
    """The benchmark's items as anchors; their own examples are toxic documents of the same number, else come comments."""
    items, docs, labels = (table(spark, folder, t) for t in ("benchmark", "documents", "labels"))
    anchors = items.select(F.col("item_id").alias("anchor"), "text", F.array().cast("array<string>").alias("voices"))
    toxic = docs.join(labels.filter("toxic = 1").select("doc_id").join(items.select(F.col("item_id").alias("doc_id")), "doc_id"), "doc_id")
    first = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)
    examples = toxic.select(F.col("doc_id").alias("anchor"), F.col("doc_id").alias("place"), first.alias("title"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("url"))
    samples = docs.limit(0).select(F.col("doc_id").alias("place"), F.col("text").alias("title"), F.lit("").alias("url"))
    return T.ledger(anchors, examples, comments(spark, folder).select("id", F.col("body").alias("text")), samples)


@register("layer_summaries", "WITH n AS (SELECT p_brand AS layer, p_type AS name, count(*) AS mentions, CASE WHEN max(p_size) > 45 THEN 'size ' || max(p_size) ELSE '' END AS hint FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY mentions DESC, name) AS k FROM n) SELECT layer, count(*) AS competitors, string_agg(name, ',' ORDER BY k) FILTER (k <= 3) AS top, coalesce(arg_min(hint, k) FILTER (hint <> ''), '') AS threat FROM r GROUP BY layer")
def layer_summaries(spark, folder):
    size = F.max("p_size")
    rows = table(spark, folder, "part").groupBy(F.col("p_brand").alias("layer"), F.col("p_type").alias("name")).agg(F.count("*").alias("mentions"), size.alias("size"))
    hint = F.when(F.col("size") > 45, F.concat(F.lit("size "), F.col("size").cast("string"))).otherwise("")
    return T.layer_summary(rows.select("layer", "name", "mentions", F.array(F.lit(" "), hint).alias("hints")))


_URL = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


@register("named_ids", f"WITH d AS (SELECT page_id, sha1(unhex('{_URL.replace('-', '')}') || encode('run:' || page_id || ':' || coalesce(url, ''))) AS h FROM pages) SELECT page_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || '89ab'[(CAST(('0x' || h[17]) AS INTEGER) % 4) + 1] || h[18:20] || '-' || h[21:32] AS run_id FROM d")
def named_ids(spark, folder):
    name = F.concat(F.lit("run:"), F.col("page_id").cast("string"), F.lit(":"), F.coalesce("url", F.lit("")))
    return table(spark, folder, "pages").select("page_id", T.uuid5(_URL, name).alias("run_id"))


@register("refreshed_view", "SELECT event_type, count(*) AS n, CAST(sum(floor(value)) AS BIGINT) AS score FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) GROUP BY 1")
def refreshed_view(spark, folder):
    """Users' latest events by type, after three batches of versions, each of which recomputes the types that it touches."""
    events = table(spark, folder, "events").select("user_id", "event_id", "event_type", F.floor("value").alias("score"), F.lit(False).alias("deleted"), "ts")
    sums = lambda rows: rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("score").alias("score"))
    view = RefreshedView(spark, scratch(spark, "view"), "user_id", "event_id", "event_type", sums, partitions=16)
    for low, high in (("2000-01-01", "2024-01-10"), ("2024-01-10", "2024-01-20"), ("2024-01-20", "2100-01-01")):
        view.refresh(events.filter(F.expr(f"coalesce(ts, timestamp_ntz'2000-01-02') >= timestamp_ntz'{low}' AND coalesce(ts, timestamp_ntz'2000-01-02') < timestamp_ntz'{high}'")).drop("ts"))
    return view.read()


@register("stream_cursors", "SELECT event_type AS community, CAST(arg_max(event_id, (ts, -event_id)) AS VARCHAR) AS cursor, CAST(min(epoch_us(ts) - CAST(floor(value) AS BIGINT) * 1000000) AS BIGINT) AS floor FROM events GROUP BY 1")
def stream_cursors(spark, folder):
    """Events as pages of a backfill, in three batches of a stream that goes on from its checkpoint: the last cursor and the floor by type."""
    ts = F.col("ts").cast("timestamp")
    pages = table(spark, folder, "events").select(F.col("event_type").alias("community"), ts.alias("seen"), F.col("event_id").cast("string").alias("cursor"), F.timestamp_micros(F.unix_micros(ts) - F.floor("value") * 1_000_000).alias("created"), F.lit(False).alias("capped"))
    part = lambda low, high: pages.filter((F.col("seen") >= F.lit(low).cast("timestamp")) & (F.col("seen") < F.lit(high).cast("timestamp")))
    batches = [part("2000-01-01", "2024-01-10"), part("2024-01-10", "2024-01-20"), part("2024-01-20", "2100-01-01")]
    told = E.run_batches(batches, cursor.cursors, "update").filter("status = 'RUNNING'")
    last = told.groupBy("community").agg(F.max_by("cursor", "told").alias("cursor"), F.min("floor").alias("floor"))
    return last.select("community", "cursor", F.unix_micros("floor").alias("floor"))
