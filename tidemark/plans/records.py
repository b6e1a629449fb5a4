"""Registered queries on single rows: projections, JSON, text functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.plans.catalogue import ANCHOR, register
from tidemark.plans.posts import COMMENTS, POSTS, comments, posts, quoted
from tidemark.session import table


@register("truncated_text", f"WITH {POSTS} SELECT id, md5(left(text, 1200)) AS head, length(left(text, 1200)) AS chars FROM posts")
def truncated_text(spark, folder):
    head = F.substring("text", 1, 1200)
    return posts(spark, folder).select("id", F.md5(head).alias("head"), F.length(head).cast("long").alias("chars"))


@register("score_bands", f"WITH {POSTS} SELECT id, CASE WHEN score >= 50 THEN 'high' WHEN score >= 10 THEN 'medium' ELSE 'low' END AS score_band, CASE WHEN comments >= 50 THEN 'high' WHEN comments >= 5 THEN 'medium' ELSE 'low' END AS comment_band FROM posts")
def score_bands(spark, folder):
    band = lambda c, m: F.when(F.col(c) >= 50, "high").when(F.col(c) >= m, "medium").otherwise("low")
    return posts(spark, folder).select("id", band("score", 10).alias("score_band"), band("comments", 5).alias("comment_band"))


@register("summary_records", f"""WITH {POSTS}, t AS (SELECT *, trim(CASE WHEN body = '' THEN title ELSE body END, ' ') AS s FROM posts)
SELECT id, CASE WHEN length(s) > 200 THEN left(s, 197) || '...' ELSE s END AS summary, coalesce(CAST(author AS VARCHAR), '') AS author, CAST(coalesce(floor(score), 0) AS BIGINT) AS score FROM t""")
def summary_records(spark, folder):
    body = F.when(F.col("body") == "", F.col("title")).otherwise(F.col("body"))
    return posts(spark, folder).select("id", X.ellipsis(body).alias("summary"), F.coalesce(F.col("author").cast("string"), F.lit("")).alias("author"), F.coalesce(F.floor("score"), F.lit(0)).alias("score"))


@register(
    "json_objects",
    """SELECT event_id, '{"type":"' || event_type || '","meta":{"user":' || user_id || ',"k":' || k || '}}' AS made, k AS read_k, k % 2 = 0 AS is_even, 'k' = 'k' AS has_key, '{"k":' || k || ',"zone":"' || event_type || '"}' AS changed, '{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '"}' AS whole
FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""",
)
def json_objects(spark, folder):
    """Objects built, read, tested for a key and a value, changed at a path, and whole rows as objects."""
    rows = table(spark, folder, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    made = F.to_json(F.struct(F.col("event_type").alias("type"), F.struct(F.col("user_id").alias("user"), "k").alias("meta")))
    fields = F.from_json("props", "map<string,string>")
    changed = F.to_json(F.from_json("props", "struct<k: bigint>").withField("zone", F.col("event_type")))
    even = F.get_json_object(made, "$.meta.k").cast("long") % 2 == 0
    whole = F.to_json(F.struct("event_id", "user_id", "event_type"))
    return rows.select("event_id", made.alias("made"), F.get_json_object(made, "$.meta.k").cast("long").alias("read_k"), even.alias("is_even"), F.map_contains_key(fields, "k").alias("has_key"), changed.alias("changed"), whole.alias("whole"))


@register("json_arrays", """SELECT user_id, '[' || string_agg('"' || event_type || '"', ',' ORDER BY event_type) || ']' AS as_json, count(*) AS n, min(event_type) AS first, bool_or(event_type = 'error') AS has_error FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY user_id""")
def json_arrays(spark, folder):
    rows = table(spark, folder, "events").groupBy("user_id").agg(F.to_json(F.sort_array(F.collect_set("event_type"))).alias("as_json"))
    parsed = F.from_json("as_json", "array<string>")
    return rows.select("user_id", "as_json", F.json_array_length("as_json").cast("long").alias("n"), F.get(parsed, 0).alias("first"), F.array_contains(parsed, "error").alias("has_error"))


@register(
    "category_shapes",
    """SELECT doc_id, k, array_to_string(CASE k WHEN 0 THEN [source, lang] WHEN 1 THEN CASE WHEN source < lang THEN [source, lang] ELSE [lang, source] END WHEN 2 THEN [source] ELSE [] END, ',') AS keys FROM (SELECT doc_id, source, lang, doc_id % 4 AS k FROM documents)""",
)
def category_shapes(spark, folder):
    """Category keys of JSON that is an array, an object (its keys, sorted), a string or nothing."""
    rows = table(spark, folder, "documents").select("doc_id", "source", "lang", (F.col("doc_id") % 4).alias("k"))
    one, two = F.to_json(F.array("source", "lang")), F.concat(F.lit('{"'), F.col("source"), F.lit('": 1, "'), F.col("lang"), F.lit('": 2}'))
    raw = F.when(F.col("k") == 0, one).when(F.col("k") == 1, two).when(F.col("k") == 2, F.concat(F.lit('"'), F.col("source"), F.lit('"')))
    listed, object_ = F.from_json("raw", "array<string>"), F.array_sort(F.map_keys(F.from_json("raw", "map<string,int>")))
    lone = F.regexp_extract("raw", r'^\s*"(.*)"\s*$', 1)
    start = F.substring(F.btrim("raw"), 1, 1)
    keys = F.when(start == "[", listed).when(start == "{", object_).when(lone != "", F.array(lone)).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("raw", raw).select("doc_id", "k", F.array_join(keys, ",").alias("keys"))


@register("vector_literals", "SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 3) + 0.0::DOUBLE AS total FROM embeddings")
def vector_literals(spark, folder):
    """Vectors written as text and read again."""
    text = table(spark, folder, "embeddings").select("vec_id", F.concat(F.lit("["), F.array_join(F.transform("embedding", lambda x: x.cast("string")), ","), F.lit("]")).alias("text"))
    read = text.select("vec_id", F.from_json("text", "array<float>").alias("v"))
    return read.select("vec_id", F.size("v").cast("long").alias("n"), (F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")), 3) + 0.0).alias("total"))


@register("name_keys", "SELECT n_name, lower(trim(n_name)) AS key, 'r/' || lower(trim(n_name)) AS slug, regexp_replace(lower('R/' || n_name), '^r/', '') AS stripped FROM nation")
def name_keys(spark, folder):
    prefixed = F.concat(F.lit(" R/"), F.col("n_name"), F.lit(" "))
    return table(spark, folder, "nation").select("n_name", X.name_key(prefixed).alias("key"), X.slug(prefixed).alias("slug"), X.name_key(F.concat(F.lit("R/"), F.col("n_name"))).alias("stripped"))


@register("optional_list_filter", "SELECT n_name FROM nation WHERE lower(n_name) IN ('nation_1', 'nation_7', 'france') OR NOT EXISTS (SELECT 1 FROM nation WHERE lower(n_name) IN ('nation_1', 'nation_7', 'france'))")
def optional_list_filter(spark, folder):
    rows = table(spark, folder, "nation").select("n_name")
    hit = F.lower("n_name").isin("nation_1", "nation_7", "france")
    some = rows.agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("some"))
    return rows.join(F.broadcast(some)).filter(hit | ~F.col("some")).select("n_name")


SENTENCES = r"list_filter(list_transform(regexp_split_to_array(text, '[.!?\n]+'), lambda s: trim(s)), lambda s: s <> '')"
KEY = r"trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9 \t\n\r\f\v]', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g'))"


@register("sentence_hashes", f"WITH {POSTS}, s AS (SELECT id, unnest({SENTENCES}) AS s FROM posts) SELECT id, CASE WHEN {KEY.format('s')} = '' THEN '' ELSE sha256({KEY.format('s')}) END AS hash, count(*) AS n FROM s GROUP BY 1, 2")
def sentence_hashes(spark, folder):
    rows = posts(spark, folder).select("id", F.explode(X.sentences(F.col("text"))).alias("s"))
    return rows.groupBy("id", X.sentence_hash(F.col("s")).alias("hash")).agg(F.count("*").alias("n"))


TEMPLATE = f"""{POSTS}, s AS (SELECT id, unnest({SENTENCES}) AS s, generate_subscripts({SENTENCES}, 1) AS pos FROM posts),
k AS (SELECT id, pos, s, {KEY.format('s')} AS key, len(list_filter(regexp_split_to_array(s, '[ \\t\\n\\r]+'), lambda w: w <> '')) AS words FROM s),
d AS (SELECT key, count(DISTINCT id) / (SELECT count(*) FROM posts) AS share FROM k GROUP BY key),
r AS (SELECT k.*, share, row_number() OVER (PARTITION BY k.key ORDER BY id, pos) AS seen FROM k JOIN d ON k.key = d.key)"""


@register("template_sentences_removed", f"WITH {TEMPLATE} SELECT id, count(*) FILTER (WHERE CASE WHEN words > 10 THEN share <= 0.005 ELSE key = '' OR seen = 1 END) AS kept, count(*) AS sentences, md5(coalesce(string_agg(s, ' ' ORDER BY pos) FILTER (WHERE CASE WHEN words > 10 THEN share <= 0.005 ELSE key = '' OR seen = 1 END), '')) AS text FROM r GROUP BY id")
def template_sentences_removed(spark, folder):
    """Long sentences of many documents go; of equal short ones the first stays. Shares are of all documents."""
    rows = posts(spark, folder).select("id", "text")
    s = rows.select("id", F.posexplode(X.sentences(F.col("text"))).alias("at", "s")).select("*", X.sentence_key(F.col("s")).alias("key"))
    words = F.size(F.filter(F.split("s", r"[ \t\n\r]+"), lambda w: w != ""))
    share = s.groupBy("key").agg(F.countDistinct("id").alias("docs")).join(F.broadcast(rows.agg(F.count("*").alias("n")))).select("key", (F.col("docs") / F.col("n")).alias("share"))
    seen = F.row_number().over(Window.partitionBy("key").orderBy("id", "at"))
    keep = F.when(F.col("words") > 10, F.col("share") <= 0.005).otherwise((F.col("key") == "") | (F.col("seen") == 1))
    marked = s.withColumn("words", words).withColumn("seen", seen).join(share, "key").withColumn("keep", keep)
    listed = F.array_sort(F.collect_list(F.when(F.col("keep"), F.struct("at", "s"))))
    return marked.groupBy("id").agg(F.count_if("keep").alias("kept"), F.count("*").alias("sentences"), F.md5(F.array_join(F.transform(listed, lambda x: x["s"]), " ")).alias("text"))


@register("context_windows", f"WITH {POSTS}, s AS (SELECT id, unnest({SENTENCES}) AS s, generate_subscripts({SENTENCES}, 1) AS pos FROM posts) SELECT id, pos, md5(concat_ws(' ', lag(s) OVER w, s, lead(s) OVER w)) AS window FROM s WINDOW w AS (PARTITION BY id ORDER BY pos)")
def context_windows(spark, folder):
    rows = posts(spark, folder).select("id", X.sentences(F.col("text")).alias("parts"))
    each = rows.select("id", F.posexplode(F.transform("parts", lambda _, i: X.context(F.col("parts"), i))).alias("at", "window"))
    return each.select("id", (F.col("at") + 1).cast("long").alias("pos"), F.md5("window").alias("window"))


FLAT = r"regexp_replace(lower(text), '[ \t\n\r\f\v]+', ' ', 'g')"


@register(
    "dedupe_tokens",
    f"""WITH {POSTS}, w AS (SELECT id, regexp_extract_all(lower(text), '[a-z0-9]{{2,}}') AS w, {FLAT} AS f FROM posts)
SELECT id, len(w) AS words, greatest(len(w) - 1, 0) AS pairs, len(list_distinct(list_transform(range(1, greatest(length(f) - 3, 1)), lambda i: substr(f, i, 5)))) AS shingles,
md5(array_to_string(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1]), ' ')) AS pair_hash FROM w""",
)
def dedupe_tokens(spark, folder):
    w = X.tokens(F.col("text"), 2)
    rows = posts(spark, folder).select("id", w.alias("w"), X.bigrams(w).alias("p"), X.char_shingles(F.col("text")).alias("c"))
    return rows.select("id", F.size("w").cast("long").alias("words"), F.size("p").cast("long").alias("pairs"), F.size("c").cast("long").alias("shingles"), F.md5(F.array_join("p", " ")).alias("pair_hash"))


STOP = ["that", "with", "this", "from", "und", "die", "der", "les", "que", "los"]


@register("frequency_keywords", f"""WITH {POSTS}, w AS (SELECT source, unnest(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}')) AS word FROM posts), c AS (SELECT source, word, count(*) AS n FROM w WHERE word NOT IN ({', '.join(map(quoted, STOP))}) GROUP BY 1, 2)
SELECT source, word, n, place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, word) AS place FROM c) WHERE place <= 12""")
def frequency_keywords(spark, folder):
    from tidemark.operators import analytics as A

    rows = posts(spark, folder).select("source", F.explode(X.content_words(F.col("text"), STOP)).alias("word"))
    return A.top_per_key(rows.groupBy("source", "word").agg(F.count("*").alias("n")), ["source"], 12, F.desc("n"), F.asc("word"))


@register("mixed_tokens", "SELECT item_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9]+'))) AS words FROM benchmark")
def mixed_tokens(spark, folder):
    return table(spark, folder, "benchmark").select("item_id", F.size(X.mixed_tokens(F.col("text"))).cast("long").alias("words"))


@register(
    "months_filled",
    """WITH m AS (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-12-01', INTERVAL 1 MONTH)) AS DATE) AS m), o AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m, count(*) AS n FROM orders GROUP BY 1)
SELECT strftime(m, '%Y-%m') AS month, coalesce(n, 0) AS n FROM m LEFT JOIN o USING (m)""",
)
def months_filled(spark, folder):
    months = spark.sql("SELECT explode(sequence(date'1995-01-01', date'2001-12-01', interval 1 month)) AS m")
    counts = table(spark, folder, "orders").groupBy(F.trunc(F.to_date("o_orderdate"), "month").alias("m")).agg(F.count("*").alias("n"))
    return months.join(counts, "m", "left").select(F.date_format("m", "yyyy-MM").alias("month"), F.coalesce("n", F.lit(0)).alias("n"))


@register("interval_by_parameter", f"SELECT d.days, count(*) AS n FROM events, (VALUES (1), (3), (10), (25)) AS d(days) WHERE ts >= TIMESTAMP '{ANCHOR}' - to_days(d.days) GROUP BY d.days")
def interval_by_parameter(spark, folder):
    rows = table(spark, folder, "events").select("ts", F.explode(F.array(*map(F.lit, (1, 3, 10, 25)))).alias("days"))
    return rows.filter(F.col("ts") >= F.expr(f"timestamp_ntz'{ANCHOR}' - make_interval(0, 0, 0, days)")).groupBy("days").agg(F.count("*").alias("n"))


@register("overlapping_slices", "WITH RECURSIVE s(k, a, z) AS (SELECT 0, 1704067200::BIGINT, 1704067200::BIGINT + 604800 UNION ALL SELECT k + 1, z - 7200, least(1706659200, z - 7200 + 604800) FROM s WHERE z < 1706659200) SELECT k, count(*) AS n FROM events, s WHERE floor(epoch(ts)) >= a AND floor(epoch(ts)) < z GROUP BY k")
def overlapping_slices(spark, folder):
    slices = spark.createDataFrame([(k, a, z) for k, (a, z) in enumerate(X.time_slices(1704067200, 1706659200, 7))], "k int, a long, z long")
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    rows = table(spark, folder, "events").select(seconds.alias("s")).join(F.broadcast(slices), (F.col("s") >= F.col("a")) & (F.col("s") < F.col("z")))
    return rows.groupBy("k").agg(F.count("*").alias("n"))


@register("link_counts", "SELECT page_id, (length(coalesce(html, '')) - length(replace(coalesce(html, ''), 'http', ''))) // 4 AS links, (length(coalesce(html, '')) - length(replace(coalesce(html, ''), 'http', ''))) // 4 > 2 AS many FROM pages")
def link_counts(spark, folder):
    n = F.regexp_count(F.coalesce("html", F.lit("")), F.lit("http")).cast("long")
    return table(spark, folder, "pages").select("page_id", n.alias("links"), (n > 2).alias("many"))


@register("group_digests", "SELECT user_id, left(sha1(string_agg(CAST(event_id AS VARCHAR), '|' ORDER BY event_id)), 10) AS digest FROM events GROUP BY user_id")
def group_digests(spark, folder):
    ids = F.transform(F.sort_array(F.collect_list("event_id")), lambda x: x.cast("string"))
    return table(spark, folder, "events").groupBy("user_id").agg(F.substring(F.sha1(F.array_join(ids, "|")), 1, 10).alias("digest"))


@register("comment_statistics", f"""WITH {COMMENTS} SELECT post_id, count(*) AS comment_count, round(avg(score), 4) AS average_score, count(*) FILTER (WHERE length(body) > 150) AS long_comments, count(*) FILTER (WHERE regexp_matches(body, '(?i)[?]|\\b(how|what|why|where)\\b')) AS questions,
count(*) FILTER (WHERE regexp_matches(body, '(?i)\\b(fixed|solution|solved|bought|ordered|recommend|works well|use this)\\b')) AS solutions, max(score) AS best, count(*) FILTER (WHERE score >= 800) AS core FROM comments GROUP BY post_id""")
def comment_statistics(spark, folder):
    from tidemark.functions import scoring as S

    body = F.col("body")
    question, solution = S.matches(body, r"[?]|\b(how|what|why|where)\b"), S.matches(body, r"\b(fixed|solution|solved|bought|ordered|recommend|works well|use this)\b")
    return comments(spark, folder).groupBy("post_id").agg(
        F.count("*").alias("comment_count"), F.round(F.avg("score"), 4).alias("average_score"), F.count_if(F.length("body") > 150).alias("long_comments"), F.count_if(question).alias("questions"), F.count_if(solution).alias("solutions"), F.max("score").alias("best"), F.count_if(F.col("score") >= 800).alias("core")
    )
