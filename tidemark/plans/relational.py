"""Registered queries on joins, aggregates, windows, sorts and sets, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import analytics as A
from tidemark.operators import postings as I
from tidemark.operators import relational as R
from tidemark.operators import search as Q
from tidemark.plans.catalogue import register
from tidemark.plans.posts import COMMENTS, MENTIONS, POSTS, comments, mentions, order_posts, posts
from tidemark.session import table


@register("left_join_dimensions", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 3")
def left_join_dimensions(spark, folder):
    """Both dimensions are far below the size at which Spark itself stops broadcasting them."""
    customer, nation, region = (table(spark, folder, t) for t in ("customer", "nation", "region"))
    rows = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.join(region.filter("r_regionkey < 3"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("c_custkey", "n_name", "r_name")


@register("semi_join_list", "SELECT o_orderkey FROM orders WHERE o_custkey IN (1, 4, 7, 10, 100)")
def semi_join_list(spark, folder):
    return table(spark, folder, "orders").filter(F.col("o_custkey").isin(1, 4, 7, 10, 100)).select("o_orderkey")


@register("exists_in_array", "SELECT user_id, array_to_string(list(DISTINCT event_type ORDER BY event_type), ',') AS known FROM events WHERE EXISTS (SELECT 1 FROM (SELECT event_type AS t FROM events GROUP BY 1 HAVING count(*) > (SELECT count(*) / 6 FROM events)) WHERE t = event_type) GROUP BY user_id")
def exists_in_array(spark, folder):
    """Keys of an array that a second table has."""
    events = table(spark, folder, "events")
    total = events.agg((F.count("*") / 6).alias("least"))
    common = events.groupBy("event_type").agg(F.count("*").alias("n")).join(F.broadcast(total)).filter("n > least").select("event_type")
    lists = events.groupBy("user_id").agg(F.collect_set("event_type").alias("types"))
    each = lists.select("user_id", F.explode("types").alias("event_type")).join(common, "event_type", "left_semi")
    return each.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_list("event_type")), ",").alias("known"))


@register("composite_key_join", "SELECT l_orderkey, l_linenumber, o_orderdate < l_shipdate AS later FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND year(l_shipdate) = year(o_orderdate)")
def composite_key_join(spark, folder):
    lines, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    rows = lines.join(orders, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.year("l_shipdate") == F.year("o_orderdate")))
    return rows.select("l_orderkey", "l_linenumber", (F.col("o_orderdate") < F.col("l_shipdate")).alias("later"))


@register("lateral_array", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS word FROM part) GROUP BY word")
def lateral_array(spark, folder):
    raw = table(spark, folder, "part").select(F.to_json(F.split(F.lower("p_name"), " ")).alias("words"))
    return raw.select(F.explode(F.from_json("words", "array<string>")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@register("lateral_aggregate", "SELECT c_custkey, n, round(total, 2) AS total, last FROM customer LEFT JOIN LATERAL (SELECT count(*) AS n, sum(o_totalprice) AS total, max(o_orderkey) AS last FROM orders WHERE o_custkey = c_custkey) ON TRUE")
def lateral_aggregate(spark, folder):
    """The correlated aggregate as one aggregate before the join."""
    sums = table(spark, folder, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("o_orderkey").alias("last"))
    rows = table(spark, folder, "customer").select("c_custkey").join(sums, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), "total", "last")


@register("scalar_relation", "SELECT doc_id, CASE WHEN has_bad THEN quality ELSE 1 - quality END AS label FROM labels, (SELECT count(*) FILTER (WHERE toxic = 1) > 0 AS has_bad FROM labels)")
def scalar_relation(spark, folder):
    labels = table(spark, folder, "labels")
    one = labels.agg((F.count_if(F.col("toxic") == 1) > 0).alias("has_bad"))
    return labels.join(F.broadcast(one)).select("doc_id", F.when(F.col("has_bad"), F.col("quality")).otherwise(1 - F.col("quality")).alias("label"))


@register(
    "five_aggregates_one_dimension",
    """SELECT n_name, coalesce(a.n, 0) AS customers, coalesce(b.n, 0) AS suppliers, coalesce(c.n, 0) AS orders, coalesce(d.n, 0) AS lines, coalesce(e.n, 0) AS brands FROM nation
LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a ON a.k = n_nationkey LEFT JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON b.k = n_nationkey
LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) c ON c.k = n_nationkey LEFT JOIN (SELECT s_nationkey AS k, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1) d ON d.k = n_nationkey
LEFT JOIN (SELECT s_nationkey AS k, count(DISTINCT p_brand) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY 1) e ON e.k = n_nationkey""",
)
def five_aggregates(spark, folder):
    customer, supplier, orders, lines, part, nation = (table(spark, folder, t) for t in ("customer", "supplier", "orders", "lineitem", "part", "nation"))
    by = lambda rows, key, name, value=F.count("*"): rows.groupBy(F.col(key).alias("n_nationkey")).agg(value.alias(name))
    supplied = lines.select("l_suppkey", "l_partkey").join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    branded = supplied.join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    ordered = orders.select("o_custkey").join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    parts = [by(customer, "c_nationkey", "customers"), by(supplier, "s_nationkey", "suppliers"), by(ordered, "c_nationkey", "orders"), by(supplied, "s_nationkey", "lines"), by(branded, "s_nationkey", "brands", F.countDistinct("p_brand"))]
    return R.aggregates_on_dimension(nation.select("n_nationkey", "n_name"), "n_nationkey", parts).drop("n_nationkey")


@register("normalised_key_join", "SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON regexp_replace(lower(s_name), '^[a-z]+#?0*', '') = regexp_replace(lower(c_name), '^[a-z]+#?0*', '')")
def normalised_key_join(spark, folder):
    key = lambda c: F.regexp_replace(F.lower(c), "^[a-z]+#?0*", "").alias("name_key")
    return table(spark, folder, "supplier").select("s_suppkey", key("s_name")).join(table(spark, folder, "customer").select("c_custkey", key("c_name")), "name_key").select("s_suppkey", "c_custkey")


@register(
    "brand_pain_cooccurrence",
    f"""WITH {MENTIONS}, pain AS (SELECT post, community FROM order_posts WHERE status = 'F')
SELECT brand, aspect, count(DISTINCT m.post) AS n FROM mentions m JOIN pain USING (post) GROUP BY 1, 2 HAVING count(DISTINCT m.post) >= 3 ORDER BY n DESC, brand, aspect LIMIT 60""",
)
def brand_pain(spark, folder):
    pain = order_posts(spark, folder).filter(F.col("status") == "F").select("post")
    pairs = mentions(spark, folder).join(pain, "post", "left_semi").select("post", "brand", "aspect").distinct()
    counts = pairs.groupBy("brand", "aspect").agg(F.count("*").alias("n")).filter("n >= 3")
    return counts.orderBy(F.desc("n"), "brand", "aspect").limit(60)


@register("updated_from_join", "SELECT c_custkey, coalesce(n, c_nationkey) AS c_nationkey, CASE WHEN n IS NOT NULL THEN 'updated' ELSE 'kept' END AS fate FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey")
def updated_from_join(spark, folder):
    changes = table(spark, folder, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("c_nationkey"))
    return R.updated_from(table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("c_nationkey")), changes, "c_custkey")


@register("readiness_fan", "SELECT n_name, EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal < -900) AS has_debtor, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000) AS has_rich, CASE WHEN EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000) THEN 'rich' WHEN EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal < -900) THEN 'debt' ELSE 'none' END AS decision FROM nation")
def readiness_fan(spark, folder):
    """Left joins to flags, and a decision by the first that is there."""
    flag = lambda t, key, cond, name: table(spark, folder, t).filter(cond).select(F.col(key).alias("n_nationkey")).distinct().withColumn(name, F.lit(True))
    rows = table(spark, folder, "nation").select("n_nationkey", "n_name").join(flag("customer", "c_nationkey", "c_acctbal < -900", "d"), "n_nationkey", "left").join(flag("supplier", "s_nationkey", "s_acctbal > 9000", "r"), "n_nationkey", "left")
    return rows.select("n_name", F.col("d").isNotNull().alias("has_debtor"), F.col("r").isNotNull().alias("has_rich"), F.when(F.col("r"), "rich").when(F.col("d"), "debt").otherwise("none").alias("decision"))


@register("reply_index", f"WITH {COMMENTS}, r AS (SELECT c.id AS parent, d.id AS reply, d.score FROM comments c JOIN comments d ON d.post_id = c.post_id AND d.depth > c.depth AND d.depth <= c.depth + 3) SELECT parent, reply, place FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY score DESC, reply) AS place FROM r) WHERE place <= 2")
def reply_index(spark, folder):
    """The two best of the three turns after each; a turn meets only those, by depth."""
    rows = comments(spark, folder)
    asked = rows.select("post_id", F.col("id").alias("parent"), F.explode(F.sequence(F.col("depth") + 1, F.col("depth") + 3)).alias("depth"))
    replies = asked.join(rows.select("post_id", "depth", F.col("id").alias("reply"), "score"), ["post_id", "depth"])
    return A.top_per_key(replies, ["parent"], 2, F.desc("score"), F.asc("reply")).select("parent", "reply", "place")


@register("array_aggregates", "SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS types, array_to_string(list_sort(list(DISTINCT event_type) FILTER (WHERE value > 50)), ',') AS loud, array_to_string(list(event_type ORDER BY value DESC, event_id)[1:5], ',') AS best FROM events GROUP BY user_id")
def array_aggregates(spark, folder):
    """Distinct values, distinct values under a condition, and the first five in order, which a window takes before they are listed."""
    events = table(spark, folder, "events")
    sets = events.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("types"), F.nullif(F.array_join(F.sort_array(F.collect_set(F.when(F.col("value") > 50, F.col("event_type")))), ","), F.lit("")).alias("loud"))
    top = A.top_per_key(events.select("user_id", "event_type", "value", "event_id"), ["user_id"], 5, F.desc("value"), F.asc("event_id"))
    best = top.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "event_type"))), lambda x: x["event_type"]), ",").alias("best"))
    return sets.join(best, "user_id").select("user_id", "types", "loud", "best")


@register("ordered_objects", """SELECT conv_id, '[' || string_agg('{"turn":' || turn || ',"role":"' || role || '"}', ',' ORDER BY turn) || ']' AS turns FROM conversations GROUP BY conv_id""")
def ordered_objects(spark, folder):
    return table(spark, folder, "conversations").groupBy("conv_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("turn", "role")))).alias("turns"))


@register("exact_ranks", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, list_sort(list(value))[CAST(floor(0.9 * (count(*) - 1)) AS INTEGER) + 1] AS nearest90 FROM events GROUP BY event_type")
def exact_ranks(spark, folder):
    """Percentiles by counting ranks: no group's values are held in one buffer."""
    return R.percentiles_by_rank(table(spark, folder, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95}, {"nearest90": 0.9})


@register("rank_correlation", "SELECT event_type, round(corr(a, b), 6) AS r FROM (SELECT event_type, CAST(rank() OVER (PARTITION BY event_type ORDER BY value) AS DOUBLE) AS a, CAST(rank() OVER (PARTITION BY event_type ORDER BY CAST(json_extract(props, '$.k') AS BIGINT)) AS DOUBLE) AS b FROM events) GROUP BY event_type")
def rank_correlation(spark, folder):
    rows = table(spark, folder, "events").select("event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))
    ranked = rows.select("event_type", *(F.rank().over(Window.partitionBy("event_type").orderBy(c)).cast("double").alias(c) for c in ("value", "k")))
    return ranked.groupBy("event_type").agg(F.round(F.corr("value", "k"), 6).alias("r"))


@register("label_signals", "SELECT quality, toxic, count(*) AS n, round(avg(n_chars), 4) AS confidence, CASE quality WHEN 0 THEN 'pain' ELSE 'solution' END AS kind, array_to_string(list(doc_id ORDER BY doc_id)[1:5], ',') AS samples FROM documents JOIN labels USING (doc_id) GROUP BY quality, toxic")
def label_signals(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "n_chars").join(table(spark, folder, "labels"), "doc_id")
    sums = rows.groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("confidence"))
    top = A.top_per_key(rows.select("quality", "toxic", "doc_id"), ["quality", "toxic"], 5, F.asc("doc_id"))
    samples = top.groupBy("quality", "toxic").agg(F.array_join(F.sort_array(F.collect_list("doc_id")).cast("array<string>"), ",").alias("samples"))
    return sums.join(samples, ["quality", "toxic"]).withColumn("kind", F.when(F.col("quality") == 0, "pain").otherwise("solution"))


@register("rfe_tiers", "SELECT user_id, r, f, round(e, 4) AS e, CASE WHEN r <= 2 AND f >= 60 AND e >= 35 THEN 'A' WHEN r <= 5 AND f >= 50 THEN 'B' WHEN f >= 20 THEN 'C' ELSE 'D' END AS tier FROM (SELECT user_id, date_diff('day', CAST(max(ts) AS DATE), DATE '2024-01-31') AS r, count(*) AS f, avg(value) AS e FROM events GROUP BY user_id)")
def rfe_tiers(spark, folder):
    sums = table(spark, folder, "events").groupBy("user_id").agg(F.datediff(F.lit("2024-01-31").cast("date"), F.max("ts")).cast("long").alias("r"), F.count("*").alias("f"), F.avg("value").alias("e"))
    tier = F.when((F.col("r") <= 2) & (F.col("f") >= 60) & (F.col("e") >= 35), "A").when((F.col("r") <= 5) & (F.col("f") >= 50), "B").when(F.col("f") >= 20, "C").otherwise("D")
    return sums.select("user_id", "r", "f", F.round("e", 4).alias("e"), tier.alias("tier"))


@register("entity_sentiment", f"WITH {MENTIONS} SELECT brand, aspect, count(*) AS n, round(avg(CASE status WHEN 'F' THEN -1 WHEN 'O' THEN 1 ELSE 0 END), 6) AS sentiment FROM mentions JOIN order_posts USING (post) GROUP BY brand, aspect HAVING count(*) >= 20")
def entity_sentiment(spark, folder):
    rows = mentions(spark, folder).select("post", "brand", "aspect").join(order_posts(spark, folder).select("post", "status"), "post")
    signed = F.when(F.col("status") == "F", -1).when(F.col("status") == "O", 1).otherwise(0)
    return rows.groupBy("brand", "aspect").agg(F.count("*").alias("n"), F.round(F.avg(signed), 6).alias("sentiment")).filter("n >= 20")


@register("stats_snapshot", """SELECT coalesce(p.source, c.source) AS source, coalesce(posts, 0) AS posts, coalesce(comments, 0) AS comments, coalesce(recent, 0) AS recent, round(coalesce(problems / greatest(solutions, 1), 0), 6) AS ratio FROM
(SELECT source, count(*) AS posts, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-02') AS recent FROM documents LEFT JOIN events ON event_id = doc_id GROUP BY source) p FULL JOIN (SELECT source, count(*) AS comments FROM documents JOIN conversations ON conv_id = doc_id GROUP BY source) c ON p.source = c.source
LEFT JOIN (SELECT source, count(*) FILTER (WHERE quality = 0) AS problems, count(*) FILTER (WHERE quality = 1) AS solutions FROM documents JOIN labels USING (doc_id) GROUP BY source) l ON l.source = coalesce(p.source, c.source)""")
def stats_snapshot(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source")
    late = F.col("ts") >= F.expr("timestamp_ntz'2024-01-02'")
    p = docs.join(table(spark, folder, "events").select("event_id", "ts"), F.col("event_id") == F.col("doc_id"), "left").groupBy("source").agg(F.count("*").alias("posts"), F.count_if(late).alias("recent"))
    c = docs.join(table(spark, folder, "conversations").select("conv_id"), F.col("conv_id") == F.col("doc_id")).groupBy("source").agg(F.count("*").alias("comments"))
    ratio = A.ratio_by(docs.join(table(spark, folder, "labels"), "doc_id"), "source", F.col("quality"), 0, 1)
    zero = lambda name, to: F.coalesce(F.col(name), F.lit(to)).alias(name)
    return p.join(c, "source", "full").join(ratio, "source", "left").select("source", zero("posts", 0), zero("comments", 0), zero("recent", 0), zero("ratio", 0.0))


@register("storage_statistics", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("documents", "events", "labels", "conversations", "pages")))
def storage_statistics(spark, folder):
    from functools import reduce

    parts = [table(spark, folder, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in ("documents", "events", "labels", "conversations", "pages")]
    return reduce(lambda a, b: a.unionByName(b), parts)


@register("coverage_summary", "SELECT min(n) AS least, round(avg(n), 4) AS mean, max(n) AS most, count(*) FILTER (WHERE n >= 70) AS full, count(*) FILTER (WHERE n BETWEEN 50 AND 69) AS part, count(*) FILTER (WHERE n < 50) AS thin FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)")
def coverage_summary(spark, folder):
    n = table(spark, folder, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.agg(F.min("n").alias("least"), F.round(F.avg("n"), 4).alias("mean"), F.max("n").alias("most"), F.count_if(F.col("n") >= 70).alias("full"), F.count_if(F.col("n").between(50, 69)).alias("part"), F.count_if(F.col("n") < 50).alias("thin"))


@register("body_hash_counts", "SELECT source, count(DISTINCT md5(lower(regexp_replace(trim(text), '\\s+', ' ', 'g')))) AS bodies, count(*) AS n, count(DISTINCT doc_id) AS ids FROM documents GROUP BY source")
def body_hash_counts(spark, folder):
    return table(spark, folder, "documents").groupBy("source").agg(F.countDistinct(X.body_hash(F.col("text"))).alias("bodies"), F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"))


@register("distribution_percent", "SELECT event_type, CAST(round(100.0 * n / t) AS BIGINT) || '%' AS share FROM (SELECT event_type, count(*) AS n, (SELECT count(*) FROM events) AS t FROM events GROUP BY 1) ORDER BY n DESC, event_type LIMIT 5")
def distribution_percent(spark, folder):
    events = table(spark, folder, "events")
    counts = events.groupBy("event_type").agg(F.count("*").alias("n")).join(F.broadcast(events.agg(F.count("*").alias("t"))))
    return counts.orderBy(F.desc("n"), "event_type").limit(5).select("event_type", F.concat(F.round(F.col("n") * 100.0 / F.col("t")).cast("long").cast("string"), F.lit("%")).alias("share"))


@register("admin_scalars", "SELECT round(avg(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))), 6) AS days, count(*) AS n, round(avg(l_discount), 8) AS discount FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def admin_scalars(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_shipdate", "l_discount").join(table(spark, folder, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.agg(F.round(F.avg(F.datediff("l_shipdate", "o_orderdate")), 6).alias("days"), F.count("*").alias("n"), F.round(F.avg("l_discount"), 8).alias("discount"))


@register("paged_users", "SELECT user_id, n, (SELECT count(DISTINCT user_id) FROM events) AS total FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) ORDER BY n DESC, user_id LIMIT 20 OFFSET 40")
def paged_users(spark, folder):
    counts = table(spark, folder, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return R.page(counts, 20, 40, F.desc("n"), F.asc("user_id"))


@register("keyset_page", "SELECT event_id, value FROM events WHERE value < 40 OR (value = 40 AND event_id > 500) ORDER BY value DESC, event_id LIMIT 25")
def keyset_page(spark, folder):
    return R.page_after(table(spark, folder, "events").select("event_id", "value"), "value", "event_id", 40.0, 500, 25)


@register("cube_lang_source", "SELECT lang, source, count(*) AS n, grouping_id(lang, source) AS level FROM documents GROUP BY CUBE (lang, source)")
def cube_lang_source(spark, folder):
    return table(spark, folder, "documents").cube("lang", "source").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@register("grouping_sets", "SELECT event_type, user_id % 3 AS third, count(*) AS n, grouping_id(event_type, user_id % 3) AS level FROM events GROUP BY GROUPING SETS ((event_type), (user_id % 3), ())")
def grouping_sets(spark, folder):
    rows = table(spark, folder, "events").select("event_type", (F.col("user_id") % 3).alias("third"))
    type_, third = F.col("event_type"), F.col("third")
    return rows.groupingSets([[type_], [third], []], type_, third).agg(F.count("*").alias("n"), F.grouping_id().alias("level")).select("event_type", "third", "n", "level")


@register("seven_key_dedupe", f"WITH {POSTS}, h AS (SELECT id, score, comments, author, lang, length(text) AS chars, source, md5(lower(regexp_replace(trim(text), '\\s+', ' ', 'g'))) AS h FROM posts) SELECT id, h FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY score DESC NULLS LAST, CASE source WHEN 'src0' THEN 0 WHEN 'src1' THEN 1 ELSE 2 END, comments DESC NULLS LAST, chars DESC, author NULLS LAST, lang, id) AS k FROM h) WHERE k = 1")
def seven_key_dedupe(spark, folder):
    rows = posts(spark, folder).select("id", "score", "comments", "author", "lang", F.length("text").alias("chars"), "source", X.body_hash(F.col("text")).alias("h"))
    pool = F.when(F.col("source") == "src0", 0).when(F.col("source") == "src1", 1).otherwise(2)
    return A.latest_per_key(rows, ["h"], F.desc_nulls_last("score"), pool, F.desc_nulls_last("comments"), F.desc("chars"), F.asc_nulls_last("author"), F.asc("lang"), F.asc("id")).select("id", "h")


@register("renumbered_keys", "WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1) AS ord FROM part), f AS (SELECT p_partkey, word, min(ord) AS ord FROM w GROUP BY 1, 2) SELECT p_partkey, word, row_number() OVER (PARTITION BY p_partkey ORDER BY ord) AS place FROM f WHERE length(word) > 3")
def renumbered_keys(spark, folder):
    words = table(spark, folder, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("ord", "word"))
    first = words.groupBy("p_partkey", "word").agg(F.min("ord").alias("ord")).filter(F.length("word") > 3)
    return first.select("p_partkey", "word", F.row_number().over(Window.partitionBy("p_partkey").orderBy("ord")).cast("long").alias("place"))


@register("norm_hash_groups", r"WITH n AS (SELECT doc_id, sha256(regexp_replace(regexp_replace(lower(trim(text)), '[^a-z0-9 \t\n\r\f\v]', '', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')) AS h FROM documents) SELECT doc_id, h, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS place FROM n")
def norm_hash_groups(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", X.norm_hash(F.col("text")).alias("h"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("h").orderBy("doc_id")).cast("long"))


@register("latest_score_nulls_last", "SELECT user_id, event_id, v FROM (SELECT user_id, event_id, CASE WHEN event_type = 'view' THEN NULL ELSE value END AS v, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'view' THEN NULL ELSE value END DESC NULLS LAST, event_id) AS k FROM events) WHERE k = 1")
def latest_score_nulls_last(spark, folder):
    rows = table(spark, folder, "events").select("user_id", "event_id", F.when(F.col("event_type") != "view", F.col("value")).alias("v"))
    return A.latest_per_key(rows, ["user_id"], F.desc_nulls_last("v"), F.asc("event_id"))


@register("monthly_velocity", "WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total, count(DISTINCT o_custkey) AS authors FROM orders GROUP BY 1) SELECT month, n - lag(n) OVER w AS n_velocity, round(total - lag(total) OVER w, 2) AS total_velocity, authors - lag(authors) OVER w AS author_velocity FROM m WINDOW w AS (ORDER BY month)")
def monthly_velocity(spark, folder):
    """One row per month goes through one task."""
    m = table(spark, folder, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.countDistinct("o_custkey").alias("authors"))
    w = Window.orderBy("month")
    change = lambda c: F.col(c) - F.lag(c).over(w)
    return m.select("month", change("n").alias("n_velocity"), F.round(change("total"), 2).alias("total_velocity"), change("authors").alias("author_velocity"))


@register(
    "trend_series",
    """WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1), g AS (SELECT month, n, lag(n) OVER (ORDER BY month) AS p FROM m), v AS (SELECT round(3.0::DOUBLE * arg_max(n, month) / sum(n), 6) AS velocity FROM (SELECT * FROM m ORDER BY month DESC LIMIT 3)),
t AS (SELECT month, n, (n - p) / greatest(p, 1) AS growth, velocity FROM g, v)
SELECT month, n, round(growth, 4) AS growth, velocity, CASE WHEN growth IS NULL THEN 'STABLE' WHEN (growth > 0.5 AND n > 5) OR (velocity > 1.3 AND n > 10) THEN 'EXPLODING' WHEN growth > 0.2 OR velocity > 1.1 THEN 'RISING' WHEN growth < -0.2 OR velocity < 0.8 THEN 'FALLING' ELSE 'STABLE' END AS trend FROM t""",
)
def trend_series(spark, folder):
    from tidemark.functions import scoring as S

    m = table(spark, folder, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    last = m.orderBy(F.desc("month")).limit(3).agg(F.round(F.max_by("n", "month") * 3.0 / F.sum("n"), 6).alias("velocity"))
    before = F.lag("n").over(Window.orderBy("month"))
    rows = m.withColumn("growth", (F.col("n") - before) / F.greatest(before, F.lit(1))).join(F.broadcast(last))
    return rows.select("month", "n", F.round("growth", 4).alias("growth"), "velocity", S.trend_label(F.col("growth"), F.col("n"), F.col("velocity")).alias("trend"))


@register("window_frames", "SELECT event_id, first_value(value) OVER w AS first, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS last3, count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS day FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def window_frames(spark, folder):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = Window.partitionBy("user_id").orderBy("s").rangeBetween(-86_400, 0)
    rows = table(spark, folder, "events").withColumn("s", F.unix_timestamp(F.col("ts").cast("timestamp")))
    return rows.select("event_id", F.first("value").over(w).alias("first"), F.round(F.sum("value").over(w.rowsBetween(-2, 0)), 4).alias("last3"), F.count("*").over(seconds).alias("day"))


@register("priority_order", "SELECT conv_id, turn, role FROM conversations ORDER BY CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END, length(coalesce(text, '')) DESC NULLS LAST, conv_id, turn LIMIT 40")
def priority_order(spark, folder):
    first = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    return table(spark, folder, "conversations").orderBy(first, F.desc_nulls_last(F.length(F.coalesce("text", F.lit("")))), "conv_id", "turn").select("conv_id", "turn", "role").limit(40)


@register("most_common_first_seen", "SELECT event_type, n, first FROM (SELECT event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1) ORDER BY n DESC, first LIMIT 3")
def most_common(spark, folder):
    return R.most_common(table(spark, folder, "events"), "event_type", "event_id", 3)


@register("unions_one_shape", "SELECT kind, month, count(*) AS n FROM (SELECT 'order' AS kind, strftime(o_orderdate, '%Y-%m') AS month FROM orders UNION ALL SELECT 'line', strftime(l_shipdate, '%Y-%m') FROM lineitem) GROUP BY 1, 2")
def unions_one_shape(spark, folder):
    month = lambda t, kind, c: table(spark, folder, t).select(F.lit(kind).alias("kind"), F.date_format(c, "yyyy-MM").alias("month"))
    return month("orders", "order", "o_orderdate").unionByName(month("lineitem", "line", "l_shipdate")).groupBy("kind", "month").agg(F.count("*").alias("n"))


@register("labels_in_one_shape", "SELECT content, category, num_comments, count(*) AS n FROM (SELECT 'post' AS content, CASE quality WHEN 0 THEN 'pain' ELSE 'solution' END AS category, 0 AS num_comments FROM labels UNION ALL SELECT 'comment', CASE role WHEN 'user' THEN 'pain' ELSE 'solution' END, 0 FROM conversations) GROUP BY ALL")
def labels_in_one_shape(spark, folder):
    kind = lambda rows, content, pain: rows.select(F.lit(content).alias("content"), F.when(pain, "pain").otherwise("solution").alias("category"), F.lit(0).alias("num_comments"))
    both = kind(table(spark, folder, "labels"), "post", F.col("quality") == 0).unionByName(kind(table(spark, folder, "conversations"), "comment", F.col("role") == "user"))
    return both.groupBy("content", "category", "num_comments").agg(F.count("*").alias("n"))


@register("merged_by_id", "SELECT id, origin FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p, k) AS r FROM (SELECT doc_id AS id, 'primary' AS origin, 0 AS p, doc_id AS k FROM labels UNION ALL SELECT doc_id, 'extra', 1, doc_id FROM documents)) WHERE r = 1")
def merged_by_id(spark, folder):
    side = lambda name, origin: table(spark, folder, name).select(F.col("doc_id").alias("id"), F.lit(origin).alias("origin"))
    return R.merged_by_priority([side("labels", "primary"), side("documents", "extra")], "id")


@register("without_subsets", "WITH g AS (SELECT user_id * 100 + day(ts) AS user_day, list_sort(list(DISTINCT event_type)) AS types FROM events GROUP BY 1), d AS (SELECT types, min(user_day) AS user_day FROM g GROUP BY types) SELECT user_day, array_to_string(types, ',') AS types FROM d x WHERE NOT EXISTS (SELECT 1 FROM d y WHERE len(y.types) > len(x.types) AND list_has_all(y.types, x.types))")
def without_subsets(spark, folder):
    """Sets of event types by user and day of the month; of equal ones the first, and none that another has all of."""
    rows = table(spark, folder, "events").select((F.col("user_id") * 100 + F.dayofmonth("ts")).alias("user_day"), F.col("event_type").alias("item")).distinct()
    return R.without_subsets(rows, "user_day", "item")


@register("filled_up_to_minimum", "WITH a AS (SELECT p_brand AS name, 0 AS p, count(*) AS n FROM part WHERE p_size > 45 GROUP BY 1 HAVING count(*) > 10), b AS (SELECT p_brand AS name, 1 AS p, count(*) AS n FROM part GROUP BY 1), u AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE lower(name) NOT IN (SELECT lower(name) FROM a)) SELECT name, p, n FROM u ORDER BY p, n DESC, name LIMIT (SELECT greatest(20, count(*)) FROM a)")
def filled_up(spark, folder):
    part = table(spark, folder, "part")
    counts = lambda rows: rows.groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("n"))
    return R.filled_up(counts(part.filter("p_size > 45")).filter("n > 10"), counts(part), "name", 20, F.desc("n"))


@register(
    "hybrid_merge",
    """WITH t AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents), a AS (SELECT id, round(len(list_filter(w, lambda x: x IN ('thatin', 'the'))) / (1.0::DOUBLE + ln(1.0::DOUBLE + len(w))), 6) AS t FROM t WHERE list_has_any(w, ['thatin', 'the'])),
b AS (SELECT vec_id AS id, round(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS s FROM embeddings, (SELECT arg_min(embedding, vec_id) AS q FROM embeddings))
SELECT id, round(CASE WHEN coalesce(t, 0) > 0 AND coalesce(s, 0) > 0 THEN 0.7::DOUBLE * s + 0.3::DOUBLE * t ELSE greatest(coalesce(s, 0), coalesce(t, 0)) END, 7) AS score FROM a FULL JOIN (SELECT * FROM b WHERE s > 0.1) USING (id)""",
)
def hybrid_merge(spark, folder):
    """Hits of full text and of vectors, merged by id: both blended, else the one there is."""
    index = I.build(table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text"), stemmed=False)
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = vectors.groupBy().agg(F.min_by("embedding", "id").alias("q"))
    near = Q.within_distance(vectors, "id", "embedding", asked, 0.9).withColumnRenamed("similarity", "semantic")
    return R.blended(I.search(index, [["thatin"], ["the"]]), near, "id", "text_rank", "semantic", 0.7).select("id", F.round("score", 7).alias("score"))


@register("effective_weights", "SELECT word, count(*) AS n, round(count(*) / (SELECT count(*) FROM part), 6) AS weight FROM (SELECT unnest(list_distinct(string_split(p_name, ' '))) AS word FROM part) GROUP BY word")
def effective_weights(spark, folder):
    part = table(spark, folder, "part")
    words = part.select(F.explode(F.array_distinct(F.split("p_name", " "))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.join(F.broadcast(part.agg(F.count("*").alias("total")))).select("word", "n", F.round(F.col("n") / F.col("total"), 6).alias("weight"))


@register("decision_card", f"WITH {MENTIONS} SELECT 'brand' AS kind, brand AS name, n FROM (SELECT brand, count(DISTINCT post) AS n FROM mentions GROUP BY 1 ORDER BY n DESC, brand LIMIT 5) UNION ALL SELECT 'pain', aspect, n FROM (SELECT aspect, count(*) AS n FROM mentions JOIN order_posts USING (post) WHERE status = 'F' GROUP BY 1 ORDER BY n DESC, aspect LIMIT 3)")
def decision_card(spark, folder):
    rows = mentions(spark, folder)
    brands = rows.select("post", "brand").distinct().groupBy(F.col("brand").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(5)
    pains = rows.join(order_posts(spark, folder).filter("status = 'F'").select("post"), "post", "left_semi").groupBy(F.col("aspect").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(3)
    return brands.select(F.lit("brand").alias("kind"), "name", "n").unionByName(pains.select(F.lit("pain").alias("kind"), "name", "n"))


@register("rows_within_day_alike", """SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN events x ON x.event_id = a.vec_id JOIN embeddings b ON b.vec_id > a.vec_id JOIN events y ON y.event_id = b.vec_id
WHERE abs(floor(epoch(x.ts)) - floor(epoch(y.ts))) <= 14400 AND round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) >= 0.35""")
def rows_within_day_alike(spark, folder):
    """Pairs at most four hours apart and alike: rows meet in their own and the next four-hour bucket only."""
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding").join(table(spark, folder, "events").select("event_id", "ts"), F.col("event_id") == F.col("vec_id"))
    return R.alike_in_time(rows, "vec_id", "ts", "embedding", 14_400, 0.35)
