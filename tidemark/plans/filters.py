"""Registered queries on filters of posts and comments, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scoring as S
from tidemark.operators import filters as O
from tidemark.plans.catalogue import register
from tidemark.plans.posts import COMMENTS, POSTS, comments, posts, quoted, sql_any, sql_matches
from tidemark.session import table

FEW, MANY = ["orantion the", "hehely. "], ["thatin", "sich", "que"]


def _floor_sql(keep: str) -> str:
    return f"WITH {POSTS}, m AS (SELECT *, {keep} AS keep FROM posts) SELECT id FROM m WHERE keep OR (SELECT count(*) FILTER (WHERE keep) < greatest(1, floor(count(*) * 0.2)) FROM m)"


@register("keyword_floor_kept", _floor_sql(sql_any("lower(text)", MANY)))
def keyword_floor_kept(spark, folder):
    return O.by_keywords(posts(spark, folder), F.col("text"), MANY).select("id")


@register("keyword_floor_gives_way", _floor_sql(sql_any("lower(text)", FEW)))
def keyword_floor_gives_way(spark, folder):
    return O.by_keywords(posts(spark, folder), F.col("text"), FEW).select("id")


@register("blocklist_floor", _floor_sql(f"NOT {sql_any('lower(text)', ['inoran', 'worthless'])}"))
def blocklist_floor(spark, folder):
    return O.without_blocked(posts(spark, folder), F.col("text"), ["inoran", "worthless"]).select("id")


@register("blacklist_filter", _floor_sql(f"coalesce(author, -1) NOT IN (SELECT user_id FROM events GROUP BY user_id HAVING avg(value) > 30) AND NOT {sql_matches('text', 'worthless|[*]{3}')} AND NOT {sql_any('lower(text)', ['inoran the'])}"))
def blacklist_filter(spark, folder):
    loud = table(spark, folder, "events").groupBy(F.col("user_id").alias("author")).agg(F.avg("value").alias("v")).filter("v > 30")
    return O.without_blacklisted(posts(spark, folder), F.col("text"), F.col("author"), loud, "worthless|[*]{3}", ["inoran the"]).select("id")


@register("context_filter", f"WITH {POSTS} SELECT id FROM posts WHERE {sql_any('lower(text)', ['hehely', 'ononst'])}")
def context_filter(spark, folder):
    return O.with_context(posts(spark, folder), F.col("text"), ["hehely", "ononst"]).select("id")


@register("required_entities", f"WITH {POSTS} SELECT id FROM posts WHERE {sql_any('lower(source)', ['src1'])} OR {sql_any('lower(text)', ['src1', 'thatin the'])}")
def required_entities(spark, folder):
    return O.with_entities(posts(spark, folder), F.col("source"), F.col("text"), ["src1", "thatin the"]).select("id")


PHRASES, TOKENS = {"thatin": 1.4, "on the": 1.8}, {"hehely": 0.9, "ononst": 0.65, "thatin": 0.5}
_TITLE = " + ".join(f"CASE WHEN contains(t, {quoted(p)}) THEN {w * 2.2!r}::DOUBLE WHEN contains(b, {quoted(p)}) THEN {w * 1.8!r}::DOUBLE ELSE 0.0 END" for p, w in PHRASES.items())
_TOKEN = " + ".join(f"CASE WHEN list_contains(w, {quoted(k)}) THEN {v}::DOUBLE ELSE 0.0 END" for k, v in TOKENS.items())
_N = lambda parts: " + ".join(f"CASE WHEN {p} THEN 1 ELSE 0 END" for p in parts)
EVIDENCE = f"""{POSTS}, w AS (SELECT id, lower(title) AS t, lower(text) AS b, regexp_extract_all(lower(text), '[a-z0-9]+') AS w, source = 'src3' AS liked FROM posts),
e AS (SELECT id, 0.0::DOUBLE + {_TITLE} + (0.0::DOUBLE + {_TOKEN}) + CASE WHEN liked THEN 0.75::DOUBLE ELSE 0.0 END AS score, {_N([f"contains(t, {quoted(p)}) OR contains(b, {quoted(p)})" for p in PHRASES])} AS phrase_hits, liked,
{_N([f"list_contains(w, {quoted(k)})" for k in TOKENS])} AS token_hits, {_N([f"contains(t, {quoted(k)}) OR contains(b, {quoted(k)}) OR list_contains(w, {quoted(k)})" if k in PHRASES else f"list_contains(w, {quoted(k)})" for k in dict.fromkeys([*PHRASES, *TOKENS])])} AS terms FROM w),
g AS (SELECT *, score >= 2.0 AND terms >= 2 AND (phrase_hits >= 1 OR token_hits >= 2 OR (liked AND token_hits >= 1)) AS good FROM e)"""


@register("evidence_selection", f"WITH {EVIDENCE} SELECT id, round(score, 6) AS score, phrase_hits, token_hits, terms FROM g WHERE good OR (SELECT count(*) FILTER (WHERE good) = 0 FROM g)")
def evidence_selection(spark, folder):
    rows = posts(spark, folder)
    found = O.select_evidence(rows, O.evidence_scores(F.col("title"), F.col("text"), F.col("source"), PHRASES, TOKENS, ["src3"]), 2.0, 2)
    return found.select("id", F.round("evidence.score", 6).alias("score"), "evidence.phrase_hits", "evidence.token_hits", "evidence.terms")


_SOLUTION = f"WITH {POSTS}, s AS (SELECT id, {_N(['contains(t, {})'.format(quoted(w)) for w in ('thatin', 'hehely')])} AS required, {_N(['contains(t, {})'.format(quoted(w)) for w in ('ononst', 'inoran')])} AS soft FROM (SELECT id, lower(text) AS t FROM posts))"


@register("solutions_by_profile", f"{_SOLUTION} SELECT id, 2 * CASE WHEN required > 0 THEN 1 ELSE 0 END + CASE WHEN soft > 0 THEN 1 ELSE 0 END + required + soft AS points FROM s WHERE required > 0 OR soft > 0 ORDER BY points DESC, id LIMIT 50")
def solutions_by_profile(spark, folder):
    t = S.plain(F.col("text"))
    required, soft = (F.size(S.hits(t, w)) for w in (["thatin", "hehely"], ["ononst", "inoran"]))
    scored = posts(spark, folder).select("id", (2 * F.when(required > 0, 1).otherwise(0) + F.when(soft > 0, 1).otherwise(0) + required + soft).alias("points")).filter("points > 0")
    return scored.orderBy(F.desc("points"), "id").limit(50)


_FATE = f"""WITH {COMMENTS}, c AS (SELECT id, body, CASE author WHEN 'assistant' THEN 'core' WHEN 'user' THEN 'lab' END AS pool, depth AS ts FROM comments),
n AS (SELECT id, lower(trim(regexp_replace(body, '[ \\t\\n\\r]+', ' ', 'g'))) AS norm, CASE WHEN coalesce(pool, 'unscored') NOT IN ('core', 'lab') THEN 'pool' WHEN ts < 1 THEN 'age' END AS early FROM c),
m AS (SELECT id, norm, coalesce(early, CASE WHEN length(norm) < 60 THEN 'short' END) AS early FROM n),
f AS (SELECT id, coalesce(early, CASE WHEN row_number() OVER (PARTITION BY norm, early IS NOT NULL ORDER BY id) > 1 THEN 'repeated' END, 'admitted') AS fate FROM m)"""


def _fates(spark, folder):
    pool = F.when(F.col("author") == "assistant", "core").when(F.col("author") == "user", "lab")
    rows = comments(spark, folder).select("id", "body", pool.alias("pool"), F.col("depth").alias("ts"))
    return O.prefilter_comments(rows, ["core", "lab"], 60, F.lit(1))


@register("comment_prefilter", f"{_FATE} SELECT id, fate FROM f")
def comment_prefilter(spark, folder):
    return _fates(spark, folder).select("id", "fate")


@register("comment_prefilter_counts", f"{_FATE} SELECT fate, count(*) AS n FROM f GROUP BY fate")
def comment_prefilter_counts(spark, folder):
    return _fates(spark, folder).groupBy("fate").agg(F.count("*").alias("n"))


@register(
    "relevance_with_profile",
    """WITH c AS (SELECT lower(source) AS community, count(*) AS n FROM documents GROUP BY source), a AS (SELECT unnest(['src1', 'src5', 'elsewhere']) AS name)
SELECT coalesce(community, name) AS community, CASE WHEN name IS NOT NULL THEN greatest(coalesce(n, 0), 10000) ELSE n END AS n FROM c FULL JOIN a ON community = name WHERE name IS NOT NULL OR contains(community, 'rc2')""",
)
def relevance_with_profile(spark, folder):
    counts = table(spark, folder, "documents").groupBy(F.col("source").alias("community")).agg(F.count("*").alias("n"))
    return O.relevance_with_profile(counts, ["r/src1", "src5", "elsewhere"], ["rc2"])


@register("spam_modes", f"""WITH {POSTS}, s AS (SELECT id, {sql_matches('text', 'worthless')} AS spam FROM posts), m(mode) AS (VALUES ('allow'), ('tag'), ('drop'))
SELECT mode, count(*) AS n, count(*) FILTER (WHERE spam AND mode = 'tag') AS tagged FROM s, m WHERE NOT (mode = 'drop' AND spam) GROUP BY mode""")
def spam_modes(spark, folder):
    rows = posts(spark, folder).select("id", S.matches(F.col("text"), "worthless").alias("spam"), F.explode(F.array(F.lit("allow"), F.lit("tag"), F.lit("drop"))).alias("mode"))
    kept = rows.filter(~((F.col("mode") == "drop") & F.col("spam")))
    return kept.groupBy("mode").agg(F.count("*").alias("n"), F.count_if(F.col("spam") & (F.col("mode") == "tag")).alias("tagged"))


@register("eligible_comments", f"WITH {COMMENTS} SELECT id FROM comments WHERE body NOT IN ('[deleted]', '[removed]') AND length(body) > 20 AND author NOT ILIKE '%sys%'")
def eligible_comments(spark, folder):
    return comments(spark, folder).filter(~F.col("body").isin("[deleted]", "[removed]") & (F.length("body") > 20) & ~F.col("author").ilike("%sys%")).select("id")
