"""Registered queries on scores and classes of texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scoring as S
from tidemark.plans.catalogue import register
from tidemark.plans.posts import COMMENTS, POSTS, comments, posts, quoted, sql_any, sql_matches, sql_sum, sql_word
from tidemark.session import table

#: Words of the tables' invented languages, as the lexicons of the queries.
RULES = S.Rules({"thatin": 0.3, "hehely": 0.25, "orantion": 0.2, "tion": 0.05}, {"inoran": -0.2, "worthless": -0.6}, ["ononst re", "|"], {r"\bthe (re|in)": 0.1, "re[.]\\n": 0.05}, {r"\bof (the|and)\b": 0.08})
ASPECTS = {"shipping": ["thatin", "ononst"], "quality": ["hehely"], "service": ["inoran the", "orantion"], "price": ["und der", "de la"]}
NEEDS = {"Survival": ["inoran", "erre"], "Efficiency": ["thatin", "thre"], "Belonging": ["hehely"], "Aesthetic": ["ononst"], "Growth": ["orantion", "thed"]}
PHRASES = {"Efficiency": ["is the"], "Growth": ["by the", "on the"]}
MOOD = {"inoran": -2.0, "worthless": -3.1, "hehely": 1.9, "thatin": 0.8, "ononst": -1.1, "the": 0.2}
CATEGORIES = {"pricing": ["thre", "thed"], "quality": ["erin", "eron"], "support": ["heit", "lich"], "other": ["the"]}
LEVELS = {"strong": ["inoran"], "medium": ["hehely", "ononst"], "weak": ["thatin", "orantion"]}

T = "lower(text)"


@register(
    "opportunity_score",
    f"""WITH {POSTS}, s AS (SELECT id, lower(text) AS t FROM posts), w AS (
SELECT id, t, {sql_any('t', RULES.negations)} AS negated,
(0.0::DOUBLE {''.join(f' + CASE WHEN {sql_matches("t", p)} THEN {w}::DOUBLE ELSE 0.0 END' for p, w in RULES.boosts.items())}) AS boost,
(0.0::DOUBLE {''.join(f' + CASE WHEN {sql_matches("t", p)} THEN {w}::DOUBLE ELSE 0.0 END' for p, w in RULES.penalties.items())}) AS penalty,
{sql_sum('t', [*RULES.positive.items(), *RULES.negative.items()])} AS terms FROM s)
SELECT id, round(greatest(0.0, least(1.0, CASE WHEN negated THEN least(terms + boost - penalty, 0.0) ELSE terms + boost - penalty END)), 6) AS score, negated,
array_to_string(list_filter([{', '.join(quoted(k) for k in RULES.positive)}], lambda k: contains(t, k)), ',') AS positive_hits,
array_to_string(list_filter([{', '.join(quoted(k) for k in RULES.negative)}], lambda k: contains(t, k)), ',') AS negative_hits, round(boost, 6) AS boost, round(penalty, 6) AS penalty FROM w""",
)
def opportunity_score(spark, folder):
    rows = posts(spark, folder).select("id", S.opportunity(F.col("text"), RULES).alias("o"))
    joined = lambda c: F.array_join(f"o.{c}", ",").alias(c)
    return rows.select("id", F.round("o.score", 6).alias("score"), "o.negated", joined("positive_hits"), joined("negative_hits"), F.round("o.boost", 6).alias("boost"), F.round("o.penalty", 6).alias("penalty"))


#: The rules' patterns, as in ``scoring.auto_score``.
_SPAM = "promo code|discount code|affiliate link|buy now|check out my|click here"
AUTO = f"""SELECT id, source, CASE WHEN spam THEN 0 WHEN trade THEN 6 WHEN decision THEN 7 WHEN problem THEN 6 WHEN price THEN 5 ELSE 3 END AS score,
CASE WHEN spam THEN NULL WHEN trade THEN 'normal' WHEN decision THEN 'gold_decision' WHEN problem THEN 'gold_problem' ELSE 'normal' END AS tier FROM (
SELECT id, source, (length(body) - length(replace(body, 'http', ''))) // 4 > 2 OR {sql_matches('body', r'bit[.]ly|amzn[.]to|t[.]co|goo[.]gl|tinyurl[.]com')} OR {sql_matches("title || ' ' || body", _SPAM)} AS spam,
{sql_matches('title', r'\[(WTS|WTT|WTB|S|B)\]')} OR {sql_matches('title', r'\b(selling|buying|trading)\b.*\b(price|usd|\$)\b')} AS trade,
{sql_matches("title || ' ' || body", 'recommend|suggestion|which one|which should I| vs |versus|worth it|review|looking for|advice on')} AS decision,
{sql_matches("title || ' ' || body", 'how to|issue with|failed|broke|not working|help with|problem with|error|bug')} AS problem,
{sql_matches('title', r'\b(price|budget|cost|worth)\b')} AND {sql_matches('title', r'\$[0-9]+|[0-9]+(\s)?(usd|k)')} AS price FROM {{rows}})"""


@register("post_auto_score", f"WITH {POSTS} SELECT id, score, tier, CASE WHEN score >= 8 THEN 'core' WHEN score <= 2 THEN 'noise' ELSE 'lab' END AS pool FROM ({AUTO.format(rows='posts')})")
def post_auto_score(spark, folder):
    return posts(spark, folder).select("id", S.auto_score(F.col("title"), F.col("body")).alias("a")).select("id", "a.score", "a.tier", "a.pool")


PAGES_AS_POSTS = r"(SELECT page_id AS id, coalesce(url, '') AS source, coalesce(url, '') AS title, coalesce(html, '') AS body FROM pages)"


@register("page_auto_score", f"SELECT id, score, tier, CASE WHEN score >= 8 THEN 'core' WHEN score <= 2 THEN 'noise' ELSE 'lab' END AS pool FROM ({AUTO.format(rows=PAGES_AS_POSTS)})")
def page_auto_score(spark, folder):
    return table(spark, folder, "pages").select(F.col("page_id").alias("id"), S.auto_score(F.col("url"), F.col("html")).alias("a")).select("id", "a.score", "a.tier", "a.pool")


BASIC = f"""CASE WHEN body IS NULL THEN 0 ELSE least(5, 2 + CASE WHEN length(body) > 150 THEN 1 ELSE 0 END
+ CASE WHEN {sql_matches('body', r'\b(fixed|solution|solved|bought|ordered|recommend|works well|use this|try this)\b')} THEN 2 ELSE 0 END
+ CASE WHEN {sql_matches('body', r'\?|\b(how|what|why|where|does anyone)\b')} THEN 1 ELSE 0 END) END"""


@register("comment_basic_score", f"SELECT conv_id, turn, {BASIC} AS score FROM (SELECT *, text AS body FROM conversations)")
def comment_basic_score(spark, folder):
    return table(spark, folder, "conversations").select("conv_id", "turn", S.comment_basic_score(F.col("text")).alias("score"))


@register(
    "default_bucket_score",
    f"""WITH {POSTS} SELECT id, CASE WHEN s >= 50 OR c >= 50 THEN 8.0::DOUBLE WHEN s >= 10 OR c >= 5 THEN 6.0 WHEN s >= 3 OR c >= 1 THEN 3.0 ELSE 1.0 END AS value,
CASE WHEN s >= 50 OR c >= 50 THEN 'core' WHEN s >= 10 OR c >= 5 THEN 'core' WHEN s >= 3 OR c >= 1 THEN 'lab' ELSE 'noise' END AS pool FROM (SELECT id, coalesce(score, 0) AS s, coalesce(comments, 0) AS c FROM posts)""",
)
def default_bucket_score(spark, folder):
    return posts(spark, folder).select("id", S.engagement_bucket(F.col("score"), F.col("comments")).alias("b")).select("id", "b.value", "b.pool")


@register(
    "category_aspect",
    f"""WITH {POSTS}, t AS (SELECT id, lower(text) AS t FROM posts), a AS (SELECT id, t, CASE WHEN {sql_any('t', ['der', 'das'])} AND {sql_any('t', ['ung', 'keit'])} THEN 'install'
{' '.join(f"WHEN {sql_word('t', v)} THEN '{k}'" for k, v in ASPECTS.items())} ELSE 'other' END AS aspect, {sql_matches('t', 'worthless|automatically removed')} AS bot FROM t)
SELECT id, CASE WHEN bot THEN 'other' WHEN {sql_any('t', ['rewh', 'çon'])} THEN 'solution' WHEN aspect <> 'other' OR {sql_any('t', ['thth'])} THEN 'pain' ELSE 'other' END AS category,
CASE WHEN bot THEN 'other' ELSE aspect END AS aspect FROM a""",
)
def category_aspect(spark, folder):
    found = S.classify(F.col("text"), ASPECTS, ["rewh", "çon"], ["thth"], "worthless|automatically removed", ("install", ["der", "das"], ["ung", "keit"]))
    return posts(spark, folder).select("id", found.alias("c")).select("id", "c.category", "c.aspect")


MOOD_SQL = "list_sum(list_transform(regexp_extract_all(lower({}), '[a-z]+'), lambda w: CASE w " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in MOOD.items()) + " ELSE 0.0::DOUBLE END))"
SENTIMENT = "(SELECT round(x / sqrt(x * x + 15.0::DOUBLE), 6) FROM (SELECT coalesce(" + MOOD_SQL + ", 0.0::DOUBLE) AS x))"


@register("lexicon_sentiment", f"WITH {POSTS} SELECT id, round(x / sqrt(x * x + 15.0::DOUBLE), 6) AS sentiment FROM (SELECT id, coalesce({MOOD_SQL.format('text')}, 0.0::DOUBLE) AS x FROM posts)")
def lexicon_sentiment(spark, folder):
    return posts(spark, folder).select("id", S.sentiment(F.col("text"), MOOD).alias("sentiment"))


_NEED_COUNT = {n: " + ".join(["0.0::DOUBLE", *(f"CASE WHEN contains(t, {quoted(p)}) THEN 2.0 ELSE 0.0 END" for p in PHRASES.get(n, ())), *(f"len(regexp_extract_all(t, '\\b{w}\\b'))::DOUBLE" for w in NEEDS[n])]) for n in S.NEEDS}
NEED_SQL = f"""{POSTS}, t AS (SELECT id, source, lower(text) AS t, round(x / sqrt(x * x + 15.0::DOUBLE), 6) AS mood FROM (SELECT id, source, text, coalesce({MOOD_SQL.format('text')}, 0.0::DOUBLE) AS x FROM posts)),
n AS (SELECT id, source, mood, t, {', '.join(f'{v} AS {k}' for k, v in _NEED_COUNT.items())} FROM t),
g AS (SELECT id, source, mood, t, Belonging, Aesthetic, CASE WHEN contains(t, '?') THEN Growth * 1.3::DOUBLE ELSE Growth END AS Growth, CASE WHEN contains(t, '?') THEN Efficiency * 1.1::DOUBLE ELSE Efficiency END AS Efficiency,
  CASE WHEN mood >= -0.05 THEN 0.0 WHEN mood >= -0.2 THEN Survival * 0.5::DOUBLE ELSE Survival * 1.5::DOUBLE END AS Survival FROM n),
h AS (SELECT id, source, mood, {sql_word('t', ['worthless'])} AS noise, Belonging, Aesthetic, Growth, Efficiency, CASE WHEN Survival > 0 AND mood > -0.4 AND (Growth >= Survival OR Efficiency >= Survival) THEN Survival * 0.5::DOUBLE ELSE Survival END AS Survival FROM g),
needs AS (SELECT id, source, mood, {', '.join(f'CASE WHEN noise THEN 0.0::DOUBLE ELSE round({k}, 4) END AS {k}' for k in S.NEEDS)} FROM h),
named AS (SELECT *, CASE greatest({', '.join(S.NEEDS)}) WHEN 0 THEN 'Unclassified' {' '.join(f"WHEN {n} THEN '{n}'" for n in S.NEEDS)} END AS first FROM needs),
rest AS (SELECT *, {', '.join(f"CASE WHEN first = '{n}' THEN -1.0::DOUBLE ELSE {n} END AS r{k}" for k, n in enumerate(S.NEEDS))} FROM named),
tagged AS (SELECT *, CASE WHEN first <> 'Unclassified' AND greatest(r0, r1, r2, r3, r4) >= 1.0 THEN CASE greatest(r0, r1, r2, r3, r4) {' '.join(f"WHEN r{k} THEN '{n}'" for k, n in enumerate(S.NEEDS))} END END AS second FROM rest)"""


def _needs(spark, folder):
    rows = posts(spark, folder).select("id", "source", "text", S.sentiment(F.col("text"), MOOD).alias("mood"))
    return rows.select("id", "source", "mood", S.need_scores(F.col("text"), F.col("mood"), NEEDS, PHRASES, ["worthless"]).alias("n"))


@register("need_scores", f"WITH {NEED_SQL} SELECT id, {', '.join(f'{n} AS {n.lower()}' for n in S.NEEDS)}, first AS primary_need, second AS secondary_need FROM tagged")
def need_scores(spark, folder):
    n = F.col("n")
    return _needs(spark, folder).select("id", *(n[x].alias(x.lower()) for x in S.NEEDS), S.primary_need(n).alias("primary_need"), S.secondary_need(n).alias("secondary_need"))


NEED_WEIGHTS = {"Survival": 1.5, "Efficiency": 2.5, "Growth": 1.2, "Belonging": 0.5, "Aesthetic": 0.5}


@register(
    "need_weighted_score",
    f"""WITH {NEED_SQL}, a AS (SELECT source, count(*) AS n, sum(CASE first {' '.join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in NEED_WEIGHTS.items())} ELSE 0.0 END) / count(*) / 2.5::DOUBLE AS need, avg(mood) AS mood,
count(*) FILTER (WHERE second = 'Efficiency' AND first IN ('Survival', 'Growth')) / count(*) AS dual FROM tagged GROUP BY source)
SELECT source, n, round(need, 6) AS need, round(mood, 6) AS mood, round(greatest(0.0, least(1.0, 0.4::DOUBLE * 0.25 + least(1.0, need) * 0.5 + CASE WHEN mood < -0.3 THEN 0.15 WHEN mood > 0.2 THEN 0.05 ELSE 0.0 END::DOUBLE * 0.25 + dual * 0.1::DOUBLE)), 6) AS score FROM a""",
)
def need_weighted_score(spark, folder):
    rows = _needs(spark, folder).select("source", "mood", S.primary_need(F.col("n")).alias("first"), S.secondary_need(F.col("n")).alias("second"))
    weight = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in NEED_WEIGHTS.items() for x in p)), F.col("first")), F.lit(0.0))
    dual = (F.col("second") == "Efficiency") & F.col("first").isin("Survival", "Growth")
    sums = rows.groupBy("source").agg(F.count("*").alias("n"), (F.sum(weight) / F.count("*") / 2.5).alias("need"), F.avg("mood").alias("mood"), (F.count_if(dual) / F.count("*")).alias("dual"))
    score = S.need_weighted(F.lit(0.4), F.col("need"), F.col("mood"), F.col("dual"))
    return sums.select("source", "n", F.round("need", 6).alias("need"), F.round("mood", 6).alias("mood"), F.round(score, 6).alias("score"))


@register(
    "pain_category",
    f"""WITH {POSTS}, t AS (SELECT id, lower(text) AS t FROM posts), c AS (SELECT id, {', '.join(f"({' + '.join(f'(length(t) - length(replace(t, {quoted(w)}, {quoted(str())}))) // {len(w)}' for w in v)}) AS {k}" for k, v in CATEGORIES.items() if k != 'other')} FROM t)
SELECT id, CASE greatest(pricing, quality, support) WHEN 0 THEN 'other' WHEN pricing THEN 'pricing' WHEN quality THEN 'quality' ELSE 'support' END AS category FROM c""",
)
def pain_category(spark, folder):
    return posts(spark, folder).select("id", S.most_frequent_category(F.col("text"), CATEGORIES).alias("category"))


_LEVEL = "CASE " + " ".join(f"WHEN {sql_any('t', v)} THEN '{k}'" for k, v in LEVELS.items()) + " ELSE {} END"
_N_SIGNALS = " + ".join(f"CASE WHEN contains(t, {quoted(w)}) THEN 1 ELSE 0 END" for v in LEVELS.values() for w in v)


@register("signal_scores", f"WITH {POSTS} SELECT id, {_N_SIGNALS} AS signals, round(({_N_SIGNALS}) * 10 + (coalesce(score, 0) + coalesce(comments, 0) * 2) * 0.01::DOUBLE, 4) AS signal_score, {_LEVEL.format('NULL')} AS level FROM (SELECT *, lower(text) AS t FROM posts)")
def signal_scores(spark, folder):
    n = F.size(S.hits(S.plain(F.col("text")), [w for v in LEVELS.values() for w in v]))
    return posts(spark, folder).select("id", n.alias("signals"), F.round(S.signal_score(n, F.col("score"), F.col("comments")), 4).alias("signal_score"), S.first_level(F.col("text"), LEVELS, None).alias("level"))


@register("rant_intensity", f"""WITH {POSTS}, l AS (SELECT source, {_LEVEL.format("'none'")} AS level FROM (SELECT source, lower(text) AS t FROM posts))
SELECT source, {', '.join(f"round(avg(CASE WHEN level = '{k}' THEN 1.0 ELSE 0.0 END), 6) AS {k}" for k in LEVELS)} FROM l GROUP BY source""")
def rant_intensity(spark, folder):
    rows = posts(spark, folder).select("source", S.first_level(F.col("text"), LEVELS, "none").alias("level"))
    return rows.groupBy("source").agg(*(F.round(F.avg((F.col("level") == k).cast("int")), 6).alias(k) for k in LEVELS))


@register("need_urgency", f"""WITH {POSTS}, l AS (SELECT source, CASE WHEN {sql_any('t', LEVELS['strong'])} THEN 'urgent' WHEN {sql_any('t', LEVELS['medium'])} THEN 'moderate' ELSE 'casual' END AS level FROM (SELECT source, lower(text) AS t FROM posts))
SELECT source, level, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY source), 6) AS share FROM l GROUP BY source, level""")
def need_urgency(spark, folder):
    level = S.first_level(F.col("text"), {"urgent": LEVELS["strong"], "moderate": LEVELS["medium"]}, "casual")
    from pyspark.sql import Window

    counts = posts(spark, folder).groupBy("source", level.alias("level")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("source")), 6))


@register("intent_label", f"WITH {POSTS} SELECT id, CASE WHEN {sql_any('t', ['hehely'])} THEN 'already_left' WHEN {sql_any('t', ['thatin', 'ononst'])} THEN 'considering' ELSE 'staying_reluctantly' END AS intent FROM (SELECT id, lower(text) AS t FROM posts)")
def intent_label(spark, folder):
    return posts(spark, folder).select("id", S.first_level(F.col("text"), {"already_left": ["hehely"], "considering": ["thatin", "ononst"]}, "staying_reluctantly").alias("intent"))


KINDS = ["user_review", "ask_question", "news_sharing", "rant", "other"]
INTENTS = ["share_solution", "complain", "recommend_product", "offtopic"]
_ANALYSIS = f"""a AS (SELECT event_id AS id, [{', '.join(map(quoted, KINDS))}][user_id % 5 + 1] AS kind, CASE event_type WHEN 'click' THEN 'share_solution' WHEN 'error' THEN 'complain' WHEN 'purchase' THEN 'recommend_product' END AS intent,
CAST(json_extract(props, '$.k') AS BIGINT) // 30 AS pains, event_type = 'signup' AS shipping, value > 50 AS tax, least(1.0::DOUBLE, value / 96.7::DOUBLE) AS buys FROM events),
b AS (SELECT *, coalesce(intent, 'offtopic') AS i FROM a)"""


def _analysis_sql(w):
    by = lambda c, table_: "".join(f" + CASE WHEN {c} = '{k}' THEN {v}::DOUBLE ELSE 0.0 END" for k, v in table_.items())
    return f"""WITH {_ANALYSIS}, v AS (SELECT *, 3.0::DOUBLE{by('kind', w.kind)}{by('i', w.intent)} + least(pains * {w.pain}::DOUBLE, {w.most_pain}) + CASE WHEN shipping THEN 1.0 ELSE 0.0 END + CASE WHEN tax THEN 1.0 ELSE 0.0 END AS base FROM b),
s AS (SELECT *, greatest(0.0, least(10.0, CASE WHEN buys > 0.7 THEN base * 1.2::DOUBLE ELSE base END)) AS x, greatest(0.0, least(1.0, pains * {w.opportunity}::DOUBLE + buys * 0.5::DOUBLE + CASE WHEN i = 'complain' THEN 0.2::DOUBLE ELSE 0.0 END)) AS y FROM v)
SELECT id, round(x, 2) AS value, round(y, 2) AS opportunity, CASE WHEN x >= 8.0 THEN 'core' WHEN x <= 3.9 THEN 'noise' ELSE 'lab' END AS pool FROM s"""


def _analysis(spark, folder, weights):
    rows = table(spark, folder, "events")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("user_id") % 5 + 1).cast("int"))
    intent = F.when(F.col("event_type") == "click", "share_solution").when(F.col("event_type") == "error", "complain").when(F.col("event_type") == "purchase", "recommend_product")
    pains = F.floor(F.get_json_object("props", "$.k").cast("long") / 30)
    found = S.analysis_score(kind, intent, pains, F.col("event_type") == "signup", F.col("value") > 50, F.least(F.lit(1.0), F.col("value") / 96.7), weights)
    return rows.select(F.col("event_id").alias("id"), found.alias("a")).select("id", "a.value", "a.opportunity", "a.pool")


@register("post_analysis_score", _analysis_sql(S.POST_ANALYSIS))
def post_analysis_score(spark, folder):
    return _analysis(spark, folder, S.POST_ANALYSIS)


@register("comment_analysis_score", _analysis_sql(S.COMMENT_ANALYSIS))
def comment_analysis_score(spark, folder):
    return _analysis(spark, folder, S.COMMENT_ANALYSIS)


@register(
    "spam_classes",
    f"""WITH {POSTS}, f AS (SELECT id, author, title || ' ' || body AS t FROM posts)
SELECT id, CASE WHEN author IN (1, 2, 3) THEN 'Spam_Bot' WHEN {sql_matches('t', 'worthless|[*]{3}')} AND {sql_matches('t', r'\b(btc|eth|crypto|token)\b')} THEN 'Spam_Crypto' WHEN {sql_matches('t', 'worthless|[*]{3}')} THEN 'Spam_Ad'
WHEN {sql_any('lower(t)', ['inoran the'])} THEN 'Spam_LowQuality' END AS spam FROM f""",
)
def spam_classes(spark, folder):
    return posts(spark, folder).select("id", S.spam_class(F.col("title"), F.col("body"), F.col("author"), [1, 2, 3], "worthless|[*]{3}", ["inoran the"]).alias("spam"))


NOISE_SQL = f"length(trim(regexp_replace(body, '[ \\t\\n\\r]+', ' ', 'g'))) < 40 OR {sql_any('lower(body)', ['la le', 'der die'])} OR lower(trim(coalesce(author, ''))) IN ('system')"


@register("noise_comments", f"WITH {COMMENTS} SELECT id, {NOISE_SQL} AS noise FROM comments")
def noise_comments(spark, folder):
    return comments(spark, folder).select("id", S.noise_comment(F.col("body"), F.col("author"), 40, ["la le", "der die"], ("system",)).alias("noise"))


@register(
    "analysis_confidence",
    """SELECT source, round(greatest(0.0, least(1.0, 0.0::DOUBLE + least(coalesce(q, 0) / 0.9::DOUBLE, 1.0) * 0.4::DOUBLE + least(n / 100.0::DOUBLE, 1.0) * 0.15::DOUBLE + least(l / 10.0::DOUBLE, 1.0) * 0.15::DOUBLE
+ least(p / 10.0::DOUBLE, 1.0) * 0.1::DOUBLE + least(x / 5.0::DOUBLE, 1.0) * 0.1::DOUBLE + least(l / 5.0::DOUBLE, 1.0) * 0.1::DOUBLE)), 2) AS confidence FROM (
SELECT source, avg(quality) AS q, count(*) AS n, count(DISTINCT lang) AS l, count(*) FILTER (WHERE quality = 0) AS p, count(*) FILTER (WHERE toxic = 1) AS x FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)""",
)
def analysis_confidence(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "source", "lang").join(table(spark, folder, "labels"), "doc_id", "left")
    sums = rows.groupBy("source").agg(F.avg("quality").alias("q"), F.count("*").alias("n"), F.countDistinct("lang").alias("l"), F.count_if(F.col("quality") == 0).alias("p"), F.count_if(F.col("toxic") == 1).alias("x"))
    return sums.select("source", S.analysis_confidence(*map(F.col, "qnlpxl")).alias("confidence"))
