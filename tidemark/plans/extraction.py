"""Registered queries on signals taken from sentences, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scoring as S
from tidemark.operators import analytics as A
from tidemark.operators import extraction as E
from tidemark.plans.catalogue import register
from tidemark.plans.posts import POSTS, posts, quoted, sql_any, sql_matches, sql_sum
from tidemark.plans.records import SENTENCES
from tidemark.plans.scoring import MOOD, MOOD_SQL
from tidemark.session import table

NEGATIVE, STRONG, UNABLE, KEYS = ["inoran", "worthless", "ononst"], ["worthless"], ["hehely"], ["thatin", "the", "orantion"]
SENT = f"{POSTS}, raw AS (SELECT id, coalesce(score, 0) AS score, coalesce(comments, 0) AS comments, {SENTENCES} AS parts FROM posts), sent AS (SELECT id, score, comments, parts, unnest(parts) AS s, generate_subscripts(parts, 1) AS pos FROM raw), low AS (SELECT *, lower(s) AS low FROM sent)"
_N = lambda text, terms: "(" + " + ".join(f"CASE WHEN contains({text}, {quoted(t)}) THEN 1 ELSE 0 END" for t in terms) + ")"
_FLAGS = lambda terms: "(" + " + ".join(f"max(CASE WHEN contains(low, {quoted(t)}) THEN 1 ELSE 0 END)" for t in terms) + ")"


@register(
    "pain_points",
    f"""WITH {SENT}, m AS (SELECT id, low, left(low, 100) AS key, score + comments * 0.5::DOUBLE AS e, CASE WHEN {sql_any('low', NEGATIVE)} THEN greatest(-1.0, -0.3::DOUBLE - 0.15::DOUBLE * least({_N('low', NEGATIVE)}, 5)) ELSE -0.3::DOUBLE END AS a FROM low
  WHERE length(s) >= 15 AND ({sql_any('low', NEGATIVE)} OR {sql_matches('s', 'on the .*ed|by the re')})),
b AS (SELECT *, CASE WHEN {sql_any('low', STRONG)} THEN least(a - 0.2::DOUBLE, -0.9) ELSE a END AS b FROM m), c AS (SELECT *, CASE WHEN {sql_any('low', UNABLE)} THEN least(b - 0.1::DOUBLE, -0.8) ELSE b END AS mood FROM b),
g AS (SELECT key, count(*) AS frequency, avg(mood) AS sentiment, count(DISTINCT id) AS posts, max(e) AS most, {_FLAGS(KEYS)} AS keywords FROM c GROUP BY key)
SELECT key, frequency, round(sentiment, 6) AS sentiment, keywords, posts, round(least(frequency / 3, 1.0) * 0.5 + abs(sentiment) * 0.3::DOUBLE + least(keywords / 3, 1.0) * 0.15::DOUBLE + least(most / 80, 1.0) * 0.05::DOUBLE, 6) AS relevance FROM g""",
)
def pain_points(spark, folder):
    return E.pain_points(posts(spark, folder), NEGATIVE, ["on the .*ed", "by the re"], KEYS, STRONG, UNABLE)


PRODUCT = r"[A-Z][a-z]{3,}"


@register(
    "competitors",
    f"""WITH {SENT}, m AS (SELECT id, low, list_distinct(regexp_extract_all(s, '{PRODUCT}')) AS names, CASE WHEN {_N('low', NEGATIVE)} > 0 THEN greatest(-0.8, -0.2::DOUBLE - 0.15::DOUBLE * {_N('low', NEGATIVE)}) WHEN {sql_any('low', ['hehely', 'orantion'])} THEN 0.4 ELSE 0.1 END AS mood FROM low WHERE length(s) >= 15),
e AS (SELECT id, mood, unnest(names) AS name FROM m WHERE len(names) > 0 AND ({sql_any('low', ['thatin', ' by '])} OR len(names) >= 2)), g AS (SELECT name, count(*) AS mentions, avg(mood) AS sentiment, count(DISTINCT id) AS posts FROM e WHERE lower(name) NOT IN ('that', 'with', 'this') GROUP BY name)
SELECT name, mentions, round(sentiment, 6) AS sentiment, least(mentions, 5) AS contexts, posts, round(least(mentions / 3, 1.0) * 0.6::DOUBLE + abs(sentiment) * 0.25::DOUBLE + least(least(mentions, 5) / 4, 1.0) * 0.15::DOUBLE, 6) AS relevance FROM g""",
)
def competitors(spark, folder):
    return E.competitors(posts(spark, folder), PRODUCT, ["thatin", " by "], NEGATIVE, ["hehely", "orantion"], ["that", "with", "this"])


OPP = S.Rules({"thatin": 0.3, "tion": 0.05}, {"inoran": -0.2}, ["ononst re"])
_SCORE = "greatest(0.0, least(1.0, CASE WHEN contains({0}, 'ononst re') THEN least({1}, 0.0) ELSE {1} END))"
_OWN = lambda t: _SCORE.format(t, sql_sum(t, [*OPP.positive.items(), *OPP.negative.items()]))


@register(
    "opportunities",
    f"""WITH {SENT}, m AS (SELECT id, low, score, left(low, 100) AS key, CASE WHEN {sql_any('low', ['ononst'])} THEN 1.5 WHEN {sql_any('low', ['erre'])} THEN 1.0 WHEN {sql_any('low', ['thre'])} THEN 0.5 ELSE 0.0 END::DOUBLE + CASE WHEN {sql_any('low', ['orantion'])} THEN 0.8::DOUBLE ELSE 0.0 END AS u,
  lower(array_to_string(parts[greatest(pos - 1, 1):pos + 1], ' ')) AS w FROM low WHERE length(s) >= 20 AND {sql_any('low', ['thatin', 'hehely'])}), o AS (SELECT *, {_OWN('w')} AS c, {_OWN('low')} AS own FROM m),
g AS (SELECT key, count(*) AS demand, sum(u) AS u, avg(score) AS mean, avg(c) AS c, min(own) AS own, count(DISTINCT id) AS posts, {_FLAGS(KEYS)} AS keywords FROM o GROUP BY key)
SELECT key, demand, round(least(u / demand, 1.5), 6) AS urgency, round(greatest(0.0, least(1.0, greatest(0.0, least(1.0, least(demand / 3, 1.0) * 0.35::DOUBLE + least(least(u / demand, 1.5), 1.0) * 0.3::DOUBLE + least(mean / 60, 1.0) * 0.2::DOUBLE + least(keywords / 3, 1.0) * 0.15::DOUBLE + own)) + c * 0.2::DOUBLE)), 6) AS relevance,
CAST(floor(round(100.0::DOUBLE + demand * 50 + mean * 2 + keywords * 20, 6)) AS BIGINT) AS potential_users, posts FROM g""",
)
def opportunities(spark, folder):
    return E.opportunities(posts(spark, folder), ["thatin", "hehely"], ["ononst"], ["erre"], ["thre"], ["orantion"], KEYS, OPP)


VERBS = {"thed": 0.1, "eron": 0.05}
_FEEL = f"round(x / sqrt(x * x + 15.0::DOUBLE), 6)"


def _solutions_sql(cues, keys):
    return f"""WITH {SENT}, x AS (SELECT low, s, coalesce({MOOD_SQL.format('low')}, 0.0::DOUBLE) AS x FROM low WHERE length(s) >= 10 AND NOT {sql_any('low', ['worthless'])}), f AS (SELECT low, s, {_FEEL} AS feel FROM x),
p AS (SELECT left(low, 80) AS key, feel + {sql_sum('low', VERBS.items())} AS feel, CASE WHEN length(s) >= 15 AND {sql_any('low', cues)} AND {sql_any('low', keys)} AND feel >= 0 THEN 1 WHEN length(s) >= 15 AND {sql_any('low', cues)} AND feel >= 0 THEN 2
  WHEN length(s) >= 15 AND {sql_any('low', cues)} AND feel >= -0.15 THEN 3 WHEN {sql_any('low', VERBS)} AND feel >= -0.3 THEN 4 END AS n FROM f),
k AS (SELECT key, min(n) AS first FROM p WHERE n IS NOT NULL GROUP BY key), c AS (SELECT count(*) FILTER (WHERE first <= 1) AS c1, count(*) FILTER (WHERE first <= 2) AS c2, count(*) FILTER (WHERE first <= 3) AS c3 FROM k),
l AS (SELECT CASE WHEN CASE WHEN c1 > 0 THEN c1 ELSE c2 END >= 5 THEN CASE WHEN c1 > 0 THEN 1 ELSE 2 END WHEN c3 >= 5 THEN 3 ELSE 4 END AS last FROM c)
SELECT key, min(n) AS first_pass, count(*) AS frequency, round(least(count(*) / 2, 1.0) * 0.6::DOUBLE + sum(feel) / count(*) * 0.4::DOUBLE, 6) AS relevance FROM p, l WHERE n <= last GROUP BY key"""


@register("solutions_first_pass", _solutions_sql(["thatin"], ["the"]))
def solutions_first_pass(spark, folder):
    return E.solutions(posts(spark, folder), ["thatin"], VERBS, ["worthless"], ["the"], MOOD)


@register("solutions_relaxed", _solutions_sql(["ononst inoran the"], ["nothing"]))
def solutions_relaxed(spark, folder):
    return E.solutions(posts(spark, folder), ["ononst inoran the"], VERBS, ["worthless"], ["nothing"], MOOD)


@register(
    "best_quotes",
    f"""WITH {POSTS}, r AS (SELECT source, s, lower(s) AS low FROM (SELECT source, unnest({SENTENCES}) AS s FROM posts) WHERE length(s) BETWEEN 50 AND 150), o AS (SELECT source, low, min(s) AS quote FROM r GROUP BY 1, 2), x AS (SELECT *, coalesce({MOOD_SQL.format('low')}, 0.0::DOUBLE) AS x FROM o),
c AS (SELECT source, low, quote, round(abs({_FEEL}) * 0.4::DOUBLE + {_N('low', KEYS)} / 3 * 0.4::DOUBLE + CASE WHEN {sql_any('low', ['!', 'erre'])} THEN 0.2::DOUBLE ELSE 0.0 END, 6) AS score FROM x)
SELECT source, quote, score, place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, length(quote) DESC, low) AS place FROM c) WHERE place <= 3""",
)
def best_quotes(spark, folder):
    return E.quotes(posts(spark, folder), "source", KEYS, MOOD, ["!", "erre"], 3)


@register("candidate_terms")
def candidate_terms(spark, folder):
    """No SQL: the second engine's expressions have no look-around, and runs of words overlap its matches; tested on a fixture."""
    rows = posts(spark, folder)
    known = table(spark, folder, "part").select(F.explode(F.split("p_name", " ")).alias("term"))
    return E.candidate_terms(rows.select("id", "text"), 3, known)


DICTIONARY = {"brand": ["thatin", "hehely"], "feature": ["orantion", "that"], "pain": ["inoran", "ononst"]}


@register(
    "dictionary_entities",
    f"""WITH {POSTS}, e AS (SELECT id, unnest(regexp_extract_all(lower(text), '\\b(?:{'|'.join(sorted((t for v in DICTIONARY.values() for t in v), key=lambda t: (-len(t), t)))})\\b')) AS entity FROM posts)
SELECT id, entity, count(*) AS n, CASE {' '.join(f"WHEN entity IN ({', '.join(map(quoted, v))}) THEN '{k}'" for k, v in DICTIONARY.items())} END AS category FROM e GROUP BY id, entity""",
)
def dictionary_entities(spark, folder):
    return E.entities(posts(spark, folder), DICTIONARY)


@register("entity_summary", """WITH e AS (SELECT source, unnest(regexp_extract_all(lower(text), '\\b(?:orantion|hehely|inoran|ononst|thatin|that)\\b')) AS entity FROM documents), c AS (SELECT source, entity, count(*) AS n FROM e GROUP BY 1, 2) SELECT source, entity, n, place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, entity) AS place FROM c) WHERE place <= 2""")
def entity_summary(spark, folder):
    rows = posts(spark, folder).select("id", "source", "text")
    found = E.entities(rows, DICTIONARY).join(rows.select("id", "source"), "id")
    return A.top_per_key(found.groupBy("source", "entity").agg(F.sum("n").alias("n")), ["source"], 2, F.desc("n"), F.asc("entity"))


@register("competitor_layers", "WITH n AS (SELECT p_name AS name, count(*) AS n FROM part GROUP BY 1), a(alias, layer) AS (VALUES ('red', 'L1'), ('dark red', 'L2'), ('green', 'L3'), ('blue', 'L2')) SELECT name, n, coalesce((SELECT min(layer) FROM a WHERE alias = lower(name)), (SELECT arg_min(layer, (-length(alias), alias)) FROM a WHERE contains(lower(name), alias)), 'other') AS layer FROM n")
def competitor_layers(spark, folder):
    names = table(spark, folder, "part").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("n"))
    aliases = spark.createDataFrame([("red", "L1"), ("dark red", "L2"), ("green", "L3"), ("blue", "L2")], "alias string, layer string")
    return E.layered(names, aliases)


@register("brands_in_text", "SELECT p_partkey, array_to_string(list_filter(['green', 'red', 'large', 'small', 'steel'], lambda b: contains(lower(p_name), b)), ',') AS brands FROM part")
def brands_in_text(spark, folder):
    found = S.hits(F.lower("p_name"), ["green", "red", "large", "small", "steel"])
    return table(spark, folder, "part").select("p_partkey", F.array_join(found, ",").alias("brands"))


LAYERS = {"L1": ["thatin", "hehely"], "L2": ["orantion"], "L3": ["inoran", "zzz"]}
_COUNT = lambda k: f"(length(t) - length(replace(t, {quoted(k)}, ''))) // {len(k)}"
_FLAT = [k for v in LAYERS.values() for k in v]


@register(
    "theme_scores",
    f"""WITH {POSTS}, r AS (SELECT source, len(regexp_extract_all(t, '[a-z0-9]+')) AS words, {', '.join(f"{' + '.join(map(_COUNT, v))} AS {k}" for k, v in LAYERS.items())}, {_COUNT('ononst')} AS other, {', '.join(f"contains(t, {quoted(k)}) AS h{i}" for i, k in enumerate(_FLAT))} FROM (SELECT source, lower(text) AS t FROM posts)),
g AS (SELECT source, sum(words) AS words, sum(other) AS other, {', '.join(f'sum({k}) AS {k}' for k in LAYERS)}, {' + '.join(f'max(CASE WHEN h{i} THEN 1 ELSE 0 END)' for i in range(len(_FLAT)))} AS found FROM r GROUP BY source), h AS (SELECT *, {' + '.join(LAYERS)} AS hits FROM g)
SELECT source, round(found / {len(_FLAT)}, 6) AS coverage, round(coalesce(hits * 100 / nullif(words, 0), 0), 6) AS density, round(coalesce(hits / nullif(hits + other, 0), 0), 6) AS purity, {', '.join(f'CAST({k} AS BIGINT) AS layer_{k}' for k in LAYERS)} FROM h""",
)
def theme_scores(spark, folder):
    return E.theme_scores(posts(spark, folder), "source", LAYERS, ["ononst"])
