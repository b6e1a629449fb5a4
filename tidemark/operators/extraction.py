"""Signals taken from the sentences of posts: pain points, competitors, opportunities, solutions, quotes, terms, entities.

Posts have id, text, score and comments; nulls are empty or 0. Lexicons, patterns and weights are parameters. Sentences
are counted once each; those with equal keys, the first characters of their lower-case text, are one signal. All are
aggregates combined before their shuffle. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scoring as S
from tidemark.functions import text as X


def sentences(posts: DataFrame, least: int) -> DataFrame:
    """A row per sentence of at least ``least`` characters: id, score, comments, s, low, pos and the text's ``parts``."""
    parts = X.sentences(F.coalesce("text", F.lit("")))
    rows = posts.select("id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("comments", F.lit(0)).alias("comments"), parts.alias("parts"))
    each = rows.select("id", "score", "comments", "parts", F.posexplode("parts").alias("pos", "s")).filter(F.length("s") >= least)
    return each.withColumn("low", F.lower("s"))


def _count(text: Column, terms: Sequence[str]) -> Column:
    return S.total([S.points(text.contains(t), 1) for t in terms]).cast("int")


def _hit_flags(text: Column, terms: Sequence[str]) -> list[Column]:
    """Of the rows of a group: 1 for each term that any of them has."""
    return [F.max(text.contains(t).cast("int")) for t in terms]


def pain_points(posts: DataFrame, negative: Sequence[str], patterns: Sequence[str], keywords: Sequence[str], strong: Sequence[str] = (), unable: Sequence[str] = ()) -> DataFrame:
    """Per key of 100 characters: frequency, sentiment, keywords (their number), posts, relevance.

    A sentence of 15 characters or more with a negative term or pattern. Sentiment: -0.3, -0.15 more for each of up to
    five terms; strong words take it to -0.9 at least, words of inability to -0.8. Relevance: .5 frequency / 3, .3
    sentiment, .15 keywords / 3, .05 engagement / 80, each part at most 1.
    """
    rows = sentences(posts, 15)
    n = _count(F.col("low"), negative)
    matched = S.any_of(F.col("low"), negative)
    by_pattern = S.matches(F.col("s"), "|".join(patterns)) if patterns else F.lit(False)
    mood = F.when(matched, F.greatest(F.lit(-1.0), -0.3 - 0.15 * F.least(n, F.lit(5)))).otherwise(-0.3)
    mood = F.when(S.any_of(F.col("low"), strong), F.least(mood - 0.2, F.lit(-0.9))).otherwise(mood)
    mood = F.when(S.any_of(F.col("low"), unable), F.least(mood - 0.1, F.lit(-0.8))).otherwise(mood)
    found = rows.filter(matched | by_pattern).select("id", "low", F.substring("low", 1, 100).alias("key"), mood.alias("mood"), (F.col("score") + F.col("comments") * 0.5).alias("engagement"))
    flags = _hit_flags(F.col("low"), [k.lower() for k in keywords])
    sums = found.groupBy("key").agg(F.count("*").alias("frequency"), F.avg("mood").alias("sentiment"), F.countDistinct("id").alias("posts"), F.max("engagement").alias("most"), S.total(flags).cast("int").alias("keywords"))
    one = lambda c, by: F.least(F.col(c) / by, F.lit(1.0))
    relevance = one("frequency", 3.0) * 0.5 + F.abs("sentiment") * 0.3 + one("keywords", 3.0) * 0.15 + one("most", 80.0) * 0.05
    return sums.select("key", "frequency", F.round("sentiment", 6).alias("sentiment"), "keywords", "posts", F.round(relevance, 6).alias("relevance"))


def competitors(posts: DataFrame, product: str, cues: Sequence[str], negative: Sequence[str], positive: Sequence[str], stop: Sequence[str]) -> DataFrame:
    """Per product name (a match of ``product``): mentions, sentiment, contexts (5 at most), posts, relevance.

    A sentence of 15 characters or more counts with a cue or two different names. Sentiment: negative terms -0.2 and -0.15
    each to -0.8, else a positive word 0.4, else 0.1. Relevance: .6 mentions / 3, .25 sentiment, .15 contexts / 4.
    """
    rows = sentences(posts, 15)
    names = F.array_distinct(F.regexp_extract_all("s", F.lit(product), F.lit(0)))
    n = _count(F.col("low"), negative)
    mood = F.when(n > 0, F.greatest(F.lit(-0.8), -0.2 - 0.15 * n)).when(S.any_of(F.col("low"), positive), 0.4).otherwise(0.1)
    found = rows.select("id", "low", names.alias("names"), mood.alias("mood")).filter((F.size("names") > 0) & (S.any_of(F.col("low"), cues) | (F.size("names") >= 2)))
    each = found.select("id", "mood", F.explode("names").alias("name")).filter(~F.lower("name").isin(list(stop)) if stop else F.lit(True))
    sums = each.groupBy("name").agg(F.count("*").alias("mentions"), F.avg("mood").alias("sentiment"), F.countDistinct("id").alias("posts"))
    contexts = F.least(F.col("mentions"), F.lit(5))
    relevance = F.least(F.col("mentions") / 3.0, F.lit(1.0)) * 0.6 + F.abs("sentiment") * 0.25 + F.least(contexts / 4.0, F.lit(1.0)) * 0.15
    return sums.select("name", "mentions", F.round("sentiment", 6).alias("sentiment"), contexts.alias("contexts"), "posts", F.round(relevance, 6).alias("relevance"))


def opportunities(posts: DataFrame, cues: Sequence[str], urgent: Sequence[str], needed: Sequence[str], wished: Sequence[str], paying: Sequence[str], keywords: Sequence[str], rules: S.Rules) -> DataFrame:
    """Per key of 100 characters: demand, urgency, relevance, potential_users, posts.

    A sentence of 20 characters or more with a cue. Urgency is the mean of 1.5, 1 or .5 by the first list that it hits and
    .8 for paying, at most 1.5. Relevance: .35 demand / 3, .3 urgency, .2 mean score / 60, .15 keywords / 3, then the
    sentence's opportunity score and a fifth of that of it and its neighbours, from 0 to 1. Users: 100 + 50 a mention + 2
    x the mean score + 20 a keyword.
    """
    rows = sentences(posts, 20).filter(S.any_of(F.col("low"), cues))
    low = F.col("low")
    urgency = F.when(S.any_of(low, urgent), 1.5).when(S.any_of(low, needed), 1.0).when(S.any_of(low, wished), 0.5).otherwise(0.0) + S.points(S.any_of(low, paying), 0.8)
    around = S.opportunity(X.context(F.col("parts"), F.col("pos")), rules)["score"]
    found = rows.select("id", "low", "score", F.substring("low", 1, 100).alias("key"), urgency.alias("u"), around.alias("c"), S.opportunity(low, rules)["score"].alias("own"))
    sums = found.groupBy("key").agg(
        F.count("*").alias("demand"), F.sum("u").alias("u"), F.avg("score").alias("mean"), F.avg("c").alias("c"), F.min("own").alias("own"), F.countDistinct("id").alias("posts"), S.total(_hit_flags(low, [k.lower() for k in keywords])).cast("int").alias("keywords")
    )
    clamp = S.clamp
    urgency = F.least(F.col("u") / F.col("demand"), F.lit(1.5))
    base = F.least(F.col("demand") / 3.0, F.lit(1.0)) * 0.35 + F.least(urgency, F.lit(1.0)) * 0.3 + F.least(F.col("mean") / 60.0, F.lit(1.0)) * 0.2 + F.least(F.col("keywords") / 3.0, F.lit(1.0)) * 0.15
    relevance = clamp(clamp(base + F.col("own")) + F.col("c") * 0.2)
    users = F.floor(F.round(F.lit(100.0) + F.col("demand") * 50.0 + F.col("mean") * 2.0 + F.col("keywords") * 20.0, 6))
    return sums.select("key", "demand", F.round(urgency, 6).alias("urgency"), F.round(relevance, 6).alias("relevance"), users.cast("long").alias("potential_users"), "posts")


def solutions(posts: DataFrame, cues: Sequence[str], verbs: Mapping[str, float], against: Sequence[str], keywords: Sequence[str], mood: Mapping[str, float], floors: tuple[float, float, float] = (0.0, -0.15, -0.3), enough: int = 5) -> DataFrame:
    """Per key of 80 characters: the pass that found it, frequency, relevance. Each sentence is counted once.

    Passes go on while fewer than ``enough`` keys are found: with cue and keyword at the first floor of sentiment; with
    cue alone at it, only if none was found; with cue at the second; with a verb at the third. One scan finds the first
    pass of every sentence; one row says how far the passes go.
    """
    rows = sentences(posts, 10).filter(~S.any_of(F.col("low"), against))
    low = F.col("low")
    feeling = S.sentiment(low, mood)
    cue, key, verb, long_ = S.any_of(low, cues), S.any_of(low, [k.lower() for k in keywords]), S.any_of(low, list(verbs)), F.length("s") >= 15
    number = F.when(long_ & cue & key & (feeling >= floors[0]), 1).when(long_ & cue & (feeling >= floors[0]), 2).when(long_ & cue & (feeling >= floors[1]), 3).when(verb & (feeling >= floors[2]), 4)
    boosted = feeling + S.total([S.points(low.contains(v), b) for v, b in verbs.items()])
    found = rows.select(F.substring("low", 1, 80).alias("key"), number.alias("number"), boosted.alias("feeling")).filter("number is not null")
    sums = found.groupBy("key", "number").agg(F.count("*").alias("n"), F.sum("feeling").alias("f"))
    first = sums.groupBy("key").agg(F.min("number").alias("first"))
    upto = lambda k: F.count_if(F.col("first") <= k)
    counts = first.agg(upto(1).alias("c1"), upto(2).alias("c2"), upto(3).alias("c3"))
    after_two = F.when(F.col("c1") > 0, F.col("c1")).otherwise(F.col("c2"))
    last = counts.select(F.when(after_two >= enough, F.when(F.col("c1") > 0, 1).otherwise(2)).when(F.col("c3") >= enough, 3).otherwise(4).alias("last"))
    kept = sums.join(F.broadcast(last)).filter(F.col("number") <= F.col("last"))
    out = kept.groupBy("key").agg(F.min("number").alias("first_pass"), F.sum("n").alias("frequency"), F.sum("f").alias("f"))
    relevance = F.least(F.col("frequency") / 2.0, F.lit(1.0)) * 0.6 + F.col("f") / F.col("frequency") * 0.4
    return out.select("key", "first_pass", "frequency", F.round(relevance, 6).alias("relevance"))


def quotes(posts: DataFrame, group: str, keywords: Sequence[str], mood: Mapping[str, float], marks: Sequence[str], n: int) -> DataFrame:
    """The ``n`` best quotes of each group: sentences of 50 to 150 characters, equal ones (case aside) once.

    .4 of the sentiment's size, .4 of the share of keywords that it has, .2 for a mark of emotion; then the longer one.
    """
    parts = F.explode(X.sentences(F.coalesce("text", F.lit("")))).alias("quote")
    rows = posts.select(F.col(group), parts).filter(F.length("quote").between(50, 150))
    low = F.lower("quote")
    score = F.abs(S.sentiment(low, mood)) * 0.4 + _count(low, [k.lower() for k in keywords]) / max(1, len(keywords)) * 0.4 + S.points(S.any_of(low, marks), 0.2)
    once = rows.groupBy(group, low.alias("low")).agg(F.min("quote").alias("quote")).withColumn("score", F.round(score, 6))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), F.desc(F.length("quote")), "low"))
    return once.withColumn("place", place.cast("long")).filter(F.col("place") <= n).select(group, "quote", "score", "place")


def candidate_terms(posts: DataFrame, least: int, known: DataFrame, similarity: Column | None = None) -> DataFrame:
    """Capitalised runs of one to three words that stand ``least`` times or more and aren't ``known`` (term).

    frequency, posts and confidence = .4 + .35 x frequency / ``least`` (at most 1) + .25 x ``similarity``, to 1.
    """
    runs = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?<![A-Za-z0-9_])[A-Z][a-z]{2,}(?: [A-Z][a-z]{2,}){0,2}(?![A-Za-z0-9_])"), F.lit(0))
    sums = posts.select("id", F.explode(runs).alias("term")).groupBy("term").agg(F.count("*").alias("frequency"), F.countDistinct("id").alias("posts")).filter(F.col("frequency") >= least)
    fresh = sums.join(known.select(F.lower("term").alias("known_term")).distinct(), F.lower("term") == F.col("known_term"), "left_anti")
    confidence = F.lit(0.4) + F.least(F.lit(1.0), F.col("frequency") / (4.0 * least)) * 0.35 + (similarity if similarity is not None else F.lit(0.0)) * 0.25
    return fresh.withColumn("confidence", F.round(F.least(F.lit(1.0), confidence), 6))


def entities(posts: DataFrame, dictionary: Mapping[str, Sequence[str]]) -> DataFrame:
    """A row per post, category and entity of the dictionary that stands in the text as a whole word, with its occurrences.

    The dictionary is one alternation, longest first, so a text is gone through once and matches don't overlap.
    """
    import re

    pairs = {term.lower(): name for name, terms in dictionary.items() for term in terms}
    longest = sorted(pairs, key=lambda t: (-len(t), t))
    pattern = S.EDGE + "(?:" + "|".join(re.escape(t) for t in longest) + ")" + S.EDGE
    category = F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))
    found = posts.select("id", F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(pattern), F.lit(0))).alias("entity"))
    return found.groupBy("id", "entity").agg(F.count("*").alias("n")).withColumn("category", F.element_at(category, F.col("entity")))


def layered(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """``names`` (name, n) with the layer of ``aliases`` (alias, layer): that of the equal alias, else of the longest one in the name, else ``other``.

    Aliases are a dictionary, small against the names: each name is tested against them as one array.
    """
    table = aliases.agg(F.array_sort(F.collect_set(F.struct((-F.length("alias")).alias("k"), F.lower("alias").alias("alias"), "layer"))).alias("table"))
    low = F.lower("name")
    hit = lambda test: F.get(F.transform(F.filter("table", test), lambda x: x["layer"]), 0)
    exact, part = hit(lambda x: x["alias"] == low), hit(lambda x: F.contains(low, x["alias"]))
    return names.join(F.broadcast(table)).withColumn("layer", F.coalesce(exact, part, F.lit("other"))).drop("table")


def theme_scores(posts: DataFrame, group: str, terms: Mapping[str, Sequence[str]], others: Sequence[str]) -> DataFrame:
    """Per group: coverage (share of terms found), density (hits per 100 words), purity (hits against ``others``), and hits by layer."""
    t = S.plain(F.col("text"))
    flat = [k for v in terms.values() for k in v]
    n = lambda k: F.regexp_count(t, F.lit(k))
    layers = {name: S.total([n(k) for k in v]).cast("long") for name, v in terms.items()}
    rows = posts.select(group, F.size(X.tokens(t)).alias("words"), *(c.alias(f"layer_{name}") for name, c in layers.items()), S.total([n(k) for k in others]).cast("long").alias("other"), *(t.contains(k).alias(f"has_{i}") for i, k in enumerate(flat)))
    sums = rows.groupBy(group).agg(F.sum("words").alias("words"), F.sum("other").alias("other"), *(F.sum(f"layer_{name}").alias(f"layer_{name}") for name in terms), S.total([F.max(F.col(f"has_{i}").cast("int")) for i in range(len(flat))]).alias("found"))
    hits = S.total([F.col(f"layer_{name}") for name in terms])
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return sums.select(group, F.round(F.col("found") / len(flat), 6).alias("coverage"), zero(F.try_divide(hits * 100, F.col("words"))).alias("density"), zero(F.try_divide(hits, hits + F.col("other"))).alias("purity"), *(F.col(f"layer_{name}") for name in terms))
