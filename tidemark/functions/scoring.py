"""Scores and classes of texts and posts by rules: Columns in, Columns out, all of it inside the JVM.

Lexicons, weights and thresholds are parameters. A null text counts as an empty one unless a function says otherwise.
Substrings are found as they stand; whole words end at anything but ASCII letters, digits and the underscore.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The edge of a word, the same in every regular expression engine whatever letters it knows.
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def plain(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def points(condition: Column, n: float) -> Column:
    """``n`` where the condition holds, else 0; a null condition doesn't hold."""
    return F.when(condition, F.lit(n)).otherwise(F.lit(n * 0))


def total(parts: Sequence[Column]) -> Column:
    """The sum, from left to right; 0.0 of none."""
    return reduce(add, parts, F.lit(0.0))


def any_of(text: Column, terms: Sequence[str]) -> Column:
    """Does any term stand in the text, as any part of it? False without terms."""
    return reduce(lambda a, b: a | b, (text.contains(t) for t in terms), F.lit(False))


def hits(text: Column, terms: Sequence[str]) -> Column:
    """The terms that stand in the text, in the order given."""
    if not terms:
        return F.array().cast("array<string>")
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t))


def matches(text: Column, pattern: str) -> Column:
    """A search that ignores the case of ASCII letters; ``\\b`` is an ASCII edge."""
    return text.rlike("(?i)" + pattern.replace(r"\b", EDGE))


def whole_word(text: Column, terms: Sequence[str]) -> Column:
    """Any term as a whole word or phrase, with any white space between its words; terms without ASCII letters or digits anywhere."""
    word = lambda t: EDGE + r"\s+".join(map(re.escape, t.split())) + EDGE if re.search("[A-Za-z0-9]", t) else re.escape(t)
    return matches(text, "|".join(word(t) for t in terms)) if terms else F.lit(False)


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


@dataclass(frozen=True)
class Rules:
    """Rules of the opportunity score: terms and regular expressions with their weights, and terms that negate."""

    positive: Mapping[str, float] = field(default_factory=dict)
    negative: Mapping[str, float] = field(default_factory=dict)
    negations: Sequence[str] = ()
    boosts: Mapping[str, float] = field(default_factory=dict)
    penalties: Mapping[str, float] = field(default_factory=dict)


def template_sums(text: Column, rules: Rules) -> tuple[Column, Column]:
    """Sums of the boosts and of the penalties whose patterns match; weights below 0 count as 0."""
    of = lambda table: total([points(matches(text, p), max(0.0, float(w))) for p, w in table.items()])
    return of(rules.boosts), of(rules.penalties)


def opportunity(text: Column, rules: Rules) -> Column:
    """A struct: score, positive_hits, negative_hits, negated, boost, penalty.

    Each term counts once, however often it stands in the text; a negation caps the sum at 0; the score is from 0 to 1.
    """
    t = plain(text)
    boost, penalty = template_sums(t, rules)
    terms = [points(t.contains(k), float(w)) for k, w in [*rules.positive.items(), *rules.negative.items()]]
    raw = total(terms) + boost - penalty
    negated = any_of(t, rules.negations)
    score = clamp(F.when(negated, F.least(raw, F.lit(0.0))).otherwise(raw))
    return F.struct(
        score.alias("score"), hits(t, list(rules.positive)).alias("positive_hits"), hits(t, list(rules.negative)).alias("negative_hits"),
        negated.alias("negated"), boost.alias("boost"), penalty.alias("penalty"),
    )


def need_weighted(intent: Column, need: Column, sentiment: Column, dual_share: Column, bonus: float = 0.1) -> Column:
    """The score with needs: 0.25 intent + 0.5 need + 0.25 of the sentiment's modifier + the share of double labels x bonus.

    ``need``: the weighted share of needs over 2.5, at most 1. ``sentiment``: a mean; below -0.3 it adds 0.15, above
    0.2 it adds 0.05. Nulls count as 0.
    """
    zero = F.lit(0.0)
    mood = F.when(sentiment < -0.3, 0.15).when(sentiment > 0.2, 0.05).otherwise(0.0)
    return clamp(F.coalesce(intent, zero) * 0.25 + F.least(F.lit(1.0), F.coalesce(need, zero)) * 0.5 + mood * 0.25 + F.coalesce(dual_share, zero) * bonus)


def auto_score(title: Column, body: Column) -> Column:
    """A struct (score, tier, pool) of a post by fixed rules, the first that holds: advertisement 0, trade 6, decision 7,
    problem 6, price 5, else 3. Pools: core from 8, noise to 2, lab between."""
    title, body = F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))
    full = F.concat(title, F.lit(" "), body)
    # The patterns of the rules
    spam = (F.regexp_count(body, F.lit("http")) > 2) | matches(body, r"bit\.ly|amzn\.to|t\.co|goo\.gl|tinyurl\.com")
    spam = spam | matches(full, "promo code|discount code|affiliate link|buy now|check out my|click here")
    trade = matches(title, r"\[(WTS|WTT|WTB|S|B)\]") | matches(title, r"\b(selling|buying|trading)\b.*\b(price|usd|\$)\b")
    decision = matches(full, "recommend|suggestion|which one|which should I| vs |versus|worth it|review|looking for|advice on")
    problem = matches(full, "how to|issue with|failed|broke|not working|help with|problem with|error|bug")
    price = matches(title, r"\b(price|budget|cost|worth)\b") & matches(title, r"\$[0-9]+|[0-9]+(\s)?(usd|k)")
    score = F.when(spam, 0).when(trade, 6).when(decision, 7).when(problem, 6).when(price, 5).otherwise(3)
    tier = F.when(spam, F.lit(None)).when(trade, "normal").when(decision, "gold_decision").when(problem, "gold_problem").otherwise("normal")
    return F.struct(score.alias("score"), tier.alias("tier"), pool_of(score, 8, 2).alias("pool"))


def pool_of(score: Column, core: float, noise: float) -> Column:
    """core from ``core``, noise to ``noise``, lab between; a null score is lab."""
    return F.when(score >= core, "core").when(score <= noise, "noise").otherwise("lab")


def comment_basic_score(body: Column) -> Column:
    """0 to 5: 2, +1 over 150 characters, +2 with a solution's words, +1 with a question's; 0 of a null."""
    # The words of both rules
    solution = matches(body, r"\b(fixed|solution|solved|bought|ordered|recommend|works well|use this|try this)\b")
    question = matches(body, r"\?|\b(how|what|why|where|does anyone)\b")
    score = F.lit(2) + points(F.length(body) > 150, 1) + points(solution, 2) + points(question, 1)
    return F.when(body.isNull(), 0).otherwise(F.least(F.lit(5), score)).cast("int")


def engagement_bucket(score: Column, comments: Column) -> Column:
    """A struct (value, pool) by score and number of comments; nulls count as 0."""
    s, c = F.coalesce(score, F.lit(0)), F.coalesce(comments, F.lit(0))
    steps = (((s >= 50) | (c >= 50), 8.0, "core"), ((s >= 10) | (c >= 5), 6.0, "core"), ((s >= 3) | (c >= 1), 3.0, "lab"))
    value, pool = F.lit(1.0), F.lit("noise")
    for holds, v, p in reversed(steps):
        value, pool = F.when(holds, v).otherwise(value), F.when(holds, p).otherwise(pool)
    return F.struct(value.alias("value"), pool.alias("pool"))


@dataclass(frozen=True)
class AnalysisWeights:
    """Points of a labelled analysis: by its kind and its intent, per pain tag and at most."""

    kind: Mapping[str, float]
    intent: Mapping[str, float]
    pain: float
    most_pain: float
    opportunity: float


#: The points of posts and of comments.
POST_ANALYSIS = AnalysisWeights({"user_review": 3.0, "ask_question": 1.0, "news_sharing": 1.0, "rant": 2.0}, {"share_solution": 2.0, "complain": 2.0, "recommend_product": 1.0}, 1.5, 4.5, 0.25)
COMMENT_ANALYSIS = AnalysisWeights({"buyer_review": 2.0, "buyer_ask": 1.0, "seller_operator": -1.0, "expert_sharing": 2.0}, {"share_solution": 3.0, "complain": 2.0, "recommend_product": 1.0, "offtopic": -2.0}, 1.0, 3.0, 0.2)


def analysis_score(kind: Column, intent: Column, n_pains: Column, shipping: Column, tax: Column, purchase: Column, w: AnalysisWeights) -> Column:
    """A struct (value 0-10, opportunity 0-1, pool) of a labelled analysis. A null intent is off topic, other nulls 0 or false."""
    intent, pains, buys = F.coalesce(intent, F.lit("offtopic")), F.coalesce(n_pains, F.lit(0)), F.coalesce(purchase, F.lit(0.0))
    by = lambda c, table: total([points(c == k, v) for k, v in table.items()])
    base = F.lit(3.0) + by(kind, w.kind) + by(intent, w.intent) + F.least(pains * w.pain, F.lit(w.most_pain)) + points(shipping, 1.0) + points(tax, 1.0)
    value = clamp(F.when(buys > 0.7, base * 1.2).otherwise(base), 0.0, 10.0)
    chance = clamp(pains * w.opportunity + buys * 0.5 + points(intent == "complain", 0.2))
    return F.struct(F.round(value, 2).alias("value"), F.round(chance, 2).alias("opportunity"), pool_of(value, 8.0, 3.9).alias("pool"))


def classify(text: Column, aspects: Mapping[str, Sequence[str]], solution: Sequence[str], strong: Sequence[str], bot: str | None = None, trigger: tuple[str, Sequence[str], Sequence[str]] | None = None) -> Column:
    """A struct (category, aspect): solution, pain or other; the first aspect one of whose words the text has.

    ``trigger``: an aspect that comes before all others where a word of its first and of its second list stand in the
    text. A text that matches ``bot`` is other in both. A solution's word beats an aspect; an aspect or a strong word is pain.
    """
    t = plain(text)
    aspect = F.lit("other")
    for name, terms in reversed(list(aspects.items())):
        aspect = F.when(whole_word(t, terms), name).otherwise(aspect)
    if trigger:
        aspect = F.when(any_of(t, trigger[1]) & any_of(t, trigger[2]), trigger[0]).otherwise(aspect)
    category = F.when(any_of(t, solution), "solution").when((aspect != "other") | any_of(t, strong), "pain").otherwise("other")
    is_bot = matches(t, bot) if bot else F.lit(False)
    return F.struct(F.when(is_bot, "other").otherwise(category).alias("category"), F.when(is_bot, "other").otherwise(aspect).alias("aspect"))


def sentiment(text: Column, lexicon: Mapping[str, float]) -> Column:
    """From -1 to 1: the sum of its words' values, s, as s / sqrt(s * s + 15); 0 without such words.

    ``lexicon`` has lower-case words of ASCII letters.
    """
    words = F.regexp_extract_all(plain(text), F.lit("[a-z]+"), F.lit(0))
    table = F.create_map(*(F.lit(x) for pair in lexicon.items() for x in pair))
    s = F.aggregate(words, F.lit(0.0), lambda total_, w: total_ + F.coalesce(F.try_element_at(table, w), F.lit(0.0)))
    return F.round(s / F.sqrt(s * s + 15.0), 6)


def least_sentiment(text: Column, lexicon: Mapping[str, float]) -> Column:
    """Of the sentences of more than five characters the lowest sentiment; 0 of none."""
    parts = F.filter(F.split(F.btrim(F.coalesce(text, F.lit(""))), r"(?<=[.!?])\s+"), lambda s: F.length(s) > 5)
    return F.coalesce(F.array_min(F.transform(parts, lambda s: sentiment(s, lexicon))), F.lit(0.0))


#: The five needs in the order in which the first of equal ones is taken.
NEEDS = ("Survival", "Efficiency", "Belonging", "Aesthetic", "Growth")


def need_scores(text: Column, mood: Column, words: Mapping[str, Sequence[str]], phrases: Mapping[str, Sequence[str]], noise: Sequence[str]) -> Column:
    """A struct of the five needs: 2 for each phrase, 1 for each occurrence of a word, then gates.

    Survival needs a bad mood: none from -0.05 on, half from -0.2 on, else half as much again. A question adds three
    tenths to growth and a tenth to efficiency. A survival that isn't above growth or efficiency is halved unless the
    mood is -0.4 or worse. A noise word makes all 0.
    """
    t = plain(text)
    count = lambda name: total([points(t.contains(p), 2.0) for p in phrases.get(name, ())]) + total([F.regexp_count(t, F.lit(EDGE + re.escape(w) + EDGE)).cast("double") for w in words.get(name, ())])
    score = {name: count(name) for name in NEEDS}
    asks = t.contains("?")
    growth = F.when(asks, score["Growth"] * 1.3).otherwise(score["Growth"])
    efficiency = F.when(asks, score["Efficiency"] * 1.1).otherwise(score["Efficiency"])
    survival = F.when(mood >= -0.05, 0.0).when(mood >= -0.2, score["Survival"] * 0.5).otherwise(score["Survival"] * 1.5)
    survival = F.when((survival > 0) & (mood > -0.4) & ((growth >= survival) | (efficiency >= survival)), survival * 0.5).otherwise(survival)
    final = score | {"Growth": growth, "Efficiency": efficiency, "Survival": survival}
    none = whole_word(t, noise)
    return F.struct(*(F.when(none, 0.0).otherwise(F.round(final[name], 4)).alias(name) for name in NEEDS))


def primary_need(scores: Column) -> Column:
    """The need with the highest score, the first of equal ones; Unclassified where all are 0."""
    best = F.greatest(*(scores[n] for n in NEEDS))
    named = reduce(lambda rest, n: F.when(scores[n] == best, n).otherwise(rest), reversed(NEEDS), F.lit(None).cast("string"))
    return F.when(best == 0, "Unclassified").otherwise(named)


def secondary_need(scores: Column, least: float = 1.0) -> Column:
    """The next need after the primary one if its score is at least ``least``, else null."""
    first = primary_need(scores)
    rest = {n: F.when(first == n, -1.0).otherwise(scores[n]) for n in NEEDS}
    best = F.greatest(*rest.values())
    named = reduce(lambda other, n: F.when(rest[n] == best, n).otherwise(other), reversed(NEEDS), F.lit(None).cast("string"))
    return F.when((first != "Unclassified") & (best >= least), named)


def most_frequent_category(text: Column, categories: Mapping[str, Sequence[str]]) -> Column:
    """The category whose terms stand in the text most often, the first of equal ones; ``other`` without any."""
    t = plain(text)
    n = {name: total([F.regexp_count(t, F.lit(re.escape(w))) for w in terms]) for name, terms in categories.items() if name != "other"}
    best = F.greatest(*n.values(), F.lit(0.0))
    named = reduce(lambda rest, name: F.when(n[name] == best, name).otherwise(rest), reversed(list(n)), F.lit("other"))
    return F.when(best > 0, named).otherwise("other")


def signal_score(n_signals: Column, score: Column, comments: Column) -> Column:
    """10 a signal and a hundredth of score + 2 comments; nulls count as 0."""
    zero = F.lit(0)
    return F.coalesce(n_signals, zero) * 10 + (F.coalesce(score, zero) + F.coalesce(comments, zero) * 2) * 0.01


def first_level(text: Column, levels: Mapping[str, Sequence[str]], otherwise: str | None) -> Column:
    """The first level one of whose terms stands in the text."""
    t = plain(text)
    return reduce(lambda rest, name: F.when(any_of(t, levels[name]), name).otherwise(rest), reversed(list(levels)), F.lit(otherwise).cast("string"))


def analysis_confidence(hit_rate: Column, posts: Column, communities: Column, pains: Column, competitors: Column, opportunities: Column) -> Column:
    """From 0 to 1: shares of what would be enough, weighed .4, .15, .15, .1, .1, .1; nulls count as 0."""
    share = lambda c, enough, weight: F.least(F.coalesce(c, F.lit(0)) / enough, F.lit(1.0)) * weight
    parts = [share(hit_rate, 0.9, 0.4), share(posts, 100.0, 0.15), share(communities, 10.0, 0.15), share(pains, 10.0, 0.1), share(competitors, 5.0, 0.1), share(opportunities, 5.0, 0.1)]
    return F.round(clamp(total(parts)), 2)


def spam_class(title: Column, body: Column, author: Column, authors: Sequence[str], pattern: str, phrases: Sequence[str]) -> Column:
    """Spam_Bot, Spam_Crypto, Spam_Ad, Spam_LowQuality or null: blocked authors, a pattern, then phrases."""
    title, body = F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))
    full = F.concat(title, F.lit(" "), body)
    coin = matches(full, r"\b(btc|eth|crypto|token)\b")
    hit = matches(full, pattern)
    low = any_of(F.lower(full), phrases)
    return F.when(author.isin(list(authors)), "Spam_Bot").when(hit & coin, "Spam_Crypto").when(hit, "Spam_Ad").when(low, "Spam_LowQuality")


def noise_comment(body: Column, author: Column, least: int, phrases: Sequence[str], authors: Sequence[str] = ("automoderator", "mod", "moderator")) -> Column:
    """Too short without needless white space, with a moderator's phrase, or by a moderator."""
    flat = F.btrim(F.regexp_replace(F.coalesce(body, F.lit("")), r"\s+", " "))
    return (F.length(flat) < least) | (F.length(flat) == 0) | any_of(F.lower(flat), phrases) | F.lower(F.btrim(F.coalesce(author, F.lit("")))).isin(list(authors))


def recommendation_status(recent: Column, historical: Column, observations: Column, other_evidence: Column) -> Column:
    """READY with recent posts and any evidence, HISTORICAL with old posts or observations, else WATCHING."""
    evidence = observations + historical + other_evidence
    return F.when((recent > 0) & (evidence > 0), "READY").when((historical > 0) | (observations > 0), "HISTORICAL").otherwise("WATCHING")


def capped_sum(terms: Sequence[tuple[Column, float, float]]) -> Column:
    """The sum of value x weight, each at most its cap; negative and null values count as 0."""
    return total([F.least(F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)) * w, F.lit(cap)) for c, w, cap in terms])


def crawl_interval_hours(hit_rate: Column) -> Column:
    """4 above a rate of 0.9, 1 below 0.7, else 2; 2 of a null."""
    return F.when(hit_rate > 0.9, 4).when(hit_rate < 0.7, 1).otherwise(2)


def tier_by_valid_posts(average: Column, active: Column, blocked: Column, first: float, second: float) -> Column:
    """tier1 above ``first``, tier2 above ``second``, else tier3; no_data to 0 or null; blacklisted before; null if not active."""
    by = F.when(F.coalesce(average, F.lit(0)) <= 0, "no_data").when(average > first, "tier1").when(average > second, "tier2").otherwise("tier3")
    return F.when(active, F.when(blocked, "blacklisted").otherwise(by))


def trend_label(counts_growth: Column, count: Column, velocity: Column) -> Column:
    """EXPLODING, RISING, FALLING or STABLE by growth since the month before and the velocity of the last three."""
    return (
        F.when(counts_growth.isNull(), "STABLE")
        .when(((counts_growth > 0.5) & (count > 5)) | ((velocity > 1.3) & (count > 10)), "EXPLODING")
        .when((counts_growth > 0.2) | (velocity > 1.1), "RISING")
        .when((counts_growth < -0.2) | (velocity < 0.8), "FALLING")
        .otherwise("STABLE")
    )
