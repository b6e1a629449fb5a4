"""Filters of posts and comments that look at more than one row: with a floor, by evidence, with counters.

Terms, patterns and limits are parameters. Null texts match nothing. Empty tables give empty ones. Columns of the rows
stay as they are; helper columns are kept apart from them in a struct, so no name of theirs is taken.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scoring as S
from tidemark.functions import text as X


def nested(rows: DataFrame, **more: Column) -> DataFrame:
    """``row``, a struct of all columns, and ``more`` beside it."""
    return rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), *(c.alias(name) for name, c in more.items()))


def with_floor(rows: DataFrame, keep: Column, floor: float = 0.2) -> DataFrame:
    """Rows for which ``keep`` holds; all rows if these are fewer than ``floor`` of all, or none at all.

    The two counts are one row of one pass, broadcast to the second.
    """
    marked = nested(rows, kept=F.coalesce(keep, F.lit(False)))
    sums = marked.agg(F.count("*").alias("n"), F.count_if("kept").alias("k"))
    enough = sums.select((F.col("k") >= F.greatest(F.lit(1), F.floor(F.col("n") * floor))).alias("enough"))
    return marked.join(F.broadcast(enough)).filter(F.col("kept") | ~F.col("enough")).select("row.*")


def by_keywords(rows: DataFrame, text: Column, keywords: Sequence[str], floor: float = 0.2) -> DataFrame:
    """Rows with any keyword, with the floor; all rows without keywords."""
    return with_floor(rows, S.any_of(S.plain(text), [k.lower() for k in keywords]), floor) if keywords else rows


def without_blocked(rows: DataFrame, text: Column, blocked: Sequence[str], floor: float = 0.2) -> DataFrame:
    """Rows without any blocked term, with the floor; all rows if nothing is blocked."""
    return with_floor(rows, ~S.any_of(S.plain(text), [k.lower() for k in blocked]), floor) if blocked else rows


def without_blacklisted(rows: DataFrame, text: Column, author: Column, authors: DataFrame, pattern: str, phrases: Sequence[str], floor: float = 0.2) -> DataFrame:
    """Rows not by one of ``authors`` (author), without the pattern and the phrases, with the floor.

    Authors are joined as a table, so the list may be long; a null author is never blocked.
    """
    key = authors.select(F.col("author").alias("blocked_author")).distinct()
    marked = nested(rows, author=author, text=F.coalesce(text, F.lit("")))
    joined = marked.join(key, F.col("author") == F.col("blocked_author"), "left")
    keep = F.col("blocked_author").isNull() & ~S.matches(F.col("text"), pattern) & ~S.any_of(F.lower("text"), phrases)
    return with_floor(joined.select("row", keep.alias("kept")), F.col("kept"), floor).select("row.*")


def with_context(rows: DataFrame, text: Column, terms: Sequence[str]) -> DataFrame:
    """Rows with a context term; all rows without terms. No floor: a narrow topic may leave nothing."""
    return rows.filter(S.any_of(S.plain(text), [t.lower() for t in terms])) if terms else rows


def with_entities(rows: DataFrame, community: Column, text: Column, entities: Sequence[str]) -> DataFrame:
    """Rows with an entity in their text or, if it is one word of three letters or more, in their community's name."""
    names = [e.lower() for e in entities if " " not in e and len(e) >= 3]
    return rows.filter(S.any_of(X.name_key(F.coalesce(community, F.lit(""))), names) | S.any_of(S.plain(text), [e.lower() for e in entities])) if entities else rows


def evidence_scores(title: Column, text: Column, community: Column, phrases: Mapping[str, float], tokens: Mapping[str, float], preferred: Sequence[str] = ()) -> Column:
    """A struct: score, phrase_hits, token_hits, terms, preferred.

    A phrase counts 2.2 times its weight in the title, else 1.8 times in the text; a token its weight as a whole word;
    a preferred community 0.75.
    """
    t, b = S.plain(title), S.plain(text)
    words = F.array_distinct(X.tokens(text))
    phrase = [F.when(t.contains(p), w * 2.2).when(b.contains(p), w * 1.8).otherwise(0.0) for p, w in phrases.items()]
    token = [F.when(F.array_contains(words, k), w).otherwise(0.0) for k, w in tokens.items()]
    liked = F.lower(F.coalesce(community, F.lit(""))).isin([p.lower() for p in preferred]) if preferred else F.lit(False)
    count = lambda parts: S.total([F.when(p > 0, 1).otherwise(0) for p in parts]).cast("int")
    both = [F.when((a > 0) | (F.array_contains(words, k) if k in tokens else F.lit(False)), 1).otherwise(0) for k, a in zip(phrases, phrase)]
    others = [F.when(c > 0, 1).otherwise(0) for k, c in zip(tokens, token) if k not in phrases]
    return F.struct(
        (S.total(phrase) + S.total(token) + S.points(liked, 0.75)).alias("score"), count(phrase).alias("phrase_hits"), count(token).alias("token_hits"),
        S.total([*both, *others]).cast("int").alias("terms"), liked.alias("preferred"),
    )


def select_evidence(rows: DataFrame, found: Column, least_score: float, least_terms: int) -> DataFrame:
    """Rows with ``found`` (of ``evidence_scores``) good enough, with that struct as ``evidence``; all rows if none is.

    Good enough: the score, the number of terms, and a phrase, two tokens, or one in a preferred community.
    """
    e = F.col("evidence")
    hit = (e["phrase_hits"] >= 1) | (e["token_hits"] >= 2) | (e["preferred"] & (e["token_hits"] >= 1))
    scored = rows.drop("evidence").withColumn("evidence", found)
    return with_floor(scored, (e["score"] >= least_score) & (e["terms"] >= least_terms) & hit, 0.0)


def prefilter_comments(rows: DataFrame, pools: Sequence[str], least: int, since: Column) -> DataFrame:
    """Adds ``fate`` to comments (id, body, pool, ts): pool, age, short, repeated or admitted, the first that holds.

    A body that an admitted comment with a smaller id has, but for case and white space, is repeated. A null pool is
    unscored; a null time is never too old.
    """
    squashed = F.lower(F.btrim(F.regexp_replace(F.coalesce(F.col("body"), F.lit("")), r"\s+", " ")))
    early = F.when(~F.lower(F.coalesce(F.col("pool"), F.lit("unscored"))).isin(list(pools)), "pool").when(F.col("ts") < since, "age").when(F.length(squashed) < least, "short")
    marked = nested(rows, early=early, hash=F.md5(squashed))
    # rows out already are spread by their id, so one empty text isn't one task
    place = F.row_number().over(Window.partitionBy("hash", F.when(F.col("early").isNotNull(), F.col("row.id"))).orderBy("row.id"))
    fate = F.coalesce(F.col("early"), F.when(place > 1, "repeated"), F.lit("admitted"))
    return marked.withColumn("fate", fate).select("row.*", "fate")


def relevance_with_profile(counts: DataFrame, allowed: Sequence[str], patterns: Sequence[str], boost: int = 10_000) -> DataFrame:
    """``counts`` (community, n) by a profile: allowed communities count at least ``boost`` and are added where missing.

    With a list of allowed ones others need a pattern in their name; without, all stay.
    """
    key = X.name_key(F.coalesce(F.col("community"), F.lit("")))
    rows = counts.select(key.alias("community"), F.coalesce("n", F.lit(0)).alias("n")).filter("community <> ''")
    if not allowed:
        return rows
    spark = counts.sparkSession
    names = spark.createDataFrame([(a.lower().removeprefix("r/"), True) for a in dict.fromkeys(allowed)], "allowed_name string, is_allowed boolean")
    joined = rows.join(F.broadcast(names), F.col("community") == F.col("allowed_name"), "full")
    joined = joined.filter(F.col("is_allowed") | S.any_of(F.col("community"), [p.lower() for p in patterns]))
    n = F.when(F.col("is_allowed"), F.greatest(F.coalesce("n", F.lit(0)), F.lit(boost))).otherwise(F.col("n"))
    return joined.select(F.coalesce("community", "allowed_name").alias("community"), n.cast("long").alias("n"))
