"""Whole-word search, rank and hybrid retrieval by a scan: words match as they are, case aside. ``postings`` has stems and an index.

A query is terms joined by OR; a term of several words is a phrase. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scoring as S
from tidemark.functions import text as X


def matching(rows: DataFrame, text: Column, terms: Sequence[str], excluded: Sequence[str] = ()) -> DataFrame:
    """Rows with any term and none of the excluded ones, as whole words or phrases; none without terms."""
    found = rows.filter(S.whole_word(S.plain(text), terms))
    return found.filter(~S.whole_word(S.plain(text), excluded)) if excluded else found


def text_rank(text: Column, terms: Sequence[str]) -> Column:
    """Occurrences of the terms as whole words over 1 + ln(1 + number of words)."""
    t = S.plain(text)
    hits = S.total([F.regexp_count(t, F.lit(S.EDGE + r"\s+".join(k.lower().split()) + S.EDGE)) for k in terms])
    return F.round(hits / (F.log(1.0 + F.size(X.tokens(t))) + 1.0), 6)


def cover_density(text: Column, a: str, b: str) -> Column:
    """Of two words: the sum over places of ``a`` of 1 / distance to the nearest ``b``, in words; 0 without both.

    Work is the product of their numbers of places; ``postings.cover_density`` is linear and of any number of words.
    """
    words = X.tokens(F.coalesce(text, F.lit("")))
    places = lambda w: F.filter(F.transform(words, lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull())
    near = lambda i: F.array_min(F.transform(places(b), lambda j: F.abs(i - j)))
    return F.round(F.aggregate(places(a), F.lit(0.0), lambda s, i: s + F.coalesce(1.0 / near(i), F.lit(0.0))), 6)


def within_distance(vectors: DataFrame, key: str, vector: str, query: DataFrame, distance: float) -> DataFrame:
    """Rows with a cosine distance of less than ``distance`` to the one vector of ``query`` (q), unit vectors both."""
    similarity = F.round(X.cosine(F.col(vector), F.col("q")), 6)
    return vectors.join(F.broadcast(query.select("q"))).select(key, similarity.alias("similarity")).filter(1 - F.col("similarity") < distance)


def hybrid(texts: DataFrame, vectors: DataFrame, key: str, weight: float, limit: int) -> DataFrame:
    """The best ``limit`` rows of ``texts`` (key, text_rank) and ``vectors`` (key, similarity) by their blend."""
    from tidemark.operators.relational import blended

    scored = blended(texts, vectors, key, "text_rank", "similarity", weight)
    return scored.select(key, F.round("score", 6).alias("score")).orderBy(F.desc("score"), key).limit(limit)


def two_strata(rows: DataFrame, done: DataFrame, key: str, high: Column, limit: int, tail_share: float, order: Column) -> DataFrame:
    """Rows not yet ``done``: the first of the high stratum and, ``tail_share`` of ``limit`` of them, of the rest."""
    tail = int(limit * tail_share)
    open_ = rows.join(done.select(key).distinct(), key, "left_anti").withColumn("is_high", F.coalesce(high, F.lit(False)))
    place = F.row_number().over(Window.partitionBy("is_high").orderBy(order, F.asc(key)))
    return open_.withColumn("place", place).filter(F.col("place") <= F.when(F.col("is_high"), limit - tail).otherwise(tail)).filter(F.col("place") <= max(tail, limit - tail))
