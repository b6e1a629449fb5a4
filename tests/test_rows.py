"""Rollups and governance on small rows: nulls, ties, repeats and empty tables."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import governance as G
from tidemark.operators import rollups as W


def got(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_comments_and_authors_over_batches(spark):
    schema = "id long, author string, at long, body string, score long"
    comments, authors = spark.createDataFrame([], schema), spark.createDataFrame([], "author string, first_seen long, last_seen long")
    first = [(1, "a", 5, "old", 1), (1, "a", 6, "new", None), (2, None, 7, None, 3), (3, "b", 9, "x", 1)]
    comments, authors = W.comments_with_authors(comments, authors, spark.createDataFrame(first, schema))
    assert got(comments) == [(1, "a", 6, "new", None), (2, None, 7, None, 3), (3, "b", 9, "x", 1)] and got(authors) == [("a", 5, 6), ("b", 9, 9)]
    second = [(2, "c", 8, "late", None), (3, None, 2, None, 4), (4, "a", 1, "y", 0)]
    comments, authors = W.comments_with_authors(comments, authors, spark.createDataFrame(second, schema))
    assert got(comments) == [(1, "a", 6, "new", None), (2, "c", 8, "late", 3), (3, "b", 2, "x", 4), (4, "a", 1, "y", 0)]
    assert got(authors) == [("a", 1, 6), ("b", 9, 9), ("c", 8, 8)]


def test_labels_are_replaced_and_first_writers_stay(spark):
    old = spark.createDataFrame([(1, "pain", "x"), (2, "joy", None)], "id long, category string, by string")
    new = spark.createDataFrame([(1, None, "y"), (2, "pain", "z"), (3, "joy", "w")], "id long, category string, by string")
    assert got(W.labels_upserted(old, new, ["id"], ["category"], ["by"])) == [(1, None, "x"), (2, "pain", None), (3, "joy", "w")]
    assert got(W.labels_upserted(old, new.limit(0), ["id"], ["category"], ["by"])) == got(old)


def test_terms_with_places(spark):
    rows = spark.createDataFrame([(1, "The the THE  by\nthe way. theme"), (2, None), (3, "by the")], "id long, text string")
    assert got(W.term_places(rows, {"the": "phrase", "The": "exact", "by the": "phrase"})) == [(1, "The", 1, 0), (1, "by the", 1, 13), (1, "the", 4, 0), (3, "by the", 1, 0), (3, "the", 1, 3)]


def test_releases_brands_groups_and_moods(spark):
    counts = spark.createDataFrame([("r1", 1, "a", 5), ("r2", 2, "a", 9), ("r2", 2, "b", 1)], "release string, at long, layer string, n long")
    assert got(W.release_trend(counts, {"a": 6})) == [(1, "r1", "a", 5, None, False), (2, "r2", "a", 9, 4, True), (2, "r2", "b", 1, None, False)]
    rows = [("x", "p", i, f"a{i % 2}", i % 3) for i in range(4)] + [("x", "p", 3, "a1", 0), ("y", "p", 9, "a", None)]
    found = got(W.brand_pains(spark.createDataFrame(rows, "brand string, pain string, id long, author string, score long"), 2, 2, 2))
    assert found == [("x", "p", 4, 2, "2,1", "ok"), ("y", "p", 1, 1, "9", "too_few_mentions")]
    items = spark.createDataFrame([(1, "s", "p", "f"), (2, "s", "p", None), (2, "s", "p", None), (3, "s", None, "f"), (4, None, "p", "f")], "id long, a string, b string, c string")
    assert got(W.breakdown(items, "a", "b", "c", 2)) == [("pack", "s/p", 2), ("scope", "s", 3)]
    moods = spark.createDataFrame([("c", 0.5), ("c", -0.05), ("c", -0.06), ("c", None)], "c string, m double")
    assert got(W.mood_shares(moods, "c", F.col("m"))) == [("c", 4, 0.25, 0.25, 0.5)]
    gaps = spark.createDataFrame([(3, 1), (0, 0), (None, 2)], "d long, s long")
    assert [r[0] for r in gaps.select(W.gap_scores(gaps, "d", "s")).collect()] == [0.75, 0.0, 0.0]
    assert got(W.named_by_patterns(spark.createDataFrame([(1, "vs Acme or vs ACME"), (2, "vs Zed, vs acme"), (3, None)], "id long, text string"), [r"vs (\w+)"], 1)) == [("acme", 2)]


def test_relations_and_health(spark):
    spark.range(3).createOrReplaceTempView("tidemark_there")
    assert W.best_relation(spark, ["tidemark_not_there", "tidemark_there"]).count() == 3
    with pytest.raises(ValueError):
        W.best_relation(spark, ["tidemark_not_there"])
    rows = [("c", '{"k": 1, "m": "x"}'), ("c", '{"k": 5}'), ("c", "{oops"), ("c", None), ("d", "[]"), ("d", "{}")]
    health = W.health(spark.createDataFrame(rows, "contract string, body string"), "k bigint, m string", ["k", "m"], "k")
    assert got(health)[0] == ("c", 4, 2, 1, 1, 5) and got(health)[1][:2] == ("d", 2)
    assert got(G.alerts(health.filter("contract = 'c'"), [("broken", 0.4, "high"), ("incomplete", 0.25, "low")])) == [("c", "broken", 0.5, "high")]


def test_aspects_candidates_matches_and_fit(spark):
    rows = [("a", i, f"word{i % 2} and a longer text of some words", i % 3) for i in range(6)] + [("b", 9, "short", 1), (None, 10, "a text of no aspect that is long enough", None)]
    found = {r.aspect: (r.n, r.samples, r.keywords) for r in G.aspect_clusters(spark.createDataFrame(rows, "aspect string, id long, text string, score long"), 2, 3).collect()}
    assert found["a"] == (2, "2,5", "and,longer,some") and "b" not in found
    rows = [("t", 0.9, "c1", "u"), ("t", None, "c2", "u"), ("u", 0.1, "c1", "v"), (None, None, None, None)]
    assert got(G.candidate_stats(spark.createDataFrame(rows, "term string, confidence double, community string, author string"), 2, 0.5, 2)) == [("t", 2, 0.9, 2, 1, True), ("u", 1, 0.1, 1, 1, False), (None, 1, None, 0, 0, False)]
    names = spark.createDataFrame([(1, "Red kettle"), (2, "kettle"), (3, None), (4, "zz")], "id long, text string")
    entries = spark.createDataFrame([(7, "kettle red"), (8, "kettle"), (9, "red")], "id long, text string")
    assert got(G.best_matches(names, entries, 0.5)) == [(1, 7, 1.0), (2, 8, 1.0)]
    texts = spark.createDataFrame([("x", "brew coffee coffee"), ("y", "tea time"), ("x", None), ("z", "coffee tea")], "c string, text string")
    assert [r.c for r in G.fit_to_description(texts, "c", "coffee brewing coffee", 5).collect()] == ["x", "z"]
    assert G.fit_to_description(texts, "c", "", 5).isEmpty() and G.fit_to_description(texts.limit(0), "c", "coffee", 5).isEmpty()
    rows = [("k", "b", 1), ("k", "a", 2), ("k", "b", 3), ("k", "a", 3), ("l", None, None)]
    assert got(G.primary_of(spark.createDataFrame(rows, "k string, c string, t long"), "k", "c", "t")) == [("k", "a", 2), ("l", None, 1)]
    rows = [("s", 1, "x"), ("s", 2, "x"), ("s", 3, "y"), ("t", 1, None)]
    assert got(G.coherence(spark.createDataFrame(rows, "suggestion string, id long, anchor string"), 2)) == [("s", 3, 1, 0.666667), ("t", 1, 0, 0.0)]
