"""Operators on small rows: nulls, ties, empty tables, clashing names; and those without SQL by brute force."""

import math
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scoring as S
from tidemark.functions import text as X
from tidemark.operators import analytics as A
from tidemark.operators import community as C
from tidemark.operators import dedupe as D
from tidemark.operators import evaluation as V
from tidemark.operators import extraction as E
from tidemark.operators import feeds as G
from tidemark.operators import filters as O
from tidemark.operators import graph as N
from tidemark.operators import lifecycle as L
from tidemark.operators import relational as R
from tidemark.operators import search as Q
from tidemark.operators import selection as P
from tidemark.operators import similarity as M
from tidemark.streaming import events as T

#: Names that operators give to columns of their own.
CLASHING = ("place", "turn", "row", "key", "n", "first", "was", "side", "bucket", "sum", "rest", "kept", "_new", "left", "score_")


@pytest.fixture(scope="module")
def ready(spark):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(T.scratch(spark, "checkpoints"))
    return spark


def clash(rows, *skip):
    return rows.withColumns({c: F.lit("own") for c in CLASHING if c not in rows.columns and c not in skip})


def got(frame, *columns):
    return sorted(map(tuple, frame.select(*columns).collect()), key=repr)


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def test_names_of_the_rows_stay(spark):
    rows = clash(spark.createDataFrame([(1, "a", 3.0), (1, "b", 3.0), (None, "c", None)], "k int, id string, v double"))
    best = A.latest_per_key(rows, ["k"], F.desc("v"), F.asc("id"))
    assert got(best, "k", "id", "place", "row") == [(1, "a", "own", "own"), (None, "c", "own", "own")]
    assert got(A.interleaved_in_buckets(rows, "k", F.floor("v"), F.desc("v"), F.asc("id")), "id", "turn", "place") == [("a", 1, "own"), ("b", 2, "own"), ("c", 1, "own")]
    old, new = rows.select("k", "id", "_new"), rows.limit(0).select("k", "id", "_new")
    assert A.upserted(old.filter("k is null"), new, ["k"]).columns == ["k", "id", "_new"]
    quotas = P.largest_remainder(clash(spark.createDataFrame([("a", 0), ("b", 0)], "name string, m long")), "name", "m", 10)
    assert got(quotas, "name", "quota", "rest") == [("a", 0, "own"), ("b", 0, "own")]
    streaks = P.streaks(clash(spark.createDataFrame([(1, "x", 1), (1, "x", 2), (1, None, 3), (1, None, 4)], "u int, v string, t int")), "u", "v", "t")
    assert got(streaks, "streak", "v", "n") == [(1, "x", 2), (2, None, 2)]
    events = clash(spark.createDataFrame([(1, 5)], "u int, t int"), "value")
    snaps = spark.createDataFrame([(1, 2, 10)], "u int, t int, value int")
    assert got(A.as_of(events, snaps, "u", "t", "value"), "value", "side") == [(10, "own")]
    assert got(A.scd2(clash(spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "u int, t int, v string").withColumn("t", F.timestamp_seconds("t"))), ["u"], "t", "v"), "v", "is_current") == [("a", False), ("b", True)]


def test_upsert_with_nulls(spark):
    old = spark.createDataFrame([(None, 1, 2), (2, 3, 4)], "k int, a int, b int")
    new = spark.createDataFrame([(None, None, 9), (3, 1, 1)], "k int, a int, b int")
    assert got(A.upserted(old, new, ["k"]), "k", "a", "b") == [(2, 3, 4), (3, 1, 1), (None, 1, 9)]
    assert (None, None, 9) in got(A.upserted(old, new, ["k"], False), "k", "a", "b")
    assert A.upserted(old.limit(0), new.limit(0), ["k"]).count() == 0


def test_floor_filters(spark):
    rows = clash(spark.createDataFrame([(i, "x" if i < 3 else "y") for i in range(10)] + [(10, None)], "id int, text string"))
    assert O.by_keywords(rows, F.col("text"), ["X"]).count() == 3 and O.by_keywords(rows, F.col("text"), ["zz"]).count() == 11
    assert O.by_keywords(rows.filter("id > 1"), F.col("text"), ["x"]).count() == 1  # one of nine is the floor, rounded down
    assert O.without_blocked(rows, F.col("text"), ["y"]).count() == 4 and O.by_keywords(rows, F.col("text"), []).count() == 11
    assert O.by_keywords(rows.limit(0), F.col("text"), ["x"]).count() == 0
    assert set(O.by_keywords(rows, F.col("text"), ["x"]).columns) == set(rows.columns)
    authors = spark.createDataFrame([("bot",), (None,)], "author string")
    said = spark.createDataFrame([(1, "bot", "a"), (2, None, "buy now"), (3, "me", None)], "id int, who string, text string")
    assert got(O.without_blacklisted(said, F.col("text"), F.col("who"), authors, "buy now", ["zz"]), "id") == [(3,)]


def test_prefilter_and_profile(spark):
    rows = spark.createDataFrame([(1, "Same  body here", "core", 5), (2, "same body HERE ", None, 5), (3, "same body here", "core", None), (4, "x", "core", 5), (5, "long enough body", "core", 1), (6, None, "core", 5)], "id int, body string, pool string, ts int")
    found = dict(got(O.prefilter_comments(clash(rows), ["core"], 5, F.lit(3)), "id", "fate"))
    assert found == {1: "admitted", 2: "pool", 3: "repeated", 4: "short", 5: "age", 6: "short"}
    counts = spark.createDataFrame([("r/A", 3), ("bb", 4), ("", 9), (None, 1)], "community string, n int")
    assert got(O.relevance_with_profile(counts, ["R/a", "new"], ["b"], 10), "community", "n") == [("a", 10), ("bb", 4), ("new", 10)]
    assert O.relevance_with_profile(counts, [], []).count() == 2


def test_text_helpers(spark):
    assert one(spark, "a b  c", lambda c: X.bigrams(X.tokens(c))) == ["a_b", "b_c"] and one(spark, "a", lambda c: X.bigrams(X.tokens(c))) == []
    assert one(spark, "AB  cde", X.char_shingles) == ["ab cd", "b cde"] and one(spark, "abc", X.char_shingles) == []
    assert one(spark, "x" * 201, X.ellipsis) == "x" * 197 + "..." and one(spark, None, X.ellipsis) == ""
    assert one(spark, "!!", X.sentence_hash) == "" and one(spark, None, X.sentence_hash) is None
    assert one(spark, " R/Ab ", X.slug) == "r/ab" and one(spark, None, X.slug) is None
    assert X.search_query(["a b", "c", 'a "b', ""]) == '"a b" OR c' and X.focus_phrases("Coffee grinder and scale, for home; a") == ["coffee grinder", "scale", "home"]
    assert X.time_slices(0, 86_400 * 2, 1, 100) == [(0, 86_400), (86_300, 172_700), (172_600, 172_800)] and X.time_slices(5, 5) == []
    with pytest.raises(ValueError):
        X.time_slices(0, 10, 1, 86_400)


def test_scores_on_edges(spark):
    rules = S.Rules({"want": 0.7, "need": 0.6}, {"meh": -0.2}, ["don't"], {r"\bbuy\b": 0.1}, {"spam": 0.5})
    score = lambda t: one(spark, t, lambda c: S.opportunity(c, rules)["score"])
    assert score("I WANT and need it, want it") == 1.0 and score("want, meh") == pytest.approx(0.5) and score("don't want") == 0.0 and score(None) == 0.0
    assert score("want to buy") == pytest.approx(0.8) and score("want spam") == pytest.approx(0.2)
    assert one(spark, None, S.comment_basic_score) == 0 and one(spark, "how? solved " + "x" * 150, S.comment_basic_score) == 5
    auto = lambda t, b: spark.createDataFrame([(t, b)], "t string, b string").select(S.auto_score(F.col("t"), F.col("b")).alias("a")).first().a.asDict()
    assert auto("x", "http http http") == {"score": 0, "tier": None, "pool": "noise"} and auto("[WTS] y", "")["score"] == 6
    assert auto("any", "which one?")["tier"] == "gold_decision" and auto("", "a bug")["tier"] == "gold_problem" and auto(None, None)["score"] == 3
    assert auto("price $20", "")["score"] == 5
    needs = lambda t, m: spark.createDataFrame([(t, m)], "t string, m double").select(S.need_scores(F.col("t"), F.col("m"), {"Survival": ["hurt"], "Growth": ["learn"]}, {}, ["shift"]).alias("n")).select("n", S.primary_need(F.col("n")).alias("p"), S.secondary_need(F.col("n")).alias("s")).first()
    assert needs("hurt hurt learn", 0.0)[1:] == ("Growth", None) and needs("hurt hurt", -0.5).n.Survival == 3.0 and needs("hurt, night shift", -0.5).p == "Unclassified"
    assert needs("hurt hurt hurt learn?", -0.9)[1:] == ("Survival", "Growth") and needs(None, None).p == "Unclassified"
    kind = lambda t: tuple(one(spark, t, lambda c: S.classify(c, {"price": ["too dear"], "ship": ["late"]}, ["fixed it"], ["hate"], "i am a bot", ("ship", ["parcel"], ["lost"]))))
    assert kind("It is too  dear and late") == ("pain", "price") and kind("parcel lost, too dear") == ("pain", "ship") and kind("late; fixed it") == ("solution", "ship")
    assert kind("I am a bot, late") == ("other", "other") and kind(None) == ("other", "other") and kind("hate") == ("pain", "other") and kind("translated") == ("other", "other")
    assert one(spark, None, lambda c: S.most_frequent_category(c, {"a": ["x"]})) == "other" and one(spark, "y x", lambda c: S.most_frequent_category(c, {"a": ["x"], "b": ["y"]})) == "a"
    assert one(spark, "Bad. Good good!", lambda c: S.least_sentiment(c, {"bad": -2.0, "good": 2.0})) > 0  # "Bad." has four characters
    assert one(spark, "It is bad. Good good!", lambda c: S.least_sentiment(c, {"bad": -2.0, "good": 2.0})) < 0


def test_communities(spark):
    posts = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 9)], "community string, post int")
    mentions = spark.createDataFrame([(0, "X"), (0, "X"), (1, "X"), (2, "X"), (9, None)], "post int, brand string")
    matrix = C.saturation_matrix(posts, mentions)
    assert got(matrix, "community", "brand", "saturation", "class") == [("a", "X", 0.6, "middle"), ("b", "X", 0.0, "open")]
    assert got(C.overall_saturation(matrix), "community", "overall") == [("a", 0.6), ("b", 0.0)]
    assert got(C.opportunity_windows(matrix, 0.5, 3), "brand", "community", "place") == [("X", "b", 1)]
    assert C.saturation_matrix(posts.limit(0), mentions.limit(0)).count() == 0
    days = spark.createDataFrame([("a", "2024-01-31"), ("a", "2024-01-31"), ("a", "2024-01-29"), ("a", None)], "c string, t string").withColumn("t", F.to_date("t"))
    assert C.daily_trend(days, "c", "t", F.lit("2024-01-31").cast("date"), 3).first().trend == [1.0, 0.0, 2.0]
    growth = C.growth_by_window(days, "c", "t", F.lit("2024-02-05").cast("date"), 7).first()
    assert (growth.recent, growth.previous, growth.growth) == (2, 1, 2.0)
    assert one(spark, "a a a a b", C.is_spam_title) and not one(spark, "a b c d", C.is_spam_title) and one(spark, None, C.is_spam_title)
    assert spark.range(1).select(C.has_surge(F.array(*map(F.lit, (1.0, 1.0, 4.0)))), C.has_surge(F.array().cast("array<double>"))).first()[:] == (True, False)
    ranked = spark.createDataFrame([(i, i % 2 == 0, 10 - i) for i in range(10)], "id int, generic boolean, s int")
    assert [r.id for r in C.with_generic_cap(ranked, F.col("generic"), 4, 0.25, F.desc("s")).collect()] == [0, 1, 3, 5]


def test_lifecycle(spark):
    stored = spark.createDataFrame([(1, "a", 1, 10, 10, True), (2, "b", 1, 10, 10, True), (None, "z", 3, 10, 10, True), (5, "old", 1, 1, 1, False)], "k int, v string, version int, valid_from int, fetched int, is_current boolean")
    batch = spark.createDataFrame([(1, "a", 20), (2, "c", 20), (2, "x", 15), (None, None, 20), (7, "n", 20)], "k int, v string, t int")
    found = got(L.versioned_upsert(stored, clash(batch), ["k"], "t", ["v"]), "k", "v", "version", "fetched", "is_current")
    assert found == sorted([(1, "a", 1, 20, True), (2, "b", 1, 10, False), (2, "c", 2, 20, True), (None, "z", 3, 10, False), (None, None, 4, 20, True), (7, "n", 1, 20, True), (5, "old", 1, 1, False)], key=repr)
    assert L.versioned_upsert(stored.limit(0), batch.limit(0), ["k"], "t", ["v"]).count() == 0
    hot = spark.createDataFrame([(1, 5, "new"), (1, 5, "tie"), (2, 1, "late")], "k int, t int, v string")
    assert got(L.last_write_wins(spark.createDataFrame([(1, 5, "old"), (2, 3, "kept")], "k int, t int, v string"), hot, ["k"], "t"), "k", "v") == [(1, "tie"), (2, "kept")]
    assert got(L.insert_if_absent(hot.filter("k = 1"), hot, "k"), "k") == [(2,)]
    rows = spark.createDataFrame([("", "x", "t"), ("s", "[deleted]", "t"), ("s", "", "tiny"), ("s", "fine enough body", "title")], "source string, body string, title string")
    reasons = [(F.col("source") == "", "unmapped"), (F.col("body") == "[deleted]", "ghost"), (F.length("body") < 5, "short")]
    assert [r.reject_reason for r in L.quarantined(rows, reasons).collect()] == ["unmapped", "ghost", "short", None]
    line = spark.createDataFrame([("a", 5)], "k string, t int")
    assert got(L.moved_waterline(line, spark.createDataFrame([("a", 3), ("b", 1)], "k string, t int"), "k", "t"), "k", "t") == [("a", 5), ("b", 1)]
    assert got(L.moved_floor(line, spark.createDataFrame([("a", 3)], "k string, t int"), "k", "t"), "k", "t") == [("a", 3)]
    scores = spark.createDataFrame([(1, "main", 1), (1, "llm", 9), (2, "llm", 3)], "c int, rule string, t int")
    assert got(L.latest_scores(scores, "c", "rule", "t", "main", spark.createDataFrame([(1,)], "c int")), "c", "t", "pool") == [(1, 1, "noise")]
    assert got(L.latest_scores(scores, "c", "rule", "t", "none", scores.limit(0).select("c")), "c", "t") == [(1, 9), (2, 3)]


def test_relational(spark):
    values = [3.0, 1.0, 1.0, 8.0, 2.0, None]
    rows = spark.createDataFrame([("a", v) for v in values] + [("b", 7.0)], "k string, v double")
    found = {r.k: r for r in R.percentiles_by_rank(rows, "k", "v", {"p": 0.5, "q": 0.95}, {"near": 0.9}).collect()}
    some = [v for v in values if v is not None]
    assert (found["a"].p, found["a"].q, found["a"].near) == (np.percentile(some, 50), pytest.approx(np.percentile(some, 95)), 3.0) and found["b"].q == 7.0
    groups = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "b"), (3, "c"), (4, "b"), (4, "a")], "g int, item string")
    assert got(R.without_subsets(groups, "g", "item"), "g", "types") == [(1, "a,b"), (3, "b,c")]
    a, b = spark.createDataFrame([("X", 5)], "name string, m int"), spark.createDataFrame([("x", 9), ("y", 4), ("z", 4)], "name string, m int")
    assert got(R.filled_up(a, b, "name", 2, F.desc("m")), "name", "p") == [("X", 0), ("y", 1)] and R.filled_up(a, b.limit(0), "name", 5, F.desc("m")).count() == 1
    merged = R.merged_by_priority([spark.createDataFrame([(1, "p"), (None, "p")], "id int, o string"), spark.createDataFrame([(1, "e"), (2, "e"), (None, "e")], "id int, o string")], "id")
    assert got(merged, "id", "o") == [(1, "p"), (2, "e"), (None, "p")]
    texts, vectors = spark.createDataFrame([(1, 0.5), (2, 0.0)], "id int, t double"), spark.createDataFrame([(1, 0.9), (3, 0.2), (2, 0.4)], "id int, s double")
    assert got(R.blended(texts, vectors, "id", "t", "s", 0.7).withColumn("score", F.round("score", 4)), "id", "score") == [(1, 0.78), (2, 0.4), (3, 0.2)]


def test_feeds(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], float(i), i, i) for i in range(8)] + [(7, "b", 1.0, 0, 0)], "id int, community string, score double, comments int, ts int")
    scored = G.probe_posts(rows, F.lit(2), 4.0, 7, F.col("id") == 6)
    assert got(scored, "id", "evidence") == [(4, 12), (5, 15), (7, 21)]
    assert [r.id for r in G.probe_search(scored, 1, 5).collect()] == [7, 4] and [r.id for r in G.probe_hot(scored, 1, 1, 5).collect()] == [7]
    assert got(G.percent_split(spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 5)], "k string, m int"), "k", "m"), "k", "percent") == [("a", 13), ("b", 13), ("c", 13), ("d", 61)]
    assert got(G.percent_split(spark.createDataFrame([("a", 0)], "k string, m int"), "k", "m"), "percent") == [(0,)]
    daily = spark.createDataFrame([("a", 1, True), ("a", 2, None), ("a", 3, True), ("a", 4, True), ("b", 1, False)], "k string, t int, good boolean")
    assert got(G.streak_to_now(daily, "k", "t", F.col("good")), "k", "streak") == [("a", 2), ("b", 0)]
    assert [one(spark, n, lambda c: G.retry_delay(c, 5, 30, 50), "int") for n in (None, 0, 5, 6, 99)] == [0, 0, 0, 30, 50]


def test_evaluation(spark):
    assert V.bucket_targets(10, {"a": 1, "b": 20, "c": 3}, {"a": 0.5, "b": 0.3, "c": 0.2}) == {"a": 1, "b": 7, "c": 2}
    assert V.batch_plan(23, 5, 10) == [5, 10, 8] and V.batch_plan(0, 5, 10) == []
    for total in (0, 3, 20, 64, 65, 1000):
        t, n, r = V.shallow_limits(total)
        assert t >= 1 and r <= t and (not total or t + n + r <= max(total, 1)), (total, t, n, r)
    counts = spark.createDataFrame([("a", 10, 1), ("b", 2, 5), ("c", 9, 0)], "k string, m int, w int")
    for total in (0, 2, 6, 11, 15, 21, 40):
        quotas = dict(got(V.capped_quotas(counts, "k", "m", "w", total, 2), "k", "quota"))
        assert sum(quotas.values()) == min(total, 21) and all(q <= n for q, n in zip((quotas["a"], quotas["b"], quotas["c"]), (10, 2, 9))), (total, quotas)
    rows = spark.createDataFrame([(i, "ab"[i % 7 == 0], i) for i in range(70)], "id int, c string, s int")
    found = V.stratified_sample(rows, "id", F.when(F.col("s") < 35, "low").otherwise("high"), "c", 10, {"low": 0.5, "high": 0.5}).collect()
    assert len(found) == 10 and {r.c for r in found} == {"a", "b"}


def test_search_and_extraction(spark):
    rows = spark.createDataFrame([(1, "The big  deal, dealt."), (2, "bigger deals"), (3, None)], "id int, text string")
    assert got(Q.matching(rows, F.col("text"), ["big deal"]), "id") == [(1,)] and Q.matching(rows, F.col("text"), []).count() == 0 and Q.matching(rows, F.col("text"), ["deals", "deal"], ["the"]).count() == 1
    assert one(spark, "a x b", lambda c: Q.cover_density(c, "a", "b")) == 0.5 and one(spark, None, lambda c: Q.cover_density(c, "a", "b")) == 0.0
    posts = spark.createDataFrame([(1, "I hate the slow sync today. I hate the slow sync today! Nice.", 80.0, 0), (2, "Notion vs Asana is a hard choice. Only Trello here now.", None, None), (3, None, 1.0, 1)], "id int, text string, score double, comments int")
    pains = E.pain_points(posts, ["hate", "slow"], [], ["sync"], ["hate"]).collect()
    assert [(p.frequency, p.posts, p.keywords) for p in pains] == [(2, 1, 1)] and pains[0].sentiment == pytest.approx(-0.9)
    assert got(E.competitors(posts, r"\b[A-Z][a-z]{3,}\b", ["vs"], ["hate"], [], ["only"]), "name", "mentions") == [("Asana", 1), ("Notion", 1), ("Trello", 1)]
    assert E.pain_points(posts.limit(0), ["hate"], [], []).count() == 0
    text = "Blue Ridge beats Blue Ridge. We saw Blue Ridge and Acme there. Acme was fine, so was Acme."
    terms = E.candidate_terms(spark.createDataFrame([(1, text), (2, None)], "id int, text string"), 3, spark.createDataFrame([("acme",)], "term string"))
    assert got(terms, "term", "frequency", "posts", "confidence") == [("Blue Ridge", 3, 1, 0.4875)]
    found = E.entities(spark.createDataFrame([(1, "Iced coffee, coffee and tea; coffees")], "id int, text string"), {"drink": ["coffee", "iced coffee"], "leaf": ["tea"]})
    assert got(found, "entity", "n", "category") == [("coffee", 1, "drink"), ("iced coffee", 1, "drink"), ("tea", 1, "leaf")]
    wide = E.solutions(posts, ["zz"], {"hate": 0.1}, [], ["sync"], {"hate": -0.1})
    assert got(wide, "first_pass", "frequency") == [(4, 2)]


def plain_tokens(text):
    import re

    low = text.lower()
    words, flat = re.findall("[a-z0-9]{2,}", low), re.sub(r"\s+", " ", low)
    return set(words) | {f"{a}_{b}" for a, b in zip(words, words[1:])} | {flat[i : i + 5] for i in range(len(flat) - 4)}


def test_near_duplicates_by_brute_force(ready):
    import re

    base = ["The new grinder makes far too much noise in the early morning hours", "Shipping took three weeks and the box was crushed at one corner", "Which scale should I buy for espresso under fifty euros", "x", "", None]
    rows, k = [], 0
    for text in base:
        for edit in (lambda t: t, lambda t: t and t.replace("the", "this", 1), lambda t: t and t + " please"):
            rows.append((k, edit(text), float(k % 4), k % 3))
            k += 1
    want, ids = {}, [r[0] for r in rows]
    group = {i: i for i in ids}
    flat = {i: " ".join(re.findall("[a-z]+", (t or "").lower())) for i, t, *_ in rows}
    sets = {i: plain_tokens(t or "") for i, t, *_ in rows}
    for a in ids:
        for b in ids:
            if a < b and sets[a] | sets[b]:
                jaccard = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
                if jaccard >= 0.85 or jaccard >= 0.6 and SequenceMatcher(None, flat[a], flat[b]).ratio() >= 0.85:
                    x, y = group[a], group[b]
                    group = {i: min(x, y) if g in (x, y) else g for i, g in group.items()}
    empties = [i for i in ids if not sets[i]]
    for i in empties:
        group[i] = group[i]
    engagement = {i: s + 0.75 * c for i, _, s, c in rows}
    members = defaultdict(list)
    for i, g in group.items():
        members[g].append(i)
    for some in members.values():
        best = max(some, key=lambda i: (engagement[i], -i))
        want[best] = (len(some), sorted(set(some) - {best}))
    found = {r.id: (r.evidence_count, list(r.duplicate_ids)) for r in D.deduplicated(ready.createDataFrame(rows, "id long, text string, score double, comments int"), 0.85).collect()}
    with_text = {i for i in ids if sets[i]}
    assert {k: v for k, v in found.items() if k in with_text} == {k: v for k, v in want.items() if k in with_text}
    assert D.deduplicated(ready.createDataFrame([], "id long, text string, score double, comments int")).count() == 0


def test_components_of_chains(ready):
    links = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 100), (300, 300)]
    nodes = ready.createDataFrame([(i,) for i in [*range(61), 100, 200, 300, 400]], "id long")
    found = dict(got(D.components(nodes, ready.createDataFrame(links, "a long, b long")), "id", "root"))
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 300, 400: 400}


def test_greedy_dedupe_by_a_plain_loop(ready):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, "ab"[i % 2], x[i].astype(float).tolist() if i % 11 else None, float(i * 7 % 5)) for i in range(60)]
    want, kept = {}, defaultdict(list)
    for i, b, v, _ in sorted(rows, key=lambda r: (-r[3], r[0])):
        alike = next((j for j, w in kept[b] if v is not None and round(float(np.dot(v, w)), 6) >= 0.4), None)
        want[i] = i if alike is None else alike
        if alike is None and v is not None:
            kept[b].append((i, v))
    found = D.greedy_by_vector(ready.createDataFrame(rows, "id long, b string, vector array<double>, engagement double"), "b", 0.4)
    assert dict(got(found, "id", "kept_by")) == want


def test_tfidf_clusters(ready):
    rows = [(1, "battery drains overnight while idle"), (2, "the battery drains overnight"), (3, "checkout page crashes often"), (4, "page crashes at checkout"), (5, None), (6, "")]
    found = dict(got(D.tfidf_clusters(ready.createDataFrame(rows, "id long, text string"), 0.3), "id", "root"))
    assert found == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6}


def plain_groups(ids, alike):
    group = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if a < b and alike(a, b) and group[a] != group[b]:
                x, y = sorted((group[a], group[b]))
                group = {i: x if g == y else g for i, g in group.items()}
    return group


def test_tfidf_clusters_lose_no_link(ready):
    """A heavy word's first text isn't alike to the others, which are equal."""
    rows = [(0, "aaaa zzzz yyyy"), (1, "bbbb wwww vvvv"), (2, "cccc tttt ssss"), (10, "aaaa bbbb cccc"), (11, "aaaa bbbb cccc")]
    found = dict(got(D.tfidf_clusters(ready.createDataFrame(rows, "id long, text string"), 0.3), "id", "root"))
    assert found[10] == found[11]


@pytest.mark.parametrize("seed", range(3))
def test_cosine_and_jaccard_joins_by_brute_force(ready, seed):
    """Hub words that all texts have, groups of edited copies, repeated texts, empty ones; blocks of five."""
    rng = np.random.default_rng(seed)
    words = [f"word{i}" for i in range(40)]
    base = [[words[j] for j in rng.zipf(1.4, 12) % 40] for _ in range(40)]
    base += [[*base[0][:-1], words[i % 40]] for i in range(25)] + [base[1]] * 6 + [["common"], ["common"], []]
    texts = {i: ["hubb", *t] if t else t for i, t in enumerate(base)}
    frame = ready.createDataFrame([(i, t) for i, t in texts.items()], "id long, words array<string>").repartition(4)

    n = len(texts)
    df = Counter(w for t in texts.values() for w in set(t))
    vectors = {}
    for i, t in texts.items():
        v = {w: k * (math.log((n + 1) / (df[w] + 1)) + 1) for w, k in Counter(t).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors[i] = {w: x / norm for w, x in v.items()}
    cosine = lambda a, b: round(sum(x * vectors[b].get(w, 0.0) for w, x in vectors[a].items()), 6)
    links = M.cosine_links(M.tfidf(frame, F.col("words")), 0.6, block=5)
    found = dict(got(N.components(frame.select("id"), links), "id", "root"))
    assert found == plain_groups(texts, lambda a, b: cosine(a, b) >= 0.6)
    assert all(abs(r.cosine - cosine(r.a, r.b)) < 2e-6 for r in links.collect())

    sets = frame.select("id", F.transform(F.array_distinct("words"), lambda t: F.xxhash64(t)).alias("tokens"))
    jaccard = lambda a, b: len(set(texts[a]) & set(texts[b])) / max(1, len(set(texts[a]) | set(texts[b])))
    links, rest = M.linked_sets(sets, 0.7, 0.4, block=5)
    group = plain_groups(texts, lambda a, b: jaccard(a, b) >= 0.7)
    assert dict(got(N.components(frame.select("id"), links), "id", "root")) == group
    seen = {(r.a, r.b) for r in rest.collect()}
    same = lambda a: min(i for i, t in texts.items() if set(t) == set(texts[a]))
    assert {(a, b) for a in texts for b in texts if a < b and same(a) == a and same(b) == b and 0.4 <= jaccard(a, b) < 0.7 and group[a] != group[b]} <= seen
    assert all(0.4 <= jaccard(a, b) < 0.7 for a, b in seen)


def test_stream_goes_on_from_its_checkpoint(spark):
    batch = lambda *ids: spark.createDataFrame([(i, 1) for i in ids], "event_id int, user_id int").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000)))
    found = T.run_batches([batch(1, 2), batch(2, 3), batch(3, 3, 4)], lambda s: T.once(s, "event_id", "1 day"), "append")
    assert got(found, "event_id") == [(1,), (2,), (3,), (4,)]
