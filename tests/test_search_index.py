"""Stems, the posting table and inverted lists against scans."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.stemming import STOP, stem
from tidemark.operators import postings as I
from tidemark.operators import vectors as V

#: Words and their stems as the rules' publication gives them.
STEMS = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist
knack knack knackeries knackeri knavish knavish kneaded knead knew knew knightly knight knots knot running run happily happili sky sky skies sky dying die
generate generat generously generous communities communiti caresses caress flies fli tied tie gas gas hopping hop hoping hope feed feed agreed agre relational relat
conditional condit rationalize ration electricity electr hopefulness hope adjustment adjust adoption adopt replacement replac probate probat rate rate controlling control
analogies analog by by say say cry cri early earli national nation succeed succeed bias bias this this us us knives knive yes yes youth youth boyish boyish""".split()


def test_stems():
    assert {w: stem(w) for w in STEMS[::2]} == dict(zip(STEMS[::2], STEMS[1::2]))
    assert [stem(w) for w in ("", "a", "42nd", "é")] == ["", "a", "42nd", "é"]


def texts(seed=3, n=300):
    rng = random.Random(seed)
    words = "run running runs the of market markets marketing slow slowly battery batteries drain drained a by price".split()
    out = [(i * 37, " ".join(rng.choice(words) + rng.choice(["", "", ",", "\n"]) for _ in range(rng.choice([0, 3, 10, 60])))) for i in range(n)]
    return [*out, (50_000, None), (50_001, "the of by"), (50_002, "Battery drains")]


def scan(rows, any_of, excluded, stemmed):
    lex = lambda k: [(stem(w) if stemmed else w, i) for i, w in enumerate(re.findall("[a-z0-9]+", k.lower())) if not (stemmed and w in STOP)]
    wanted = {t for g in any_of for k in g for t, _ in lex(k)}
    out = []
    for id_, text in rows:
        n = len(re.findall("[a-z0-9]+", (text or "").lower()))
        at = {}
        for t, i in lex(text or ""):
            at.setdefault(t, set()).add(i)
        has = lambda k: (not lex(k)) or any(all(p - lex(k)[0][1] + i in at.get(t, ()) for t, i in lex(k)) for p in at.get(lex(k)[0][0], ()))
        groups = [[k for k in g if lex(k)] for g in any_of]
        if any(g and all(map(has, g)) for g in groups) and not any(lex(k) and has(k) for k in excluded):
            out.append((id_, round(float(sum(len(at.get(t, ())) for t in wanted) / (1 + np.log(1 + n))), 6)))
    return sorted(out)


def assert_close(found, want):
    assert [i for i, _ in found] == [i for i, _ in want] and all(abs(a - b) < 2e-6 for (_, a), (_, b) in zip(found, want))


QUERIES = [
    ([["market"]], []), ([["running", "battery"], ["slow market"]], ["price"]), ([["battery of drain"]], []), ([["the"]], []),
    ([["the"], ["markets"]], ["the of"]), ([["zebra"]], []), ([["price", "slowly", "drains"]], ["run by"]),
]


@pytest.mark.parametrize("stemmed", [True, False])
def test_search_equals_a_scan(spark, stemmed, monkeypatch):
    monkeypatch.setattr(I, "RANGE", 512)
    monkeypatch.setattr(I, "FIRST_BLOCKS", 2)
    rows = texts()
    index = I.build(spark.createDataFrame(rows, "id long, text string").withColumns({c: F.lit(1) for c in ("term", "word", "place", "docs")}), stemmed)
    for any_of, excluded in QUERIES:
        want = scan(rows, any_of, excluded, stemmed)
        assert_close(sorted(map(tuple, I.search(index, any_of, excluded).collect())), want)
        best = sorted(want, key=lambda r: (-r[1], r[0]))[:7]
        assert_close([tuple(r) for r in I.top(index, any_of, 7, excluded).collect()], best)


def covers(places):
    """All runs with every term in them and none shorter inside."""
    entries = sorted((p, i) for i, ps in enumerate(places) for p in ps)
    full = lambda a, b: {i for p, i in entries if a <= p <= b} == set(range(len(places)))
    found = [(a, b) for a, _ in entries for b, _ in entries if a <= b and full(a, b)]
    least = [x for x in found if not any(y != x and x[0] <= y[0] and y[1] <= x[1] for y in found)]
    return sum(0.1 / (1 + b - a - (sum(a <= p <= b for p, _ in entries) - 1)) for a, b in set(least))


def test_cover_density(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(40):
        at = rng.sample(range(60), rng.randint(0, 14))
        rows.append([sorted(at[i::3]) for i in range(3)])
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, places array<array<int>>")
    found = dict(map(tuple, frame.select("id", I.cover_density(F.col("places"), 3)).collect()))
    assert found == pytest.approx({i: round(covers(r), 6) if all(r) else 0.0 for i, r in enumerate(rows)})
    index = I.build(spark.createDataFrame([(1, "run to the markets"), (2, "market, then a runner ran"), (3, "markets run markets")], "id long, text string"))
    assert dict(map(tuple, I.covered(index, ["markets", "running"]).collect())) == {1: round(0.1 / 3, 6), 3: 0.2}


def test_cover_density_of_many_hits_is_linear(spark):
    frame = spark.createDataFrame([([list(range(i, 20_001, 3)) for i in range(3)],)], "places array<array<int>>")
    found = frame.select(I.cover_density(F.col("places"), 3).alias("d"))
    found.collect()
    began = time.time()
    assert found.first().d == pytest.approx(0.1 * 19_999)
    assert time.time() - began < 5


def vectors(n, seed=2, width=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(12, width))[rng.integers(0, 12, n)] + rng.normal(size=(n, width)) * 0.5
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[5] = x[4]
    x[-1] = 0.0
    return x.astype(np.float32)


def test_nearest_equals_a_scan_and_probes_find_most(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 64)
    x = vectors(2000)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>").repartition(5)
    lists = V.inverted_lists(frame, 20)
    asked = frame.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("q"))
    score = np.round(x.astype(float)[::50] @ x.astype(float).T, 6)
    want = {(q * 50, i) for q in range(len(score)) for i in np.lexsort((np.arange(len(x)), -score[q]))[:10].tolist()}
    exact = V.nearest(lists, asked, 10, probes=2).collect()
    assert {(r.query_id, r.id) for r in exact} == want and all(abs(r.score - score[r.query_id // 50, r.id]) < 1e-9 for r in exact)
    some = {(r.query_id, r.id) for r in V.nearest(lists, asked, 10, probes=5, exact=False).collect()}
    assert len(some & want) >= 0.9 * len(want)


def test_links_within_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 32)
    x = vectors(400, 6)
    rows = [(i, ["a", "b", None][i % 3], v.tolist() if i % 17 else None) for i, v in enumerate(x)]
    found = V.links_within(spark.createDataFrame(rows, "id long, part string, vector array<float>"), "part", 0.8, lists=9)
    score = np.round(x.astype(float) @ x.astype(float).T, 6)
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if i % 3 == j % 3 and i % 17 and j % 17 and score[i, j] >= 0.8}
    assert {(min(r.a, r.b), max(r.a, r.b)) for r in found.collect()} == want and want
    assert V.links_within(spark.createDataFrame([], "id long, part string, vector array<float>"), "part", 0.8).isEmpty()
    assert V.inverted_lists(spark.createDataFrame([], "id long, vector array<float>")) is None
