"""Clusters of pain points against a plain version of the rules."""

import math
import random
import re
from collections import Counter

import pytest

from tidemark.operators import pain as P

STOP = ["the", "is", "for", "and", "a", "of", "team", "process", "workflow"]
SCHEMA = "report string, id long, description string, document string, frequency long, sentiment double, community string"


def plain(items, least, most, limit):
    """Of one report: the clusters, as lists of ids."""
    items = sorted(r for r in items if (r[2] or "").strip())
    n = len(items)
    if not n:
        return []
    low, high = max(1, min(least, n)), max(max(1, min(least, n)), min(most, n))
    grams = []
    for r in items:
        w = [x for x in re.findall(r"\w{2,}", (r[3] or r[2]).lower()) if x not in STOP]
        grams.append(Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]))
    total = sum(grams, Counter())
    vocabulary = sorted(total, key=lambda t: (-total[t], t))[:limit]
    df = {t: sum(t in g for g in grams) for t in vocabulary}
    vectors = []
    for g in grams:
        v = {t: g[t] * (math.log((n + 1) / (df[t] + 1)) + 1) for t in vocabulary if t in g}
        size = math.sqrt(sum(x * x for x in v.values())) or 1
        vectors.append({t: x / size for t, x in v.items()})
    keys = [{w for w in re.findall("[a-z]{4,}", r[2].lower()) if len(w) >= 5 and w not in STOP} for r in items]

    def split(alike):
        parent = list(range(n))
        find = lambda i: i if parent[i] == i else find(parent[i])
        for i in range(n):
            for j in range(i + 1, n):
                if alike(i, j):
                    a, b = sorted((find(i), find(j)))
                    parent[b] = a
        out = {}
        for i in range(n):
            out.setdefault(find(i), []).append(i)
        return [out[k] for k in sorted(out)]

    cosine = lambda i, j: round(sum(x * vectors[j].get(t, 0) for t, x in vectors[i].items()), 6)
    options = [(t, split(lambda i, j: keys[i] & keys[j] or cosine(i, j) >= t)) for t in P.THRESHOLDS] if vocabulary else []
    fits = sorted((len(c), t, k) for k, (t, c) in enumerate(options) if low <= len(c) <= high)
    found = options[fits[0][2]][1] if fits else split(lambda i, j: keys[i] & keys[j])
    if len(found) > most:
        found = sorted(found, key=len, reverse=True)
        head = found[:most]
        for c in found[most:]:
            min(head, key=len).extend(c)
        found = [sorted(c) for c in head]
    if len(found) < least:
        found = sorted(found, key=len, reverse=True)
        while len(found) < min(least, n) and max(map(len, found)) > 1:
            at = max(range(len(found)), key=lambda k: len(found[k]))
            c = found[at]
            found[at] = c[: len(c) // 2]
            found.append(c[len(c) // 2 :])
    return sorted(sorted(items[i][1] for i in c) for c in found)


def rows(seed):
    rng = random.Random(seed)
    words = "battery drains checkout crash shipping delay refund slow price noise login error ok app box".split()
    out = []
    for report, n in (("a", 12), ("b", 1), ("c", 25), ("d", 4), (None, 6)):
        for _ in range(n):
            text = " ".join(rng.choices(words, k=rng.choice([2, 4, 6])))
            out.append((report, len(out), text, f"{text} {rng.choice(words)} the app", rng.randint(0, 3), -0.1 * rng.randint(0, 9), rng.choice(["r/x", "r/y", " ", None])))
    out += [("e", 900 + i, "aa bb", "aa bb", 1, 0.0, "r/z") for i in range(7)]  # copies without keywords
    out += [("f", 950 + i, t, None, 0, None, None) for i, t in enumerate([None, "  ", "the", "of a"])]
    return out


@pytest.mark.parametrize("seed,least,most,limit", [(1, 2, 5, 80), (2, 3, 4, 10), (3, 5, 6, 80), (4, 1, 2, 3)])
def test_clusters_equal_a_plain_version(spark, seed, least, most, limit):
    data = rows(seed)
    found, _ = P.clustered(spark.createDataFrame(data, SCHEMA).repartition(3), STOP, least, most, limit)
    got = {}
    for r in found.collect():
        got.setdefault(r.report, {}).setdefault(r.cluster, []).append(r.id)
    for report in ("a", "b", "c", "d", "e", "f", None):
        want = plain([r for r in data if r[0] == report], least, most, limit)
        assert sorted(sorted(c) for c in got.get(report or "", {}).values()) == want, report


def test_summaries_and_fallback(spark):
    data = [
        ("x", 1, "Onboarding workflow is painfully slow for sellers", None, 20, -0.6, "r/test"), ("x", 2, "New seller onboarding is slow and confusing", None, 25, -0.6, "r/crossbordertrade"),
        ("x", 3, "Logistics fees are skyrocketing after the policy", None, 20, -0.4, "r/logistics"), ("x", 4, "Paid ads feel wasteful without attribution", None, 20, -0.35, "r/marketing"),
        ("y", 5, "Returns process is confusing for orders", None, 7, -0.55, "r/tips"),
    ]
    found = P.pain_clusters(spark.createDataFrame(data, SCHEMA), STOP, 3, 5).collect()
    first = next(r for r in found if r.first_id == 1)
    assert (first.items, first.total_frequency, first.negative_mean, first.communities, first.place) == (2, 45, -0.6, 2, 1) and first.topic in ("slow", "onboarding")
    assert sorted((r.report, r.items) for r in found) == [("x", 1), ("x", 1), ("x", 2), ("y", 1)]
    both = P.with_fallback(spark.createDataFrame(found).filter("report = 'y'"), spark.createDataFrame(found)).collect()
    assert sorted((r.report, r.source) for r in both) == [("x", "tfidf_fallback")] * 3 + [("y", "db_labels")]
    assert P.pain_clusters(spark.createDataFrame([], SCHEMA), STOP).isEmpty()
