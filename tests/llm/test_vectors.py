"""Clustering and hard negatives against plain versions."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import clustering, negatives

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, x int, score int"


def rows_of(seed=5, n=160, width=64):
    """Vectors of a few directions, copies, ties, and rows that take no part."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    out = []
    for i in range(n):
        v = centres[i % 6] + rng.normal(size=width) * 0.4
        out.append((i, (v / np.linalg.norm(v)).tolist(), i % 5, "c", 1, 1))
    out += [(n + i, out[3][1], 3, "c", 1, 1) for i in range(12)]  # a group of copies
    out += [out[7], out[7]]  # repeated rows
    odd = [None, [], [1.0] * (width - 1), [1.0] * (width + 1), [0.0] * (width - 1) + [None], [0.0] * (width - 1) + [math.nan], [math.inf] + [0.0] * (width - 1)]
    out += [(9000 + i, v, 1, "c", 1, 1) for i, v in enumerate(odd)]
    out += [(None, out[4][1], 2, "c", 1, 1), (9100, [0.0] * width, 1, "c", 1, 1), (9150, [1e300] + [0.0] * (width - 1), 1, "c", 1, 1)]
    return out


def plain_clusters(rows, k=8, rounds=10, width=64):
    def fits(v):
        return v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)

    whole = lambda x: math.floor(max(min(x * 1024, 2.0**27), -(2.0**27)))
    kept = [(r[0], [whole(x) for x in r[1]]) for r in rows if fits(r[1])]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(x) for _, x in order[:k]]
    apart = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    best = lambda x: min((apart(x, c), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        of = {}
        for _, x in kept:
            of.setdefault(best(x)[1], []).append(x)
        for i, members in of.items():
            centroids[i] = [sum(c) // len(members) for c in zip(*members)]
    found = [(vec_id, *best(x)) for vec_id, x in kept]
    sums = [sum(d for _, d, c in found if c == i) for i in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted([(v is not None, v or 0, c, d, sums[c], sum(sums), digest[c]) for v, d, c in found])


def test_clusters_equal_a_plain_version(spark):
    rows = rows_of()
    found = clustering.clusters(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert sorted((r.vec_id is not None, r.vec_id or 0, *r[1:]) for r in found) == plain_clusters(rows)


def test_clusters_of_few_and_no_vectors(spark):
    few = rows_of(n=5)[:3]
    found = clustering.clusters(spark.createDataFrame(few, SCHEMA)).collect()
    assert sorted((True, *r) for r in found) == plain_clusters(few) and {r.distance for r in found} == {0}
    none = clustering.clusters(spark.createDataFrame([], SCHEMA))
    assert none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and none.isEmpty()
    assert clustering.clusters(spark.createDataFrame([(1, None, 1, "", 1, 1)], SCHEMA)).isEmpty()


@pytest.mark.parametrize("seed", range(6))
def test_annuli_find_the_first_of_the_nearest(seed):
    """Norms far apart, many equal distances and equal centroids, large components."""
    rng = np.random.default_rng(seed)
    spread = 10 ** rng.integers(0, 7, size=(60, 1))
    centroids = rng.integers(-3, 4, size=(60, 4)) * spread
    rows = np.concatenate([rng.integers(-3, 4, size=(400, 4)) * 10 ** rng.integers(0, 7, size=(400, 1)), centroids])
    number, distance = clustering.Annuli(centroids.tolist()).nearest(rows.astype(np.int64))
    every = ((rows[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (distance == every.min(axis=1)).all() and (number == every.argmin(axis=1)).all()


def plain_negatives(rows, every=50, positives=5, negatives=3, least=50, most=95, scale=256):
    whole = lambda x: math.floor(max(min(x * scale, 2.0**27), -(2.0**27)))
    kept = [(i, *r[:1], r[2], [whole(x) for x in r[1]]) for i, r in enumerate(rows) if r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    place = lambda id_: (id_ is None, id_ or 0)
    out = []
    for uid, anchor, label, q in kept:
        if anchor is None or anchor % every:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(q, x)), place(id_), id_, other == label) for u, id_, other, x in kept if u != uid), key=lambda s: s[:2])
        for p in [s for s in scored if s[3]][:positives]:
            fits = [s for s in scored if not s[3] and -least * p[0] <= -100 * s[0] <= -most * p[0]]
            out += [(anchor, p[2], k, s[2], -p[0], -s[0]) for k, s in enumerate(fits[:negatives], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("partitions", [None, 40])
def test_hard_negatives_equal_a_plain_version(spark, partitions, monkeypatch):
    """Blocks and packs of a few rows, so that searches take several rounds over many cells."""
    monkeypatch.setattr(negatives, "BLOCK", 7)
    monkeypatch.setattr(negatives, "PACK", 3)
    monkeypatch.setattr(negatives, "FIRST_CELLS", 2)
    if partitions:
        build = negatives.build_index
        monkeypatch.setattr(negatives, "build_index", lambda rows: build(rows, partitions))
    rows = [(i, v, (label if i != 17 else None), *rest) for i, v, label, *rest in rows_of(seed=8, n=300)]
    rows += [(400, rows[50][1], 1, "c", 1, 1), (450, rows[51][1], 2, "c", 1, 1), (500, [], 1, "c", 1, 1)]
    found = negatives.mine(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, found.collect()), key=str) == plain_negatives(rows, 10)


def test_hard_negatives_of_few_and_no_rows(spark):
    none = negatives.mine(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0)
    assert none.isEmpty() and none.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    few = [(0, [1.0, 0.0], 1, "c", 1, 1), (1, [0.9, 0.1], 1, "c", 1, 1), (2, [0.7, 0.2], 2, "c", 1, 1), (3, [0.7], 2, "c", 1, 1), (None, [0.6, 0.0], 3, "c", 1, 1), (5, [-1.0, 0.0], 1, "c", 1, 1)]
    found = negatives.mine(spark.createDataFrame(few, SCHEMA), F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(tuple, found), key=str) == plain_negatives(few) and len(found) == 3
    assert negatives.mine(spark.createDataFrame(few[1:], SCHEMA), F.col("vec_id") % 50 == 0).isEmpty()


def test_bounds_hold_for_every_row():
    rng = np.random.default_rng(4)
    x = rng.integers(-200, 200, size=(500, 8)) * rng.integers(1, 60, size=(500, 1))
    geometry = negatives.Geometry(x[:5], int((x * x).sum(axis=1).max()))
    pivot, key = geometry.keys(x)
    upper, lower = geometry.bounds(x, pivot, key, key)
    score = x @ x.T
    assert (score <= upper).all() and (score >= lower).all() and (upper - score).min() < 4
