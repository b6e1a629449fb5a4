"""Cases of the findings of round 4."""

import math
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.operators import analytics as A
from tidemark.operators import graph as N
from tidemark.operators import pain as B
from tidemark.operators import postings as I
from tidemark.operators import relational as R
from tidemark.operators import similarity as M
from tidemark.operators import topics as T
from tidemark.operators import vectors as V
from tidemark.plans import catalogue, register_all
from tidemark.session import shared_folder

register_all()


def test_neighbours_by_cut_and_by_rounded_seconds(spark):
    """second of a day, with the time's fraction; ids that are null or the same have no pair."""
    day = "2024-01-01 0"
    rows = [(1, "1:00:00.2"), (2, "2:00:00.7"), (3, "1:00:00.7"), (4, "1:00:00.1"), (None, "1:00:10"), (1, "1:00:20")]
    frame = spark.createDataFrame([(i, "u", day + t) for i, t in rows], "id long, u string, t string").withColumn("t", F.col("t").cast("timestamp"))
    found = {(r.a, r.b) for r in A.hour_neighbours(frame, "u", "t", 1).collect()}
    # 1 to 2 is 3,600 seconds cut off and 3,601 rounded; 3 is rounded a second after 4, so 4 isn't after it by id
    assert found == {(1, 3), (1, 4), (3, 1), (4, 1), (3, 2), (1, 2)}
    early = spark.createDataFrame([(1, "u", "1969-12-31 23:59:58.3"), (2, "u", "1969-12-31 23:59:58")], "id long, u string, t string").withColumn("t", F.col("t").cast("timestamp"))
    assert [(r.a, r.b) for r in A.hour_neighbours(early, "u", "t", 1).collect()] == [(1, 2)]


def test_archetypes_round_the_average_and_not_its_noise(spark, tmp_path):
    """an average of 0.45 whose sum of doubles falls short; an event without a type isn't one without error."""
    values = [0.8, 0.09, 0.19, 0.85, 0.07, 0.03, 0.95, 0.51, 0.48, 0.53]
    rows = [(i, 1, None if i % 5 == 0 else "view", v, '{"k": 0}') for i, v in enumerate(values)]
    rows += [(10 + i, 2, "view", v, '{"k": 0}') for i, v in enumerate(reversed(values))]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    found = {r.user_id: (r.engagement, r.hours) for r in catalogue.QUERIES["crawl_archetypes"](spark, str(tmp_path)).collect()}
    assert found == {1: (0.5, 2), 2: (0.5, 4)}


def test_an_index_is_smaller_than_its_texts(spark):
    """F8 to F10, F12 to F14: what a build writes to the shared folder, beside the bytes of the texts."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(3000)]
    rows = [(i, " ".join(words[int(rng.paretovariate(0.6)) % 3000] for _ in range(300))) for i in range(1500)]
    folder = Path(shared_folder(spark).removeprefix("file://"))
    size = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    before = size()
    index = I.build(spark.createDataFrame(rows, "id long, text string").coalesce(2), stemmed=False)
    assert size() - before < 0.8 * sum(len(t) for _, t in rows)
    assert I.search(index, [[words[1]]]).count() == sum(words[1] in t.split() for _, t in rows)


def test_blocks_end_by_words_whatever_the_ids(spark, monkeypatch):
    monkeypatch.setattr(I, "WORDS", 20, raising=False)
    monkeypatch.setattr(I, "FIRST_BLOCKS", 1)
    rows = [((-1) ** i * (1 << 40) * i, "red " * (i % 7) + "blue sky" * (i % 2)) for i in range(60)] + [(7, None), (8, "red " * 90)]
    index = I.build(spark.createDataFrame(rows, "id long, text string").repartition(3), stemmed=False)
    assert {r.id for r in I.search(index, [["red", "sky"]]).collect()} == {i for i, t in rows if t and "red" in t and "sky" in t}
    assert [r.id for r in I.top(index, [["red"]], 1).collect()] == [8]
    assert index.postings.filter("term is null").selectExpr("sum(size(ids))").first()[0] == 62


def test_evidence_by_words_of_equal_titles_and_ids(spark):
    """titles come back for the chosen comments alone; rows of one id count together, a title counts once."""
    rng = random.Random(6)
    words = [f"word{i}" for i in range(12)]
    rows = [(i % 70, " ".join(rng.choices(words, k=4)) + " " * (i % 2)) for i in range(90)] + [(200 + i, "word1 word2") for i in range(5)] + [(300, " "), (301, None)]
    sought = [(a, w) for a in range(8) for w in rng.sample(words, 5)]
    found = T._by_words(spark.createDataFrame(sought, "anchor long, token string"), spark.createDataFrame(rows, "id long, text string"), 3)
    got = sorted((r.anchor, -r.n, r.id, r.title) for r in found.collect())
    want = []
    for a in range(8):
        mine, best = {w for b, w in sought if a == b}, {}
        for i, text in rows:
            n = sum(len(mine & set((t or "").split())) for j, t in rows if j == i)
            if n and (title := (text or "").strip()):
                best[title] = min(best.get(title, (0, 0)), (-n, i))
        first = sorted((p, q, title) for title, (p, q) in best.items())
        want += [(a, *x) for x in first if x[:2] <= first[2][:2]]
    same_place = {(a, p, q) for a, p, q, _ in want}
    assert len(got) == 24 and set(got) <= set(want) and {(a, p, q) for a, p, q, _ in got} == same_place


def test_rows_alike_in_time_equal_all_pairs(spark):
    """blocks of a few rows, times before 1970 with fractions, equal keys, vectors that are null or have a null."""
    rng = random.Random(8)
    rows = [(i % 57, -200.0 + 5 * rng.random() * i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    rows += [(100, 0.0, None), (101, 0.0, [1.0, None, 0.0, 0.0]), (None, 0.0, [9.0] * 4), (102, None, [9.0] * 4), (103, -0.5, [9.0] * 4), (104, -40.2, [9.0] * 4)]
    frame = spark.createDataFrame(rows, "k long, t double, v array<double>").withColumn("t", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
    whole = [(k, math.floor(t), v) for k, t, v in rows if k is not None and t is not None and v and None not in v]
    want = sorted(
        (min(a, b), max(a, b)) for n, (a, s, v) in enumerate(whole) for b, u, w in whole[:n] if a != b and abs(s - u) <= 40 and sum(x * y for x, y in zip(v, w)) >= 0.35
    )
    found = R.alike_in_time(frame, "k", "t", "v", 40, 0.35, block=3)
    assert sorted((r.a, r.b) for r in found.collect()) == want and (103, 104) in want
    assert R.alike_in_time(frame.limit(0), "k", "t", "v", 40, 0.35).isEmpty()


def test_links_meet_in_groups_of_blocks(spark, monkeypatch):
    """blocks go to their pairs by groups, so few rows with vectors are made; the links are all that there are."""
    monkeypatch.setattr(V, "BLOCK", 16)
    monkeypatch.setattr(V, "GROUP", 100, raising=False)
    x = np.random.default_rng(3).normal(size=(600, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, "ab"[i % 2], v.tolist()) for i, v in enumerate(x)], "id long, part string, vector array<double>")
    links = V.links_within(frame, "part", 0.5, lists=5)
    found = sorted((min(r.a, r.b), max(r.a, r.b)) for r in links.collect())
    score = np.round(x @ x.T, 6)
    assert found == [(i, j) for i in range(600) for j in range(i + 1, 600) if i % 2 == j % 2 and score[i, j] >= 0.5]
    monkeypatch.setattr(V, "_linked", lambda least, digits: lambda batches: (pa.RecordBatch.from_arrays([pa.array([1] * b.num_rows), pa.array([1] * b.num_rows), pa.array([1.0] * b.num_rows)], ["a", "b", "score"]) for b in batches))
    met = V.links_within(frame, "part", 0.5, lists=5).count()
    assert met <= 100


def test_greedy_selection_reads_the_links_once(spark):
    """links given in either direction, twice and to themselves."""
    read = spark.sparkContext.accumulator(0)
    links = [(3, 1), (1, 3), (2, 3), (3, 3), (4, 5), (5, 4), (6, 2)]

    def counted(row):
        read.add(1)
        return row

    frame = spark.createDataFrame(spark.sparkContext.parallelize(links, 1).map(counted), "a long, b long")
    nodes = spark.createDataFrame([(i, -float(i == 3)) for i in range(1, 8)], "id long, e double")
    assert dict(map(tuple, N.greedy_kept(nodes, frame, ("e",)).collect())) == {1: 3, 2: 3, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7}
    assert read.value == len(links)


def test_links_by_threshold_have_the_components_of_all_pairs(spark):
    """a link an item, threshold and pair of blocks at most, where all pairs were made."""
    x = np.abs(np.random.default_rng(5).normal(size=(90, 6))) * (np.random.default_rng(6).random((90, 6)) < 0.5)
    x[7] = 0.0
    x = np.round(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9), 9)
    rows = [(i, "pq"[i % 2], p + 1, float(w)) for i, v in enumerate(x) for p, w in enumerate(v) if w]
    links = B.threshold_links(spark.createDataFrame(rows, "id long, report string, place int, w double"), 6, (0.5, 0.9, 0.97), block=20).collect()
    for t, bar in enumerate((0.5, 0.9, 0.97)):
        groups = []
        for edges in ([(r.a, r.b) for r in links if r.t == t], [(i, j) for i in range(90) for j in range(i) if i % 2 == j % 2 and round(float(x[i] @ x[j]), 6) >= bar]):
            group = list(range(90))
            for a, b in edges:
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
            groups.append(group)
        assert groups[0] == groups[1] and len(set(groups[1])) < 90


def test_few_candidates_come_to_their_tokens_and_no_link_is_lost(spark, monkeypatch):
    """sets with rare tokens in common that are else unlike fall by their sketches."""
    rng = np.random.default_rng(9)
    sets = {i: {int(t) for t in rng.integers(1000, 4000, 60)} | set(range(i % 6 * 40, i % 6 * 40 + 30)) for i in range(150)}
    for i in range(150, 180):
        sets[i] = set(list(sets[i - 150])[: -1 - i % 20]) | {9000 + i}
    seen = []
    jaccard = M._jaccard
    monkeypatch.setattr(M, "_jaccard", lambda pairs, rows: seen.append(pairs.count()) or jaccard(pairs, rows))
    frame = spark.createDataFrame([(i, [(t * 0x9E3779B97F4A7C15) % (1 << 63) for t in s]) for i, s in sets.items()], "id long, tokens array<long>")
    links, rest = M.linked_sets(frame, 0.8, 0.75)
    share = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    every = {(a, b): share(a, b) for a in sets for b in sets if a < b and share(a, b) >= 0.75}
    assert {(min(r.a, r.b), max(r.a, r.b)) for r in links.collect()} == {p for p, x in every.items() if x >= 0.8}
    assert {(r.a, r.b) for r in rest.collect()} == {p for p, x in every.items() if x < 0.8}
    assert len(every) > 10 and seen[-1] <= 40
