"""Cursors in keyed state, refreshed views, and quantiles by selection."""

import os
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ranks, views
from tidemark.streaming import cursor

PAGES = "community string, seen timestamp, cursor string, created timestamp, capped boolean"


def test_cursors_go_on_from_their_checkpoint(spark, tmp_path):
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    at = lambda h: datetime(2024, 3, 1) + timedelta(hours=h)
    batches = [
        [("a", at(1), "p1", day(50), False), ("a", at(2), "p2", day(40), False), ("b", at(1), "q1", day(9), False)],
        [("a", at(3), "p3", day(30), False), ("a", at(3), "p3", day(30), False), ("a", at(4), None, None, None), ("b", at(3), "q0", day(20), True)],  # repeated, empty and newer pages
        [("c", at(60), "r1", None, False), ("c", at(9), "r2", day(3), False)],
        [("c", at(80), "r3", day(2), False), ("a", at(5), "old", day(1), False)],  # the second comes behind the watermark
    ]
    out = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, PAGES).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(PAGES).parquet(f"{tmp_path}/in/*")

        def save(found, batch):
            out.append({(r.community, r.status): (r.cursor, r.cursor_created, r.floor) for r in found.collect()})

        cursor.cursors(stream).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(save).start().awaitTermination()
    told = {}
    for o in out:
        told |= o
    assert told[("a", "RUNNING")] == ("p3", day(30), day(30)) and told[("b", "DONE_CAPPED")] == ("q0", day(20), day(9))
    assert told[("a", "STALLED")] == ("p3", day(30), day(30)) and told[("c", "RUNNING")] == ("r3", day(2), day(2))


def test_a_view_is_refreshed_where_it_changed(spark, tmp_path):
    rng = random.Random(3)
    compute = lambda rows: rows.groupBy("topic").agg(F.count("*").alias("n"), F.sum("score").alias("score"))
    view = views.RefreshedView(spark, f"file://{tmp_path}", "id", "version", "topic", compute, partitions=8)
    every, schema = [], "id long, version int, topic string, score long, deleted boolean"
    for batch in range(4):
        if batch < 3:
            rows = [(i, batch, rng.choice(["a", "b", "c", "d", None]), rng.randint(0, 9), rng.random() < 0.2) for i in rng.sample(range(60), 25)]
        else:  # one ident whose key loses its only row
            rows = [(i, 9, "only", 1, False) for i in (70,)]
        every += rows
        before = {f: os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(f"{tmp_path}/view") for f in names if f.startswith("part-")}
        touched = view.refresh(spark.createDataFrame(rows + rows[:3], schema))
        current = {}
        for r in sorted(every, key=lambda r: r[1]):
            current[r[0]] = r
        want = {}
        for r in current.values():
            if not r[4]:
                n, s = want.get(r[2], (0, 0))
                want[r[2]] = (n + 1, s + r[3])
        assert {r.topic: (r.n, r.score) for r in view.read().collect()} == want
        after = {f for d, _, names in os.walk(f"{tmp_path}/view") for f in names if f.startswith("part-")}
        if batch == 3:
            assert len(touched) == 1 and len(set(before) & after) >= len(before) - 1
    assert view.refresh(spark.createDataFrame([(70, 9, "only", 1, False)], schema)) == []  # a repeated batch changes nothing
    view.refresh(spark.createDataFrame([(70, 10, "only", 1, True)], schema))
    assert "only" not in {r.topic for r in view.read().collect()}


@pytest.mark.parametrize("seed", range(3))
def test_quantiles_equal_sorted_ranks(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [("hot", float(v)) for v in rng.lognormal(0, 3, 3000)] + [("same", 2.5)] * 40 + [("two", -1e300), ("two", 1e300), ("one", 0.0), ("gone", None), ("gone", float("nan"))]
    rows += [(None, float(v)) for v in rng.integers(-5, 5, 99)] + [("tiny", v * 5e-324) for v in range(9)] + [("near", 1.0 + v * 2.3e-16) for v in range(50)]
    shares = [0.0, 0.1, 0.5, 0.95, 1.0]
    found = {(r.k, r.share): (r.low, r.high, r.n) for r in ranks.exact_quantiles(spark.createDataFrame(rows, "k string, v double"), "k", "v", shares).collect()}
    want = {}
    for key in {k for k, _ in rows} - {"gone"}:
        v = np.sort([x for k, x in rows if k == key])
        for s in shares:
            want[key, s] = (v[int(np.floor(s * (len(v) - 1)))], v[int(np.ceil(s * (len(v) - 1)))], len(v))
    assert found == want
