"""Comment trees, JSON lines as batch and stream, lexicons, dictionaries and selection under caps."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators import capped, dictionary
from tidemark.sources import comments as K
from tidemark.sources import json_lines as J
from tidemark.sources import lexicon as L


def comment(id_, replies=None, **more):
    return {"kind": "t1", "data": {"id": id_, "body": f"body of {id_}", "author_fullname": "t2_x", **more} | ({"replies": {"data": {"children": replies}}} if replies else {"replies": ""})}


LISTING = {"data": {"children": [
    comment("c1", [comment("c2", [comment("c5", edited=1700000000.0)]), {"kind": "more", "data": {"children": ["c8", "c9"], "parent_id": "t1_c1"}}], score=10, total_awards_received=2),
    {"kind": "more", "data": {"count": 10, "children": ["c3", "c4"]}}, {"kind": "t3", "data": {}}, {"kind": "t1"}, 7, comment("c6", score="many"),
]}}


def test_comment_trees(spark):
    deep = comment("d0")
    for i in range(1, 300):
        deep = comment(f"d{i}", [deep])
    rows = [(1, json.dumps(LISTING)), (2, json.dumps([deep])), (3, "{broken"), (4, None), (5, "[]"), (6, "3"), (7, json.dumps(LISTING["data"]["children"]))]
    listings = spark.createDataFrame(rows, "listing long, json string").withColumns({"place": F.lit(1), "depth": F.lit("x")})
    found = K.comment_rows(listings).collect()
    kept = {n: [r for r in found if r.listing == n and r.place is not None] for n in range(1, 8)}
    assert [(r.id, r.depth, r.place, r.path) for r in kept[1]] == [("c1", 0, 0, "/c1"), ("c2", 1, 1, "/c1/c2"), ("c5", 2, 2, "/c1/c2/c5"), ("c6", 0, 3, "/c6")]
    assert [(r.score, r.awards_count, r.edited) for r in kept[1]] == [(10, 2, False), (None, 0, False), (None, 0, True), (None, 0, False)]
    assert [tuple(r)[1:] for r in kept[7]] == [tuple(r)[1:] for r in kept[1]] and not kept[4] + kept[5] + kept[6]
    assert [(r.id, r.depth) for r in kept[2]] == [(f"d{299 - i}", i) for i in range(300)]
    assert [(r.depth, r.missing) for r in found if r.listing == 1 and r.missing] == [(1, ["c8", "c9"]), (0, ["c3", "c4"])]
    assert [r.error for r in found if r.listing == 3] == ["JSONDecodeError"]
    assert [r.id for r in K.comment_rows(listings.filter("listing = 1"), 2).collect()] == ["c1", "c2"]
    later = {"json": {"data": {"things": [comment("m1", [comment("no")], score=3), {"kind": "more", "data": {"children": ["m2"]}}]}}}
    found = K.more_children(spark.createDataFrame([(1, json.dumps(later)), (2, "{}"), (3, json.dumps({"json": None}))], "listing long, json string")).collect()
    assert [(r.id, r.depth, r.missing) for r in found] == [("m1", 0, None), (None, 0, ["m2"])]


LINES = [
    '{"id": "a", "title": "t", "selftext": "", "body": "b", "score": 3, "created_utc": 150}', '{"id": "b", "created_utc": "199.5", "selftext": "s"}', "", "   ", "{oops", "[1]", '"x"',
    '{"id": "c"}', '{"id": "d", "created_utc": "soon"}', '{"id": "e", "created_utc": 99.9}', '{"id": "f", "created_utc": 200}', '{"id": "", "created_utc": 199.9}', '{"created_utc": 100}', '{"id": "b2", "created_utc": 199.5}',
]
REASONS = {"blank": 2, "broken": 3, "no_time": 1, "bad_time": 1, "outside": 2, None: 5}


def test_json_lines_as_batch_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.jsonl").write_text("\n".join(LINES[:6]) + "\n")

    def run():
        rows = J.backfill_rows(J.read_lines(spark, str(tmp_path / "in"), stream=True), 100, 200)
        query = rows.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out"))
        query.awaitTermination(120)

    run()
    (tmp_path / "in" / "two.jsonl").write_text("\n".join(LINES[6:]))
    run()  # goes on from the checkpoint, so no line comes twice
    batch = J.backfill_rows(J.read_lines(spark, str(tmp_path / "in")), 100, 200)
    plain = lambda rows: sorted(map(str, rows.drop("file").collect()))
    assert plain(spark.read.parquet(str(tmp_path / "out"))) == plain(batch)
    assert Counter(r.reason for r in batch.collect()) == REASONS
    assert {r.id: r.body for r in batch.collect() if not r.reason and r.id} == {"a": "b", "b": "s", "b2": None}
    assert tuple(J.watermarks(batch).first()) == (5, 100.0, 199.5, "b")
    assert tuple(J.watermarks(batch.limit(0)).first()) == (0, None, None, None)


def test_lexicons(spark, tmp_path):
    layers = {"layers": {"L1": {"brands": [{"canonical": "Acme", "aliases": ["ACM"], "weight": 2}, {"canonical": " "}, "bare"], "other": [{"canonical": "no"}]}, "L9": None}}
    themes = {"themes": {"home": {"default_layer": "L3", "aliases": {"Mop": ["swab"]}, "features": ["Mop", {"canonical": "Bucket", "polarity": -1}], "weights": {"features": 0.5}}}}
    for name, data in (("a.json", layers), ("b.json", themes), ("c.json", [1])):
        (tmp_path / name).write_text(json.dumps(data))
    (tmp_path / "d.json").write_text("{: [")
    rows = L.read_lexicon(spark, str(tmp_path)).collect()
    found = {r.canonical: (r.theme, r.layer, r.category, list(r.aliases), r.precision, r.weight, r.polarity) for r in rows if not r.error}
    assert found == {"Acme": (None, "L1", "brands", ["ACM"], "exact", 2.0, None), "Mop": ("home", "L3", "features", ["swab"], "phrase", 0.5, None), "Bucket": ("home", "L3", "features", [], "phrase", 0.5, "-1")}
    assert [r.file for r in rows if r.error] == ["d.json"]
    assert L.names(L.read_lexicon(spark, str(tmp_path))).count() == 5
    folder = tmp_path / "folder"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps({"Models": ["Z1", " Z1 "], "hazards": ["fire"], "odd": ["x"]}))
    (folder / "b.json").write_text(json.dumps({"brands": ["Z1", 3], "risks": "none"}))
    found = L.read_dictionaries(spark, str(folder), {"models": "brands", "hazards": "risks"}, ["brands", "risks"]).collect()
    assert sorted(map(tuple, found)) == [("brands", "Z1"), ("risks", "fire")]


def test_dictionary_matches_by_a_plain_walk(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    terms = {tuple(rng.choices(words, k=rng.choice([1, 1, 2, 2, 3, 5]))) for _ in range(20_000)}
    terms = {t for t in terms if len(t) > 1 or int(t[0][1:]) < 10}
    texts = {i: " ".join(rng.choices(words, k=rng.choice([0, 1, 4, 80]))) for i in range(60)} | {99: None}
    rows = [(f"c{len(t)}", " ".join(t).upper(), ", ".join(t)) for t in sorted(terms)] + [("c0", "first", "W1"), ("x", "none", " . ")]
    found = dictionary.matches(spark.createDataFrame(list(texts.items()), "id long, text string").withColumns({"w": F.lit(1), "start": F.lit(1), "term": F.lit(1)}), spark.createDataFrame(rows, "category string, canonical string, term string"))
    want = []
    for i, text in texts.items():
        w, at = (text or "").split(), 0
        while at < len(w):
            n = next((n for n in range(5, 0, -1) if tuple(w[at : at + n]) in terms and at + n <= len(w)), 0)
            if n:
                want.append((i, at, n, " ".join(w[at : at + n]), "c0" if w[at : at + n] == ["w1"] else f"c{n}"))
            at += n or 1
    assert sorted((r.id, r.start, r.n, r.term, r.category) for r in found.collect()) == sorted(want)
    with pytest.raises(ValueError):
        dictionary.matches(spark.createDataFrame([(1, "a")], "id long, text string"), spark.createDataFrame([("c", "c", "a b c d e f g h i")], "category string, canonical string, term string"))


@pytest.mark.parametrize("seed", range(4))
def test_selection_under_caps_equals_the_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice("abc"), rng.choice([None, *range(12)]), rng.randrange(4), rng.randrange(5)) for i in range(150)]
    caps = {"scope": 15 + seed, "pack": 3, "community": 12}
    counts, want = {k: Counter() for k in caps}, set()
    for r in sorted(rows, key=lambda r: (-r[4], r[0])):
        keys = {"scope": r[1], "pack": r[2], "community": r[3]}
        if len(want) < 33 and all(v is None or counts[k][v] < caps[k] for k, v in keys.items()):
            want.add(r[0])
            for k, v in keys.items():
                counts[k][v] += 1
    frame = spark.createDataFrame(rows, "id long, scope string, pack long, community long, score long")
    found = capped.admitted(frame, [F.desc("score"), F.asc("id")], caps, most=33)
    assert {r.id for r in found.filter("taken").collect()} == want and found.count() == len(rows) and found.columns == [*frame.columns, "taken"]
    assert capped.admitted(frame.limit(0), [F.asc("id")], caps).isEmpty()
