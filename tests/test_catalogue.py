"""Every registered query against its SQL on a second engine, over the smallest tables."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidemark.operators import analytics as A
from tidemark.operators import lifecycle as L
from tidemark.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def other():
    engine = duckdb.connect()
    for name in TABLES:
        engine.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return engine


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 8) if isinstance(v, float) else v
    return sorted(columns), sorted(repr([plain(r[i]) for i in order]) for r in values)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query(spark, other, name):
    found = catalogue.QUERIES[name](spark, FOLDER)
    want = other.execute(catalogue.ORACLE_SQL[name])
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows([c[0] for c in want.description], want.fetchall())


def test_entry_is_imported_without_a_session():
    code = "import __spark_entry__ as e; from pyspark import SparkContext; assert SparkContext._active_spark_context is None and len(e.queries()) >= len(e.oracle_sql()) > 200"
    subprocess.run([sys.executable, "-W", "ignore", "-c", code], check=True, cwd=Path(__file__).resolve().parents[1])


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def _table(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet")


def test_every_fiftieth_vector_asks(spark):
    asked = _table(spark, "embeddings").filter("vec_id % 50 = 0").count()
    assert asked > 1 and catalogue.QUERIES["cosine_topk_each"](spark, FOLDER).count() == 25 * asked


@pytest.mark.parametrize("name", ["tf_idf_keywords", "longest_quote", "term_occurrences", "sentence_stats"])
def test_all_languages_are_read(spark, name):
    found = catalogue.QUERIES[f"{name}_all_languages"](spark, FOLDER).join(_table(spark, "documents"), "doc_id")
    assert {r.lang for r in found.select("lang").distinct().collect()} == {"en", "de", "fr", "es"}


def test_upsert_reads_all_events(spark):
    events = _table(spark, "events").filter("user_id % 3 <> 0")
    kept = {r.user_id: r.kind for r in catalogue.QUERIES["upsert_later_over_earlier"](spark, FOLDER).collect()}
    assert kept.keys() == {r.user_id for r in _table(spark, "events").select("user_id").distinct().collect()}
    late = events.filter("ts >= timestamp_ntz'2024-01-16'").groupBy("user_id").agg({"event_type": "min"}).collect()
    assert late and all(kept[u] == kind for u, kind in late)


def test_interleaving_drops_no_event(spark):
    assert catalogue.QUERIES["interleave_all_by_type"](spark, FOLDER).count() == _table(spark, "events").count()
    rows = spark.range(600).selectExpr("if(id % 7 = 0, null, 'hot') as k", "if(id % 11 = 0, null, id % 90 / 10) as v", "id")
    order = lambda: (F.desc("v"), F.asc("id"))
    turns = lambda found: sorted((r.id, r.turn) for r in found.collect())
    assert turns(A.interleaved_in_buckets(rows, "k", F.floor("v"), *order())) == turns(A.interleaved(rows, "k", *order()))


def test_insert_if_absent_reads_all_events(spark):
    stored, fresh = set(), {}
    for e in _table(spark, "events").collect():
        key = (e.user_id, e.event_type, e.ts.hour)
        if e.ts.isoformat() < "2024-01-16":
            stored.add(key)
        else:
            fresh[key] = min(e.event_id, fresh.get(key, e.event_id))
    want = {(*key, first) for key, first in fresh.items() if key not in stored}
    found = catalogue.QUERIES["insert_if_absent"](spark, FOLDER).collect()
    assert len(found) == len(want) and {tuple(r) for r in found} == want and 0 < len(want) < len(fresh)
    rows = spark.createDataFrame([(None, "a", 3), (None, "a", 2), (1, None, 5), (1, "a", 4)], "k int, v string, id int")
    some = L.insert_if_absent(rows.filter("id = 5"), rows, ["k", "v"])
    assert sorted(r.id for r in some.collect()) == [2, 4]
