"""Text and table operators on small rows."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import analytics as A


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


def test_text(spark):
    assert one(spark, " r/Reddit ", X.name_key) == "reddit"
    assert one(spark, "See [the docs](http://a.b/c) or `code`, mail a.b@c.de\n> quoted  http://x.y", X.cleaned) == "See the docs or , mail"
    assert one(spark, "One. Two!  \n\nThree?", X.sentences) == ["One", "Two", "Three"]
    assert one(spark, "Don't  STOP!", X.norm_hash) == one(spark, "dont stop", X.norm_hash)
    assert one(spark, "a Big  deal here", lambda c: X.mentions(c, ["big deal"])) and not one(spark, "bigger deal", lambda c: X.mentions(c, ["big"]))
    assert one(spark, "aXaxa", lambda c: X.occurrences(c, "ax")) == 2
    assert one(spark, None, X.cleaned) is None


def test_jaccard_and_ratio(spark):
    row = spark.sql("SELECT array(1,2,3) a, array(2,3,4) b, array() e")
    assert row.select(X.jaccard(F.col("a"), F.col("b"))).first()[0] == pytest.approx(0.5)
    assert row.select(X.jaccard(F.col("e"), F.col("e"))).first()[0] == 0.0
    assert spark.range(1).select(A.guarded_ratio(F.lit(1), F.lit(0)), A.guarded_ratio(F.lit(0), F.lit(0), None)).first()[:] == (1.0, None)


def test_upsert_scd_and_as_of(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", None)], "k int, s string, n int")
    new = spark.createDataFrame([(2, None, 7), (3, "c", 1)], "k int, s string, n int")
    assert sorted(map(tuple, A.upserted(old, new, ["k"]).collect())) == [(1, "a", 5), (2, "b", 7), (3, "c", 1)]
    assert (2, None, 7) in set(map(tuple, A.upserted(old, new, ["k"], keep_old_nonnull=False).collect()))
    versions = spark.createDataFrame([(1, 1, "x"), (1, 2, "x"), (1, 3, "y")], "k int, t int, v string").withColumn("t", F.timestamp_seconds("t"))
    found = A.scd2(versions, ["k"], "t", "v").orderBy("version").collect()
    assert [(r.v, r.version, r.is_current) for r in found] == [("x", 1, False), ("y", 2, True)]
    events = spark.createDataFrame([(1, 5, "e"), (1, 1, "f"), (2, 9, "g")], "k int, t int, id string")
    snaps = spark.createDataFrame([(1, 2, 10), (1, 5, 20), (1, 6, 30)], "k int, t int, value int")
    assert {r.id: r.value for r in A.as_of(events, snaps, "k", "t", "value").collect()} == {"e": 20, "f": None, "g": None}
