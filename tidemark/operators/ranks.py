"""Exact quantiles of keys of any size: counts of ranges, refined where the rank is, so that no key is sorted in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import checkpointed

#: Ranges that a range is cut into.
PARTS = 256


def exact_quantiles(rows: DataFrame, key: str, value: str, shares: Sequence[float]) -> DataFrame:
    """key, share, low, high, and n: of the key's sorted values those at floor and ceil of share x (n - 1).

    Null and NaN values are left out; a key without others has no row; a null key is a key. Each round counts a key's values in
    PARTS ranges, combined before the shuffle, and goes on with the values of the range that has the rank, between its least and largest.
    """
    plain = rows.select(F.col(key).alias("key"), F.col(value).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    counted = checkpointed(plain.groupBy("key", "v").agg(F.count("*").alias("c")))
    whole = counted.groupBy("key").agg(F.sum("c").alias("n"), F.min("v").alias("from"), F.max("v").alias("to"))
    at = F.explode(F.array(*(F.struct(F.lit(float(s)).alias("share"), F.lit(e).alias("edge")) for s in shares for e in ("low", "high")))).alias("a")
    place = F.when(F.col("a.edge") == "low", F.floor(F.col("a.share") * (F.col("n") - 1))).otherwise(F.ceil(F.col("a.share") * (F.col("n") - 1)))
    open_ = checkpointed(whole.select("key", "n", at, "from", "to").select("key", "n", "a.share", "a.edge", place.cast("long").alias("rank"), "from", "to"))
    done = None
    while True:
        settled = open_.filter("from = to").select("key", "n", "share", "edge", F.col("from").alias("v"))
        done = settled if done is None else done.unionByName(settled)
        open_ = open_.filter("from < to")
        if open_.isEmpty():
            break
        wide = F.greatest(F.col("to") / PARTS - F.col("from") / PARTS, F.lit(5e-324))
        # both ends are cut off, so the least and the largest value part whatever rounding does
        cut = F.when(F.col("v") == F.col("from"), -1).when(F.col("v") == F.col("to"), PARTS).otherwise(F.least(F.greatest(F.floor(F.col("v") / wide - F.col("from") / wide), F.lit(0)), F.lit(PARTS - 1))).cast("int")
        ranges = open_.select("key", "from", "to").distinct()
        inside = counted.withColumnRenamed("key", "of").join(ranges, F.col("of").eqNullSafe(F.col("key")) & F.col("v").between(F.col("from"), F.col("to")))
        sums = inside.groupBy("key", "from", "to", cut.alias("cut")).agg(F.sum("c").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        # PARTS + 2 rows of a range at most
        listed = sums.groupBy("key", "from", "to").agg(F.array_sort(F.collect_list(F.struct("cut", "c", "least", "most"))).alias("cuts"))
        joined = open_.join(listed.select(F.col("key").alias("of"), F.col("from").alias("f"), F.col("to").alias("t"), "cuts"), F.col("key").eqNullSafe(F.col("of")) & (F.col("from") == F.col("f")) & (F.col("to") == F.col("t")))
        none = F.struct(F.lit(0).cast("long").alias("before"), F.lit(None).cast("double").alias("least"), F.lit(None).cast("double").alias("most"), F.lit(None).cast("long").alias("rank"))

        def step(s, x):
            here = s["least"].isNull() & (F.col("rank") < s["before"] + x["c"])
            return F.struct((s["before"] + x["c"]).alias("before"), F.when(here, x["least"]).otherwise(s["least"]).alias("least"), F.when(here, x["most"]).otherwise(s["most"]).alias("most"), F.when(here, F.col("rank") - s["before"]).otherwise(s["rank"]).alias("rank"))

        found = joined.withColumn("s", F.aggregate("cuts", none, step))
        open_ = checkpointed(found.select("key", "n", "share", "edge", F.col("s.rank").alias("rank"), F.col("s.least").alias("from"), F.col("s.most").alias("to")))
    return done.groupBy(F.col("key").alias(key), "share").agg(F.max(F.when(F.col("edge") == "low", F.col("v"))).alias("low"), F.max(F.when(F.col("edge") == "high", F.col("v"))).alias("high"), F.max("n").alias("n"))
