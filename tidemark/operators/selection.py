"""Quotas, evaluation, streaks and term statistics as DataFrame operators.

Ties are broken by key; no clock is read. Empty tables give empty results. Columns that an operator adds take the place
of any of the same name; helper columns get names that the rows don't have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.analytics import fresh


def largest_remainder(counts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Deals ``total`` out in proportion to ``n``, as ``quota``: whole parts first, the rest to the largest remainders.

    One row per key goes through one task. Without any count, or with a null one, quotas are 0.
    """
    everyone = Window.partitionBy(F.lit(1))
    rows = counts.select(F.struct(*counts.columns).alias("row"), F.coalesce(F.col(n), F.lit(0)).alias("n"), F.col(key).alias("key")).withColumn("sum", F.sum("n").over(everyone))
    whole, rest = F.expr(f"if(sum = 0, 0, (n * {total}) div sum)"), F.expr(f"if(sum = 0, 0, (n * {total}) % sum)")
    rows = rows.withColumns({"whole": whole, "rest": rest})
    left = F.lit(total) - F.sum("whole").over(everyone)
    place = F.row_number().over(everyone.orderBy(F.desc("rest"), "key"))
    rows = rows.withColumns({"left": left, "place": place})
    quota = F.when(F.col("sum") == 0, 0).otherwise(F.col("whole") + F.when(F.col("place") <= F.col("left"), 1).otherwise(0)).cast("long")
    return rows.select(*(F.col("row")[c].alias(c) for c in counts.columns if c != "quota"), quota.alias("quota"))


def sample_by_hash(rows: DataFrame, stratum: str, n: int, key: str) -> DataFrame:
    """The ``n`` rows of each stratum with the smallest md5 of ``key``: random in looks, the same in every run."""
    order = Window.partitionBy(stratum).orderBy(F.md5(F.col(key).cast("string")), key)
    return rows.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= n)


def threshold_grid(scored: DataFrame, score: str, label: str, thresholds: list[float]) -> DataFrame:
    """Per threshold: tp, fp, fn, precision, recall and f1, in one pass over the rows."""
    each = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    sums = scored.select(F.col(score).alias("s"), (F.col(label) == 1).alias("y"), each).groupBy("threshold")
    sums = sums.agg(*(F.count_if(c).alias(k) for k, c in (("tp", F.expr("s >= threshold and y")), ("fp", F.expr("s >= threshold and not y")), ("fn", F.expr("s < threshold and y")))))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return sums.withColumns({
        "precision": F.round(share(F.col("tp"), F.col("tp") + F.col("fp")), 6),
        "recall": F.round(share(F.col("tp"), F.col("tp") + F.col("fn")), 6),
        "f1": F.round(share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6),
    })


def best_threshold(grid: DataFrame, floor: float) -> DataFrame:
    """The row with the best f1 whose precision is at least ``floor``; of equal ones the smallest threshold."""
    return grid.filter(F.col("precision") >= floor).orderBy(F.desc("f1"), "threshold").limit(1)


def precision_at(scored: DataFrame, key: str, score: str, label: str, k: int) -> DataFrame:
    """Of the ``k`` best-scored rows: how many there are and the share with label 1."""
    best = scored.orderBy(F.desc(score), key).limit(k)
    return best.agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg((F.col(label) == 1).cast("int")), F.lit(0.0)), 6).alias("precision"))


def streaks(rows: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """Runs of equal values within a key: ``value``, ``streak`` (from 1) and ``n``."""
    w, first = Window.partitionBy(key).orderBy(*order), fresh(rows, "first")
    begins = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    numbered = rows.withColumn(first, begins).withColumn("streak", F.sum(first).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "streak").agg(F.first(value).alias(value), F.count("*").alias("n"))


def tf_idf(tokens: DataFrame, doc: str, token: str, docs: DataFrame) -> DataFrame:
    """``doc``, ``token``, ``tf`` and ``weight`` = tf * (ln((1 + n) / (1 + df)) + 1), from a row per occurrence.

    n is the number of rows of ``docs``, one row of its own that is sent to the others.
    """
    tf = tokens.groupBy(doc, token).agg(F.count("*").alias("tf"))
    df = tf.groupBy(token).agg(F.count("*").alias("df"))
    idf = F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1
    both = tf.join(df, token).join(F.broadcast(docs.agg(F.count("*").alias("n_docs"))))
    return both.select(doc, token, "tf", F.round(F.col("tf") * idf, 6).alias("weight"))
