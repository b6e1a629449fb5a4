"""Mixing sources to target weights, as a time-varying curriculum.

Every source has a weight schedule over the schedule's time from 0 to 1. Its integral is the source's demand of words
up to each time; the demands of all sources add up to the mix's. A source's documents, in a fixed pseudo-random order,
stand one after another along their words. The source's integral, inverted, gives the time at which its demand reaches
a document, and the mix's demand at that time is the document's training position, counted in words of the whole mix.
The mix is all documents by that position, range-sorted.

A source that is asked for more than it has is read again, up to ``most_repeats`` times over; the excess goes to the
other sources by weight until none is above its limit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import WORD, checkpointed

WEIGHTS = (5, 2, 1)


@dataclass(frozen=True)
class Ramp:
    """A schedule that goes in a straight line from ``start`` to ``end`` times the source's mean weight.

    The mean over training is 1, so ``end`` is ``2 - start``; both are from 0 to 2. Its integral up to time t is
    ``start * t + (1 - start) * t * t``.
    """

    start: float = 1.0

    def time(self, share: Column) -> Column:
        """When the source's demand has come to ``share`` of its total: the inverted integral."""
        if self.start == 1.0:
            return share
        a, b = 1.0 - self.start, self.start
        return (F.sqrt(F.lit(b * b) + 4.0 * a * share) - b) / (2.0 * a)


#: Sources take turns; the first of three comes early, the second evenly, the third late.
SCHEDULES = (Ramp(1.5), Ramp(1.0), Ramp(0.5))


def n_words(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_repeats: int = 3) -> DataFrame:
    """``sizes``: source, source_size. Adds turn (from 0, by code point, null last), weight and target.

    A source is at its limit when limit / weight is below the level at which the others share the rest; sources by
    that ratio, the level after each, and the first level that no later limit undercuts. One row per source goes
    through one task.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    turns = sizes.withColumn("turn", (F.row_number().over(by_name) - 1).cast("long"))
    turns = turns.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("turn") % len(weights) + 1).cast("int")).cast("long"))
    turns = turns.withColumn("most", F.col("source_size") * most_repeats)
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "turn")
    to_here, all_rows = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    level = turns.withColumn("rest", F.sum("source_size").over(all_rows) - F.coalesce(F.sum("most").over(to_here), F.lit(0)))
    level = level.withColumn("open", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(to_here), F.lit(0)))
    # with the sources before this one at their limits, this one and the later ones share the rest
    level = level.withColumn("fits", F.col("rest").cast("double") * F.col("weight") <= F.col("most").cast("double") * F.col("open"))
    first = F.min(F.when(F.col("fits"), F.struct(F.col("most") / F.col("weight"), F.col("turn"), F.col("rest"), F.col("open")))).over(all_rows)
    level = level.withColumn("at", first)
    free = F.struct(F.col("most") / F.col("weight"), F.col("turn")) >= F.struct(F.col("at.col1"), F.col("at.turn"))
    shared = F.col("weight") * F.col("at.rest").cast("double") / F.col("at.open")
    return level.select("source", "turn", "weight", "source_size", F.when(F.col("at").isNull() | ~free, F.col("most").cast("double")).otherwise(shared).alias("target"))


def _by_turn(turn: Column, values: list) -> Column:
    """The value for the schedule whose turn it is."""
    found = F.lit(None).cast("double")
    for i, value in enumerate(values):
        found = F.when(turn % len(values) == i, value).otherwise(found)
    return found


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_repeats: int = 3, schedules: tuple[Ramp, ...] = SCHEDULES, docs_per_bucket: int = 20_000,
    carry: tuple[str, ...] | None = None,
) -> DataFrame:
    """Per document of ``docs`` (doc_id, text, source): size, source_size, target, taken and ``positions``.

    ``positions`` has a place in training, in words of the whole mix, for each time that the mix takes the document,
    none if it doesn't. A document is taken when its middle word is, so a source's words come within half a document
    of its target. The order within a source is by the md5 of doc_id, then size and the md5 of the text, the same in
    every run.

    A running sum over a source, which may hold most documents, is made in two steps: over buckets of that order, as
    many as the documents ask for, then within each bucket. Null texts have size 0; null sources are one source, null
    doc_ids ordinary documents. Repeated rows are documents of their own. An empty table gives no rows. All columns of
    ``docs`` stay, or those in ``carry``, so texts move only if they are asked for; new ones are in the struct column
    ``mix``, which takes the place of any column of that name.
    """
    docs = docs.drop("mix")
    kept = docs.columns if carry is None else carry
    own = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    n = docs.count()
    digits = max(1, next(d for d in range(1, 9) if 16**d * docs_per_bucket >= n))
    tie = F.md5(F.coalesce("text", F.lit("")))
    sized = docs.select(F.struct(*kept).alias("doc"), F.struct("source").alias("of"), n_words().alias("size"), own.alias("order"), tie.alias("tie"))
    sized = sized.withColumn("bucket", F.substring("order", 1, digits))
    buckets = checkpointed(sized.groupBy("of", "bucket").agg(F.sum("size").alias("words")))
    sizes = buckets.groupBy("of").agg(F.sum("words").alias("source_size")).select(F.col("of.source").alias("source"), "source_size")
    targets = source_targets(sizes, weights, most_repeats)
    # the mix's demand at time t is level * t + slope * t * t, the sum of the sources' integrals
    everyone = Window.partitionBy(F.lit(1))
    starts = _by_turn(F.col("turn"), [F.lit(r.start) for r in schedules])
    targets = targets.withColumns({"level": F.sum(F.col("target") * starts).over(everyone), "slope": F.sum(F.col("target") * (1.0 - starts)).over(everyone)})
    targets = targets.withColumn("of_target", F.struct("source")).drop("source")
    ahead = Window.partitionBy("of").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    places = buckets.select("of", "bucket", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("before")).join(targets, F.col("of").eqNullSafe(F.col("of_target")))
    within = Window.partitionBy("of", "bucket").orderBy("order", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    right = places.select(F.col("of").alias("of2"), F.col("bucket").alias("bucket2"), "before", "turn", "weight", "source_size", "target", "level", "slope")
    placed = placed.join(right, F.col("of").eqNullSafe(F.col("of2")) & (F.col("bucket") == F.col("bucket2")))
    middle = F.col("before") + F.col("inner") + F.col("size") / 2.0
    share = F.array(*(F.try_divide(middle + k * F.col("source_size"), F.col("target")) for k in range(most_repeats)))
    time = F.transform(F.filter(share, lambda x: (F.col("target") > 0) & (x < 1.0)), lambda x: _by_turn(F.col("turn"), [r.time(x) for r in schedules]))
    positions = F.transform(time, lambda t: F.col("level") * t + F.col("slope") * t * t)
    out = placed.select("doc", F.struct("size", "source_size", "target", "weight", positions.alias("positions")).alias("mix"))
    taken = (F.size("mix.positions") * F.col("mix.size")).cast("long")
    return out.select("doc.*", F.col("mix").withField("taken", taken).alias("mix"))


def in_training_order(mixed: DataFrame, column: str = "mix") -> DataFrame:
    """One row per time that the mix takes a document, range-sorted by ``position``, which takes the place of any such column.

    Documents that aren't taken have no row, so an empty mix gives none. Of equal positions (documents without words)
    the order is by the md5 of doc_id, null as any other.
    """
    rows = mixed.drop("position").select("*", F.explode(f"{column}.positions").alias("position"))
    return rows.orderBy("position", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
