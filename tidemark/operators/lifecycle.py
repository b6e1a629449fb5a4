"""The life of rows: versions, merges into stored tables, expiry, archives, quarantine, waterlines.

A stored table is Parquet without updates: a merge reads it, makes the new rows and writes them elsewhere; the caller
swaps the paths. Time is an argument. Null keys are one key. Empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def versioned_upsert(stored: DataFrame, batch: DataFrame, keys: Sequence[str], time: str, values: Sequence[str]) -> DataFrame:
    """``stored`` (keys, values, version, valid_from, fetched, is_current) with a batch (keys, values, time) merged in.

    A batch row whose values are those of the key's current version only moves ``fetched`` on; another closes that
    version and becomes the next. Of several batch rows of a key the latest counts.
    """
    named = [F.col(k) for k in keys]
    w = Window.partitionBy(*keys).orderBy(F.desc(time), *values)
    latest = batch.withColumn("_place_in_key", F.row_number().over(w)).filter("_place_in_key = 1").select(F.struct(*keys).alias("key"), F.struct(*values).alias("new"), F.col(time).alias("at"))
    old = stored.select(F.struct(*keys).alias("key"), F.struct(*stored.columns).alias("row"))
    joined = old.join(latest, old["key"].eqNullSafe(latest["key"]), "full").select(F.coalesce(old["key"], latest["key"]).alias("key"), "row", "new", "at")
    r = F.col("row")
    same = F.struct(*(r[v].alias(v) for v in values)).eqNullSafe(F.col("new"))
    touched = r["is_current"] & F.col("new").isNotNull()
    kept = joined.filter("row is not null").select(
        *(r[k].alias(k) for k in keys), *(r[v].alias(v) for v in values), r["version"].alias("version"), r["valid_from"].alias("valid_from"),
        F.when(touched & same, F.greatest(r["fetched"], F.col("at"))).otherwise(r["fetched"]).alias("fetched"), (r["is_current"] & ~(touched & ~same)).alias("is_current"),
    )
    fresh = joined.filter((r.isNull() | (touched & ~same)) & F.col("new").isNotNull())
    added = fresh.select(*(F.col("key")[k].alias(k) for k in keys), *(F.col("new")[v].alias(v) for v in values), (F.coalesce(r["version"], F.lit(0)) + 1).cast("int").alias("version"), F.col("at").alias("valid_from"), F.col("at").alias("fetched"), F.lit(True).alias("is_current"))
    del named
    return kept.unionByName(added)


def last_write_wins(stored: DataFrame, batch: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Of both tables' rows of a key that with the latest ``time``; the batch's of equal times."""
    both = stored.select(F.struct(*stored.columns).alias("row"), F.lit(0).alias("new")).unionByName(batch.select(F.struct(*stored.columns).alias("row"), F.lit(1).alias("new")))
    best = both.groupBy(*(F.col(f"row.{k}").alias(f"key{i}") for i, k in enumerate(keys))).agg(F.max_by("row", F.struct(F.col(f"row.{time}"), "new", "row")).alias("row"))
    return best.select("row.*")


def insert_if_absent(stored: DataFrame, batch: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """The batch's rows whose key, of one column or several, isn't stored, the first in the order of all columns of each key."""
    keys = [key] if isinstance(key, str) else list(key)
    order = [F.asc(c) for c in batch.columns]
    first = batch.withColumn("_place_in_key", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_place_in_key = 1").drop("_place_in_key")
    known = stored.select(*(F.col(k).alias(f"_known_{i}") for i, k in enumerate(keys))).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_known_{i}")) for i, k in enumerate(keys)]
    return first.join(known, same, "left_anti")


def closed_versions(rows: DataFrame, keys: Sequence[str], time: str, version: str) -> DataFrame:
    """Stored versions with ``valid_to`` (the next one's time, null if there is none) and ``is_current``: older ones are closed."""
    following = F.lead(time).over(Window.partitionBy(*keys).orderBy(time, version))
    return rows.withColumns({"valid_to": following, "is_current": following.isNull()})


def archived(rows: DataFrame, is_current: Column, time: Column, before: Column) -> DataFrame:
    """Versions that aren't current and older than ``before``, as whole-row JSON in ``payload``."""
    return rows.filter(~F.coalesce(is_current, F.lit(False)) & (time < before)).select(F.to_json(F.struct(*rows.columns)).alias("payload"))


def quarantined(rows: DataFrame, reasons: Sequence[tuple[Column, str]]) -> DataFrame:
    """Adds ``reject_reason``, the first that holds; null for rows that are let in. One pass; the caller writes both parts."""
    reason = F.lit(None).cast("string")
    for holds, name in reversed(reasons):
        reason = F.when(holds, name).otherwise(reason)
    return rows.withColumn("reject_reason", reason)


def tiered_expiry(value: Column, score: Column, created: Column, awards: Column | None = None) -> Column:
    """When a comment expires, in microseconds: never from a value of 8, after 30 days to 2, else 365, 180 or 90 days by score."""
    day = F.lit(86_400_000_000)
    much = (score > 100) | ((awards > 5) if awards is not None else F.lit(False))
    days = F.when(F.coalesce(value <= 2, F.lit(False)), 30).when(much, 365).when(score > 10, 180).otherwise(90)
    return F.when(F.coalesce(value >= 8, F.lit(False)), None).otherwise(created + day * days)


def retiered(old_value: Column, new_value: Column, expires: Column, created: Column, now: Column) -> Column:
    """A struct (expires, pool) after a change of value, microseconds; without a change the expiry stays and the pool is null.

    From 8: never, core. To 2: within 30 days of creation and 7 days from now, noise. Else lab, 180 days where there was no end.
    """
    day = F.lit(86_400_000_000)
    changed = ~old_value.eqNullSafe(new_value)
    soon = F.least(created + day * 30, now + day * 7)
    end = F.when(~changed, expires).when(new_value >= 8, None).when(new_value <= 2, soon).otherwise(F.coalesce(expires, created + day * 180))
    pool = F.when(changed, F.when(new_value >= 8, "core").when(new_value <= 2, "noise").otherwise("lab"))
    return F.struct(end.alias("expires"), pool.alias("pool"))


def moved_floor(stored: DataFrame, batch: DataFrame, key: str, time: str) -> DataFrame:
    """The lower of the stored and the batch's least ``time`` of each key: a floor only ever goes back."""
    least = batch.groupBy(key).agg(F.min(time).alias(time))
    return stored.select(key, time).unionByName(least).groupBy(key).agg(F.min(time).alias(time))


def moved_waterline(stored: DataFrame, incremental: DataFrame, key: str, time: str) -> DataFrame:
    """The later of the stored and the batch's greatest ``time``; a backfill is kept out by not being passed in."""
    most = incremental.groupBy(key).agg(F.max(time).alias(time))
    return stored.select(key, time).unionByName(most).groupBy(key).agg(F.max(time).alias(time))


def two_tracks(rows: DataFrame, key: str, time: str, backfill: Column) -> DataFrame:
    """Per key: waterline (newest row of the incremental track, null without any), floor (oldest row of both), stored, and beyond.

    ``beyond`` counts the backfill's rows that are newer than the waterline, which they don't move. Rows without a time are stored only.
    """
    marked = rows.select(key, F.col(time).alias("at"), backfill.alias("late"))
    line = marked.groupBy(key).agg(F.max(F.when(~F.col("late"), F.col("at"))).alias("waterline"), F.min("at").alias("floor"), F.count("*").alias("stored"))
    newer = F.coalesce(F.col("at") > F.col("waterline"), F.col("waterline").isNull() & F.col("at").isNotNull())
    beyond = marked.filter("late").join(line.select(key, "waterline"), key).groupBy(key).agg(F.count_if(newer).alias("beyond"))
    return line.join(beyond, key, "left").na.fill(0, ["beyond"])


def backfill_status(months: Column, sample: Column, capped: Column, wanted: int = 12, least: int = 100) -> Column:
    """DONE_CAPPED, DONE_12M, NEEDS or ERROR by coverage, sample size and cap."""
    return F.when(months.isNull(), "ERROR").when(capped, "DONE_CAPPED").when((months >= wanted) & (sample >= least), "DONE_12M").otherwise("NEEDS")


def latest_scores(scores: DataFrame, content: str, rule: str, time: str, primary: str, noise: DataFrame) -> DataFrame:
    """The latest score of each content, by the primary rule if that rule is used at all; pool noise where a noise label says so.

    ``noise``: ids of contents labelled as noise. Adds ``pool``.
    """
    has = scores.agg(F.coalesce(F.bool_or(F.col(rule) == primary), F.lit(False)).alias("has_primary"))
    some = scores.join(F.broadcast(has)).filter(~F.col("has_primary") | (F.col(rule) == primary)).drop("has_primary")
    w = Window.partitionBy(content).orderBy(F.desc(time), F.desc(rule))
    first = some.withColumn("_place_in_key", F.row_number().over(w)).filter("_place_in_key = 1").drop("_place_in_key")
    flagged = noise.select(F.col(content).alias("noise_id")).distinct()
    return first.join(flagged, F.col(content) == F.col("noise_id"), "left").withColumn("pool", F.when(F.col("noise_id").isNotNull(), "noise").otherwise("lab")).drop("noise_id")
