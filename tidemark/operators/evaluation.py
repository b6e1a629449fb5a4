"""Samples, quotas, gates and alerts. Decisions are rules over a few aggregated numbers; what is aggregated is not limited.

Ties go by hash or key, so reruns agree. Empty tables give empty results or zero counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket_targets(limit: int, available: Mapping[str, int], weights: Mapping[str, float]) -> dict[str, int]:
    """How many samples of each bucket: its share of ``limit``, what is left to the heaviest with room, never more than there are."""
    order = sorted(weights, key=lambda b: -weights[b])
    target = {b: min(int(limit * weights[b]), available.get(b, 0)) for b in order}
    rest = limit - sum(target.values())
    for b in [*order, *(b for b in available if b not in weights)]:
        more = min(rest, available.get(b, 0) - target.get(b, 0))
        if more > 0:
            target[b] = target.get(b, 0) + more
            rest -= more
    return target


def stratified_sample(rows: DataFrame, key: str, bucket: Column, community: str, limit: int, weights: Mapping[str, float]) -> DataFrame:
    """``limit`` rows over score buckets by weight: each community's first rows before any community's second, by hash of ``key``.

    Adds ``bucket`` and ``place``. Only the counts of the buckets, a few numbers, come to the driver.
    """
    order = (F.md5(F.col(key).cast("string")), F.asc(key))
    marked = rows.withColumn("bucket", bucket).withColumn("turn", F.row_number().over(Window.partitionBy("bucket", community).orderBy(*order)))
    counts = {r["bucket"]: r["count"] for r in marked.groupBy("bucket").count().collect()}
    targets = bucket_targets(limit, counts, weights)
    most = F.lit(0)
    for name, n in targets.items():
        most = F.when(F.col("bucket") == name, n).otherwise(most)
    # a row of a late turn can't be among the first, so large communities aren't ranked whole
    early = marked.filter(F.col("turn") <= max([1, *targets.values()]))
    placed = early.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy("turn", *order)).cast("long"))
    return placed.filter(F.col("place") <= most).drop("turn")


def capped_quotas(counts: DataFrame, key: str, n: str, weight: str, total: int, base: int) -> DataFrame:
    """``total`` in shares of ``weight`` with a base quota for everyone and never more than ``n``; one row per key.

    What fractions leave goes to the largest of them with room, then to keys in order; nothing in, nothing out.
    """
    everyone = Window.partitionBy(F.lit(1))
    b = counts.withColumn("base_quota", F.least(F.col(n), F.lit(base)))
    b = b.withColumn("wanted", F.greatest(F.lit(0), F.least(F.lit(total), F.sum(n).over(everyone)) - F.sum("base_quota").over(everyone)))
    room = F.col(n) - F.col("base_quota")
    w = F.when(room > 0, F.greatest(F.coalesce(F.col(weight), F.lit(0)), F.lit(1))).otherwise(0)
    b = b.withColumn("w", w).withColumn("share", F.coalesce(F.try_divide(F.col("wanted") * F.col("w"), F.sum("w").over(everyone)), F.lit(0.0)))
    b = b.withColumn("extra", F.least(room, F.floor("share"))).withColumn("left", F.col("wanted") - F.sum("extra").over(everyone))
    open_ = (room > F.col("extra")).cast("int")
    by_rest = Window.partitionBy(open_).orderBy(F.desc(F.round(F.col("share") - F.floor("share"), 9)), key)
    b = b.withColumn("extra", F.col("extra") + F.when((open_ == 1) & (F.row_number().over(by_rest) <= F.col("left")), 1).otherwise(0))
    # the rest, if one more for each wasn't enough: to keys in order, as much as they have room for
    b = b.withColumn("left", F.col("wanted") - F.sum("extra").over(everyone)).withColumn("free", F.col(n) - F.col("base_quota") - F.col("extra"))
    ahead = F.coalesce(F.sum("free").over(everyone.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.greatest(F.lit(0), F.least(F.col("free"), F.col("left") - ahead))
    # a target below the base quotas trims them, to keys in order
    given = F.coalesce(F.sum("base_quota").over(everyone.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    trimmed = F.greatest(F.lit(0), F.least(F.col("base_quota"), F.lit(total) - given))
    quota = F.when(F.col("wanted") > 0, F.col("base_quota") + F.col("extra") + last).otherwise(trimmed)
    return b.select(*counts.columns, quota.cast("long").alias("quota"))


def batch_plan(total: int, first: int, size: int) -> list[int]:
    """Sizes of batches: the first, then others of ``size``, the last what is left."""
    out, rest, step = [], max(0, total), first
    while rest > 0 and step > 0:
        out.append(min(rest, step))
        rest, step = rest - out[-1], size
    return out


def shallow_limits(total: int, top: int = 30, new: int = 20, reply_top: int = 15, per_top: int = 1) -> tuple[int, int, int]:
    """(top, new, reply_top) shrunk in proportion so that all of them with their replies are at most ``total``; 0 is no limit."""
    top, new, per_top = max(1, top), max(0, new), max(0, per_top)
    if total <= 0:
        return top, new, max(0, reply_top)
    reply_top = max(0, min(reply_top, top))
    if total >= top + new + reply_top * per_top:
        return top, new, reply_top
    new_share, reply_share = new / top, reply_top / top
    t = max(1, int(total / (1 + new_share + reply_share * per_top)))
    n, r = round(t * new_share), min(t, round(t * reply_share))
    while t > 1 and t + n + r * per_top > total:
        t -= 1
        r = min(r, t)
    n = max(0, min(n, total - t - r * per_top))
    while r > 0 and t + n + r * per_top > total:
        r -= 1
    return t, n, r


def shallow_comments(rows: DataFrame, top: int, new: int, reply_top: int, per_top: int) -> DataFrame:
    """``rows`` (post, id, parent, depth, score, created): of each post its best top comments, their best replies, and its newest.

    ``origin`` says which, the first that holds. Each ranking keeps so few of a post that no post is held in one task.
    """
    level = rows.filter("depth = 0")
    rank = lambda frame, by, name, *order: frame.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    best = rank(level, ["post"], "k", F.desc("score"), F.desc("created"), "id").filter(F.col("k") <= top)
    newest = rank(level, ["post"], "k", F.desc("created"), "id").filter(F.col("k") <= new)
    parents = best.filter(F.col("k") <= reply_top).select("post", F.col("id").alias("parent"))
    replies = rank(rows.filter("depth > 0").join(parents, ["post", "parent"], "left_semi"), ["post", "parent"], "k", F.desc("score"), F.desc("created"), "id").filter(F.col("k") <= per_top)
    each = [f.select("post", "id", F.lit(p).alias("p"), F.lit(o).alias("origin")) for f, p, o in ((best, 0, "top"), (replies, 1, "reply"), (newest, 2, "new"))]
    both = each[0].unionByName(each[1]).unionByName(each[2])
    return both.groupBy("post", "id").agg(F.min_by("origin", "p").alias("origin"))


def red_lines(metrics: DataFrame, rules: Sequence[tuple[str, str, float]]) -> DataFrame:
    """A row for each broken rule of each row of ``metrics`` (day and columns): rules are (column, below or above, limit)."""
    row = lambda c, side, limit: F.when((F.col(c) < limit) if side == "below" else (F.col(c) > limit), F.struct(F.lit(c).alias("metric"), F.lit(side).alias("side"), F.col(c).cast("double").alias("value"), F.lit(float(limit)).alias("limit")))
    alerts = F.explode(F.array_compact(F.array(*(row(*r) for r in rules)))).alias("a")
    return metrics.select("day", alerts).select("day", "a.*")


def quality_gate(facts: Mapping[str, Column], flags: Sequence[tuple[str, str, float]]) -> tuple[Column, Column]:
    """(flags, tier): a flag for each fact below its least value; tier A without flags, B with one, C with more, X with the first."""
    found = F.array_compact(F.array(*(F.when(facts[fact] < least, F.lit(name)) for name, fact, least in flags)))
    tier = F.when(F.array_contains(found, flags[0][0]), "X").when(F.size(found) == 0, "A").when(F.size(found) == 1, "B").otherwise("C")
    return found, tier
