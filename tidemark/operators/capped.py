"""Greedy selection in order under several caps, without an ordered fold.

In order, an item is taken if none of its keys has reached its cap by then. Items taken and left before one decide about it, so
rounds converge to the same: an item is taken once all that may still be taken before it can't fill a cap, and left once
those taken before it have filled one. Each round is a running sum for each kind of key; the first open item is always decided.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import checkpointed


def admitted(items: DataFrame, order: list[Column], caps: Mapping[str, int | Column], most: int | None = None) -> DataFrame:
    """``items`` with ``taken``: whether the plain loop over them in ``order`` takes the item.

    ``caps``: for each key column its cap, a number or a column of the items that is the same for all items of a key. An item with
    a null key is under no cap of that kind. ``most`` is a cap of all. ``order`` must tell all items apart. A key's running sum is one
    sorted pass of a task: a key should not hold most of the items.
    """
    ranked = items.withColumns({f"_cap_{k}": F.lit(c) if isinstance(c, int) else c for k, c in caps.items()})
    keys = dict(caps)
    if most is not None:
        ranked, keys = ranked.withColumns({"_all": F.lit(0), "_cap__all": F.lit(most)}), keys | {"_all": most}
    state = checkpointed(ranked.withColumn("taken", F.lit(None).cast("boolean")))
    while True:
        # once filled, a key's later items are left: only open items and those taken need to be summed
        may, is_ = F.coalesce("taken", F.lit(True)).cast("long"), F.coalesce("taken", F.lit(False)).cast("long")
        fits, full = F.lit(True), F.lit(False)
        rows = state
        for k in keys:
            before = Window.partitionBy(k).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
            rows = rows.withColumns({f"_may_{k}": F.coalesce(F.sum(may).over(before), F.lit(0)), f"_is_{k}": F.coalesce(F.sum(is_).over(before), F.lit(0))})
            free = F.col(k).isNull()
            fits = fits & (free | (F.col(f"_may_{k}") < F.col(f"_cap_{k}")))
            full = full | (~free & (F.col(f"_is_{k}") >= F.col(f"_cap_{k}")))
        decided = F.when(F.col("taken").isNotNull(), F.col("taken")).when(full, False).when(fits, True)
        state = checkpointed(rows.withColumn("taken", decided).drop(*(f"_{x}_{k}" for k in keys for x in ("may", "is"))))
        if state.filter("taken IS NULL").isEmpty():
            return state.drop("_all", *(f"_cap_{k}" for k in keys))
