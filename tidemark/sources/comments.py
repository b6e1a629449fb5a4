"""Trees of comments as JSON of any depth, read into rows.

A listing is ``{"data": {"children": [...]}}`` or a list of children. A child of kind ``t1`` is a comment, its ``replies``
a listing of its own; one of kind ``more`` names comments that weren't sent; other kinds are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = {
    "id": "string", "body": "string", "author": "string", "author_id": "string", "created_utc": "double", "score": "long", "parent_id": "string", "is_submitter": "boolean",
    "distinguished": "string", "edited": "boolean", "permalink": "string", "removed_by_category": "string", "awards_count": "long",
}
SCHEMA = "listing long, place long, depth int, path string, " + ", ".join(f"{k} {t}" for k, t in FIELDS.items()) + ", missing array<string>, error string"
_ARROW = {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "boolean": pa.bool_()}


def _typed(value: object, kind: str) -> object:
    if value is None:
        return None
    if kind == "string":
        return value if isinstance(value, str) else json.dumps(value)
    if kind == "boolean":
        return value if isinstance(value, bool) else None
    try:
        return float(value) if kind == "double" else int(value)  # type: ignore[arg-type]
    except (TypeError, ValueError, OverflowError):
        return None


def _comment(data: dict) -> dict:
    found = {k: data.get({"author_id": "author_fullname", "awards_count": "total_awards_received"}.get(k, k)) for k in FIELDS}
    found |= {"edited": data.get("edited") not in (False, None, 0), "awards_count": found["awards_count"] or 0}
    return {k: _typed(v, FIELDS[k]) for k, v in found.items()}


def _children(listing: object) -> list:
    if isinstance(listing, dict):
        inner = listing.get("data")
        listing = inner.get("children") if isinstance(inner, dict) else None
    return listing if isinstance(listing, list) else []


def walk(listing: object, most: int | None) -> Iterator[dict]:
    """Comments in order, each before its replies, ``most`` at most; those that weren't sent come as rows of ids."""
    stack, place = [(iter(_children(listing)), 0, "")], 0
    while stack:
        nodes, depth, path = stack[-1]
        node = next(nodes, None)
        if node is None:
            stack.pop()
            continue
        data = node.get("data") if isinstance(node, dict) else None
        if not isinstance(data, dict):
            continue
        if node.get("kind") == "more" and isinstance(data.get("children"), list) and data["children"]:
            yield {"depth": depth, "path": path, "missing": list(map(str, data["children"])), "parent_id": _typed(data.get("parent_id"), "string")}
        if node.get("kind") != "t1":
            continue
        if most is not None and place >= most:
            return
        found = _comment(data)
        here = f"{path}/{found['id'] or ''}"
        yield found | {"depth": depth, "path": here, "place": place}
        place += 1
        stack.append((iter(_children(data.get("replies"))), depth + 1, here))


def _rows(most: int | None, of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for listing, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    out += [row | {"listing": listing} for row in of(json.loads(text))] if text is not None else []
                except (ValueError, RecursionError) as broken:
                    out.append({"listing": listing, "error": type(broken).__name__})
                if len(out) > 5000:
                    yield flush(out)
                    out = []
            if out:
                yield flush(out)

    def flush(out: list[dict]) -> pa.RecordBatch:
        kinds = {"listing": pa.int64(), "place": pa.int64(), "depth": pa.int32(), "path": pa.string()} | {k: _ARROW[t] for k, t in FIELDS.items()} | {"missing": pa.list_(pa.string()), "error": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in out], t) for k, t in kinds.items()], list(kinds))

    return run


def comment_rows(listings: DataFrame, most: int | None = None) -> DataFrame:
    """``listings`` (listing long, json): a row for each comment, as SCHEMA has it.

    ``place`` is the comment's number in its listing, each before its replies, ``depth`` 0 for the first level, ``path`` the ids down
    to it. With ``most`` only so many comments of a listing are read. A row with ``missing`` has ids of comments that weren't
    sent. A broken JSON text gives one row with ``error``; a null one, or one of another layout, none.
    """
    rows = listings.select(F.col("listing").cast("long"), "json")
    return rows.mapInArrow(_rows(most, lambda x: walk(x, most)), SCHEMA)


def more_children(payloads: DataFrame) -> DataFrame:
    """``payloads`` (listing, json) of later calls, ``{"json": {"data": {"things": [...]}}}``: their comments, all of depth 0, as ``comment_rows``."""

    def things(payload: object) -> Iterator[dict]:
        inner = payload.get("json") if isinstance(payload, dict) else None
        inner = inner.get("data") if isinstance(inner, dict) else None
        flat = inner.get("things") if isinstance(inner, dict) else None
        for thing in flat if isinstance(flat, list) else []:
            data = thing.get("data") if isinstance(thing, dict) else None
            yield from walk([{"kind": thing.get("kind"), "data": {k: v for k, v in data.items() if k != "replies"}}] if isinstance(data, dict) else [], None)

    rows = payloads.select(F.col("listing").cast("long"), "json")
    return rows.mapInArrow(_rows(None, things), SCHEMA)


def nested(comments: DataFrame, listing: str, order: str) -> DataFrame:
    """``comments`` (listing, order, id, body, author, score): per listing one JSON text in which each comment answers the one before.

    One listing is one row, so its comments together must fit one.
    """
    own = F.to_json(F.struct(F.lit(True).alias("sent"), "id", "body", "author", "score"))
    turns = comments.groupBy(listing).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), own.alias("data")))).alias("turns"))
    wrap = lambda inner, x: F.concat(F.lit('{"kind":"t1","data":'), F.left(x["data"], F.length(x["data"]) - 1), F.lit(',"replies":{"data":{"children":['), inner, F.lit("]}}}}"))
    whole = F.aggregate(F.reverse("turns"), F.lit(""), wrap, lambda s: F.concat(F.lit('{"data":{"children":['), s, F.lit("]}}")))
    return turns.select(F.col(listing).alias("listing"), whole.alias("json"))
