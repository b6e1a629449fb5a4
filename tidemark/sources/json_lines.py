"""Files of JSON lines as backfill: every line becomes a row, a bad one with the reason; the same for a batch and a stream.

Spark's text reader cuts files into byte ranges, and a stream of files keeps its own offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What of a line is read.
POST = "id string, title string, selftext string, body string, score long, num_comments long, created_utc string, author string, url string, permalink string"


def read_lines(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """``value`` and ``file`` of each line of the files at ``path``."""
    reader = spark.readStream if stream else spark.read
    return reader.text(path).select("value", F.col("_metadata.file_path").alias("file"))


def backfill_rows(lines: DataFrame, since: float, until: float) -> DataFrame:
    """``lines`` (value, file): file, reason, and the post's fields with ``created`` in seconds and ``body``.

    ``reason`` is null for a post in [since, until), else blank, broken, no_time, bad_time or outside. The text is selftext, or
    body where that is null or empty.
    """
    text = F.trim("value")
    parsed = F.from_json(text, POST + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = lines.select("file", text.alias("line"), parsed.alias("p"))
    created = F.expr("try_cast(p.created_utc AS double)")
    created = F.when(~F.isnan(created) & (F.abs(created) < 1e12), created)
    broken = F.col("p").isNull() | F.col("p._corrupt").isNotNull() | ~F.col("line").startswith("{")
    reason = (
        F.when(F.col("line") == "", "blank").when(broken, "broken").when(F.col("p.created_utc").isNull(), "no_time")
        .when(created.isNull(), "bad_time").when((created < since) | (created >= until), "outside")
    )
    return rows.select("file", reason.alias("reason"), "p.id", "p.title", F.coalesce(F.nullif("p.selftext", F.lit("")), "p.body").alias("body"), "p.score", "p.num_comments", created.alias("created"), "p.author", "p.url", "p.permalink")


def watermarks(rows: DataFrame) -> DataFrame:
    """Of posts without a reason, one row: n, floor (oldest time), last_time and last_id, the newest post with an id, of equal ones the smallest id."""
    fine = rows.filter("reason IS NULL")
    named = F.when(F.coalesce("id", F.lit("")) != "", F.struct((-F.col("created")).alias("before"), F.col("id").alias("id")))
    return fine.agg(F.count("*").alias("n"), F.min("created").alias("floor"), F.min(named).alias("m")).select("n", "floor", (-F.col("m.before")).alias("last_time"), F.col("m.id").alias("last_id"))
