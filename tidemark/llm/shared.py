"""What the operators of this subpackage have in common: shared folders, checkpoints and raw files.

Every intermediate result that more than one job reads is cut off with ``checkpoint()`` in the folder that the
cluster names in ``spark.checkpoint.dir``, so a lost executor costs a re-read and never the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.bits import hash_bits, may_be_in, once
from tidemark.session import checkpointed, scratch, shared_folder
from tidemark.session import shipped as ship

__all__ = ["checkpointed", "hash_bits", "join_groups", "may_be_in", "once", "parts_for", "read_raw", "remove", "scratch", "shared_folder", "ship", "text_or_empty", "write_raw"]

#: White space of all word rules here, as a character class of both regular expression engines.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def write_raw(rows: DataFrame, column: str, end: str, path: str) -> None:
    """Writes a binary column as raw files, one for each row, ``end`` behind it.

    Spark's text writer copies the bytes as they are, so files go through Spark's commit protocol to whatever store
    holds the path. Names have the partition's number and the row's number in it.
    """
    rows.select(F.col(column).cast("string").alias("value")).write.option("lineSep", end).option("maxRecordsPerFile", 1).text(path)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """The files of ``write_raw`` or any others: ``path``, ``length`` and ``content``, one row per file."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path)


def parts_for(amount: int, per_part: int, few: int = 1000, largest: int = 1 << 30) -> int:
    """Partitions of about ``per_part`` each while these are ``few``, beyond that larger ones, up to ``largest``.

    So 100 TB are 100,000 partitions of 1 GB and not millions, whose shuffle no driver could keep track of.
    """
    parts = -(-amount // per_part)
    return max(1, parts if parts <= few else max(few, -(-amount // largest)))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, most_heavy: int = 500) -> DataFrame:
    """``rows`` with the columns of ``groups``, one row for each key with the number of its rows in ``size``.

    Keys with more than 1 / ``most_heavy`` of all rows, and those with over a million rows and 1 / 20,000 of all, are
    broadcast, ``most_heavy`` + 20,000 at most, so that their rows stay where they are; the others are joined by a shuffle.
    Rows without a group are dropped, as those with a null key.
    ``rows`` is read twice and ``groups`` three times: both should be checkpointed or cheap.
    """
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    groups = groups.withColumn("_heavy", (F.col(size) * most_heavy > total) | (F.col(size) > max(1_000_000, total // 20_000)))
    heavy = F.broadcast(groups.filter("_heavy").drop("_heavy"))
    others = rows.join(heavy.select(key), key, "left_anti").join(groups.filter("not _heavy").drop("_heavy"), key)
    return rows.join(heavy, key).unionByName(others)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))
