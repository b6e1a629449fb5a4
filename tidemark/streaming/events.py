"""Streams of events: windowed counts, waterlines, exactly-once keys, two sinks; and running a stream to its end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import scratch


def read_events(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """Files of the table as a stream, with ``ts`` as an instant."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(stream: DataFrame, key: str, size: str, late: str) -> DataFrame:
    """Rows per ``key`` and window of event time; rows of windows that ended ``late`` before the newest are left out."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), key).agg(F.count("*").alias("n")).select(F.unix_timestamp("w.start").alias("started"), key, "n")


def waterline(stream: DataFrame, key: str, ident: str) -> DataFrame:
    """Per key the newest row's id and time; an older row that comes late never moves it back."""
    newest = F.max(F.struct("ts", ident)).alias("m")
    return stream.groupBy(key).agg(newest).select(key, F.col(f"m.{ident}").alias("last_id"), F.unix_micros("m.ts").alias("last_ts"))


def once(stream: DataFrame, key: str, late: str) -> DataFrame:
    """The first row of each key among those within ``late``; state is dropped behind the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def run_to_end(stream: DataFrame, mode: str, path: str | None = None) -> DataFrame:
    """Takes all there is and ends; the written rows. Files and state are in the shared folder, so an executor may go.

    With the ``path`` of an earlier run the stream goes on from its checkpoint.
    """
    spark = stream.sparkSession
    path = path or scratch(spark, "stream")

    def save(rows: DataFrame, batch: int) -> None:
        # every batch of a complete stream has the whole table
        out = f"{path}/rows" if mode == "complete" else f"{path}/rows/batch={batch}"
        rows.write.mode("overwrite").parquet(out)  # a batch that is run again replaces its own files

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(save).start().awaitTermination()
    return spark.read.parquet(f"{path}/rows").drop("batch")


def run_batches(batches: list[DataFrame], transform: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """Runs a stream over tables that come one after another, stopping and going on from its checkpoint between them."""
    spark = batches[0].sparkSession
    path = scratch(spark, "stream")
    out = None
    for batch in batches:
        batch.write.mode("append").parquet(f"{path}/in")
        out = run_to_end(transform(spark.readStream.schema(batch.schema).parquet(f"{path}/in")), mode, path)
    return out


def _table(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def late_batches(spark: SparkSession, folder: str) -> list[DataFrame]:
    """The events in two halves, one far in the future that closes all windows, then every twentieth event, too late."""
    events = _table(spark, folder)
    late = F.col("event_id") % 20 == 0
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp")
    closing = events.limit(1).withColumns({"ts": F.lit("2030-01-01").cast("timestamp"), "event_id": F.lit(-1).cast("long")})
    return [events.filter(~late & early), events.filter(~late & ~early), closing, events.filter(late)]


def repeated_batches(spark: SparkSession, folder: str) -> list[DataFrame]:
    """Three batches by time, each with the rows of the one before again."""
    events = _table(spark, folder)
    third = lambda a, b: events.filter((F.col("ts") >= F.lit(a).cast("timestamp")) & (F.col("ts") < F.lit(b).cast("timestamp")))
    a, b, c = third("2000-01-01", "2024-01-02"), third("2024-01-02", "2024-01-03"), third("2024-01-03", "2040-01-01")
    return [a, b.unionByName(a), c.unionByName(b)]


def dual_write(stream: DataFrame, key: str, ident: str) -> tuple[DataFrame, DataFrame]:
    """(all rows, the last row of each key) as written, batch by batch, to a cold and a hot table.

    A batch that is run again replaces its own files in both. The hot table has each batch's last rows; its reader takes
    the last of them.
    """
    spark = stream.sparkSession
    path = scratch(spark, "dual")

    def save(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/cold/batch={batch}")
        last = rows.groupBy(key).agg(F.max(F.struct("ts", ident)).alias("m")).select(key, "m.*")
        last.write.mode("overwrite").parquet(f"{path}/hot/batch={batch}")

    stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(save).start().awaitTermination()
    hot = spark.read.parquet(f"{path}/hot").groupBy(key).agg(F.max(F.struct("ts", ident)).alias("m")).select(key, "m.*")
    return spark.read.parquet(f"{path}/cold").drop("batch"), hot
