"""Views kept up by recomputing what changes touch: versions lie in partitions by key, and so does the view.

A batch of versions goes into the partitions of its keys; these alone are aggregated anew and replaced, so a version that
takes another's place takes back what that one had added. Partitions without changes keep their files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import checkpointed


class RefreshedView:
    """``rows`` have ``ident``, ``version`` and ``key``; of an ident the largest version is current, and none if that is ``deleted``.

    ``compute`` turns current rows into the view's, and must keep ``key``. An ident may move to another key: both are touched.
    ``partitions`` bounds the partitions; a refresh reads those that it touches. Batches may repeat rows. Null keys are a key.
    """

    def __init__(self, spark: SparkSession, path: str, ident: str, version: str, key: str, compute: Callable[[DataFrame], DataFrame], partitions: int = 64) -> None:
        self.spark, self.path, self.ident, self.version, self.key, self.compute, self.partitions = spark, path, ident, version, key, compute, partitions

    def _part(self, column: str):
        return F.pmod(F.xxhash64(column), F.lit(self.partitions)).cast("int")

    def _stored(self, name: str) -> DataFrame | None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)
        return self.spark.read.parquet(f"{self.path}/{name}") if there else None

    def _replace(self, rows: DataFrame, name: str) -> None:
        # a partition that becomes empty is written with no row of it, so one row of nulls stands for it
        checkpointed(rows).repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{self.path}/{name}")

    def refresh(self, changes: DataFrame) -> list[int]:
        """Takes a batch of versions in; gives the numbers of the view's partitions that were written anew."""
        new = checkpointed(changes.select(*changes.columns, self._part(self.ident).alias("part")))
        touched = [r.part for r in new.select("part").distinct().collect()]  # at most ``partitions`` numbers
        old = self._stored("versions")
        before = new.limit(0) if old is None else old.filter(F.col("part").isin(touched)).select(*new.columns)
        latest = lambda rows: rows.groupBy(self.ident).agg(F.max_by(F.struct(*(c for c in new.columns)), F.struct(self.version, F.to_json(F.struct(*new.columns)))).alias("r")).select("r.*")
        was, now = checkpointed(latest(before)), checkpointed(latest(before.unionByName(new)))
        moved = now.select(F.col(self.key).alias("k"), F.xxhash64(*now.columns).alias("h"), F.col(self.ident).alias("i"))
        had = was.select(F.col(self.key).alias("k"), F.xxhash64(*now.columns).alias("h"), F.col(self.ident).alias("i"))
        keys = moved.exceptAll(had).unionByName(had.exceptAll(moved)).select("k").distinct()
        view_parts = sorted(r.part for r in keys.select(self._part("k").alias("part")).distinct().collect())
        self._replace(now, "versions")
        if view_parts:
            current = self._stored("versions").filter("NOT deleted").drop("part").withColumn("part", self._part(self.key)).filter(F.col("part").isin(view_parts))
            view = self.compute(current.drop("part")).withColumn("part", self._part(self.key)).withColumn("is_row", F.lit(True))
            empty = self.spark.createDataFrame([(p,) for p in view_parts], "part int").withColumn("is_row", F.lit(False))
            self._replace(view.unionByName(empty, allowMissingColumns=True), "view")
        return view_parts

    def read(self) -> DataFrame:
        return self._stored("view").filter("is_row").drop("is_row", "part")
