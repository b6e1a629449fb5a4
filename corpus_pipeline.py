"""The training-data pipeline: quality rules, exact dedup, SimHash near-dedup, mixing to weights, best-fit packing.

Every stage takes all that its predecessor kept, is written as Parquet and read again, and all but the last return
the columns of ``documents``. Other columns of its input are left out. Null texts are empty ones, null ids, sources and
languages stay, repeated rows are rows of their own until exact dedup leaves one of them; an empty table gives an empty
one from every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, mixing, packing, quality, queries, shared, simhash
from tidemark.session import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules or score below the threshold go, so those with a null or empty text do."""
    return quality.quality(docs.select(*COLUMNS), table(spark, sf_dir, "labels")).filter("kept").select("doc.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, the longest, then that with the smallest doc_id (null last); null and empty texts are equal."""
    return _kept(docs, exact_dedup.dedup_exact(docs.select("doc_id", "text")).filter("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays, that with the smallest doc_id (null last)."""
    return _kept(docs, simhash.near_duplicates(docs.select("doc_id", "text")).filter("first"))


def _kept(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``found``, by doc_id and the text's hash; of rows that are the same in both, one."""
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("text_hash"))
    keys = found.select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash"))
    rows = rows.join(keys, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("text_hash") == F.col("kept_hash")), "left_semi")
    same = Window.partitionBy("doc_id", "text_hash").orderBy("source", "lang", "n_chars")
    return rows.withColumn("same", F.row_number().over(same)).filter("same = 1").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document, range-sorted by training position. Documents without words take no room."""
    return mixing.in_training_order(mixing.mix(docs.select(*COLUMNS))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each taken document's pieces with their sequences and offsets; a null text is a piece of one token."""
    return packing.pack_documents(docs, queries.tokenizer_file(queries.WORD_BPE))


def _shipped(stage):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        shared.ship(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("quality rules", keep_quality),
    ("exact dedup", drop_exact_copies),
    ("simhash near-dedup", drop_near_copies),
    ("mixing to weights", mix_sources),
    ("best-fit packing", pack),
]
STAGES = [(name, _shipped(stage)) for name, stage in STAGES]

#: Tokenisation, fingerprints and packing have no SQL; a brute-force version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's files are removed when the next one's are written."""
    docs, last = table(spark, sf_dir, "documents"), ""
    for k, (_, stage) in enumerate(STAGES):
        path = shared.scratch(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if k:
            shared.remove(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
