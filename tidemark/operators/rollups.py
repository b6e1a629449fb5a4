"""Smaller operators: writes with authors, labels and terms, term counts, releases, mixes, and functions of tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def best_relation(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """The first of the tables or views that the catalogue has."""
    for name in names:
        if spark.catalog.tableExists(name):
            return spark.table(name)
    raise ValueError(f"none of {', '.join(names)}")


def comments_with_authors(comments: DataFrame, authors: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(comments, authors) after a ``batch`` (id, author, at, body, score): new ids come in, known ones keep what the batch leaves null.

    ``authors`` (author, first_seen, last_seen): times only widen; comments without an author make none. Of repeated ids in a
    batch the last by time counts, of equal times the one with the larger body, then score.
    """
    last = batch.groupBy("id").agg(F.max_by(F.struct(*batch.columns), F.struct("at", "body", "score")).alias("r")).select("r.*")
    old = comments.select("id", *(F.col(c).alias(f"old_{c}") for c in batch.columns if c != "id"), F.lit(True).alias("known"))
    merged = last.join(old, "id", "full").select("id", *(F.coalesce(c, f"old_{c}").alias(c) for c in batch.columns if c != "id"))
    seen = batch.filter("author IS NOT NULL").groupBy("author").agg(F.min("at").alias("first_seen"), F.max("at").alias("last_seen"))
    both = authors.select("author", "first_seen", "last_seen").unionByName(seen).groupBy("author").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    return merged, both


def labels_upserted(stored: DataFrame, batch: DataFrame, keys: Sequence[str], replaced: Sequence[str], kept: Sequence[str]) -> DataFrame:
    """Labels after a batch: its values of ``replaced`` take the old ones' place, null or not; those of ``kept`` stay as first written."""
    new = batch.select(*keys, *(F.col(c).alias(f"_{c}") for c in (*replaced, *kept)), F.lit(True).alias("_new"))
    whole = stored.withColumn("_old", F.lit(True)).join(new, list(keys), "full")
    value = lambda c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    first = lambda c: F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"_{c}")).alias(c)
    return whole.select(*keys, *map(value, replaced), *map(first, kept))


def term_places(rows: DataFrame, terms: Mapping[str, str]) -> DataFrame:
    """``rows`` (id, text): id, term, n and first, its number and the first place (from 0). ``terms`` says exact (case counts) or phrase.

    A term stands between what are no ASCII letters, digits or underscores; white space in it is any.
    """
    import re

    edge = lambda body: r"(?<![A-Za-z0-9_])" + body + r"(?![A-Za-z0-9_])"
    out = []
    for term, kind in terms.items():
        pattern = F.lit(("" if kind == "exact" else "(?i)") + edge(r"\s+".join(map(re.escape, term.split()))))
        n = F.regexp_count("text", pattern)
        before = F.length(F.element_at(F.split("text", F.concat(F.lit(""), pattern), 2), 1))
        out.append(F.when(n > 0, F.struct(F.lit(term).alias("term"), n.cast("long").alias("n"), before.cast("long").alias("first"))))
    return rows.select("id", F.coalesce("text", F.lit("")).alias("text")).select("id", F.explode(F.array_compact(F.array(*out))).alias("t")).select("id", "t.*")


def release_trend(counts: DataFrame, caps: Mapping[str, int]) -> DataFrame:
    """``counts`` (release, at, layer, n): per release in order of time and layer: n, its change since the release before, and whether it is over its cap."""
    order = Window.partitionBy("layer").orderBy("at", "release")
    cap = F.create_map(*(F.lit(x) for pair in caps.items() for x in pair))
    number = F.dense_rank().over(Window.orderBy("at", "release"))  # a row for each layer and release
    return counts.select(number.alias("place"), "release", "layer", "n", (F.col("n") - F.lag("n").over(order)).alias("change"), F.coalesce(F.col("n") > F.try_element_at(cap, F.col("layer")), F.lit(False)).alias("over"))


def brand_pains(mentions: DataFrame, least_mentions: int, least_authors: int, most_evidence: int) -> DataFrame:
    """``mentions`` (brand, pain, id, author, score): per pair mentions, authors, the best ids as evidence, and ok or the first reason against it."""
    sums = mentions.groupBy("brand", "pain").agg(F.countDistinct("id").alias("mentions"), F.countDistinct("author").alias("authors"))
    place = F.row_number().over(Window.partitionBy("brand", "pain").orderBy(F.desc("score"), "id"))
    best = mentions.groupBy("brand", "pain", "id").agg(F.max("score").alias("score")).withColumn("place", place).filter(F.col("place") <= most_evidence)
    ids = best.groupBy("brand", "pain").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"].cast("string")), ",").alias("evidence"))
    status = F.when(F.col("mentions") < least_mentions, "too_few_mentions").when(F.col("authors") < least_authors, "too_few_authors").otherwise("ok")
    return sums.join(ids, ["brand", "pain"]).withColumn("status", status)


def breakdown(items: DataFrame, scope: str, pack: str, focus: str, least: int) -> DataFrame:
    """Suggested groups of ``items`` (id and three names): of the first name and the others as far as enough items share them.

    kind (scope, pack or focus), name, n: a finer group is suggested where it has ``least`` items or more. Null names make no group.
    """
    parts = []
    for kind, columns in (("scope", [scope]), ("pack", [scope, pack]), ("focus", [scope, pack, focus])):
        named = items.filter(" AND ".join(f"{c} IS NOT NULL" for c in columns))
        parts.append(named.groupBy(F.concat_ws("/", *columns).alias("name")).agg(F.countDistinct("id").alias("n")).filter(F.col("n") >= least).select(F.lit(kind).alias("kind"), "name", "n"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def mood_shares(rows: DataFrame, community: str, mood: Column, bar: float = 0.05) -> DataFrame:
    """Per community the shares of moods above ``bar``, below -``bar``, and the rest, which makes the three one."""
    up, down, n = F.count_if(mood > bar), F.count_if(mood < -bar), F.count("*")
    sums = rows.groupBy(community).agg(up.alias("u"), down.alias("d"), n.alias("n"))
    return sums.select(community, "n", F.round(F.col("u") / F.col("n"), 6).alias("positive"), F.round(F.col("d") / F.col("n"), 6).alias("negative"), F.round(1 - F.col("u") / F.col("n") - F.col("d") / F.col("n"), 6).alias("neutral"))


def named_by_patterns(rows: DataFrame, patterns: Sequence[str], top: int) -> DataFrame:
    """``rows`` (id, text): the ``top`` names that the first groups of the patterns find, by rows that name them, case aside; ties by name."""
    found = F.concat(*(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(p), F.lit(1)) for p in patterns))
    names = rows.select("id", F.explode(F.array_distinct(F.transform(found, lambda n: F.lower(F.trim(n))))).alias("name")).filter("name <> ''")
    return names.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(top)


def first_of_kinds(parts: Mapping[str, tuple[DataFrame, str, str, int]]) -> DataFrame:
    """Of tables by kind (rows, key column, relevance column, most): kind, key, relevance and place of each kind's best, ties by key."""
    out = None
    for kind, (rows, key, relevance, most) in parts.items():
        best = rows.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), F.col(relevance).cast("double").alias("relevance")).orderBy(F.desc("relevance"), "key").limit(most)
        out = best if out is None else out.unionByName(best)
    return out.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("relevance"), "key")))


def gap_scores(rows: DataFrame, demand: str, supply: str) -> Column:
    """How far supply lags demand: demand / (demand + supply), 0 where there is neither."""
    both = F.coalesce(F.col(demand), F.lit(0)) + F.coalesce(F.col(supply), F.lit(0))
    return F.when(both > 0, F.coalesce(F.col(demand), F.lit(0)) / both).otherwise(F.lit(0.0))


def scored(rows: DataFrame, scorers: Mapping[str, Callable[[Column], Column]], text: str = "text") -> DataFrame:
    """``rows`` with a column for each scorer, a function from a text's column to a score's: what is scored how is the caller's."""
    return rows.withColumns({name: scorer(F.coalesce(text, F.lit(""))) for name, scorer in scorers.items()})


def health(documents: DataFrame, schema: str, required: Sequence[str], value: str) -> DataFrame:
    """``documents`` (contract, body): per contract n, broken JSON, documents without a required field, and low and high middle of ``value``.

    A middle value is null where no document has one.
    """
    parsed = F.from_json("body", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = documents.select("contract", parsed.alias("d"), F.col("body").isNull().alias("none"))
    bad = F.col("none") | F.col("d").isNull() | F.col("d._bad").isNotNull()
    lacks = ~bad & ~F.forall(F.array(*(F.col(f"d.{c}").isNotNull() for c in required)), lambda x: x)
    return rows.groupBy("contract").agg(F.count("*").alias("n"), F.count_if(bad).alias("broken"), F.count_if(lacks).alias("incomplete"), F.min(F.when(~bad, F.col(f"d.{value}"))).alias("least"), F.max(F.when(~bad, F.col(f"d.{value}"))).alias("most"))
